import examples
import examples_corpus
import pytest
from pyspark.cloudpickle import register_pickle_by_value

from emendata.plans import catalog

for module in (examples, examples_corpus):  # workers can't import the tests
    register_pickle_by_value(module)


@pytest.mark.parametrize("name", sorted(examples.every()))
def test_expected_rows(spark, name):
    example = examples.every()[name]
    got = example.query(spark, "")
    order = [c.split()[0] for c in example.columns.split(", ")]
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, example.expected))


def test_names_and_oracles():
    every, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(every) and len(every) - len(sql) <= 8
