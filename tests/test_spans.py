import random

import pytest
from pyspark.sql import functions as F

from emendata.operators import spans

CASES = [
    ("Teh RECIEVED constructor-teh teh", [("spelling", 0, 3, "The")] + [("spelling", 29, 32, "the")]),
    ("She have it. we is", [("pronoun", 4, 8, "has"), ("pronoun", 16, 18, "are")]),
    ("I insist that he have it", []),
    ("😀. It are fine fine.  He Are", [("pronoun", 6, 9, "is"), ("repeated", 14, 19, ""), ("pronoun", 25, 28, "Is")]),
    ("a a a b b that that", [("repeated", 1, 3, ""), ("repeated", 7, 9, "")]),
    ("My friend go home every day. The child Play here", [("habit", 10, 12, "goes")]),
    ("see `teh` https://x.test/teh teh@x.test and ./teh/x #teh then teh", [("spelling", 62, 65, "the")]),
    ("open `code teh to the end", []),
    ("freind freind", [("spelling", 0, 6, "friend"), ("spelling", 7, 13, "friend")]),
    ("", []),
    (None, []),
]
#: In the second case of the first row RECIEVED becomes RECEIVED.
CASES[0][1].insert(1, ("spelling", 4, 12, "RECEIVED"))


def test_rules(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {i: [] for i in range(len(CASES))}
    for r in spans.analysed(docs).orderBy("key", "start").collect():
        got[r["key"]].append((r["rule"], r["start"], r["stop"], r["replacement"]))
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    fixed = {r["doc_id"]: r["corrected"] for r in spans.applied(docs, spans.analysed(docs)).collect()}
    assert fixed[0] == "The RECEIVED constructor-teh the" and fixed[4] == "a a b that that" and fixed[3] == "😀. It is fine.  He Is" and 2 not in fixed


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_join_and_selection_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(spans, "BIN", 16)
    rng = random.Random(seed)
    make = lambda n, most: [(rng.randint(0, 3), a, a + rng.randint(1, most)) for a in (rng.randint(0, 300) for _ in range(n))]
    rows, others = sorted({(k, rng.randint(1, 4), a, b) for k, a, b in make(150, 12)}), make(25, 40)
    over = lambda a, b, c, d: a < d and c < b
    mine = spark.createDataFrame(rows, "key long, rank int, start long, stop long")
    free = [r for r in rows if not any(r[0] == k and over(r[2], r[3], a, b) for k, a, b in others)]
    left = spans.apart(mine, spark.createDataFrame(others, "key long, start long, stop long"))
    assert sorted((r["key"], r["rank"], r["start"], r["stop"]) for r in left.collect()) == free
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        if not any(r[0] == q[0] and over(r[2], r[3], q[2], q[3]) for q in kept):
            kept.append(r)
    assert sorted(map(tuple, spans.selected(mine, "rank", "start").select("key", "rank", "start", "stop").collect())) == sorted(kept)


def test_no_python_and_no_texts_in_shuffles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = spans.analysed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert spans.analysed(docs.where(F.lit(False))).count() == 0
