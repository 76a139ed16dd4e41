"""All queries of the engine's own operators, by operator."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emendata.operators import custom
from emendata.plans import tables
from emendata.plans.dialect import Duck, Spark
from emendata.plans.statements import S, pairs, sentences
from emendata.session import shipped

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Names of the views that statements read; the user's own views of the tables' names stay.
_VIEW = "emendata_view_{}"
_READ = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in as many partitions as there are cores, where a small file has fewer splits than that; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = S[name](Spark())
        for table in {m[2] for m in _READ.finditer(sql)}:
            df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            (spread(df, "doc_id") if table == "documents" else df).createOrReplaceTempView(_VIEW.format(table))
        return spark.sql(_READ.sub(lambda m: f"{m[1]} {_VIEW.format(m[2])}", sql))

    return run


def _rows(make: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").createOrReplaceTempView(_VIEW.format("documents"))
        return spark.sql(_READ.sub(lambda m: f"{m[1]} {_VIEW.format(m[2])}", make(Spark())))

    return run


#: Sentences of all documents (doc_id, pos, item), and the pairs made of them.
sentence_rows, derived_pairs = _rows(sentences), _rows(pairs)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement("flagship_sentence_corpus")(shipped(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: statement(name) for name in S} | custom.queries() | tables.queries()


def oracle_sql() -> dict[str, str]:
    return {name: make(Duck()) for name, make in S.items()} | custom.oracle_sql() | tables.oracle_sql()
