"""Training-data pipeline over documents: five stages, each written as Parquet and read again.

Defined cases, in every stage: an empty table stays empty; extra columns, whatever their names, pass through all stages
but the last (a stage sees them under names of its own); texts of any length are handled whole; a null
text has no language and goes in the first stage (given to the second or third stage alone, it stays); null ids are
one id and null sources one source; of rows that repeat id and text one stays in the third stage, all in the others.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emendata.llm import jaccard_join, language_id, lines, mixing, packing
from emendata.llm.common import discard, ready, table, temporaries, written


#: The columns of documents; any others only pass through.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def passing(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage with other columns under neutral names, so that none clashes with one of its own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        neutral = docs.select(*(F.col(f"`{c}`").alias(c if c in COLUMNS else f"passed_{others.index(c)}") for c in docs.columns))
        return stage(spark, neutral, sf_dir).withColumnsRenamed({f"passed_{k}": c for k, c in enumerate(others)}).select(*(f"`{c}`" for c in docs.columns))

    return run


@passing
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; others (no letters, or far from every profile) go."""
    ready(spark)
    return language_id.accepted(docs)


@passing
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring line templates leave all but their first document. What a document has of its own stays, however little; one of which nothing is left goes."""
    kept = lines.dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(" \t\n\v\f\r")) != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


@passing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (word 5-grams, likeness 0.8 or more) stays."""
    ready(spark)
    return jaccard_join.one_of_each(docs)


@passing
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at target weights: each document as often as its Poisson count, in a global shuffle."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens, filled with lexical neighbours."""
    ready(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("packing", pack),
]

#: SQL can't express the language profiles, the join's brute force on whole tables in useful time, nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's own tables go when its result is written, that result when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        mine: list[str] = []
        with temporaries(spark):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=mine)
        discard(spark, before)
        before = mine
    return STAGES[-1][1](spark, docs, sf_dir)
