"""Scorers as table functions by name (L1, L2): `SELECT * FROM edits(TABLE(pairs) PARTITION BY lang)`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import ArrayType, LongType, StringType, StructType


class Edits:
    """The token edits (start, stop, words) of each row's source and target arrays; its other columns stay before them."""

    def __init__(self) -> None:
        self.names: list[str] | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("edits takes a table")
        schema = StructType()
        for f in rows.dataType:
            if f.name not in ("source", "target"):
                schema = schema.add(f)
        return AnalyzeResult(schema.add("start", LongType()).add("stop", LongType()).add("words", ArrayType(StringType())))

    def eval(self, row: Row) -> Iterator[tuple]:
        from emendata.operators.custom import edits

        kept = [v for k, v in row.asDict().items() if k not in ("source", "target")]
        for start, stop, words in edits(list(row["source"]), list(row["target"])):
            yield (*kept, start, stop, words)


#: Registered by name; a user's own go in with `register`.
SCORERS: dict[str, type] = {"edits": Edits}


def registered(spark: SparkSession) -> SparkSession:
    from pyspark.sql import functions as F

    for name, scorer in SCORERS.items():
        spark.udtf.register(name, F.udtf(scorer))
    return spark
