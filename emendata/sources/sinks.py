"""What is written: splits, manifests, immutable shards, hash-chained logs, exports by status."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder for each split; a path that is there already is refused."""
    rows.write.mode("errorifexists").partitionBy("split").json(path)


def digest(rows: DataFrame, columns: list[str] | None = None):
    """A hash of the rows in any order: the sum of their hashes; one row of count and digest."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(columns or rows.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))


def manifest(rows: DataFrame, by: str = "split") -> DataFrame:
    """B2: rows, groups and content digest of each split."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("\n", "source", "target"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("clean_group").alias("groups"), F.sum(row).cast("string").alias("digest"))


def write_immutable(rows: DataFrame, path: str) -> str:
    """Writes a shard, or checks that the one which is there has the same rows; its digest."""
    spark, mine = rows.sparkSession, digest(rows).first()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if at.getFileSystem(conf).exists(at):
        if tuple(digest(spark.read.schema(rows.schema).parquet(path)).first()) != tuple(mine):
            raise ValueError("the shard is there with other rows")
    else:
        rows.write.mode("errorifexists").parquet(path)
    return mine["digest"]


def append_log(spark: SparkSession, path: str, bodies: list[str], last: tuple[int, str] | None = None) -> tuple[int, str]:
    """Appends entries to a hash-chained log; last is the ordinal and hash of the entry before. A log's batch is what one driver step adds."""
    ordinal, before = last or (-1, "0" * 64)
    rows = []
    for body in bodies:
        own = sha256(f"{before}\n{body}".encode()).hexdigest()
        ordinal += 1
        rows.append((ordinal, before, body, own))
        before = own
    spark.createDataFrame(rows, "ordinal long, previous_sha256 string, body string, entry_sha256 string").write.mode("append").parquet(path)
    return ordinal, before


def exports(ledger: DataFrame) -> DataFrame:
    """The export of each row of a ledger by its status."""
    to = F.when(F.col("status") == "screened", "train").when(F.col("status").isin("quarantined", "duplicate", "unsupported"), "quarantine").otherwise("pending")
    return ledger.withColumn("export", to)
