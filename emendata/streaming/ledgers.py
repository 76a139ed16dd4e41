"""Ledgers that a stream may be replayed into: each job once, attempts counted, interrupted ones marked, log chained.

A micro-batch is delivered again after a failure, with the same id and rows. `upserted` writes a batch's own rows under
its id, over what an interrupted delivery left there, so that a replay changes nothing; the ledger's current state is a
view over the batches, and `compacted` folds closed ones into one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(path: str, key: str = "job") -> Callable[[DataFrame, int], None]:
    """K7: for foreachBatch: a batch's rows (job, status, ...), the last one of each job by `seq`, as the batch's own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "seq").alias("r"), F.min("seq").alias("first_seq"), F.count("*").alias("attempts"))
        last.select("r.*", "first_seq", "attempts").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def state(spark: SparkSession, path: str, key: str = "job") -> DataFrame:
    """The ledger as it is: each job's latest row, its first one's seq (insert or ignore) and the attempts of all batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    seen = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("batch", "first_seq", "attempts")]), F.struct("seq", "batch")).alias("r"), F.min("first_seq").alias("first_seq"), F.sum("attempts").alias("attempts"))
    return seen.select("r.*", "first_seq", "attempts")


def unfinished(jobs: DataFrame, ledger: DataFrame, key: str = "job") -> DataFrame:
    """Jobs to run on resuming: all that the ledger doesn't have as done."""
    return jobs.join(ledger.where("status = 'done'").select(key), key, "left_anti")


def interrupted(ledger: DataFrame) -> DataFrame:
    """Rows that a stopped run left running, marked."""
    return ledger.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


ZERO = "0" * 64


def chained(entries: DataFrame, group: str = "log", order: str = "seq", body: str = "body") -> DataFrame:
    """Group, order and body with previous_sha256 and entry_sha256, chained within each log in its order: sha256(previous, line feed, body).

    A chain is sequential by nature, so that a log is one task's, streamed in its order; logs are spread over tasks.
    """
    rows = entries.select(group, order, body)
    schema = rows.schema.add("previous_sha256", "string").add("entry_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, started = None, ZERO, False
        for batch in batches:
            before, own = [], []
            for log, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not started or log != now:
                    now, last, started = log, ZERO, True
                before.append(last)
                last = sha256(f"{last}\n{text or ''}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=schema.names)

    return rows.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, schema)


def broken(log: DataFrame, group: str = "log", order: str = "seq", body: str = "body") -> DataFrame:
    """Entries whose own hash is not that of their body, or whose previous hash is not the one before."""
    before = F.coalesce(F.lag("entry_sha256").over(Window.partitionBy(group).orderBy(order)), F.lit(ZERO))
    own = F.sha2(F.concat("previous_sha256", F.lit("\n"), body), 256)
    fault = F.when(F.col("previous_sha256") != before, "chain").when(F.col("entry_sha256") != own, "hash")
    return log.withColumn("fault", fault).where("fault is not null")
