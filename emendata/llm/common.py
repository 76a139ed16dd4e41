"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emendata.session import shipped

#: Rows and characters of one block of texts that a Python operator handles at a time.
BLOCK_ROWS, BLOCK_CHARS = 512, 2_000_000
ARROW_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """spark with this package on its workers and Arrow batches of BLOCK_ROWS and ARROW_BYTES at most (a lower limit of its own stays).

    A batch is held several times, as the JVM's buffers and each worker's; the operators take blocks anyway.
    """
    for name, most in (("maxRecordsPerBatch", BLOCK_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        full = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(full).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(full, str(most))
    return shipped(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where none is set and all runs in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at or "file:/tmp/checkpoints/emendata"


#: Tables of each open `temporaries` block; those written outside of one stay until the driver ends.
_open: list[list[str]] = []


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` makes inside go when the block ends, so that the stages of a pipeline don't add up on disk."""
    mine: list[str] = []
    _open.append(mine)
    try:
        yield
    finally:
        _open.remove(mine)
        discard(spark, mine)


def discard(spark: SparkSession, tables: list[str]) -> None:
    for at in tables:
        path, store = _path(spark, at)
        store.delete(path, True)


def written(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage.

    The table goes when its `temporaries` block ends, or with the driver; with `keep`, which then gets its path, the block leaves it.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/emendata/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if keep is not None:
        keep.append(at)
    elif _open:
        _open[-1].append(at)
    df.write.option("compression", "zstd").parquet(at)
    path, store = _path(spark, at)
    store.deleteOnExit(path)
    return spark.read.schema(schema).parquet(at)


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder (small tables of iterative algorithms)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into blocks of bounded rows and characters (one text alone may be longer)."""
    for batch in batches:
        n, start, size = batch.num_rows, 0, 0
        lengths = pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
        for i in range(n):
            size += 0 if lengths[i] != lengths[i] else int(lengths[i])
            if size >= BLOCK_CHARS or i + 1 - start >= BLOCK_ROWS:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < n:
            yield batch.slice(start, n - start)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and then the memory that it has freed goes back to the machine, as an idle worker would keep it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # glibc has it
            trim(0)

    return go


def id_remainder(column: str = "doc_id", divisor: int = 3):
    """crc32 of the id as text, modulo the divisor (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def arrow_schema(df: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
