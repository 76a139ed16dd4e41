import pytest
from pyspark.sql import functions as F

from emendata.streaming import drafts


@pytest.fixture
def stream(spark, tmp_path):
    """Events in files that arrive one after another; the last one pushes the watermark on."""
    base = "timestamp'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, "
    parts = [[(1, 1, 0), (2, 1, 5), (3, 1, 30), (3, 1, 30), (4, 2, 1)], [(2, 1, 5), (5, 2, 2)], [(9, 9, 600)], [(10, 9, 601)]]
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "event_id long, user_id long, minute int").selectExpr("event_id", "user_id", f"{base}minute) ts")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, mode, name, at):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_ledger_admits_each_job_once(spark, stream, tmp_path):
    rows = run(spark, drafts.ledger(stream, late="30 days"), "append", "ledger", str(tmp_path / "ck"))
    assert sorted(r["event_id"] for r in rows) == [1, 2, 3, 4, 5, 9, 10]


def test_bursts_close_when_quiet(spark, stream, tmp_path):
    rows = run(spark, drafts.debounced(stream, late="30 minutes").withColumn("minute", (F.unix_timestamp("last") - F.unix_timestamp(F.lit("2025-01-01 00:00:00"))) / 60), "append", "bursts", str(tmp_path / "ck"))
    assert {(r["user_id"], r["minute"]) for r in rows} >= {(1, 5), (1, 30), (2, 2)}
