"""Queue and ledger: brute force over random traffic, restarts in between, deliveries repeated after a failure."""

import random

import pytest
from pyspark.sql import functions as F

from emendata.streaming import ledgers, requests


def plain(rows, most, retry, end, upto):
    """The queue's definition, event after event; what falls due before upto is flushed."""
    held, out = {}, []

    def due(worker, now):
        for key, (request, at, retried) in list(held.items()):
            if key[0] != worker:
                continue
            if not retried and at + retry <= now:
                out.append((worker, request, "retried", at + retry))
                held[key] = (request, at, True)
            if at + end <= now:
                out.append((worker, request, "timed_out", at + end))
                del held[key]

    for worker, field, event, at, answers, good in sorted(rows, key=lambda r: (r[3], r[2])):
        due(worker, at)
        now = held.get((worker, field))
        if answers is None:
            if now:
                out.append((worker, now[0], "superseded", at))
            elif sum(k[0] == worker for k in held) >= most:
                out.append((worker, event, "busy", at))
                continue
            held[worker, field] = (event, at, False)
        elif now and now[0] == answers:
            out.append((worker, answers, "answered" if good else "failed", at))
            del held[worker, field]
        else:
            out.append((worker, answers, "stale", at))
    for worker in {k[0] for k in held}:
        due(worker, upto)
    return sorted(out)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, requests.PROVIDER)
    yield
    spark.conf.set(name, before)


def test_queue_by_brute_force_with_restarts(spark, store, tmp_path):
    rng, rows, now = random.Random(8), [], 0
    for event in range(400):
        now += rng.choice([0, 100, 2000, 9000, 40_000]) + event % 2
        worker, field = rng.randint(1, 3), rng.randint(1, 9)
        mine = [r[2] for r in rows if r[0] == worker and r[1] == field and r[4] is None]
        reply = mine and rng.random() < 0.4
        rows.append((worker, field, event, now, rng.choice(mine[-2:]) if reply else None, rng.random() < 0.7))
    rows.append((9, 1, 999, now + 10_000_000, None, None))
    schema = "worker long, field long, event long, at long, answers long, good boolean"
    cuts = [0, 130, 131, 300, len(rows)]
    got = []
    for a, b in zip(cuts, cuts[1:], strict=False):  # a query of its own for each part: state comes back from the checkpoint
        part = spark.createDataFrame(rows[a:b], schema).withColumn("ts", F.timestamp_millis("at")).drop("at")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        out = requests.outcomes(stream, most=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        out.trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(requests.OUT).parquet(str(tmp_path / "out")).collect()))
    want = plain(rows, 4, 30_000, 90_000, now + 10_000_000)
    assert got == want and {r[2] for r in want} == {"superseded", "busy", "answered", "failed", "stale", "retried", "timed_out"}


def test_ledger_after_a_failure_between_write_and_commit(spark, tmp_path):
    rows = [(job, seq, "done" if seq % 3 == 0 else "running") for seq, job in enumerate([1, 2, 1, 3, 2, 2, 4, 1])]
    for k in range(0, 8, 2):
        spark.createDataFrame(rows[k : k + 2], "job long, seq long, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job long, seq long, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write, failed = ledgers.upserted(str(tmp_path / "ledger")), []

    def once_failing(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise RuntimeError("killed before the commit")

    def start():
        stream.writeStream.foreachBatch(once_failing).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception):
        start()
    start()
    assert failed == [2]
    got = {r["job"]: (r["seq"], r["status"], r["first_seq"], r["attempts"]) for r in ledgers.state(spark, str(tmp_path / "ledger")).collect()}
    want = {j: (max(m), "done" if max(m) % 3 == 0 else "running", min(m), len(m)) for j in {r[0] for r in rows} for m in [[s for k, s, _ in rows if k == j]]}
    assert got == want
    jobs = spark.createDataFrame([(j,) for j in range(1, 7)], "job long")
    now = ledgers.interrupted(ledgers.state(spark, str(tmp_path / "ledger")))
    assert {r["job"] for r in ledgers.unfinished(jobs, now).collect()} == {j for j in range(1, 7) if want.get(j, (0, ""))[1] != "done"}
    assert {r["status"] for r in now.collect()} == {"done", "interrupted"}


def test_chain(spark):
    rows = [(log, seq, f"b{log}{seq}") for log in (1, 2) for seq in range(5)] + [(3, 0, None)]
    log = ledgers.chained(spark.createDataFrame(rows, "log long, seq long, body string"))
    assert log.count() == 11 and ledgers.broken(log.where("body is not null")).count() == 0
    cut = log.where("not (log = 1 and seq = 2) and body is not null").withColumn("body", F.when((F.col("log") == 2) & (F.col("seq") == 4), "x").otherwise(F.col("body")))
    assert {(r["log"], r["seq"], r["fault"]) for r in ledgers.broken(cut).collect()} == {(1, 3, "chain"), (2, 4, "hash")}
