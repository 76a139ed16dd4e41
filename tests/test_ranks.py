import random
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from emendata.operators import ranks, thresholds

RNG = random.Random(2)
ROWS = [(i, RNG.choice("abc") if i % 50 else None, RNG.randint(0, 60)) for i in range(3000)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, g string, v long").repartition(7)


def test_rank_and_running_sum(spark, rows):
    order = sorted(ROWS, key=lambda r: (-r[2], r[0]))
    got = {r["id"]: r["rank"] for r in ranks.with_rank(rows, F.desc("v"), F.col("id")).collect()}
    assert got == {r[0]: k for k, r in enumerate(order, 1)}
    total, want = 0, {}
    for r in order:
        total += r[2]
        want[r[0]] = total
    assert {r["id"]: r["s"] for r in ranks.with_running(rows, "v", F.desc("v"), F.col("id"), name="s").collect()} == want
    assert ranks.with_rank(rows.limit(0), F.col("v")).count() == 0


def test_rows_never_meet_in_one_task(rows):
    ranked = ranks.with_rank(rows, F.col("v"), F.col("id"))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "HashAggregate" in window and plan.count("Window") <= 2  # the only window is over one row for each partition


def test_order_statistics(spark, rows):
    picks = {"p95": F.expr("CAST(ceil(0.95 * n) AS BIGINT)"), "low": F.lit(1), "median": F.expr("CAST(floor(n / 2.0) AS BIGINT) + 1")}
    got = {r["g"]: (r["n"], r["p95"], r["low"], r["median"]) for r in ranks.order_statistics(rows.where("g is not null"), "g", "v", picks).collect()}
    want = {}
    for g in "abc":
        values = sorted(v for _, h, v in ROWS if h == g)
        want[g] = len(values), values[ceil(0.95 * len(values)) - 1], values[0], values[floor(len(values) / 2)]
    assert got == want


def test_least_by_hash(spark, rows, monkeypatch):
    monkeypatch.setattr(ranks, "BIN_BITS", 4)
    digest = F.sha2(F.col("id").cast("string"), 256)
    got = {(r["g"], r["id"]) for r in ranks.least_by_hash(rows, "g", digest, F.least(F.col("least"), F.lit(100))).collect()}
    from hashlib import sha256

    want = set()
    for g in ("a", "b", "c", None):
        ids = sorted((i for i, h, _ in ROWS if h == g), key=lambda i: sha256(str(i).encode()).hexdigest())
        want |= {(g, i) for i in ids[: min(100, sum(r[1] is None for r in ROWS))]}
    assert got == want


def test_thresholds_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, rng.random() < 0.4, round(rng.random(), 2)) for c in "xyz" for _ in range(200)]
    rows = [(c, g, s if not g else min(1.0, s + {"x": 0.1, "y": 0.4, "z": 0.0}[c])) for c, g, s in rows]
    grid = [k / 20 for k in range(1, 20)]
    bins = thresholds.histogram(spark.createDataFrame(rows, "c string, gold boolean, score double"), grid, "c")
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in thresholds.swept(bins, grid).collect()}
    count = lambda at: tuple(sum(1 for c, g, s in rows if g == gold and (s > at[c]) == over) for gold, over in ((True, True), (False, True), (True, False)))
    assert got == {t: count(dict.fromkeys("xyz", t)) for t in grid}

    def f05(at):
        tp, fp, fn = count(at)
        p, r = tp / (tp + fp) if tp + fp else 1.0, tp / (tp + fn) if tp + fn else 1.0
        return 1.25 * p * r / max(1e-12, 0.25 * p + r)

    now = dict.fromkeys("xyz", 0.05)
    best = f05(now)
    for c in "xyz":
        for t in grid:
            if t > 0.05 and f05(now | {c: t}) > best:
                now, best = now | {c: t}, f05(now | {c: t})
    assert thresholds.by_category(bins, grid, 0.05, 20) == now and len(set(now.values())) > 1
    assert set(thresholds.by_category(bins, grid, 0.05, 10_000).values()) == {0.05}
