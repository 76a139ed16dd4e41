"""The filter, trees, the generator's jumps and scorers by name, by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from emendata.operators import bootstrap, membership, scorers, trees


def test_filter_misses_nothing_and_lets_little_through(spark, monkeypatch):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    rows = spark.range(4000, 24_000).select("id", F.concat(F.lit("k"), "id").alias("k"))
    passed = {r["id"] for r in membership.maybe(rows, keys).collect()}
    assert set(range(4000, 5000)) <= passed and len(passed) - 1000 < 0.03 * 19_000
    monkeypatch.setattr(membership, "BROADCAST_BLOCKS", 0)
    assert {r["id"] for r in membership.hits(rows, keys).collect()} == set(range(4000, 5000))
    assert membership.hits(rows, keys.limit(0)).count() == 0


def test_paths_by_doubling(spark):
    rng = random.Random(1)
    parent = {0: None} | {i: i - 1 for i in range(1, 40)} | {i: rng.randrange(i) for i in range(40, 200)}
    value = {i: rng.randint(0, 9) for i in parent}
    nodes = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "node long, parent long, v long")
    want = {i: [0, 0] for i in parent}
    for i in parent:
        at, depth = i, 0
        while at is not None:
            want[at][1] += value[i]
            at, depth = parent[at], depth + 1
        want[i][0] = depth - 1
    assert {r["node"]: [r["depth"], r["inclusive"]] for r in trees.inclusive(nodes, "v").collect()} == want
    with pytest.raises(ValueError):
        trees.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"), most_rounds=4)


def test_draws_are_the_sequential_generators(spark):
    seed, want = bootstrap.SEED, []
    for _ in range(3000):
        seed = (seed * 1664525 + 1013904223) % 2**32
        want.append(seed)
    assert [r[0] for r in spark.range(3000).select(bootstrap.state(F.col("id") + 1)).collect()] == want
    far = 2**41 + 12_345
    a, c, x = 1664525, 1013904223, 143271
    power = pow(a, far, (a - 1) * 2**32)
    assert spark.range(1).select(bootstrap.state(F.lit(far))).first()[0] == (power * x + c * ((power - 1) // (a - 1))) % 2**32


def gate(spark, after, worse=None, trials=12, p95=1.0):
    rng, rows = random.Random(5), []
    for t in range(trials):
        for w in (*bootstrap.WEIGHTS, *bootstrap.GUARDED):
            b = 10 + rng.random()
            rows.append((t, w, b, b * (worse[1] if worse and worse[0] == w else after), b, b * p95))
    out = bootstrap.gate(spark.createDataFrame(rows, "trial long, workload string, before double, after double, before_p95 double, after_p95 double"), samples=300).first()
    return out["status"], out["reason"]


def test_gate(spark):
    assert gate(spark, 0.8) == ("accepted", "paired-speedup-with-quality-parity")
    assert gate(spark, 0.99) == ("rejected", "insufficient-speedup")
    assert gate(spark, 0.8, ("nearby", 1.2)) == gate(spark, 0.8, ("cold", 1.2)) == gate(spark, 0.8, p95=1.3) == ("rejected", "workload-regression")
    assert gate(spark, 0.8, trials=4) == ("inconclusive", "insufficient-paired-trials")


def test_edits_by_name(spark):
    rows = [(1, "en", "a b c".split(), "a c d".split()), (2, "de", ["x"], ["x"]), (3, "de", [], ["y"])]
    scorers.registered(spark).createDataFrame(rows, "id long, lang string, source array<string>, target array<string>").createOrReplaceTempView("some_pairs")
    got = {tuple(map(str, r)) for r in spark.sql("SELECT * FROM edits(TABLE(some_pairs) PARTITION BY lang)").collect()}
    assert got == {("1", "en", "1", "2", "[]"), ("1", "en", "3", "3", "['d']"), ("3", "de", "0", "0", "['y']")}
