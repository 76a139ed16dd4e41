"""A timing gate by bootstrap whose draws every task makes for itself: the congruential generator jumps ahead to any draw."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The generator.
SEED, FACTOR, STEP, MODULUS = 143271, 1664525, 1013904223, 1 << 32
#: Workloads and their weights, and those that are only guarded.
WEIGHTS, GUARDED = {"unchanged": 0.1, "edited": 0.6, "fresh": 0.3}, ("nearby", "cold")
#: Least speedup, greatest regressions of medians and of 95th percentiles, resamples, least trials.
SPEEDUP, REGRESSION, P95_REGRESSION, SAMPLES, TRIALS = 0.05, 0.15, 0.25, 10_000, 5
#: Tasks that share the samples, ratios that one of them holds, and draws made at once.
CHUNKS, BLOCK, STRIDE = 48, 1_000_000, 65_536
#: Draws are told apart by so many bits.
BITS = 48


def jumps(bits: int = BITS) -> list[tuple[int, int]]:
    """(a, c) by which 2^k steps of the generator are one: x -> a x + c."""
    out, a, c = [], FACTOR, STEP
    for _ in range(bits):
        out.append((a, c))
        a, c = a * a % MODULUS, (a + 1) * c % MODULUS
    return out


def state(k: Column) -> Column:
    """The generator's state after k steps, in halves so that no product leaves 64 bits."""
    table = F.array(*(F.struct(F.lit(a >> 16).cast("long").alias("high"), F.lit(a & 0xFFFF).cast("long").alias("low"), F.lit(c).cast("long").alias("c"), F.lit(1 << i).cast("long").alias("bit")) for i, (a, c) in enumerate(jumps())))
    step = lambda x, j: (((j["high"] * x) % 65536) * 65536 + j["low"] * x + j["c"]) % MODULUS
    return F.aggregate(table, F.lit(SEED).cast("long"), lambda x, j: F.when(k.bitwiseAND(j["bit"]) != 0, step(x, j)).otherwise(x))


def jumped(k: int) -> int:
    """The generator's state after k steps."""
    x = SEED
    for i, (a, c) in enumerate(jumps(max(1, k.bit_length()))):
        x = (a * x + c) % MODULUS if k >> i & 1 else x
    return x


def strides(most: int) -> tuple[np.ndarray, np.ndarray]:
    """a and c of 1, 2, ... `most` steps at once, modulo 2^32 as the type wraps."""
    a, c = np.array([FACTOR], np.uint32), np.array([STEP], np.uint32)
    while len(a) < most:  # k steps after all of them
        a, c = np.concatenate([a, a * a[-1]]), np.concatenate([c, a * c[-1] + c])
    return a[:most], c[:most]


def resampled(ratios: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """speedup of each resample of ratios (at, from 0 without gaps, and r): draw number sample * n + place."""
    n = ratios.count()
    if not n:
        return ratios.sparkSession.createDataFrame([], "sample long, speedup double")
    # every task makes the draws of some samples, over one block of the ratios, which is all that it holds
    chunks = ratios.sparkSession.range(min(samples, CHUNKS)).select(F.col("id").alias("chunk"))
    dealt = ratios.select("at", "r", F.floor(F.col("at") / BLOCK).alias("block")).join(F.broadcast(chunks))
    count = min(samples, CHUNKS)

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        low = int(rows["block"].iloc[0]) * BLOCK
        values = np.zeros(len(rows) + 1)
        values[rows["at"].to_numpy() - low] = rows["r"].to_numpy()  # the last place stays 0, for draws of other blocks
        steps_a, steps_c = strides(min(n, STRIDE))
        mine = range(int(rows["chunk"].iloc[0]), samples, count)
        out = []
        for sample in mine:
            x, total = jumped(sample * n), 0.0
            for at in range(0, n, STRIDE):
                states = steps_a[: n - at] * np.uint32(x) + steps_c[: n - at]
                places = ((states.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)).astype(np.int64) - low
                total += values[np.where((places >= 0) & (places < len(rows)), places, len(rows))].sum()
                x = int(states[-1])
            out.append(total)
        return pd.DataFrame({"sample": list(mine), "total": out})

    parts = dealt.groupBy("chunk", "block").applyInPandas(sums, "sample long, total double")
    return parts.groupBy("sample").agg((1 - F.exp(F.sum("total") / n)).alias("speedup"))


def floor_percentile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """H20's second kind: the value at floor((n - 1) q) of each group's sorted values."""
    order, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    rows = df.withColumns({"_r": F.row_number().over(order) - 1, "_n": F.count("*").over(whole)})
    return rows.where(F.col("_r") == F.floor((F.col("_n") - 1) * F.lit(q))).select(*by, value)


def gate(trials: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """L4: one row: status, reason, speedup, low and high, trials, and the worst regressions of medians and 95th percentiles.

    trials: trial, workload, before, after (medians) and before_p95, after_p95; a row for each workload of each trial.
    """
    ratio = trials.withColumns({"m": F.col("after") / F.col("before"), "p": F.col("after_p95") / F.col("before_p95")})
    worst = floor_percentile(ratio, ["workload"], "m", 0.5).agg((F.max("m") - 1).alias("regression"))
    worst95 = floor_percentile(ratio.where("workload <> 'cold'"), ["workload"], "p", 0.5).agg((F.max("p") - 1).alias("p95_regression"))
    weight = F.create_map(*(F.lit(x) for item in WEIGHTS.items() for x in item))
    each = ratio.where(F.col("workload").isin(*WEIGHTS)).groupBy("trial").agg(F.sum(weight[F.col("workload")] * F.log("m")).alias("r"))
    rows = each.select((F.row_number().over(Window.orderBy("trial")) - 1).cast("long").alias("at"), "r")  # 16 bytes a trial
    speeds = resampled(rows, samples).withColumn("all", F.lit(1))
    low, high = (floor_percentile(speeds, ["all"], "speedup", q).select(F.col("speedup").alias(name)) for q, name in ((0.025, "low"), (0.975, "high")))
    whole = rows.agg((1 - F.exp(F.avg("r"))).alias("speedup"), F.count("*").alias("trials"))
    out = whole
    for one in (worst, worst95, low, high):  # one row each
        out = out.join(F.broadcast(one), F.lit(True), "left")
    worse = (F.col("regression") > REGRESSION) | (F.col("p95_regression") > P95_REGRESSION)
    few = F.col("trials") < TRIALS
    status = F.when(few, "inconclusive").when(worse | (F.col("high") < SPEEDUP), "rejected").when(F.col("low") >= SPEEDUP, "accepted").otherwise("inconclusive")
    reason = F.when(few, "insufficient-paired-trials").when(worse, "workload-regression").when(F.col("high") < SPEEDUP, "insufficient-speedup").when(F.col("low") >= SPEEDUP, "paired-speedup-with-quality-parity").otherwise("timing-uncertainty")
    return out.select(status.alias("status"), reason.alias("reason"), "speedup", "low", "high", "trials", "regression", "p95_regression")
