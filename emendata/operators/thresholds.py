"""Thresholds by one pass: a score's place among the thresholds is a histogram's bin, suffix sums give every threshold's counts.

What follows is on a table of categories by thresholds, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, grid: list[float], category: str, gold: str = "gold", score: str = "score") -> DataFrame:
    """category, bin (how many thresholds lie below the score) and the rows with and without gold."""
    # the score goes in as a lambda's variable: an expression in its place would be computed anew for each threshold
    below = F.transform(F.array(score), lambda s: F.size(F.filter(F.array(*(F.lit(t) for t in grid)), lambda t: s > t)))[0]
    counts = F.count_if(F.col(gold)).alias("good"), F.count_if(~F.col(gold)).alias("bad")
    return rows.groupBy(F.col(category).alias("category"), below.alias("bin")).agg(*counts)


def swept(bins: DataFrame, grid: list[float], by: str | None = None) -> DataFrame:
    """H1: threshold, tp, fp and fn for every threshold, for all or by category: sums over the bins above."""
    keys = [by] if by else []
    places = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("k"), F.lit(t).alias("threshold")) for k, t in enumerate(grid))))
    sums = lambda c, above: F.sum(F.when((F.col("bin") >= F.col("k")) == F.lit(above), F.col(c)).otherwise(0))
    table = bins.select(*keys, "bin", "good", "bad", places.alias("p")).select(*keys, "bin", "good", "bad", "p.*")
    return table.groupBy(*keys, "threshold").agg(sums("good", True).alias("tp"), sums("bad", True).alias("fp"), sums("good", False).alias("fn"))


def measured(table: DataFrame) -> DataFrame:
    """table with edit_precision and edit_recall, 1 where undefined, and f05."""
    share = lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a.cast("double") / b)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    return table.withColumns({"edit_precision": p, "edit_recall": r, "f05": 1.25 * p * r / F.greatest(F.lit(1e-12), 0.25 * p + r)})


def chosen(table: DataFrame, precision: float, support: int) -> DataFrame:
    """One row: the threshold with the highest f05 (the highest of equals) among those of enough precision and predicted edits; null if there is none."""
    fit = (F.col("edit_precision") >= precision) & (F.col("tp") + F.col("fp") >= support)
    return table.agg(F.max(F.when(fit, F.struct("f05", "threshold")))["threshold"].alias("threshold"), F.max(F.when(fit, F.col("f05"))).alias("f05"))


def by_category(bins: DataFrame, grid: list[float], start: float, support: int) -> dict[str, float]:
    """Thresholds of the categories with enough gold rows, by coordinate ascent from the start in the order of names and grid: each that raises the f05 of all stays. The table of categories by thresholds is what the driver sees."""
    sums: dict[str, dict[float, tuple[int, int, int]]] = {}
    for r in swept(bins, grid, "category").collect():
        sums.setdefault(r["category"], {})[r["threshold"]] = (r["tp"], r["fp"], r["fn"])

    def f05(at: dict[str, float]) -> float:
        tp, fp, fn = (sum(sums[c][t][k] for c, t in at.items()) for k in range(3))
        p, r = tp / (tp + fp) if tp + fp else 1.0, tp / (tp + fn) if tp + fn else 1.0
        return 1.25 * p * r / max(1e-12, 0.25 * p + r)

    now = dict.fromkeys(sums, start)
    best = f05(now)
    for name in sorted(c for c, s in sums.items() if sum(s[start][::2]) >= support):
        for t in grid:
            if t > start and (score := f05(now | {name: t})) > best:
                now, best = now | {name: t}, score
    return now
