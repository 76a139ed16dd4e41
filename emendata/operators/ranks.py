"""Order over whole tables without a single task: global ranks, running sums, order statistics, the least of each group.

Rows are range-partitioned by sampled bounds and sorted within; what a partition holds is summed, one row for each, and
the sums before it are added to what it counts itself. The sorted table is written once to the shared folder, as the
bounds of a second sample would be others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emendata.session import scratch

_INDEX = (1 << 33) - 1
#: Bins of a hash's first bits.
BIN_BITS = 16


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """df in order: _part, the range partition, and _at, the row's place in it from 0."""
    at = scratch(df.sparkSession, "sorted")
    mono = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.withColumns({"_part": F.spark_partition_id(), "_at": mono.bitwiseAND(F.lit(_INDEX))}).write.parquet(at)
    return df.sparkSession.read.parquet(at)


def _before(rows: DataFrame, value: Column) -> DataFrame:
    """_part and _base, the sum of value over all partitions before it: one row for each partition."""
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_base"))


def with_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with the rank of each row, from 1; order should be total."""
    rows = placed(df, *order)
    ranked = rows.join(F.broadcast(_before(rows, F.lit(1))), "_part")
    return ranked.withColumn(name, (F.col("_base") + F.col("_at") + 1).cast("long")).drop("_part", "_at", "_base")


def with_running(df: DataFrame, value: str, *order: Column, name: str = "running") -> DataFrame:
    """df with the sum of value over the row and all before it."""
    rows = placed(df, *order)
    own = F.sum(value).over(Window.partitionBy("_part").orderBy("_at"))
    summed = rows.withColumn("_own", own).join(F.broadcast(_before(rows, F.col(value))), "_part")
    return summed.withColumn(name, F.col("_base") + F.col("_own")).drop("_part", "_at", "_own", "_base")


def order_statistics(df: DataFrame, group: str, value: str, picks: dict[str, Column]) -> DataFrame:
    """Group, n and, by name, the value at each place (an expression of n, from 1). Groups may be few and large: a group's distinct values are counted, then summed over ranges."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    totals = counts.groupBy(group).agg(F.sum("_c").alias("n"))
    base = totals.withColumn("_from", F.coalesce(F.sum("n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a group
    rows = with_running(counts, "_c", F.col(group), F.col(value), name="_upto").join(F.broadcast(base), group)
    upto = F.col("_upto") - F.col("_from")
    return rows.groupBy(group).agg(F.max("n").alias("n"), *(F.min(F.when(upto >= at, F.col(value))).alias(name) for name, at in picks.items()))


def least_by_hash(df: DataFrame, group: str, digest: Column, most: Column) -> DataFrame:
    """Of each group the `most` rows (an expression of the group's n and of the least group's, `least`) with the least hex digests. Only rows of a group's last bin are ranked."""
    rows = df.withColumns({"_h": digest, "_bin": F.conv(F.substring(digest, 1, BIN_BITS // 4), 16, 10).cast("int")})
    bins = rows.groupBy(group, "_bin").agg(F.count("*").alias("_n"))
    sizes = bins.groupBy(group).agg(F.sum("_n").alias("n"))
    sizes = sizes.join(F.broadcast(sizes.agg(F.min("n").alias("least")))).select(F.col(group).alias("_g"), most.cast("long").alias("_k"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = bins.withColumn("_before", before).join(sizes, F.col(group).eqNullSafe(F.col("_g"))).where("_before < _k")
    cut = cut.select(F.col("_g"), F.col("_bin").alias("_b"), (F.col("_k") - F.col("_before")).alias("_left"), (F.col("_before") + F.col("_n") <= F.col("_k")).alias("_all"))
    mine = rows.join(cut, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bin") == F.col("_b")))
    whole = mine.where("_all").select(*df.columns)
    last = mine.where(~F.col("_all")).withColumn("_r", F.row_number().over(Window.partitionBy(group, "_bin").orderBy("_h", *[c for c, t in df.dtypes if t in ("bigint", "int", "string")])))
    return whole.unionByName(last.where("_r <= _left").select(*df.columns))
