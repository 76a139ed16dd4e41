"""Operator 5, mixing sources to target weights by Poisson replication. DataFrame and SQL functions only.

A source of n rows with target weight w (of all weights) in a mixture of m rows repeats each row at the mean
rate r = m * w / n. A uniform number from the hash of the row's id is inverted through the Poisson distribution
of mean r: the row's count. Above PART_RATE, where exp(-r) nears the end of doubles, the count is a sum of counts
of as many equal parts as are needed, each drawn by a hash of its own: Poisson again, of mean r. Rows are exploded
by their counts and ordered by a hash of id and copy: a global shuffle that any rerun repeats. As hashes are even,
their leading digits name the output partition; no sample of the rows is taken to find bounds.

Defined cases: a null source is a source of its own; null ids share one draw; repeated rows have one count each,
the same; sources without a target, when targets are given, get weight 0; an empty table stays empty.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a source by default: its share of rows to this power (1 keeps the mixture, 0 makes all sources equal).
POWER = 0.5
#: Sources whose table of rates may be broadcast; with more of them the join is shuffled.
BROADCAST_SOURCES = 5_000
#: Copies of the table of rates beyond that: a hot source's rows fall on as many tasks.
SALTS = 32
SEED = "mix-1"
#: Rows of an output partition, beyond those of spark.sql.shuffle.partitions.
PARTITION_ROWS = 250_000
#: The highest mean of one draw.
PART_RATE = 500


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of an md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def poisson_steps(rate: Column) -> Column:
    """The distribution function at 0, 1, ... up to where its tail is below any uniform number."""
    last = F.ceil(rate + F.lit(9) * F.sqrt(rate) + F.lit(25)).cast("int")
    zero = F.exp(-rate)
    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, targets: dict[str, float] | None = None, source: str = "source", rows: float | None = None, power: float = POWER) -> DataFrame:
    """Per source: n, rate (mean repetitions of a row), its number of parts and the steps of a part's Poisson distribution.

    rows: of the mixture, as many as there are by default.
    """
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("n")).cache()
    if targets is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))])
        weighed = counts.withColumn("w", F.coalesce(given[F.col("_source")], F.lit(0.0)))
    all_n, all_w = weighed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    mixed = float(all_n if rows is None else rows)
    both = weighed.withColumn("rate", F.lit(mixed) * F.col("w") / F.lit(all_w) / F.col("n") if all_w > 0 else F.lit(0.0))
    both = both.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PART_RATE))).cast("int"))
    return both.select("_source", "n", "rate", "_parts", poisson_steps(F.col("rate") / F.col("_parts")).alias("_steps"))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", rows: float | None = None, power: float = POWER, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as its Poisson count, with mix_copy (from 1) and mix_key, ordered by mix_key."""
    if clash := sorted({"mix_copy", "mix_key", "_steps", "_parts", "_source", "_salt", "_u", "_count"} & set(docs.columns)):
        raise ValueError(f"the input already has columns {clash}")
    spark = docs.sparkSession
    table = rates(docs, targets, source, rows, power).cache()
    sources, made = table.agg(F.count("*"), F.coalesce(F.sum(F.col("n") * F.col("rate")), F.lit(0.0))).first()
    table, same = table.select("_source", "_parts", "_steps"), F.col(source).eqNullSafe(F.col("_source"))
    if sources <= BROADCAST_SOURCES:
        drawn = docs.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("_side", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(doc_id, source), F.lit(SALTS)).cast("int")
        drawn = docs.withColumn("_salt", salt).join(salted, same & (F.col("_salt") == F.col("_side")))
    below = lambda u: F.size(F.filter("_steps", lambda x: x < u))
    drawn = drawn.withColumn("_u", uniform(seed, F.col(doc_id))).withColumn("_count", below(F.col("_u")))
    others = F.transform(F.sequence(F.lit(2), F.col("_parts")), lambda k: uniform(f"{seed}/part", F.col(doc_id), k))  # the first part is drawn above
    more = F.aggregate(others, F.lit(0), lambda n, u: n + below(u))
    drawn = drawn.withColumn("_count", F.when(F.col("_parts") > 1, F.col("_count") + more).otherwise(F.col("_count")))
    copies = drawn.where(F.col("_count") > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}/order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("mix_copy").cast("string")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(made / PARTITION_ROWS))
    place = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") * F.lit(parts / 2**32)).cast("int")
    return copies.withColumn("mix_key", key).select(*docs.columns, "mix_copy", "mix_key").repartitionById(parts, place).sortWithinPartitions("mix_key")


def mix_rows(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text"))


#: Parts of a rate over PART_RATE have draws of their own; copies are counted up to the greatest count of a row.
MIX_SQL = """
WITH counts AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY source),
rated AS (SELECT source, CAST(sum(n) OVER () AS DOUBLE) * w / sum(w) OVER () / n AS rate FROM counts),
parted AS (SELECT source, greatest(1, CAST(ceil(rate / 500) AS BIGINT)) AS parts, rate / greatest(1, ceil(rate / 500)) AS rate FROM rated),
terms AS (SELECT source, rate, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END AS p FROM parted, range(0, 800) t(k) WHERE k <= ceil(rate + 9 * sqrt(rate) + 25)),
steps AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
draws AS (SELECT d.r, d.doc_id, d.source, d.text, unnest(range(1, p.parts + 1)) AS part FROM (SELECT *, row_number() OVER () AS r FROM documents) d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source),
drawn AS (SELECT r, doc_id, source, text, (CAST(('0x' || substr(md5(CASE WHEN part = 1 THEN 'mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') ELSE 'mix-1/part|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || part END), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM draws),
counted AS (SELECT d.r, d.doc_id, d.source, d.text, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.c < d.u) AS n FROM drawn d),
summed AS (SELECT doc_id, source, text, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY r, doc_id, source, text),
copies AS (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM summed)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS mix_copy, md5('mix-1/order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy) AS mix_key FROM copies
"""
