"""Membership in a large set of keys: a blocked Bloom filter made by aggregation, probed before any shuffle, hits verified exactly.

A key's hash names one block of eight 64-bit words and four bits in it, so that the filter is a table of blocks (about
BITS_PER_KEY bits a key) and a probe one equi-join: broadcast while the blocks are few enough, else shuffled. Keys that
pass are compared as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, WORDS, PROBES = 12, 8, 4
#: Blocks (about 100 bytes each) that may be broadcast.
BROADCAST_BLOCKS = 300_000


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block and the positions of its bits there."""
    second = F.xxhash64(F.lit("bits"), key)
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [F.shiftrightunsigned(second, 9 * k).bitwiseAND(F.lit(WORDS * 64 - 1)).cast("int") for k in range(PROBES)]


def bloom(keys: DataFrame, key: str = "k") -> tuple[DataFrame, int]:
    """The filter of distinct keys (block, words) and its number of blocks, which grows with the keys."""
    blocks = max(1, -(-keys.count() * BITS_PER_KEY // (WORDS * 64)))
    block, bits = _place(F.col(key), blocks)
    rows = keys.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)))
    words = rows.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(mask).alias("mask"))
    every = F.map_from_entries(F.collect_list(F.struct("word", "mask")))  # WORDS entries at most
    return words.groupBy("block").agg(every.alias("m")).select("block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("words")), blocks


def maybe(rows: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    """The rows whose key the filter of keys lets through: all that are in keys, and few others."""
    table, blocks = bloom(keys, key)
    block, bits = _place(F.col(key), blocks)
    side = F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table
    joined = rows.withColumn("block", block).join(side, "block")
    holds = [F.call_function("shiftright", F.get("words", F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1 for b in bits]
    return joined.where(reduce(lambda a, b: a & b, holds)).drop("block", "words")


def hits(rows: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    """The rows whose key is in keys: the filter first, then the keys themselves."""
    return maybe(rows, keys, key).join(keys.select(key), key, "left_semi")
