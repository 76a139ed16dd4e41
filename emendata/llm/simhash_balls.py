"""Operator 12, SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within RADIUS = 3 bits meet half way, at one and a half: one bit flipped on either side and, where they
differ in three, one bit left out on both. Whole variants (at most one bit flipped, 65 of each distinct fingerprint) are
shuffled first: all that share one are within two bits, so that each is linked to its neighbour in the sorted group and
no pair needs to be listed. What then is still apart emits variants with a third of the bits left out (132); only those
of which two components share one go on and emit variants with one single bit left out, which again link their whole
group. So every link within three bits connects its two sides, the work is linear in the distinct fingerprints whatever
the size of a group, and equal texts are one fingerprint from the start. Every edge is verified by its differing bits.

Defined cases: null texts and texts without words have fingerprint zero, linked like any other; null ids are never a
component's id unless all its ids are null. Rows that repeat an id or text are rows of their own. A text of any length is
hashed in bounded pieces. Of other columns none is read, whatever its name. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emendata.llm.common import blocks, cut, released, written
from emendata.llm.components import SALTS, components

WORDS, SEED, RADIUS, BITS = 3, 42, 3, 64
#: Thirds of the bits, each left out once.
THIRDS = (range(0, 21), range(21, 42), range(42, 64))
#: Rows of 16 bytes or so that may be broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Fingerprints whose variants one task makes: their groups stay in its memory.
TASK_FPS = 12_000
#: Shingles whose bits are counted at a time.
COUNTED = 65_536


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit by bit the majority of the shingles' hashes, as a signed 64-bit number."""
    import xxhash

    parts = (text or "").encode().lower().split()  # bytes: ASCII letters and white space alone
    if not parts:
        return 0
    body = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    ends = ends[words - 1 :] or ends[-1:]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(ends)
    for at in range(0, n, COUNTED):
        hashes = np.array([digest(body[s : e - 1], SEED) for s, e in zip(starts[at : at + COUNTED], ends[at : at + COUNTED], strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            fps = [fingerprint(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    mine = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return mine.mapInArrow(released(run), f"doc_id {mine.schema['doc_id'].dataType.simpleString()}, fp long")


def _mask(bits) -> int:
    """The bits set, as a signed number."""
    full = sum(1 << b for b in bits)
    return full - (1 << BITS) if full >> (BITS - 1) else full


def _flips(fp, bits):
    """The values with none or one of the bits flipped."""
    return F.transform(F.array(F.lit(0).cast("long"), *(F.lit(_mask([b])).cast("long") for b in bits)), lambda m: fp.bitwiseXOR(m))


def neighbours(rows: DataFrame, *key: str) -> DataFrame:
    """Edges a, b between each fp and the one before it in its group of equal keys, in the order of components; within RADIUS bits."""
    order = Window.partitionBy(*key).orderBy("part", "fp")
    near = rows.withColumns({"a": F.lag("fp").over(order), "was": F.lag("part").over(order)}).where("a is not null and was <> part")
    return near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= RADIUS).select("a", F.col("fp").alias("b"), F.col("was").alias("part_a"), F.col("part").alias("part_b")).distinct()


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def whole_variants(fps: DataFrame) -> DataFrame:
    """Edges of fingerprints that share a variant of all 64 bits: all within two bits are linked or have neighbours between them that are."""
    rows = fps.select("fp", F.col("fp").alias("part"), F.explode(_flips(F.col("fp"), range(BITS))).alias("v"))
    return neighbours(rows, "v").select("a", "b")


def left_out(fps: DataFrame) -> DataFrame:
    """fp and part with third and v: variants without a third of the bits, of which at most one other is flipped."""
    ways = F.array(*(F.struct(F.lit(k).cast("byte").alias("third"), _flips(F.col("fp").bitwiseAND(F.lit(_mask(set(range(BITS)) - set(out)))), [b for b in range(BITS) if b not in out]).alias("v")) for k, out in enumerate(THIRDS)))
    return fps.select("fp", "part", F.explode(ways).alias("w")).select("fp", "part", "w.third", F.explode("w.v").alias("v"))


def single_out(met: DataFrame) -> DataFrame:
    """fp, part, bit and v: variants without a single bit of the third. What is flipped is what the met variant has flipped or, if that is nothing, one bit of the third."""
    own, outside = F.col("fp"), functools.reduce(lambda c, k: F.when(F.col("third") == k, F.lit(_mask(set(range(BITS)) - set(THIRDS[k]))).cast("long")).otherwise(c), range(3), F.lit(0).cast("long"))
    moved = F.col("v").bitwiseXOR(own.bitwiseAND(outside))
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    of = F.element_at(F.array(*(F.array(*(F.lit(b) for b in out)) for out in THIRDS)), F.col("third") + 1)
    flipped = F.when(moved != 0, F.array(own.bitwiseXOR(moved))).otherwise(F.concat(F.array(own), F.transform(of, lambda b: own.bitwiseXOR(bit(b)))))
    rows = met.select("fp", "part", F.explode(flipped).alias("z"), of.alias("bits")).select("fp", "part", "z", F.explode("bits").alias("bit"))
    return rows.select("fp", "part", "bit", F.col("z").bitwiseAND(F.bitwise_not(bit(F.col("bit")))).alias("v"))


def linked(fps: DataFrame) -> DataFrame:
    """fp and root of every distinct fingerprint: equal for all that links of at most RADIUS bits connect."""
    first = components(whole_variants(fps)).select(F.col("node").alias("fp"), "root")
    parts = written(fps.join(_side(first), "fp", "left").select("fp", F.coalesce("root", "fp").alias("part")), "parts")
    parts = parts.repartition(-(-parts.count() // TASK_FPS) or 1, "fp")  # 16 bytes a row
    met = left_out(parts).groupBy("third", "v").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("third", "v")
    met = written(met, "met")
    several = left_out(parts).join(_side(met), ["third", "v"], "left_semi")
    edges = neighbours(single_out(several), "bit", "v").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    second = components(edges).select(F.col("node").alias("part"), F.col("root").alias("whole"))
    return parts.join(_side(second), "part", "left").select("fp", F.coalesce("whole", "part").alias("root"))


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits) and component_id, the least id that links reach."""
    rows = written(fingerprints(docs, text, doc_id), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = fps.join(linked(fps.select("fp")), "fp")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    found = cut(roots.select("fp", "root").join(least, "root").select("fp", "component_id"))
    if found.count() <= BROADCAST_ROWS:
        told = rows.join(F.broadcast(found), "fp")
    else:  # copies of one text fall on several tasks
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        told = rows.withColumn("salt", salt).join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["fp", "salt"])
    return told.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
