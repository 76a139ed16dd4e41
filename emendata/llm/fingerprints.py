"""Operator 2, document fingerprints by content-defined chunking.

A gear hash over the UTF-8 bytes sets chunk boundaries, normalised: up to the normal size a boundary needs
more zero bits than beyond it, between a least and a greatest size. As boundaries depend only on the bytes
before them, an insertion moves them but does not change chunks elsewhere. A fingerprint is the set of
chunk digests with their lengths in bytes; the likeness of two is the length of their common chunks over
that of the shorter set: the containment of one in the other.

Defined cases: null is the empty text; the empty fingerprint is like itself (1) and unlike any other (0);
rows with one id follow each other by the text's crc32, then the text; null ids come last in descending order; a
single row's next is itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendata.llm.common import blocks, released

#: Sizes of a chunk in bytes, and the zero bits asked for below and beyond the normal size.
LEAST, NORMAL, GREATEST, STRICT_BITS, LOOSE_BITS = 12, 32, 192, 6, 4
WINDOW = 32  # bytes that a 32-bit gear hash sees
_random = np.random.default_rng(20240229)
_GEAR = _random.integers(0, 2**32, 257, np.uint32)
_GEAR[256] = 0
_DIGEST = _random.integers(0, 2**64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def chunks(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: digests (48 bits) and lengths of its distinct chunks, by digest."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = [len(x) for x in texts]
    longest = max(sizes, default=0)
    if not _POWERS or len(_POWERS[0]) <= longest:
        n = max(longest + 1, 1 << 16)
        _POWERS[:] = [_powers(_STEP, n), _powers(_BACK, n)]
    up, down = _POWERS
    # all texts in one row of bytes, WINDOW empty places before each, so that no hash sees the text before
    n = len(texts)
    starts = np.cumsum([0, *sizes])[:-1] if n else np.zeros(0, np.int64)
    padded = np.full(len(data) + WINDOW * n, 256, np.uint16)
    place = np.arange(len(data)) + WINDOW * np.repeat(np.arange(1, n + 1), sizes)
    padded[place] = data
    h = _GEAR[padded]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    h = h[place]
    loose = np.flatnonzero((h >> np.uint32(32 - LOOSE_BITS)) == 0)
    strict = ((h[loose] >> np.uint32(32 - STRICT_BITS)) == 0).tolist()
    first = np.searchsorted(loose, np.append(starts, len(data))).tolist()
    loose = loose.tolist()
    ends: list[int] = []
    for d in range(n):
        start = int(starts[d])
        stop, end_at = start + sizes[d], first[d + 1]
        for i in range(first[d], end_at):
            at = loose[i] + 1
            while at - start > GREATEST:
                start += GREATEST
                ends.append(start)
            size = at - start
            if size < LEAST or size < NORMAL and not strict[i]:
                continue
            start = at
            ends.append(at)
        while stop - start > GREATEST:
            start += GREATEST
            ends.append(start)
        if stop > start:
            ends.append(stop)
    out = []
    end = np.array(ends, np.int64)
    begin = np.concatenate((np.zeros(1, np.int64), end[:-1])) if len(end) else end
    if len(end):
        within = np.arange(len(data)) - np.repeat(starts, sizes)  # place in the own text
        terms = _DIGEST[data] * up[within]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        value = (total[end] - total[begin]) * down[within[begin]]
        length = end - begin
        value ^= length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value >>= np.uint64(16)
    own = np.searchsorted(end, np.append(starts, len(data)), "right") if len(end) else np.zeros(n + 1, int)
    for d in range(n):
        if sizes[d] == 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        v, i = np.unique(value[own[d] : own[d + 1]], return_index=True)
        out.append((v, length[own[d] : own[d + 1]][i]))
    return out


def written_form(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """12 hex digits of digest and 2 of length for each chunk, by digest."""
    value, length = print_
    raw = np.empty((len(value), 7), np.uint8)
    raw[:, :6] = (value.astype(">u8").view(np.uint8).reshape(-1, 8))[:, 2:]
    raw[:, 6] = length
    return raw.tobytes().hex()


def read_form(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 7)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw[:, :6]
    return wide.reshape(-1).view(">u8").astype(np.uint64), raw[:, 6].astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    least = min(int(a[1].sum()), int(b[1].sum()))
    if not least:
        return float(len(a[0]) == len(b[0]))
    (v, length), (w, _) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.searchsorted(w, v)
    at[at == len(w)] = 0
    return min(1.0, float(length[w[at] == v].sum()) / least)


def fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with the fingerprint of each whole text."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if "fingerprint" in keep:
        raise ValueError("the input already has a column fingerprint; leave it out of keep")
    plain = docs.select(*keep, F.col(text).alias("_text"))
    schema = plain.drop("_text").schema.add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            found = chunks([(x or "").encode("utf-8", "surrogatepass") for x in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(map(written_form, found), pa.string())], names=[*keep, "fingerprint"])

    return plain.mapInArrow(run, schema)


def edited_text(text: str, following: str) -> str:
    """The text with its last third replaced by as many code points (or all) of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def ranked(docs: DataFrame) -> DataFrame:
    """doc_id, text, part and tail, each part sorted by descending doc_id: rows of `parts`, then the first row of the next one (tail).

    Parts are ranges of ids from approximate quantiles, as many as there are shuffle partitions; an id that several
    quantiles fall on, and null ids, are split further by the text's crc32, so that no id makes a part much larger
    than others. One shuffle of the texts; only the ranges' bounds and first rows' ids reach the driver.
    """
    spark = docs.sparkSession
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("crc", F.crc32(F.col("text").cast("binary")))
    n, nulls = docs.agg(F.count("*"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 16))
    cuts = []
    if ranges > 1:
        cuts = mine.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(10_000, 20 * ranges))).first()[0] or []
    bounds = sorted(set(cuts))
    # ranges by falling id; per range the pieces that its greatest id is cut into, and where it begins
    hot = [1] + [cuts.count(x) for x in reversed(bounds)] + [max(1, round(ranges * nulls / max(n, 1)))]
    first = [0]
    for k in hot[:-1]:
        first.append(first[-1] + (k + 1 if k > 1 else 1))
    step = 32
    coarse, fine = F.array(*map(F.lit, bounds[step - 1 :: step])).cast("array<bigint>"), F.array(*map(F.lit, bounds)).cast("array<bigint>")
    below = lambda some: F.size(F.filter(some, lambda x: x < F.col("doc_id")))
    at = F.lit(step) * below(coarse)
    found = F.lit(len(bounds)) - at - below(F.slice(fine, at + 1, F.lit(step)))  # 0: over all bounds
    found = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(found)
    greatest = F.col("doc_id").isNull() | F.get(F.array_sort(fine), F.lit(len(bounds)) - F.col("found")).eqNullSafe(F.col("doc_id"))
    pieces = F.get(F.array(*map(F.lit, hot)), F.col("found"))
    piece = F.when((pieces == 1), 0).when(greatest, F.floor(F.col("crc") * pieces / F.lit(2.0**32))).otherwise(pieces)
    mine = mine.withColumn("found", found).withColumn("part", (F.get(F.array(*map(F.lit, first)), F.col("found")) + piece).cast("int")).drop("found")
    order = F.struct((-F.col("doc_id")).alias("o"), "crc")
    heads = [(r["part"], None if r["h"]["o"] is None else -r["h"]["o"], r["h"]["crc"]) for r in mine.groupBy("part").agg(F.min(order).alias("h")).orderBy("part").collect()]
    before = [(heads[i][1], heads[i][2], heads[i][0], heads[i - 1][0]) for i in range(len(heads))]  # the head of a part ends the one before it
    side = spark.createDataFrame(before, "h_id long, h_crc long, h_part int, before int")
    tails = mine.join(F.broadcast(side), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("crc") == F.col("h_crc")) & (F.col("part") == F.col("h_part")))
    tails = tails.groupBy("doc_id", "crc", "before").agg(F.min("text").alias("text")).select("doc_id", "text", "crc", F.col("before").alias("part"))
    every = mine.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("tail", F.lit(True)))
    dealt = every.repartitionById(first[-1] + hot[-1], "part")
    return dealt.sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "crc", "text").select("doc_id", "text", "part", "tail")


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[str]]]:
    """Ids, texts and following texts of ranked rows, by blocks; a text and the one that it follows are one object."""
    last = None  # (part, doc_id, text) of the row before
    for batch in blocks(batches):
        ids, texts, after = [], [], []
        for doc_id, body, part, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "tail")), strict=True):
            if last is not None and last[0] == part:
                ids.append(last[1])
                texts.append(last[2])
                after.append(body)
            last = None if tail else (part, doc_id, body)
        yield ids, texts, after


def with_following(docs: DataFrame) -> DataFrame:
    """doc_id, text and following: the next text by descending doc_id, after the last the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, after in followed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(after, pa.string())], names=["doc_id", "text", "following"])

    return ranked(docs).mapInArrow(released(run), "doc_id long, text string, following string")


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """The contract's rows; each text is cut into chunks once, though it is also the next of another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda texts: [x.encode("utf-8", "surrogatepass") for x in texts]
        for ids, texts, after in followed(batches):
            edited = code([edited_text(a, b) for a, b in zip(texts, after, strict=True)])
            inside = [i + 1 < len(texts) and texts[i + 1] is after[i] for i in range(len(texts))]
            own = chunks(code(texts))
            changed, others = chunks(edited), iter(chunks(code([x for x, held in zip(after, inside, strict=True) if not held])))
            nexts = [own[i + 1] if held else next(others) for i, held in enumerate(inside)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
                    pa.array(map(written_form, own), pa.string()),
                    pa.array(map(written_form, changed), pa.string()),
                    pa.array(map(likeness, own, changed), pa.float64()),
                    pa.array(map(likeness, own, nexts), pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return ranked(docs).mapInArrow(released(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
