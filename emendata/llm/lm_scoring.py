"""Operator 7, language-model scoring by cross-entropy difference.

Two bigram models of one kind, one of a target (rows labelled good) and one of the background (all rows), share
one vocabulary: the corpus's lower-cased words. Each model mixes add-one words with pair frequencies. A document's
score is the mean over its words of target loss less background loss, in nats: below 0 it is nearer the target
than the corpus is.

Every distinct word and pair of the corpus has its own count, by a 62-bit key. Documents are written once as
blocks of word numbers. A block sends the counts of its distinct words and pairs to buckets of keys, as many as
the corpus needs; a bucket sums them and answers each block with the sums, in the block's order. So no process
holds a table of the corpus, and a word or pair crosses the shuffle once per block, however common it is.

Defined cases: a null text or one without words has score null and n_tokens 0; without a target the score
is null for all; labels that name a row twice count it once; repeated rows count each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendata.llm.common import arrow_schema, blocks, cut, released, written

#: Share of the pair model in the mixture.
PAIR_SHARE = 0.5
_WORDS = re.compile(r"[^\W_]+")
#: Words of a block of documents (one text alone may have more), and of the corpus for each bucket of keys.
BLOCK_WORDS, BUCKET_WORDS = 1_300_000, 1_000_000
#: Kinds of counts, the lowest bits of a key: pairs, words, words that have a follower (or the start).
_PAIR, _WORD, _FIRST = range(3)


class Numbers(dict):
    """Word to its number in a block, in the order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


def word_keys(words: Numbers) -> bytes:
    return b"".join(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(x: np.ndarray) -> bytes:
    """The count, then the lowest bytes of all numbers, then the next ones, compressed: most high bytes are zero."""
    body = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(body, codec="zstd", asbytes=True)


def from_planes(x: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    body = pa.decompress(x[4:], decompressed_size=int.from_bytes(x[:4], "little") * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(width, -1).T).view(kind).ravel()


def encoded(docs: DataFrame, text: str, doc_id: str, keep: list[str]) -> DataFrame:
    """Blocks of documents: keys of their words, id and number of words of each, word numbers, kept columns."""
    ids = arrow_schema(docs.select(doc_id)).field(0).type
    fields = pa.schema([("block", pa.string()), ("n_words", pa.int64()), ("words", pa.binary()), ("ids", pa.list_(ids)), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            kept = pa.BufferOutputStream()
            with pa.ipc.new_stream(kept, parts[0].schema) as out:
                for p in parts:
                    out.write_batch(p)
            row = [uuid.uuid4().hex, size, word_keys(known), names, [len(t) for t in tokens], planes(np.concatenate(tokens)), kept.getvalue().to_pybytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, fields, strict=True)], schema=fields)

        known, tokens, names, parts, size = Numbers(), [], [], [], 0
        for batch in blocks(batches, text):
            names += batch.column(doc_id).to_pylist()
            for body in batch.column(text).to_pylist():
                words = _WORDS.findall((body or "").lower())
                tokens.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                size += len(words)
            parts.append(batch.select(keep))
            if size >= BLOCK_WORDS:
                yield block()
                known, tokens, names, parts, size = Numbers(), [], [], [], 0
        if tokens:
            yield block()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.mapInArrow(released(run), f"block string, n_words long, words binary, ids array<{kind}>, lengths array<bigint>, tokens binary, kept binary")


class Block:
    """The distinct pairs and words of an encoded block, with their keys; the same order whenever it is made."""

    def __init__(self, row: dict):
        self.lengths, tokens = np.array(row["lengths"], np.int64), from_planes(row["tokens"], np.int32).astype(np.int64)
        words = np.frombuffer(row["words"], np.uint64)
        self.n = len(words)  # also the number of the start, before the first word
        first = np.empty_like(tokens)
        first[1:] = tokens[:-1]
        has = self.lengths > 0
        first[(np.cumsum(self.lengths) - self.lengths)[has]] = self.n
        self.tokens = tokens
        pairs, self.pair_of = np.unique(first * (self.n + 1) + tokens, return_inverse=True)
        self.first, self.word = np.divmod(pairs, self.n + 1)
        named = np.append(words, np.uint64(0))
        pair = _mixed(_mixed(named[self.first]) + named[self.word] * np.uint64(0x9E3779B97F4A7C15))
        single = _mixed(named)
        kinds = [(pair, _PAIR), (single[:-1], _WORD), (single, _FIRST)]
        self.keys = np.concatenate([(x & ~np.uint64(3)) | np.uint64(k) for x, k in kinds])

    def counts(self, targets: list[int] | None) -> np.ndarray:
        """n and n_target of each key; targets: positions of the target's documents."""
        good = np.zeros(len(self.lengths), bool)
        good[targets or []] = True
        good = np.repeat(good, self.lengths)
        out = []
        for some in (self.pair_of, self.pair_of[good]):
            pair = np.bincount(some, minlength=len(self.first))
            out.append(np.concatenate([pair, np.bincount(self.word, pair, self.n)[: self.n], np.bincount(self.first, pair, self.n + 1)]))
        return np.array(out).astype(np.int64)

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of keys, which is also by bucket, and where each bucket begins in it."""
        order = np.argsort(self.keys)
        bucket = ((self.keys[order] >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        return order, np.searchsorted(bucket, np.arange(n + 1, dtype=np.uint64))


def counted(blocks_: DataFrame, n_buckets: int) -> DataFrame:
    """block, bucket, n and n_target over the corpus of the block's keys in the bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["n_words"]:
                    continue
                block = Block(row)
                counts, (order, at) = block.counts(row["targets"]), block.buckets(n_buckets)
                keys, counts = block.keys[order], counts[:, order]
                full = np.flatnonzero(np.diff(at)).tolist()
                packed = lambda x: pa.array([planes(np.diff(x[at[b] : at[b + 1]], prepend=x.dtype.type(0))) if x is keys else planes(x[at[b] : at[b + 1]]) for b in full], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(full)), pa.array(full, pa.int32()), packed(keys), packed(counts[0]), packed(counts[1])], names=["block", "bucket", "keys", "n", "n_target"])

    def total(table: pa.Table) -> pa.Table:
        rows = [np.cumsum(from_planes(x, np.uint64)) for x in table.column("keys").to_pylist()]
        _, at = np.unique(np.concatenate(rows), return_inverse=True)
        ends = np.cumsum([len(x) for x in rows])[:-1]
        out = []
        for name in ("n", "n_target"):
            sums = np.bincount(at, np.concatenate([from_planes(x, np.int64) for x in table.column(name).to_pylist()]))
            out.append(pa.array([planes(x) for x in np.split(sums.astype(np.int64)[at], ends)], pa.binary()))
        return pa.table([table.column("block"), table.column("bucket"), *out], names=["block", "bucket", "n", "n_target"])

    sent = blocks_.mapInArrow(released(send), "block string, bucket int, keys binary, n binary, n_target binary")
    return sent.groupBy("bucket").applyInArrow(total, "block string, bucket int, n binary, n_target binary")


def vocabulary(blocks_: DataFrame) -> int:
    """Number of distinct words of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column("words").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64))], names=["word"])

    return blocks_.select("words").mapInArrow(run, "word long").distinct().count()


def score(docs: DataFrame, targets: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with n_tokens, target_loss, background_loss and score (means in nats); targets (doc_id) names the rows of the target model."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    made = ["n_tokens", "target_loss", "background_loss", "score"]
    if clash := sorted(set(keep) & set(made)):
        raise ValueError(f"the input already has columns {clash}; leave them out of keep")
    plain = docs.select(*keep, F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    schema = plain.drop("_text", "_id").schema.add("n_tokens", "long").add("target_loss", "double").add("background_loss", "double").add("score", "double")
    table = written(encoded(plain, "_text", "_id", keep), "lm-blocks")
    each = table.select("block", F.posexplode(F.arrays_zip("ids", "lengths"))).select(F.col("col.ids").alias("_id"), F.col("col.lengths").alias("n"), "block", "pos")
    good = each.join(targets.select(F.col(doc_id).alias("_id")).distinct(), "_id")
    good = cut(good.groupBy("block").agg(F.collect_list("pos").alias("targets"), F.sum("n").alias("n")))  # positions of the target's documents
    n_words, n_target = table.agg(F.sum("n_words")).first()[0] or 0, good.agg(F.sum("n")).first()[0] or 0
    n_buckets, n_vocabulary = -(-n_words // BUCKET_WORDS) or 1, vocabulary(table) if n_target else 0
    table = table.drop("ids").join(good.drop("n"), "block", "left")
    fields = arrow_schema(docs.sparkSession.createDataFrame([], schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            kept = pa.ipc.open_stream(row["kept"]).read_all()
            n = np.array(row["lengths"], np.int64)
            means: list = [pa.nulls(len(n), pa.float64())] * 3
            if n_target and row["n_words"]:
                block = Block(row)
                order, _ = block.buckets(n_buckets)
                sums = np.empty((2, len(order)))
                answers = sorted(right.to_pylist(), key=lambda r: r["bucket"])
                for i, name in enumerate(("n_target", "n")):
                    sums[i, order] = np.concatenate([from_planes(r[name], np.int64) for r in answers])
                pairs, words, firsts = np.split(sums, [len(block.first), len(block.first) + block.n], axis=1)
                single = (words + 1) / np.array([[n_target + n_vocabulary], [n_words + n_vocabulary]])
                losses = -np.log((1 - PAIR_SHARE) * single[:, block.word] + PAIR_SHARE * pairs / np.maximum(firsts[:, block.first], 1))
                doc = np.repeat(np.arange(len(n)), n)
                t, b = (np.bincount(doc, x[block.pair_of], len(n)) / np.maximum(n, 1) for x in losses)
                means = [pa.array(x, pa.float64(), mask=n == 0) for x in (t, b, t - b)]
            out.append(pa.table([*kept.columns, pa.array(n), *means], names=[*keep, *made]).cast(fields))
        return pa.concat_tables(out) if out else fields.empty_table()

    if n_target:
        answers = counted(table, n_buckets)
    else:
        answers = table.sparkSession.createDataFrame([], "block string, bucket int, n binary, n_target binary")
    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def score_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), labels.where(F.col("quality") == 1))
