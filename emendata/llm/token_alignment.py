"""Operator 11, cross-tokenizer alignment with id-striped dense count matrices.

Neither tokenizer has a token over a blank, tab or line feed that follows another character, so that both end tokens
there: texts fall into chunks (white space and what follows it) whose tokens, groups and links a worker remembers. A block of documents becomes one row for each stripe of A ids with the distinct links of its documents.
Stripes are partitions: the id pairs of a stripe are counted with np.add.at in one dense block of STRIPE_ROWS A ids by
all B ids, whose row maxima are the best counts. The counted blocks then lie before the links of the same stripe in the
same partitions, where each link is scored; scores go back to their block of documents.
A stripe that holds more than SALT_BYTES of links is dealt out over salts by block: its partial counts are summed
by stripe, and each salt gets the sums. Nothing but this number reaches the driver.

Defined cases: null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have no tokens:
zeros and an empty groups_sha256. Rows that repeat an id, or have none, are documents of their own. A text of any length
is one document; words of over LONG_WORD characters are not remembered. Of other columns none is read, whatever its
name. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendata.llm.common import blocks, released, written
from emendata.llm.packing import _byte_marks

#: A ids fall into STRIPES by remainder; a stripe's block has at most this share of the A ids and all B ids, 8 bytes each.
STRIPES = 256
#: Links (distinct in their document) and documents of one block; bytes of one stripe's links that one partition takes.
BLOCK_LINKS, BLOCK_DOCS, SALT_BYTES = 400_000, 8192, 256_000_000
#: Chunks that a worker remembers, twice (about 450 bytes each), and characters of the longest.
REMEMBERED, LONG_WORD = 120_000, 200

#: Where texts are cut: before a blank, tab or line feed that follows no white space. _CHUNK finds the same in texts without _ODD ones.
_CUT = re.compile("(?<=\\S)(?=[ \\t\\n])")
_CHUNK = re.compile("[ \\t\\n]+[^ \\t\\n]*")
_LONG = re.compile("\\S{%d}" % LONG_WORD)
_ODD = re.compile("[\\v\\f\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Tokens of both sides, their groups and links; vocab_a and vocab_b are the numbers of ids."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a, encoding="utf-8") as f:  # a vocabulary file of each machine, not an input
            spec = json.load(f)
        own = {x["id"] for x in spec.get("added_tokens", ())}
        marks = _byte_marks()
        ranks = {bytes(marks[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in own}
        self.whole = Tokenizer.from_file(a)
        self.whole.encode_special_tokens = True
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocab_a = self.whole.get_vocab_size()
        self.bytes_a = [b""] * self.vocab_a
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.vocab_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.vocab_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(re.search("[^▁\\s][▁ \\t\\n]", p) for p in pieces)
        self.lead = len(self.b.encode("x"))
        self.sizes_a, self.sizes_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.texts = self.table()
        #: Remembered chunks, and those of before: what is used again moves over.
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def ids(self, chunk: str) -> tuple[list[int], list[int]]:
        """A and B ids of a chunk, which starts with white space; B's own space is dropped with a letter before it.

        Words of over LONG_WORD characters, on which the fast encoder's time grows with the square, take the other one.
        """
        a = self.whole.encode(chunk, add_special_tokens=False).ids if _LONG.search(chunk) else self.fast.encode_ordinary(chunk)
        if chunk[0] == " " and len(chunk) > 1:
            return a, self.b.encode(chunk[1:])
        return a, self.b.encode("x" + chunk)[self.lead :]

    def table(self) -> list[bytes]:
        """Each id in decimal before what may follow it: an A id before a comma or its group's end, a B id likewise."""
        return [b"%d%s" % (i, end) for n, last in ((self.vocab_a, b"|"), (self.vocab_b, b";")) for i in range(n) for end in (b",", last)]

    def entries(self, chunks: list[str]) -> list[tuple | None]:
        """Of each chunk n_a, n_b, n_groups, n_links, the groups' text and the links (a * vocab_b + b, 8 bytes each); None unless both tokenizers give it back.

        Chunks that white space doesn't end are encoded as one text, which both cut where chunks meet.
        """
        whole = "".join(chunks)
        a, b = self.ids(whole)
        body = whole.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != body or b"".join(map(self.bytes_b.__getitem__, b)) != body:
            return [x for c in chunks for x in self.entries([c])] if len(chunks) > 1 else [None]
        a, b = np.array(a), np.array(b)
        ends_a, ends_b = self.sizes_a[a].cumsum(), self.sizes_b[b].cumsum()
        met_a, met_b = (x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y for x, y in ((ends_b, ends_a), (ends_a, ends_b)))
        both = ends_a[met_a]
        every = np.sort(np.concatenate([ends_a, ends_b[~met_b]]), kind="stable")
        # between two neighbouring ends, whichever side's, one pair of tokens overlaps
        links = (a[np.searchsorted(ends_a, every)] * self.vocab_b + b[np.searchsorted(ends_b, every)]).tobytes()
        upto_a, upto_b = np.searchsorted(ends_a, both, "right"), np.searchsorted(ends_b, both, "right")
        order = np.empty(len(a) + len(b), np.int64)  # a group's A ids, then its B ids
        order[np.arange(len(a)) + np.append(0, upto_b)[np.searchsorted(both, ends_a)]] = 2 * a + met_a
        order[np.arange(len(b)) + upto_a[np.searchsorted(both, ends_b)]] = 2 * (self.vocab_a + b) + met_b
        texts = list(map(self.texts.__getitem__, order.tolist()))
        cuts = np.cumsum(list(map(len, map(str.encode, chunks))))
        at = [np.append(0, np.searchsorted(x, cuts, "right")) for x in (ends_a, ends_b, both, every)]
        counts = zip(*(np.diff(x).tolist() for x in at), strict=True)
        spots, spans = (at[0] + at[1]).tolist(), (8 * at[3]).tolist()
        return [(*n, b"".join(texts[spots[k] : spots[k + 1]])[:-1], links[spans[k] : spans[k + 1]]) for k, n in enumerate(counts)]

    def __call__(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """The entries of each text's chunks, None for a text without tokens."""
        cut = []
        for text in texts:
            whole = f" {text}" if text else ""
            cut.append([whole] if whole and not self.cuts else _CUT.split(whole) if _ODD.search(whole) else _CHUNK.findall(whole))
        need, together, alone = set().union(*cut).difference(self.known), [], []
        for chunk in need:
            if chunk in self.older:
                self.known[chunk] = self.older[chunk]
            elif len(chunk) > LONG_WORD or chunk[-1].isspace():
                alone.append(chunk)
            elif chunk:
                together.append(chunk)
        if together:
            self.known.update(zip(together, self.entries(together), strict=True))
        for chunk in alone:
            self.known[chunk] = self.entries([chunk])[0] if chunk else None
        out = []
        for chunks in cut:
            found = list(map(self.known.__getitem__, chunks))
            out.append(found if found and None not in found else None)
        for chunk in alone:
            del self.known[chunk]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        return out


@functools.lru_cache(1)
def aligner(a: str, b: str) -> Aligner:
    """A worker's aligner; what it remembers serves its later tasks."""
    return Aligner(a, b)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _packed(*parts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(b"".join(x.astype("<i8" if x.dtype.itemsize == 8 else "<i4").tobytes() for x in parts))


def _opened(body: bytes, *kinds: str) -> list[np.ndarray]:
    """The parts of a packed row, of equal lengths."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body)
    n, out, at = len(raw) // sum(int(k[-1]) for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * int(k[-1])
    return out


def aligned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizers: Callable[[], tuple[str, str]] = paths) -> DataFrame:
    """Rows of two kinds by block: a document (i, doc_id, its counts and groups_sha256; stripe null), and a stripe's links of all the block's documents."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"block long, stripe int, body binary, i int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align = aligner(*tokenizers())
        block, rows, ids, links, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, size
            n = len(rows)
            if not n:
                return
            columns = [pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.concat_arrays(ids)]
            columns += [pa.array([r[k] for r in rows], pa.int64() if k < 4 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            doc = np.repeat(np.arange(n, dtype=np.int32), [len(x[0]) for x in links])
            pair, often = (np.concatenate([x[k] for x in links]) for k in (0, 1))
            a, b = pair // align.vocab_b, pair % align.vocab_b
            order = np.argsort((a % STRIPES).astype(np.uint16), kind="stable")
            a, b, doc, often = (x[order].astype(np.int32) for x in (a, b, doc, often))
            at = np.searchsorted(a % STRIPES, np.arange(STRIPES + 1))
            used = np.flatnonzero(at[1:] > at[:-1])
            bodies = [_packed(doc[s], a[s] // STRIPES, b[s], often[s]) for s in (slice(at[k], at[k + 1]) for k in used)]
            m = len(used)
            yield pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int64()), pa.array(used, pa.int32()), pa.array(bodies, pa.binary()), *(pa.nulls(m, t) for t in [pa.int32(), ids[0].type, *[pa.int64()] * 4, pa.string()])], names=names)
            block, size = block + 1, 0
            for x in (rows, ids, links):
                x.clear()

        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in blocks(batches):
            for k, found in enumerate(align(batch.column("text").to_pylist())):
                if found is None:
                    rows.append((0, 0, 0, 0, ""))
                    links.append(nothing)
                else:
                    rows.append((*(sum(e[c] for e in found) for c in range(4)), hashlib.sha256(b";".join([e[4] for e in found])).hexdigest()))
                    links.append(np.unique(np.frombuffer(b"".join([e[5] for e in found]), np.int64), return_counts=True))
                    size += len(links[-1][0])
                ids.append(batch.column("doc_id").slice(k, 1))
                if size >= BLOCK_LINKS or len(rows) >= BLOCK_DOCS:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(run), schema)


def _by_stripe(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows of the same stripe and salt."""
    import itertools

    rows = (r for batch in batches for r in batch.to_pylist())
    return itertools.groupby(rows, key=lambda r: (r["stripe"], r["salt"]))


def pair_counts(links: DataFrame, vocab_a: int, vocab_b: int, salts: int) -> DataFrame:
    """stripe and body: in how many documents each id pair of the stripe is linked; links is dealt by stripe and salt."""
    height = -(-vocab_a // STRIPES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((height, vocab_b), np.int64)
        for (stripe, _), rows in _by_stripe(batches):
            for r in rows:
                _, a, b, _ = _opened(r["body"], "<i4", "<i4", "<i4", "<i4")
                np.add.at(dense, (a, b), 1)
            yield _counted(stripe, dense)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((height, vocab_b), np.int64)
        for (stripe, _), rows in _by_stripe(batches):
            for r in rows:
                n, at = _opened(r["body"], "<i8", "<i4")
                np.add.at(dense.reshape(-1), at, n)
            yield _counted(stripe, dense)

    def _counted(stripe: int, dense: np.ndarray) -> pa.RecordBatch:
        flat = dense.reshape(-1)
        at = np.flatnonzero(flat)
        body = _packed(flat[at], at.astype(np.int32))
        flat[at] = 0  # the block serves the next stripe
        return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([body], pa.binary())], names=["stripe", "body"])

    parts = links.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt").mapInArrow(released(partial), "stripe int, body binary")
    if salts == 1:
        return parts
    parts = parts.withColumn("salt", F.lit(0)).repartition("stripe").sortWithinPartitions("stripe")
    return parts.mapInArrow(released(whole), "stripe int, body binary")


def scored(links: DataFrame, counts: DataFrame, vocab_a: int, vocab_b: int) -> DataFrame:
    """block and body (i, n_best, count_sum): scores of a block's documents by the links of one stripe; counts has a row for each stripe and salt."""
    height = -(-vocab_a // STRIPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, at, best = np.zeros((height, vocab_b), np.int64), [], None
        for _, rows in _by_stripe(batches):
            out: list = []
            for r in rows:
                if r["block"] is None:  # the counts come first
                    dense.reshape(-1)[at] = 0
                    n, at = _opened(r["body"], "<i8", "<i4")
                    dense.reshape(-1)[at] = n
                    best = dense.max(axis=1)
                    continue
                doc, a, b, often = _opened(r["body"], "<i4", "<i4", "<i4", "<i4")
                n = dense[a, b]
                width = int(doc.max()) + 1
                top = np.bincount(doc, weights=np.where(n == best[a], often, 0), minlength=width).astype(np.int64)
                total = np.zeros(width, np.int64)
                np.add.at(total, doc, n * often)
                mine = np.flatnonzero(np.bincount(doc, minlength=width))
                out.append((r["block"], _packed(top[mine], total[mine], mine.astype(np.int32))))
                if len(out) >= 256:
                    yield _rows(out)
            if out:
                yield _rows(out)

    def _rows(out: list) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["block", "body"])
        out.clear()
        return batch

    both = links.select("block", "stripe", "salt", "body").unionByName(counts.select(F.lit(None).cast("long").alias("block"), "stripe", "salt", "body"))
    return both.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("block").asc_nulls_first()).mapInArrow(released(run), "block long, body binary")


def alignment_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizers: Callable[[], tuple[str, str]] = paths, salt_bytes: int = SALT_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    table = written(aligned(docs, text, doc_id, tokenizers), "aligned")
    fullest = table.where("stripe is not null").groupBy("stripe").agg(F.sum(F.octet_length("body")).alias("n")).agg(F.max("n")).first()[0] or 0
    salts = -(-fullest // salt_bytes) or 1
    links = table.where("stripe is not null").select("block", "stripe", "body", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    own = Aligner(*tokenizers())
    counts = pair_counts(links.select("stripe", "salt", "body"), own.vocab_a, own.vocab_b, salts)
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sums = scored(links, counts, own.vocab_a, own.vocab_b)
    rows = table.where("stripe is null").drop("stripe", "body")
    shown = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    kept = rows.select("block", "i", "doc_id", *COUNTS, "groups_sha256")
    both = kept.withColumn("body", F.lit(None).cast("binary")).unionByName(sums, allowMissingColumns=True)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total = None, None, None
        for batch in batches:
            block, body, at = batch.column("block").to_pylist(), batch.column("body"), batch.column("i").to_pylist()
            keep, top, sums = [], [], []
            for k in range(batch.num_rows):
                if block[k] != now:
                    now, best, total = block[k], np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
                if at[k] is None:  # a block's scores come before its documents
                    n, s, i = _opened(body[k].as_py(), "<i8", "<i8", "<i4")
                    best[i] += n
                    total[i] += s
                else:
                    keep.append(k)
                    top.append(int(best[at[k]]))
                    sums.append(int(total[at[k]]))
            held = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(held.column(c) for c in ["doc_id", *COUNTS]), pa.array(top, pa.int64()), pa.array(sums, pa.int64()), held.column("groups_sha256")], names=shown)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return both.repartition("block").sortWithinPartitions("block", F.col("i").asc_nulls_first()).mapInArrow(released(collect), schema)
