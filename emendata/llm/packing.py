"""Operator 1, lexical retrieval packing with a sharded BM25 inverted index.

Texts become token ids once (a table in the shared folder). Document frequencies of all documents, bounded by the
vocabulary, give the idf. A document's leading term (the rarest that another document has too) names its shard:
terms with many tokens are spread over several shards by a hash, terms with few share one, so that shards hold
about SHARD_TOKENS. A shard has one inverted index of all its documents; all terms of a seed document query it, and
the unused neighbours, best first, fill the seed's window greedily: each that fits whole, then the best that does
not is cut. What is left of a cut document seeds the next window. Documents that share no term with the seed come
last. Only the last window of a shard has padding. A shard that its hash left over twice as large as it should be
is indexed in parts of that size, so that memory stays bounded.

Defined cases: null text is the empty text and holds the end id alone; rows that repeat an id are documents of
their own; ties of scores go to the earlier document of the shard (by term, id, text); an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendata.llm.common import blocks, released, written

WINDOW, END_ID = 4096, 2
K1, B = 1.2, 0.75
#: Tokens of a shard, shards that a task packs one after another, and partitions at most.
SHARD_TOKENS, TASK_SHARDS, MOST_PARTITIONS = 1_000_000, 4, 100_000


#: Words whose ids a worker remembers (about 150 bytes each).
REMEMBERED = 800_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Latin-1 texts in lower case fall into the tokenizer's own pieces by this pattern, the same as its pre-tokenizer's.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\t-\\r \\x85\\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


#: Marks that are pieces of their own after a word.
_MARKS = frozenset(".,;:!?")
#: What ends no word of the vocabulary's, or is a blank to Python alone.
_ODD = "\0\x1c\x1d\x1e\x1f"


def _byte_marks() -> dict[str, int]:
    """How byte-level vocabularies write bytes: visible ones by themselves, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in visible)}


class Encoder:
    """Ids of a tokenizer file, little-endian unsigned 16-bit (or 32-bit, for a large vocabulary).

    If `by_pieces`, the words between blanks of Latin-1 texts are remembered with their ids (REMEMBERED at most); new
    ones are cut into the pre-tokenizer's pieces, which blanks always end, and merged by the same vocabulary, read as
    ranks of byte strings in which a zero byte ends a word. Other texts, and those with a zero byte, a separator that
    is a blank to one side alone, or a special token's text, are encoded whole. Both give the same ids.
    """

    def __init__(self, path: str, by_pieces: bool = True):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        vocabulary = self.own.get_vocab(with_added_tokens=False)
        self.size = max(self.own.get_vocab().values(), default=0) + 1
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.ranks = self._ranks(path, vocabulary) if by_pieces else None
        self.known = Known(self) if self.ranks else {}

    @staticmethod
    def _ranks(path: str, vocabulary: dict[str, int]):
        """The vocabulary as ranks, None unless ids follow the order of merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:  # a vocabulary file of each machine, not an input
            model = json.load(f)["model"]
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        if model.get("end_of_word_suffix") != "</w>" or any(b <= a for a, b in zip(merged, merged[1:], strict=False)):
            return None
        marks = _byte_marks()
        ranks = {}
        for token, i in vocabulary.items():
            body = token.removesuffix("</w>") if len(token) > 4 else token
            if all(c in marks for c in body):
                ranks[bytes(marks[c] for c in body) + b"\0" * (body != token)] = i
        if any(bytes([b]) not in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("pieces", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if self.ranks is None or "<|" in text or any(map(text.__contains__, _ODD)):
            return self.whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, text.lower().split()))


class Known(dict):
    """Ids of words with their marks, remembered."""

    def __init__(self, owner: Encoder):
        self.encode, self.code = owner.ranks._core_bpe.encode_single_piece, "H" if owner.kind == "<u2" else "I"

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() or len(word) == 1:
            return self.put(word, REMEMBERED)
        if word[-1] in _MARKS and word[:-1].isalpha():
            out = self[word[:-1]] + self[word[-1]]
        else:
            pieces = _PIECES.findall(word)
            if len(pieces) == 1:
                return self.put(word, REMEMBERED)
            out = b"".join(map(self.__getitem__, pieces))
        if len(self) < REMEMBERED // 2:
            self[word] = out
        return out

    def put(self, piece: str, most: int) -> bytes:
        ids = array(self.code, self.encode((piece + "\0").encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes()
        if len(self) < most:
            self[piece] = out
        return out


@functools.lru_cache(2)
def encoder(path: str, by_pieces: bool = True) -> Encoder:
    """A worker's encoder; what it remembers serves its later tasks."""
    return Encoder(path, by_pieces)


def encoded(docs: DataFrame, path: Callable[[], str] = tokenizer_path, text: str = "text", doc_id: str = "doc_id", by_pieces: bool = True, end_id: int = END_ID) -> DataFrame:
    """doc_id, rank (of the text among rows of one id: a hash), ids (binary, with the end id) and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path(), by_pieces)
        end = np.array([end_id], encode.kind).tobytes()
        width = len(end)
        for batch in blocks(batches):
            texts = batch.column("text").to_pylist()
            ids = [encode(x) + end for x in texts]
            ranks = [crc32((x or "").encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ranks, pa.int64()), pa.array(ids, pa.binary()), pa.array([len(x) // width for x in ids], pa.int64())], names=["doc_id", "rank", "ids", "n"])

    mine = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = mine.schema["doc_id"].dataType.simpleString()
    return mine.mapInArrow(released(run), f"doc_id {kind}, rank long, ids binary, n long")


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and how often each occurs."""
    s = np.sort(ids, kind="stable")  # by digits, for 16-bit ids
    new = np.empty(len(s), bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    at = np.flatnonzero(new)
    ends = np.empty_like(at)
    ends[:-1], ends[-1:] = at[1:], len(s)
    return s[at], ends - at


def document_frequencies(table: DataFrame, kind: str, vocabulary: int) -> np.ndarray:
    """In how many documents each id is: one row an id and task, summed; no larger than the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # the texts are ids by now
        df = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                df[distinct(np.frombuffer(ids.as_buffer(), kind))[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["id", "df"])

    out = np.zeros(vocabulary, np.int64)
    for r in table.select("ids").mapInArrow(released(count), "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        out[r["id"]] = r["df"]
    return out


class Statistics:
    """idf of every id and the mean length: BM25 over all documents."""

    def __init__(self, df: np.ndarray, n: int, tokens: int):
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.shared_idf = np.where(df > 1, self.idf, 0).astype(np.float32)
        self.mean = tokens / max(n, 1)

    def weights(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A document's distinct ids and their BM25 weights."""
        kinds, tf = distinct(ids)
        return kinds, self.idf[kinds] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / self.mean))


def leading_terms(ids: pa.Array, kind: str, statistics: Statistics) -> list[int]:
    """Of each document the rarest id that isn't its alone (the first of equals)."""
    every = (np.frombuffer(x.as_buffer(), kind) for x in ids)
    return [int(x[np.argmax(statistics.shared_idf[x])]) for x in every]


def tokens_by_term(table: DataFrame, kind: str, statistics: Statistics) -> dict[int, int]:
    """Tokens of the documents of each leading term: no more rows than the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(leading_terms(batch.column("ids"), kind, statistics), pa.int32()), batch.column("n")], names=["term", "n"])

    terms = table.select("ids", "n").mapInArrow(released(run), "term int, n long")
    return {r["term"]: r["t"] for r in terms.groupBy("term").agg(F.sum("n").alias("t")).collect()}


def shards_of(tokens: dict[int, int], size: int) -> tuple[dict[int, tuple[int, int]], int]:
    """Per term its first shard and number of shards, and how many there are in all."""
    place, n, room = {}, 0, 0
    for term, t in sorted(tokens.items()):
        if t > size:
            k = -(-t // size)
            place[term] = (n, k)
            n, room = n + k, 0
        else:
            if room < t:
                n, room = n + 1, size
            place[term] = (n - 1, 1)
            room -= t
    return place, n


class Index:
    """Documents of a shard with an inverted index of BM25 weights."""

    def __init__(self, docs: list[tuple], statistics: Statistics):
        self.docs = docs
        self.lengths = np.array([len(d[3]) for d in docs], np.int64)
        self.unused = np.ones(len(docs), bool)
        parts = [statistics.weights(d[3]) for d in docs]
        terms = np.concatenate([k for k, _ in parts])
        self.weight = np.concatenate([w for _, w in parts]).astype(np.float64)
        owner = np.repeat(np.arange(len(docs)), [len(k) for k, _ in parts])
        order = np.argsort(terms, kind="stable")
        self.posting, self.weight = owner[order], self.weight[order]
        self.terms, count = distinct(terms)
        self.first = [0, *np.cumsum(count).tolist()]
        self.next = 0

    def neighbours(self, ids: np.ndarray) -> np.ndarray:
        """All unused documents that share a term with ids, by falling score."""
        kinds = distinct(ids)[0]
        at = np.minimum(np.searchsorted(self.terms, kinds), len(self.terms) - 1)
        lists = [slice(self.first[i], self.first[i + 1]) for i in at[self.terms[at] == kinds].tolist()]
        if not lists:
            return np.zeros(0, np.int64)
        scores = np.bincount(np.concatenate([self.posting[x] for x in lists]), np.concatenate([self.weight[x] for x in lists]), len(self.docs))
        scores[~self.unused] = 0
        best = np.flatnonzero(scores)
        return best[np.argsort(-scores[best], kind="stable")]

    def take(self) -> int:
        """The first unused document, -1 if there is none."""
        while self.next < len(self.docs) and not self.unused[self.next]:
            self.next += 1
        return self.next if self.next < len(self.docs) else -1


def pack_index(index: Index, carry: list, window: int) -> Iterator[list]:
    """Full windows of pieces (document, start, length). carry holds the open window and the rest of a cut document."""
    pieces, rest = carry  # rest: (document, start) or None
    room = window - sum(p[2] for p in pieces)
    while True:
        if rest is None and not pieces:
            i = index.take()
            if i < 0:
                break
            index.unused[i] = False
            rest = (index.docs[i], 0)
        if rest is not None:  # whole windows of the document at hand, or what is left of it as a seed
            doc, start = rest
            n = min(room, len(doc[3]) - start)
            pieces.append((doc, start, n))
            room -= n
            rest = (doc, start + n) if start + n < len(doc[3]) else None
        if room:
            inside = {p[0][:2] for p in pieces}  # a copy of a row (one id, one text) is no neighbour of it
            order = index.neighbours(pieces[0][0][3])
            lengths, at, skipped = index.lengths[order], 0, -1
            while room and len(fit := np.flatnonzero(lengths[at:] <= room)):
                if fit[0] and skipped < 0 and index.docs[int(order[at])][:2] not in inside:
                    skipped = int(order[at])
                at += int(fit[0])
                i, at = int(order[at]), at + 1
                if index.docs[i][:2] in inside:
                    continue
                inside.add(index.docs[i][:2])
                index.unused[i] = False
                pieces.append((index.docs[i], 0, int(index.lengths[i])))
                room -= int(index.lengths[i])
            if skipped < 0 and at < len(order) and index.docs[int(order[at])][:2] not in inside:
                skipped = int(order[at])
            while room:
                i = skipped if skipped >= 0 and index.unused[skipped] else index.take()
                if i < 0:
                    break
                index.unused[i] = False
                n = min(room, int(index.lengths[i]))
                pieces.append((index.docs[i], 0, n))
                room -= n
                rest = (index.docs[i], n) if n < index.lengths[i] else None
        if room:
            break  # all documents are used
        yield pieces
        pieces, room = [], window
    carry[:] = [pieces, rest]


def pack(docs: DataFrame, path: Callable[[], str] = tokenizer_path, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", by_pieces: bool = True, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    table = written(encoded(docs, path, text, doc_id, by_pieces), "ids")
    n, tokens = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = encoder(path(), by_pieces)
    kind, vocabulary = own.kind, max(own.size, END_ID + 1)
    statistics = Statistics(document_frequencies(table, kind, vocabulary), n, tokens)
    by_term = tokens_by_term(table, kind, statistics)
    place, shards = shards_of(by_term, shard_tokens)
    parts = max(1, min(-(-shards // TASK_SHARDS), MOST_PARTITIONS))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: dict[tuple, int] = {}  # rows of one id and text, which one hash would keep together
        for batch in batches:
            where, terms = [], leading_terms(batch.column("ids"), kind, statistics)
            for term, rank, own in zip(terms, batch.column("rank").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                first, k = place[term]
                if k > 1:
                    nth = copies[own, rank] = copies.get((own, rank), 0) + 1
                    first += crc32(f"{own}|{rank}|{nth}".encode()) % k
                where.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(terms, pa.int32()), pa.array(where, pa.int32())], names=[*batch.schema.names, "term", "shard"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    dealt = table.mapInArrow(released(assign), fields + ", term int, shard int").repartitionById(parts, "shard").sortWithinPartitions("shard", "term", "doc_id", "rank")
    id_kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, size_, count, carry = None, 0, 0, [[], None]
        out: list[tuple] = []
        types = None

        def emit(pieces: list) -> None:
            nonlocal count
            offset = 0
            for doc, start, length in pieces:
                out.append((doc[0], start, length, doc[3][start : start + length].astype("<u4").tobytes(), len(doc[3]), (at << 32) + count, offset))
                offset += length
            count += 1

        def flush(last: bool) -> None:
            nonlocal held, size_, carry, count
            if held:
                for pieces in pack_index(Index(held, statistics), carry, window):
                    emit(pieces)
                held, size_ = [], 0
            if last:
                if carry[1] is not None:  # an open rest has no index to query
                    doc, start = carry[1]
                    while start < len(doc[3]):
                        room = window - sum(p[2] for p in carry[0])
                        n = min(room, len(doc[3]) - start)
                        carry[0].append((doc, start, n))
                        start += n
                        if n == room:
                            emit(carry[0])
                            carry[0] = []
                if carry[0]:
                    emit(carry[0])
                carry, count = [[], None], 0

        def ready() -> pa.RecordBatch:
            kinds = (types, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return batch

        for batch in batches:
            types = batch.schema.field("doc_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rank", "shard", "ids")), strict=True):
                if row[2] != at:
                    if at is not None:
                        flush(True)
                    at = row[2]
                own = (row[0], row[1], row[2], np.frombuffer(row[3], kind))
                held.append(own)
                size_ += len(own[3])
                if size_ >= 2 * shard_tokens:
                    flush(False)
                    yield ready()
        if at is not None:
            flush(True)
            yield ready()

    return dealt.select("doc_id", "rank", "shard", "ids").mapInArrow(released(run), f"doc_id {id_kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_rows(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
