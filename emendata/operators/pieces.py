"""Word pieces over whole tables, by a trie that is walked over a batch's distinct words; texts are counted where they stand.

The vocabulary is learned from the table (letters, frequent words, frequent ends) and has at most MOST_PIECES entries, so
that it may go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, ENDS, MOST_PIECES, LONGEST = 3000, 1000, 20_000, 100
UNKNOWN = "[UNK]"


def vocabulary(words: DataFrame) -> DataFrame:
    """piece: all letters, alone and inside (##), the most frequent words, and inside the most frequent ends of two to four letters. words: word, n."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    ends = words.where(F.length("word") > 4).select(F.explode(F.array(*(F.right("word", F.lit(k)) for k in (2, 3, 4)))).alias("e"), "n")
    ends = ends.groupBy("e").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "e").limit(ENDS).select(F.concat(F.lit("##"), "e").alias("piece"))
    best = words.orderBy(F.desc("n"), "word").limit(WORDS).select(F.col("word").alias("piece"))
    inside = letters.select(F.concat(F.lit("##"), "c").alias("piece"))
    return letters.select(F.col("c").alias("piece")).unionByName(inside).unionByName(best).unionByName(ends).distinct()


class Trie:
    """Greedy longest match: nested dictionaries by letter, a piece's end marked by the empty string."""

    def __init__(self, pieces: list[str]):
        self.first, self.inside = {}, {}
        for piece in pieces:
            at, body = (self.inside, piece[2:]) if piece.startswith("##") and len(piece) > 2 else (self.first, piece)
            for c in body:
                at = at.setdefault(c, {})
            at[""] = piece

    def cut(self, word: str) -> list[str]:
        if len(word) > LONGEST:
            return [UNKNOWN]
        out, start = [], 0
        while start < len(word):
            at, found, stop = self.inside if start else self.first, None, start
            for k in range(start, len(word)):
                at = at.get(word[k])
                if at is None:
                    break
                if "" in at:
                    found, stop = at[""], k + 1
            if found is None:
                return [UNKNOWN]
            out.append(found)
            start = stop
        return out


def _known(pieces: DataFrame) -> list[str]:
    known = [r["piece"] for r in pieces.limit(MOST_PIECES + 1).collect()]
    if len(known) > MOST_PIECES:
        raise ValueError(f"over {MOST_PIECES} pieces")
    return known


def cut(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """Word and pieces of every distinct word."""
    known = _known(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(known)
        for batch in batches:
            body = batch.column("word")
            yield pa.RecordBatch.from_arrays([body, pa.array([trie.cut(w) for w in body.to_pylist()], pa.list_(pa.string()))], names=["word", "pieces"])

    return words.select("word").mapInArrow(run, "word string, pieces array<string>")


def sizes(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """rows with the number of pieces of all their words (an array) in its place; no word crosses the network."""
    known, others = _known(pieces), [c for c in rows.columns if c != "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(known)
        for batch in batches:
            lists = batch.column("words")
            words = lists.flatten().dictionary_encode()
            each = np.array([len(trie.cut(w)) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
            stops = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            total = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], stops))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(np.diff(total), pa.int64())], names=[*others, "pieces"])

    return rows.select(*others, "words").mapInArrow(run, rows.select(*others).schema.add("pieces", "long"))
