"""Operator 11 against the definition: whole texts, every pair of ranges compared."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emendata.llm import token_alignment as ta

POOL = ["a", "Bc", "1", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "'s", "̀", "é", "中文", "　", "😀", "²", "\x00", "<|endoftext|>", "</s>", "▁", "<0x0A>", "﻿", "!", "word", " word", " the", "."]


@pytest.fixture(scope="module")
def own():
    return ta.Aligner(*ta.paths())


def tokens(own, text):
    """A and B ids of space+text, from the tokenizers themselves; None unless both give it back."""
    a, b = own.whole.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    want = (" " + text).encode()
    if b"".join(own.bytes_a[i] for i in a) != want or b"".join(own.bytes_b[i] for i in b) != want:
        return None
    return a, b


def brute(own, texts):
    """Per text its counts, links and groups."""
    out = []
    for text in texts:
        found = tokens(own, text) if text else None
        if found is None:
            out.append((0, 0, 0, [], ""))
            continue
        a, b = found
        ranges = []
        for ids, sizes in ((a, own.bytes_a), (b, own.bytes_b)):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(sizes[i])))
                at = mine[-1][1]
            ranges.append(mine)
        links = [(a[i], b[j]) for i, x in enumerate(ranges[0]) for j, y in enumerate(ranges[1]) if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in ranges[0]} & {y[1] for y in ranges[1]})
        groups = []
        for start, end in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(i) for i, x in zip(ids, mine, strict=True) if start < x[1] <= end) for ids, mine in zip((a, b), ranges, strict=True)))
        out.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def expected(own, rows):
    every = brute(own, [t for _, t in rows])
    counts = Counter(p for x in every for p in set(x[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return Counter((d, x[0], x[1], x[2], len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for (d, _), x in zip(rows, every, strict=True))


def shown(df):
    return Counter((r["doc_id"], *(r[c] for c in ta.COUNTS), r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


def test_chunks_give_the_tokenizers_ids(own):
    rng = random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choice(POOL) for _ in range(rng.randint(1, 9)))
        got, want = own([text])[0], brute(own, [text])[0]
        if got is None:
            assert want[0] == 0
        else:
            assert (sum(e[0] for e in got), sum(e[1] for e in got), hashlib.sha256(b";".join(e[4] for e in got)).hexdigest()) == (want[0], want[1], want[4])


def test_whole_table_by_brute_force(spark, own, monkeypatch):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 900").collect()]
    rng = random.Random(3)
    odd = [(None, None), (1, ""), (None, "a b"), (5, "a b"), (5, "a b"), (6, "▁"), (7, "x" * 3000 + " y"), *((i, "".join(rng.choice(POOL) for _ in range(20))) for i in range(100_000, 100_040))]
    rows = real + odd
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("block", "stripe", "body", "i", "n_a")}).repartition(3)
    want = expected(own, rows)
    assert shown(ta.alignment_rows(docs)) == want
    assert shown(ta.alignment_rows(docs, salt_bytes=100)) == want  # all stripes salted


def test_long_texts_string_ids_and_empty_tables(spark, own):
    rows = [("p", "x" * 400_000), ("q", "ab, " * 100_000), (None, "ab, ")]
    got = {r["doc_id"]: r for r in ta.alignment_rows(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got["q"]["n_groups"] > 100_000 and got["p"]["n_a"] == len(own.whole.encode(" " + rows[0][1], add_special_tokens=False).ids)
    assert got["q"]["n_links"] == got["q"]["n_a"] + got["q"]["n_b"] - got["q"]["n_groups"]
    assert ta.alignment_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
