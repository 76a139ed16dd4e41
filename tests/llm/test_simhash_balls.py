"""Operator 12 against plain fingerprints and all pairs of distinct ones."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emendata.llm import simhash_balls as sb


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] * bool(now)
            now = ""
        else:
            now += c
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Least index reachable over links of at most three bits."""
    u, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(u))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    for text in (None, "", " \n", "One", "one two", "A b\x0bc", "É a\xa0b c D e", "word " * 200_000, "x y z w " * 3):
        assert sb.fingerprint(text) == signed(plain_fingerprint(text))


@pytest.mark.parametrize("large", [True, False])
def test_links_by_all_pairs(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(sb, "BROADCAST_ROWS", 0)
    rng = random.Random(4)
    fps = set()
    flip = lambda x, bits: x ^ sum(1 << b for b in bits)
    for k in range(120):  # pairs of every spread over the thirds, chains, stars, and some four bits apart
        x = rng.getrandbits(64)
        fps.add(x)
        if k % 4 == 0:
            fps.add(flip(x, rng.sample(list(sb.THIRDS[k % 3]), 3)))
        elif k % 4 == 1:
            fps.add(flip(x, [rng.choice(t) for t in sb.THIRDS]))
        elif k % 4 == 2:
            fps.add(flip(x, [*rng.sample(list(sb.THIRDS[k % 3]), 2), rng.choice(sb.THIRDS[(k + 1) % 3])]))
        else:
            fps.add(flip(x, rng.sample(range(64), 4)))
    centre = rng.getrandbits(64)
    fps |= {flip(centre, rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5]))) for _ in range(250)}
    chain = rng.getrandbits(64)
    for _ in range(40):
        chain = flip(chain, rng.sample(range(64), 3))
        fps.add(chain)
    fps = sorted(fps | {0, 7})
    got = {r["fp"]: r["root"] for r in sb.linked(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    want = plain_components(fps)
    assert len(got) == len(fps)
    pairs = {(got[signed(x)], w) for x, w in zip(fps, want, strict=True)}
    assert len(pairs) == len(set(got.values())) == len(set(want))


def test_rows_by_brute_force(spark, monkeypatch):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    body = " ".join(f"w{i}" for i in range(400))
    odd = [(None, None), (None, body), (2**40, ""), (3, ""), (3, " \t"), (2**41, body), (2**41, body + " end"), *((2**42 + i, body.replace(f"w{i} ", f"v{i} ")) for i in range(60))]
    rows = real + odd
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("fp", "root", "part", "v", "salt")}).repartition(3)
    fps = [plain_fingerprint(t) for _, t in rows]
    kinds = sorted(set(fps))
    root = dict(zip(kinds, plain_components(kinds), strict=True))
    least = {}
    for (d, _), f in zip(rows, fps, strict=True):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = Counter((d, f"{f:016x}", least.get(root[f])) for (d, _), f in zip(rows, fps, strict=True))
    assert Counter(map(tuple, sb.simhash_components(docs).collect())) == want
    monkeypatch.setattr(sb, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, sb.simhash_components(docs).collect())) == want
    assert sb.simhash_components(docs.limit(0)).count() == 0
