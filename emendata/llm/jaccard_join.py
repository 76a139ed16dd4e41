"""Operator 9, n-gram Jaccard join by chosen paths.

Documents with one set of word 5-grams are one class. A set's tokens are drawn by min-hashes, PER_RUN of them for
each run. A run is a tree: at each node a set follows the tokens that it draws by some of the run's hash functions,
on average one over the threshold of them, so that a pair at the threshold shares each branch with that chance and
one branch on average. A node with at most BUCKET sets is a bucket, compared by brute force; a node with more is
split again, at most DEPTH times, and beyond that compared in blocks. `Plan` derives from the threshold how many
branches a node has, after how many runs a pair at the threshold shares a bucket with the target recall, and how
many min-hashes such a pair has in common but in one case of some ten thousand.

Pairs of a bucket with as many join candidate groups. Each group's whole sets then come together once and every
pair is decided exactly: in blocks bounded in sets and tokens, and by levels of size, as sets in levels that are
not next to each other can't reach the threshold. No pairs are written: a block gives each class the weight of its
links and a spanning forest.

Defined cases: a text of fewer than five words has the one n-gram of all its words; null, empty and blank texts
have none and no links, each row a class of its own; repeated rows (equal ids too) are members of one class; null
ids take part as the greatest id, 2**63 - 1; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from emendata.llm.common import blocks, cut, released, written
from emendata.llm.components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.998
PER_RUN = 8
#: Most sets of a bucket, levels of splitting, and min-hash signatures of a block of a larger bucket.
BUCKET, DEPTH, SIGNATURES = 400, 4, 4_000
#: Most sets and tokens (8 bytes each) of a block where groups are compared whole; one set alone may have more.
BLOCK, BLOCK_TOKENS = 600, 1_000_000
#: Bytes of a part of a matrix product.
PRODUCT_BYTES = 32_000_000
#: Rows of candidate groups (about 100 bytes each) that may be broadcast; with more the join is shuffled.
BROADCAST_MEMBERS = 200_000
NO_ID = 2**63 - 1


@dataclass(frozen=True)
class Plan:
    """What follows from a threshold: branches of a node, runs, and equal min-hashes of a candidate pair."""

    threshold: float = THRESHOLD
    recall: float = RECALL

    def __post_init__(self):
        if not 0.15 < self.threshold <= 1:
            raise ValueError("the threshold must be over 0.15 and at most 1")

    @property
    def branches(self) -> tuple[int, float]:
        """Branches of every node, and the chance of one more."""
        whole = math.floor(1 / self.threshold)
        return whole, 1 / self.threshold - whole

    @property
    def runs(self) -> int:
        (whole, more), p = self.branches, 1.0
        for _ in range(DEPTH):
            miss = 1 - self.threshold * p
            p = 1 - (1 - more) * miss**whole - more * miss ** (whole + 1)
        return 1 if p >= 1 else math.ceil(math.log(1 - self.recall) / math.log(1 - p))

    @property
    def minhashes(self) -> int:
        return self.runs * PER_RUN

    @property
    def least(self) -> int:
        """Equal min-hashes, four standard deviations below what a pair at the threshold has."""
        n, t = self.minhashes, self.threshold
        return max(1, math.floor(n * t - 4.1 * math.sqrt(n * t * (1 - t))))

    @property
    def level_width(self) -> float:
        """Width of a level of sizes on the scale of logarithms: pairs at the threshold are in one or in two next to each other."""
        return max(1e-3, -math.log(self.threshold)) + 1e-9

    def factors(self) -> np.ndarray:
        return (np.random.default_rng(90210).integers(0, 2**63, self.minhashes, np.uint64) << np.uint64(1)) | np.uint64(1)


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


class Known(dict):
    """Word to 64-bit hash, remembered (100,000 words at most)."""

    def __missing__(self, word: str) -> int:
        value = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 100_000:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, known: Known, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's word n-grams."""
    parts = (text or "").split()
    w = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h * _P + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def minhashes(tokens: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), 2**32 - 1, np.uint32)
    for i in range(0, len(tokens), 4096):
        part = ((tokens[None, i : i + 4096] * factors[:, None]) >> np.uint64(32)).min(1).astype(np.uint32)
        out = np.minimum(out, part)
    return out


def keyed(docs: DataFrame, text: str, doc_id: str) -> list:
    """Columns id (null ids are NO_ID) and th: rows with both the same are copies of one another."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th")]


def sets(docs: DataFrame, plan: Plan, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """id, th, cid (digest of the set, null if empty), n and sig (min-hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, factors = Known(), plan.factors()
        for batch in blocks(batches):
            cids, sizes, sigs = [], [], []
            for body in batch.column("text").to_pylist():
                s = shingles(body, known, words)
                cids.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                sigs.append(minhashes(s, factors).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(cids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], names=["id", "th", "cid", "n", "sig"])

    mine = docs.select(*keyed(docs, text, doc_id), F.col(text).alias("text"))
    return mine.mapInArrow(released(run), "id long, th long, cid binary, n int, sig binary")


def children(path: int, run: int, sig: np.ndarray, branches: tuple[int, float]) -> list[int]:
    """The nodes that a set goes to from a node."""
    here = path.to_bytes(8, "little", signed=True)
    draw = xxh3_64_intdigest(here, seed=run)
    n = branches[0] + ((draw >> 8) % 4096 < branches[1] * 4096)
    stride = 1 + 2 * ((draw >> 24) % (PER_RUN // 2))  # odd, so that the functions differ
    out = []
    for k in range(n):
        c = (draw + k * stride) % PER_RUN
        value = xxh3_64_intdigest(here + bytes([run, c]) + int(sig[run * PER_RUN + c]).to_bytes(4, "little"))
        out.append(value - 2**63)
    return out


def split(rows: DataFrame, plan: Plan) -> DataFrame:
    """run, path, cid of the children of nodes (run, path, cid, sig); without run and path: of all roots."""
    roots, runs, branches = "path" not in rows.columns, plan.runs, plan.branches

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sigs = batch.column("cid").to_pylist(), batch.column("sig").to_pylist()
            if roots:
                found = [(r, c, cid) for cid, sig in zip(cids, sigs, strict=True) for s in [np.frombuffer(sig, np.uint32)] for r in range(runs) for c in children(0, r, s, branches)]
            else:
                at, paths = batch.column("run").to_pylist(), batch.column("path").to_pylist()
                found = [(r, c, cid) for r, p, cid, sig in zip(at, paths, cids, sigs, strict=True) for c in children(p, r, np.frombuffer(sig, np.uint32), branches)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int16(), pa.int64(), pa.binary()))], names=["run", "path", "cid"])

    return rows.mapInArrow(released(go), "run short, path long, cid binary")


def placed(members: DataFrame, key: str, plan: Plan, most: int, most_tokens: int | None = None) -> DataFrame:
    """members (key, cid, n) of keys with two or more, with level, own, cuts, above and below: where `tasks` sends them.

    A key within the bounds is one block of level 0. Another's members fall into levels by size, and a level's into
    blocks by hash, as many (cuts) as keep it within the bounds; above and below are the cuts of the next levels.
    """
    tokens = F.sum("n") if most_tokens else F.lit(0)
    sizes = members.groupBy(key).agg(F.count("*").alias("_all"), tokens.alias("_tokens")).where("_all > 1")
    fits = (F.col("_all") <= most) & (F.col("_tokens") <= (most_tokens or 0))
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(plan.level_width)).cast("int")
    small = members.join(sizes.where(fits).select(key), key).withColumn("level", F.lit(0)).withColumns({"cuts": F.lit(1), "own": F.lit(0), "above": F.lit(0), "below": F.lit(0)})
    large = members.join(sizes.where(~fits).select(key), key).withColumn("level", level)
    count = F.ceil(F.count("*") / F.lit(most))
    cuts = large.groupBy(key, "level").agg((F.greatest(count, F.ceil(F.sum("n") / F.lit(most_tokens))) if most_tokens else count).cast("int").alias("cuts"))
    near = lambda step, name: cuts.select(key, (F.col("level") + step).alias("level"), F.col("cuts").alias(name))
    cuts = cuts.join(near(-1, "above"), [key, "level"], "left").join(near(1, "below"), [key, "level"], "left").na.fill(0)
    large = large.join(cuts, [key, "level"]).withColumn("own", F.pmod(F.xxhash64("cid", F.lit("block")), F.col("cuts")).cast("int"))
    return small.unionByName(large.select(*small.columns))


def tasks(members: DataFrame, key: str) -> DataFrame:
    """task, side (0 or 1), alone and the other columns of placed members: every pair that may be alike meets in one task."""
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda o: o < n)
    kind = lambda level, i, j, cross, side: F.struct(level.alias("level"), i.alias("i"), j.alias("j"), F.lit(cross).alias("cross"), side.cast("byte").alias("side"))
    level, own = F.col("level"), F.col("own")
    same = F.transform(upto(F.col("cuts")), lambda o: kind(level, F.least(o, own), F.greatest(o, own), False, F.when(own <= o, 0).otherwise(1)))
    above = F.transform(upto(F.col("above")), lambda o: kind(level, own, o, True, F.lit(0)))
    below = F.transform(upto(F.col("below")), lambda o: kind(level - 1, o, own, True, F.lit(1)))
    dealt = members.withColumn("_t", F.explode(F.concat(same, above, below)))
    task = F.xxhash64(key, "_t.level", "_t.i", "_t.j", "_t.cross")
    alone = ~F.col("_t.cross") & (F.col("_t.i") == F.col("_t.j"))
    return dealt.withColumns({"task": task, "side": F.col("_t.side"), "alone": alone}).drop("_t", "level", "own", "cuts", "above", "below")


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Runs of rows of one task, from batches sorted by task."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[0] != at:
                if len(held) > 1:
                    yield held
                at, held = row[0], []
            held.append(row)
    if len(held) > 1:
        yield held


class Forest:
    """Union-find over the members of one task; its edges are a spanning forest."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.edges.append((min(ra, rb), max(ra, rb)))


def candidate_edges(dealt: DataFrame, plan: Plan) -> DataFrame:
    """a, b: spanning forests of the pairs in each bucket whose min-hashes agree often enough."""
    least, width = plan.least, plan.minhashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for rows in _grouped(batches, ["task", "side", "alone", "cid", "sig"]):
            sigs = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(len(rows), width)
            sides, alone, group = np.array([r[1] for r in rows]), rows[0][2], np.arange(len(rows))
            for i in range(len(rows)):
                if not alone and sides[i]:
                    continue
                # members of one group need no comparison: the group is all that counts here
                rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i]) if alone else np.flatnonzero((sides == 1) & (group != group[i]))
                for j in rest[(sigs[rest] == sigs[i]).sum(1) >= least].tolist():
                    if group[j] != group[i]:
                        out.append((rows[i][3], rows[j][3]))
                        group[group == group[j]] = group[i]
            if len(out) > 50_000:
                yield _pairs(out)
        yield _pairs(out)

    def _pairs(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in range(2)], names=["a", "b"])
        out.clear()
        return batch

    dealt = dealt.select("task", "side", "alone", "cid", "sig").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(released(run), "a binary, b binary")


def intersections(own: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets; what stands for a set with itself is of no use."""
    n = len(own)
    out = np.zeros((n, n), np.int32)
    if n <= 6:
        for i, a in enumerate(own):
            for j in range(i, n):
                out[i, j] = out[j, i] = len(np.intersect1d(a, own[j], assume_unique=True))
        return out
    sizes = np.array(list(map(len, own)))
    owner = np.repeat(np.arange(n), sizes)
    kinds, token = np.unique(np.concatenate(own), return_inverse=True)
    order = np.argsort(token, kind="stable")
    posting = owner[order]
    first = np.searchsorted(token[order], np.arange(len(kinds) + 1))
    count = np.diff(first)
    ends = np.cumsum(sizes)
    # tokens that many sets share: matrix products of bounded parts; the others by their postings
    wide = np.flatnonzero(count * 4 >= n)
    column = np.full(len(kinds), -1)
    column[wide] = np.arange(len(wide))
    at = column[token]
    for start in range(0, len(wide), step := max(1, PRODUCT_BYTES // (4 * n))):
        mine = (at >= start) & (at < start + step)
        dense = np.zeros((n, min(step, len(wide) - start)), np.float32)
        dense[owner[mine], at[mine] - start] = 1
        out += np.rint(dense @ dense.T).astype(np.int32)
    for i in range(n):
        t = token[ends[i] - sizes[i] : ends[i]]
        t = t[(column[t] < 0) & (count[t] > 1)]
        if len(t):
            c = count[t]
            where = np.repeat(first[t] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
            out[i] += np.bincount(posting[where], minlength=n)
    return out


def exact_links(dealt: DataFrame, threshold: float) -> DataFrame:
    """cid, linked (documents of other classes at the threshold or above), and forest edges as cid, other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes | None, int]] = []
        for rows in _grouped(batches, ["task", "cid", "side", "alone", "weight", "tokens"]):
            rows = list({r[1]: r for r in rows}.values())
            own, alone = [np.frombuffer(r[5], np.uint64) for r in rows], rows[0][3]
            sizes, sides, weights = np.array(list(map(len, own))), np.array([r[2] for r in rows]), np.array([r[4] for r in rows])
            linked, forest = np.zeros(len(rows), np.int64), Forest(len(rows))
            for i, both in enumerate(intersections(own)):
                likes = both >= threshold * (sizes + sizes[i] - both) - 1e-9
                likes[: i + 1] = False
                if not alone:
                    likes &= sides != sides[i]
                found = np.flatnonzero(likes)
                linked[i] += weights[found].sum()
                linked[found] += weights[i]
                for j in found.tolist():
                    forest.join(i, j)
            out += [(r[1], None, int(x)) for r, x in zip(rows, linked, strict=True) if x]
            out += [(rows[a][1], rows[b][1], 0) for a, b in forest.edges]
            if len(out) > 50_000:
                yield _rows(out)
        yield _rows(out)

    def _rows(out: list) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["cid", "other", "linked"])
        out.clear()
        return batch

    dealt = dealt.select("task", "cid", "side", "alone", "weight", "tokens").repartition("task").sortWithinPartitions("task", "cid")
    return dealt.mapInArrow(released(run), "cid binary, other binary, linked long")


def candidates(classes: DataFrame, plan: Plan) -> DataFrame:
    """cid and root: the candidate groups of classes (cid, n, sig)."""
    nodes, buckets = split(classes.select("cid", "sig"), plan), None
    for level in range(1, DEPTH + 1):
        nodes = written(nodes, f"nodes{level}")
        sizes = nodes.groupBy("run", "path").agg(F.count("*").alias("n_members")).where("n_members > 1")
        shared = nodes.join(sizes, ["run", "path"])
        small = shared if level == DEPTH else shared.where(F.col("n_members") <= BUCKET)
        buckets = small if buckets is None else buckets.unionByName(small)
        if level == DEPTH or not sizes.where(F.col("n_members") > BUCKET).limit(1).count():
            break
        nodes = split(shared.where(F.col("n_members") > BUCKET).join(classes.select("cid", "sig"), "cid").select("run", "path", "cid", "sig"), plan)
    buckets = buckets.withColumn("key", F.xxhash64("run", "path"))
    once = buckets.where(F.col("n_members") <= SIGNATURES).select(F.col("key").alias("task"), F.lit(0).cast("byte").alias("side"), F.lit(True).alias("alone"), "cid")
    more = buckets.where(F.col("n_members") > SIGNATURES).select("key", "cid").join(classes.select("cid", "n"), "cid")
    more = tasks(placed(more, "key", plan, SIGNATURES), "key").select(*once.columns)
    return components(candidate_edges(once.unionByName(more).join(classes.select("cid", "sig"), "cid"), plan)).withColumnRenamed("node", "cid")


def row_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """id, th and cid of every row, its class's least (id, th) as `least`, and n_links; cid and least are null for rows without words."""
    plan = Plan(threshold)
    rows = written(sets(docs, plan, text, doc_id, words), "sets")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min(F.struct("id", "th")).alias("first"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(classes, "classes")
    groups = cut(candidates(classes, plan).join(classes.drop("sig"), "cid"))
    wanted = placed(groups.select("root", "cid", "n", "first", "weight"), "root", plan, BLOCK, BLOCK_TOKENS)
    wanted = cut(wanted.select("first.id", "first.th", "cid", "root", "weight", "level", "own", "cuts", "above", "below"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_MEMBERS else wanted
    mine = docs.select(*keyed(docs, text, doc_id), F.col(text).alias("text")).join(side, ["id", "th"]).drop("id", "th")
    passed = [c for c in mine.columns if c != "text"]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Known(), set()  # copies of a row come once from each task
        for batch in blocks(batches):
            good, own = [], []
            for i, (body, cid) in enumerate(zip(batch.column("text").to_pylist(), batch.column("cid").to_pylist(), strict=True)):
                if cid not in seen:
                    seen.add(cid)
                    good.append(i)
                    own.append(shingles(body, known, words).tobytes())
            held = [batch.column(c).take(pa.array(good, pa.int32())) for c in passed]
            yield pa.RecordBatch.from_arrays([*held, pa.array(own, pa.binary())], names=[*passed, "tokens"])

    whole = mine.mapInArrow(released(again), mine.drop("text").schema.add("tokens", "binary"))
    found = cut(exact_links(tasks(whole, "root"), threshold))
    linked = found.where("other is null").groupBy("cid").agg(F.sum("linked").alias("linked"))
    roots = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cid")
    own = classes.drop("sig").join(roots, "cid", "left").join(linked, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = own.groupBy("root").agg(F.min("first").alias("least"))
    own = own.join(least, "root").select("cid", "least", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    every = rows.select("id", "th", "cid")
    alone = every.where("cid is null").withColumns({"least": F.lit(None).cast(own.schema["least"].dataType), "n_links": F.lit(0).cast("long")})
    return every.where("cid is not null").join(own, "cid").select(*alone.columns).unionByName(alone)


def jaccard_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id that links lead to) and n_links (other documents at the threshold)."""
    shown = F.when(F.col("id") == NO_ID, None).otherwise(F.col("id"))
    return row_classes(docs, text, doc_id, words, threshold).select(shown.alias("doc_id"), F.coalesce("least.id", "id").alias("class_id"), "n_links")


def one_of_each(docs: DataFrame, broadcast_rows: int = 1_000_000, **how) -> DataFrame:
    """docs with exactly one row of each class, that of the least id and text hash; rows without words all stay.

    Of rows that repeat both id and text one stays, the least by a hash of its other columns.
    """
    text, doc_id = how.get("text", "text"), how.get("doc_id", "doc_id")
    if clash := sorted({"_id", "_th", "_row"} & set(docs.columns)):
        raise ValueError(f"the input already has columns {clash}")
    told = row_classes(docs, **how).where("cid is not null").select(F.col("id").alias("_id"), F.col("th").alias("_th"), ((F.col("id") == F.col("least.id")) & (F.col("th") == F.col("least.th"))).alias("stays"))
    told = cut(told.groupBy("_id", "_th").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    side = F.broadcast(told) if told.count() <= broadcast_rows else told  # 16 bytes a row
    key = ["_id", "_th"]
    rows = docs.withColumns(dict(zip(key, keyed(docs, text, doc_id), strict=True)))
    once = rows.join(side.select(*key), key, "left_anti").select(*docs.columns)
    simple = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    again = rows.join(side.where("stays").select(*key), key, "left_semi").groupBy(*key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*simple)).alias("_row"))
    return once.unionByName(again.select("_row.*"))
