"""Operator 10, quality rules by distribution divergence.

Base rules count words, symbols, repeated lines and repeated three-word windows. The method then holds a
text's histogram of character classes, and its histogram of common words, against the reference histograms
of each language, learned from rows labelled good, by the Jensen-Shannon distance. The nearest reference
counts; a text farther from it than the learned limit is not kept. Histograms of fewer than `min_chars`
characters or `min_words` words say too little and are not judged (the length guards).

Defined cases: a null text has no words and fails the base rules; without any labelled row only the base
rules decide; repeated rows are rows of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emendata.llm.common import blocks, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACES = " \t\n\v\f\r"
_SYMBOLS = re.compile(r"[#*$%&|<>]+")
#: Character classes of the histogram, by code below 128; other characters are letters or `other`.
CLASSES = ["lower", "upper", "digit", "blank", "line", "stop", "quote", "dash", "mark", "symbol", "bar", "other"]
#: Expected labelled rows to learn from; common words of a reference.
LEARN_ROWS, COMMON_WORDS = 20_000, 100
#: Without rows labelled bad, a limit is the distance that this share of the good rows stays below, times the slack.
LIMIT_AT, SLACK = 0.999, 1.15
#: With them, it is the distance with the least loss, a good row lost counting as so many bad rows kept.
GOOD_LOST = 20
#: A histogram of n characters or words lies sqrt(n / (n + SMALL)) times its distance off: small ones scatter.
SMALL = 200


def _classes() -> np.ndarray:
    table = np.full(0x10000, CLASSES.index("other"), np.uint8)
    for point in range(0x10000):
        c = chr(point)
        if c == "\n":
            kind = "line"
        elif c.isspace():
            kind = "blank"
        elif c.isdigit():
            kind = "digit"
        elif c.isupper():
            kind = "upper"
        elif c.isalpha():
            kind = "lower"
        elif c in ".,;:":
            kind = "stop"
        elif c in "'\"()[]{}’‘“”«»":
            kind = "quote"
        elif c in "-_/–—":
            kind = "dash"
        elif c in "!?¡¿":
            kind = "mark"
        elif c in "|":
            kind = "bar"
        elif point < 128:
            kind = "symbol"
        else:
            kind = "other"
        table[point] = CLASSES.index(kind)
    return table


_TABLE: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_TABLE[0][np.minimum(points, 0xFFFF)], minlength=len(CLASSES))


def base_counts(text: str | None) -> list[int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII spaces alone
    n = len(words)
    lines = text.split("\n")
    real = [x for x in lines if x.strip(_SPACES)]
    repeated = 0
    if n > 3 and len(set(words)) < n:
        ids: dict[bytes, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
        k = np.int64(len(ids))
        if len(ids) < 2_000_000:  # the code of a window is below 2**63
            codes = (w[:-2] * k + w[1:-1]) * k + w[2:]
        else:
            two = np.unique(w[:-2] * k + w[1:-1], return_inverse=True)[1].astype(np.int64)
            codes = two * k + w[2:]
        order = np.argsort(codes, kind="stable")
        same = codes[order[1:]] == codes[order[:-1]]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for i in range(3):
                covered[i : n - 2 + i] |= twice
            repeated = int(covered.sum())
    return [n, len(text) - sum(map(text.count, _SPACES)), sum(map(len, _SYMBOLS.findall(text))), len(real) - len(set(real)), repeated]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def bare(word: str) -> str:
    return word.strip(".,;:!?'\"()").lower()


def words_of(text: str) -> list[str]:
    return [bare(x) for x in text.split()]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2, from 0 to 1) of histograms along the last axis."""
    p, q = a / np.maximum(a.sum(-1, keepdims=True), 1), b / np.maximum(b.sum(-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(0.0, d / 2))


class Places(dict):
    """Word as written to its place among the common words (their number for all others), remembered (200,000 words at most)."""

    def __init__(self, at: dict[str, int]):
        self.at = at

    def __missing__(self, word: str) -> int:
        place = self.at.get(bare(word), len(self.at))
        if len(self) < 200_000:
            self[word] = place
        return place


@dataclass
class References:
    """Per language: class histogram, common words and their histogram (the last place: all other words)."""

    classes: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[str, list[str]] = field(default_factory=dict)
    shares: dict[str, np.ndarray] = field(default_factory=dict)
    class_limit: float = 1.0
    word_limit: float = 1.0
    min_chars: int = 200
    min_words: int = 50

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, Places]:
        """Class histograms, word histograms, the places of each language's words and the places of all words; made once in a process."""
        if "_tables" not in self.__dict__:
            at: dict[str, int] = {}
            for w in (w for own in self.words.values() for w in own):
                at.setdefault(w, len(at))
            most = max(map(len, self.words.values()), default=0)
            places, shares = np.full((len(self.words), most), len(at) + 1), np.zeros((len(self.words), most + 1))
            for i, (name, own) in enumerate(self.words.items()):
                places[i, : len(own)] = [at[w] for w in own]
                shares[i, : len(own)], shares[i, -1] = self.shares[name][:-1], self.shares[name][-1]
            self.__dict__["_tables"] = np.array(list(self.classes.values())), shares, places, Places(at)
        return self.__dict__["_tables"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def distances(self, text: str | None) -> tuple[float | None, float | None]:
        """To the nearest reference: of classes and of words; None where a guard holds or nothing was learned."""
        text = text or ""
        if not self.classes or len(text) < self.min_chars:
            return None, None
        classes, shares, places, known = self.tables()
        near = float(distances(class_counts(text).astype(float), classes).min()) * (len(text) / (len(text) + SMALL)) ** 0.5
        words = text.split()
        n = len(words)
        if n < self.min_words or not len(places):
            return near, None
        counts = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, n), minlength=len(known.at) + 2)
        counts[-1] = 0  # the place of what a shorter list lacks
        own = np.empty_like(shares)
        own[:, :-1] = counts[places]
        own[:, -1] = n - own[:, :-1].sum(1)
        return near, float(distances(own, shares).min()) * (n / (n + SMALL)) ** 0.5

    def accepts(self, classes: float | None, words: float | None) -> bool:
        return (classes is None or classes <= self.class_limit) and (words is None or words <= self.word_limit)


def limit(good: list[float], bad: list[float]) -> float:
    """The distance up to which texts are kept, from quantiles of good and bad rows."""
    if not good:
        return 1.0
    if not bad:
        return min(1.0, float(np.quantile(good, LIMIT_AT)) * SLACK)
    g, b = np.sort(good), np.sort(bad)
    tried = np.append(np.unique(np.concatenate((g, b))), 1.0)
    lost = GOOD_LOST * (len(g) - np.searchsorted(g, tried, "right")) / len(g) + np.searchsorted(b, tried, "right") / len(b)
    best = np.flatnonzero(lost <= lost.min() + 1e-12)
    return float((tried[best[0]] + tried[best[-1]]) / 2)  # the middle of the least losses


def fit(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS, common: int = COMMON_WORDS, min_chars: int = 200, min_words: int = 50) -> References:
    """References and limits from a hash-chosen sample of about learn_rows labelled rows; references from good ones (quality 1)."""
    told = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = told.count()
    draw = F.crc32(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")).cast("binary")) / F.lit(float(2**32))
    share = min(1.0, learn_rows / max(n, 1))
    both = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull()).where(draw < share).join(told.where(draw < share), "doc_id")
    both = written(both, "labelled")
    rows = both.where((F.col("quality") == 1) & F.col("lang").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, str], int] = {}
        for batch in blocks(batches):
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for i, k in enumerate(class_counts(body).tolist()):
                    found[name, "class", str(i)] = found.get((name, "class", str(i)), 0) + k
                for w, k in Counter(words_of(body)).items():
                    found[name, "word", w] = found.get((name, "word", w), 0) + k
            if len(found) > 300_000:
                yield flush(found)
        yield flush(found)

    def flush(found: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
        keys = list(found)
        out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(found.values()), pa.int64())], names=["lang", "kind", "item", "n"])
        found.clear()
        return out

    sums = written(rows.mapInArrow(count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "histograms")
    totals = {(r["lang"], r["kind"]): r["n"] for r in sums.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    # each task's first ones alone are shuffled, as the rank has a limit
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))).where(F.col("rank") <= max(common, len(CLASSES)))
    own = References(min_chars=min_chars, min_words=min_words)
    for r in ranked.orderBy("lang", "kind", "rank").collect():  # 12 + common rows a language
        name = r["lang"]
        if r["kind"] == "class":
            own.classes.setdefault(name, np.zeros(len(CLASSES)))[int(r["item"])] = r["n"]
        elif r["rank"] <= common:
            own.words.setdefault(name, []).append(r["item"])
            own.shares[name] = np.append(own.shares.get(name, np.zeros(0)), r["n"])
    for name, found in own.shares.items():
        own.shares[name] = np.append(found, totals[name, "word"] - found.sum())
    if own.classes:
        steps = [k / 2000 for k in range(2001)]
        near = judged(both.select("text", "quality"), own, keep=["quality"]).where(~F.col("base_failed"))
        found = near.groupBy("quality").agg(F.percentile_approx("class_distance", steps, 20_000).alias("c"), F.percentile_approx("word_distance", steps, 20_000).alias("w")).collect()
        own.class_limit, own.word_limit = (limit(*[next((list(r[k]) for r in found if (r["quality"] == 1) == good and r[k]), []) for good in (True, False)]) for k in ("c", "w"))
    return own


def judged(docs: DataFrame, references: References, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, the base counts, class_distance, word_distance, base_failed and kept."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    made = [*COUNTS, "class_distance", "word_distance", "base_failed", "kept"]
    if clash := sorted(set(keep) & set(made)):
        raise ValueError(f"the input already has columns {clash}; leave them out of keep")
    plain = docs.select(*keep, F.col(text).alias("_text"))
    schema = plain.drop("_text").schema
    for name in made:
        schema = schema.add(name, "long" if name in COUNTS else "boolean" if name in made[-2:] else "double")

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            counts = [base_counts(x) for x in texts]
            near = [references.distances(x) for x in texts]
            failed = [base_failed(x[0], x[4]) for x in counts]
            kept = [not f and references.accepts(*d) for f, d in zip(failed, near, strict=True)]
            own = [pa.array([x[i] for x in counts], pa.int64()) for i in range(5)] + [pa.array([d[i] for d in near], pa.float64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *own, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=[*keep, *made])

    return plain.mapInArrow(rules, schema)


def quality_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows."""
    return judged(docs, fit(docs, labels), keep=["doc_id"])
