"""Operator 6, language ID by rank-order profiles.

A profile lists a language's most frequent n-grams (one to three letters, words bounded by a blank) by
falling count. A document's own ranking is held against each profile: every n-gram adds the distance
between its two ranks, or the greatest distance if the profile lacks it. The language with the least
sum wins; ties go to the first name.

Defined cases: a null text, or one without a letter, is `und` with score 0; a null id is never learned
from and is not held out; an empty learning set makes every row `und`; repeated rows are rows of their own.
Letters beyond U+7FFF share 15-bit codes by a fixed rule, so memory for a text is 8 bytes an n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emendata.llm.common import blocks, id_remainder, released

UND = "und"
#: n-grams of a profile and of a document's ranking.
PROFILE_SIZE = 400
#: Expected learning texts of a language, chosen by the hash of their ids; the bound of the fit.
LEARN_PER_LANGUAGE = 3000


def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint16)
    for point in range(0x32000):  # no letters are assigned beyond, but for private use
        if chr(point).isalpha():
            table[point] = point if point < 0x8000 else 1 + (point * 40503 >> 3) % 0x7FFF
    return table


_TABLE: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of the text's lower-cased words, each word between blanks."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.zeros(len(points) + 2, np.int64)
    codes[1:-1] = _TABLE[0][points]
    blank = codes == 0
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])  # one blank between words
    codes = codes[keep]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    ones = codes[codes > 0] | (1 << 45)
    twos = (codes[:-1] << 15 | codes[1:]) | (2 << 45)
    threes = (a << 30 | b << 15 | c)[b > 0] | (3 << 45)
    return np.concatenate([ones, twos, threes])


def ranking(text: str, size: int) -> np.ndarray:
    """The text's most frequent n-grams by falling count, ties by code."""
    codes = np.sort(grams(text))
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, int)
    counts = np.diff(np.append(starts, len(codes)))
    kinds = codes[starts]
    if len(kinds) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        kinds, counts = kinds[counts >= least], counts[counts >= least]
    return kinds[np.argsort(-counts, kind="stable")][:size]


def has_letter(text: str | None) -> bool:
    return bool(text) and (text[:64].isalpha() or any(map(str.isalpha, text)))


class Profiles:
    """Rankings of the learned languages, and their distances to texts."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.names, self.size = sorted(ranked), size
        kinds = sorted({g for grams_ in ranked.values() for g in grams_})
        self.kinds = np.array(kinds, np.int64)
        self.ranks = np.full((len(kinds) + 1, len(self.names)), -1, np.int32)
        at = {g: i for i, g in enumerate(kinds)}
        for k, name in enumerate(self.names):
            for rank, g in enumerate(ranked[name]):
                self.ranks[at[g], k] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not has_letter(text):
            return UND, 0.0
        own = ranking(text, self.size)
        if not len(own):
            return UND, 0.0
        i = np.searchsorted(self.kinds, own)
        i[i == len(self.kinds)] = 0
        i[self.kinds[i] != own] = len(self.kinds)
        ranks = self.ranks[i]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None]))
        sums = apart.sum(0)
        best = int(np.argmin(sums))
        return self.names[best], float(1 - sums[best] / (self.size * len(own)))


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", size: int = PROFILE_SIZE,
    per_language: int = LEARN_PER_LANGUAGE,
) -> Profiles:
    """Profiles from rows with a language whose id's remainder isn't 1; about per_language rows each, by the id's hash."""
    mine = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    mine = mine.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder() != 1))
    counts = {r["lang"]: r["n"] for r in mine.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles({}, size)
    draw = F.crc32(F.concat(F.lit("learn:"), F.col("doc_id").cast("string")).cast("binary")) / F.lit(float(2**32))
    share = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, per_language / n)))])
    chosen = mine.where(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[int, int]] = {}
        for batch in blocks(batches):
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                kinds, n = np.unique(grams(body), return_counts=True)
                own = found.setdefault(name, {})
                for g, k in zip(kinds.tolist(), n.tolist(), strict=True):
                    own[g] = own.get(g, 0) + k
            if sum(map(len, found.values())) > 500_000:
                yield from flush(found)
        yield from flush(found)

    def flush(found: dict[str, dict[int, int]]) -> Iterator[pa.RecordBatch]:
        for name, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])
        found.clear()

    sums = chosen.mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").collect():  # `size` rows a language
        out.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(out, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with lang_pred and score."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    for name in ("lang_pred", "score"):
        if name in keep:
            raise ValueError(f"the input already has a column {name}; leave it out of keep")
    plain = docs.select(*keep, F.col(text).alias("_text"))
    schema = plain.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            said = [profiles.predict(x) for x in batch.column("_text").to_pylist()]
            held = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*held, pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())], names=[*keep, "lang_pred", "score"])

    return plain.mapInArrow(released(predict), schema)


def language_rows(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score."""
    base = docs.select("doc_id", F.coalesce(id_remainder() == 1, F.lit(False)).alias("held_out"), "text")
    return identify(base, learn(docs), keep=["doc_id", "held_out"])


def accepted(docs: DataFrame, least_score: float = 0.25) -> DataFrame:
    """The rows of docs in a learned language: not `und`, and nearer its profile than least_score.

    Where nothing could be learned, the rows with a letter.
    """
    profiles = learn(docs)
    if not profiles.names:
        return docs.where(F.col("text").rlike("\\p{L}"))
    told = identify(docs, profiles, keep=docs.columns)
    return told.where((F.col("lang_pred") != UND) & (F.col("score") >= least_score)).select(*docs.columns)
