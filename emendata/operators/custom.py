"""Operators that relational functions can't express: sequence alignment, bounded edit distance, greedy folds."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emendata.session import shipped


def osa_distance(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance (adjacent transpositions), limit + 1 beyond the limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j - 1] + 1, before[j] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


def edits(source: list[str], target: list[str]) -> list[tuple[int, int, list[str]]]:
    """Spans of source and what replaces them, by the standard sequence matcher."""
    return [(i, j, list(target[k:n])) for op, i, j, k, n in SequenceMatcher(None, source, target, autojunk=False).get_opcodes() if op != "equal"]


def _embedded(short: list[str], long: list[str]) -> list[list[str]] | None:
    """What of long stands before, between and after the tokens of short, each of which is taken where it comes last; null if long doesn't hold them in order."""
    at, gaps = len(short), [[]]
    for x in reversed(long):
        if at and x == short[at - 1]:
            at -= 1
            gaps.append([])
        else:
            gaps[-1].append(x)
    return None if at else [gap[::-1] for gap in reversed(gaps)]


def fitting_edits(source: list[str], target: list[str], most: int = 4) -> list[tuple[int, int, list[str]]]:
    """The edits of two texts of which one holds the other: deletions or insertions alone. Of others, edits.

    The matcher takes the longest equal run first, also where it lies some tokens aside among repeated words, and puts
    in there what it has passed by. Where what stands before the first token and after it is more than most tokens,
    they are put with the tokens that follow, most to each.
    """
    if len(target) < len(source):
        gaps, at, plain = _embedded(target, source), 0, []
        for gap in gaps or []:
            if gap:
                plain.append((at, at + len(gap), []))
            at += len(gap) + 1
        return edits(source, target) if gaps is None else plain
    gaps = _embedded(source, target)
    if not source or gaps is None:
        return edits(source, target)
    plain = [(k, k, gap) for k, gap in enumerate(gaps) if gap]
    if not gaps[0] or len(gaps[0]) + len(gaps[1]) <= most or max(map(len, gaps)) > most:
        return plain
    words = list(gaps[0])
    for k, word in enumerate(source, 1):
        words += [word, *gaps[k]]
        if len(words) <= most * k:
            return [(0, k, words), *(e for e in plain if e[0] > k)]
    return plain


def applied(source: list[str], changes: list[tuple[int, int, list[str]]]) -> list[str]:
    out, at = [], 0
    for i, j, words in changes:
        out += [*source[at:i], *words]
        at = j
    return out + list(source[at:])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])))
def edits_udf(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([[{"start": i, "stop": j, "words": w} for i, j, w in edits(list(a), list(b))] for a, b in zip(source, target, strict=True)])


@F.pandas_udf(edits_udf.returnType)
def joined_edits_udf(source: pd.Series, target: pd.Series) -> pd.Series:
    """edits_udf over tokens joined by blanks; null where they are."""
    return _joined(edits, source, target)


@F.pandas_udf(edits_udf.returnType)
def joined_fitting_edits_udf(source: pd.Series, target: pd.Series) -> pd.Series:
    """fitting_edits likewise."""
    return _joined(fitting_edits, source, target)


def _joined(make: Callable, source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else [{"start": i, "stop": j, "words": w} for i, j, w in make(a.split(" ") if a else [], b.split(" ") if b else [])] for a, b in zip(source, target, strict=True)], dtype=object)


@F.pandas_udf(T.IntegerType())
def osa_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa_distance(x, y, 2) for x, y in zip(a, b, strict=True)])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emendata.plans.catalog import derived_pairs

    return _tokenized(derived_pairs(spark, sf_dir))


def _tokenized(rows: DataFrame) -> DataFrame:
    from emendata.plans.statements import TOKEN

    return rows.withColumns({c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)) for c in ("source", "target")})


def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: token edits of each pair that differs; each distinct pair is aligned once."""
    rows = _pairs(shipped(spark), sf_dir).where("source != target")
    each = rows.groupBy("source", "target").agg(F.collect_list("ordinal").alias("ordinals"))
    return each.withColumn("edits", edits_udf("source", "target")).select(F.explode("ordinals").alias("ordinal"), "edits")


#: Words of the dictionary.
KNOWN_WORDS = 20_000
#: Keys of known words (8 bytes and the word each) that may be broadcast; beyond, the join is shuffled.
BROADCAST_KEYS = 500_000


def deletion_keys(words: DataFrame, column: str, short: bool) -> DataFrame:
    """words with k: hashes of the word and of what is left of it after one and two deletions; if `short`, one alone for words below five letters."""
    one = lambda p: F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.concat(F.substring(p, F.lit(1), i - 1), F.substring(p, i + 1, F.lit(99))))
    less = lambda keys: F.array_distinct(F.flatten(F.transform(keys, lambda p: F.when(p == "", F.array(p)).otherwise(one(p)))))
    rows = words.withColumn("_0", F.array(column)).withColumn("_1", less(F.col("_0")))
    second = less(F.col("_1"))
    if short:
        second = F.when(F.length(column) >= 5, second).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.transform(F.concat("_0", "_1", second), lambda x: F.xxhash64(x)))
    return rows.withColumn("k", F.explode(every)).drop("_0", "_1")


def fuzzy_pairs(rare: DataFrame, common: DataFrame) -> DataFrame:
    """word, candidate, freq, distance: all pairs of rare (word) and common (candidate, freq) within two edits, one for words below five letters.

    Words so near share what is left after as many deletions each. Up to two single edits the distance is
    found natively; of pairs three or four apart those in which neighbours may have changed places reach Python.
    """
    limit = F.when(F.length("word") < 5, 1).otherwise(2)
    keys = deletion_keys(common, "candidate", False).cache()
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    found = deletion_keys(rare, "word", True).join(side, "k").where(F.abs(F.length("word") - F.length("candidate")) <= limit)
    same = F.array_sort(F.split("word", "")) == F.array_sort(F.split("candidate", ""))
    apart = lambda a, b: F.expr(f"length(translate({a}, {b}, ''))") <= 1
    # beyond two single edits: an exchange of neighbours and one more edit, or two exchanges
    moved = F.when(F.col("single") == 3, (F.abs(F.length("word") - F.length("candidate")) <= 1) & apart("word", "candidate") & apart("candidate", "word")).otherwise(same)
    found = found.withColumn("single", F.levenshtein("word", "candidate", 4)).where((F.col("single") >= 0) & ((F.col("single") <= 2) | ((limit == 2) & moved)))
    found = found.select("word", "candidate", "freq", "single").distinct()
    w = lambda i, n: F.substring("word", i, n)
    swapped = F.exists(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.concat(w(F.lit(1), i - 1), w(i + 1, F.lit(1)), w(i, F.lit(1)), w(i + 2, F.lit(99))) == F.col("candidate"))
    two = F.when(same & swapped, 1).otherwise(2)  # two single edits are one if they are an exchange of neighbours
    near = found.where("single <= 2").select("word", "candidate", "freq", F.when(F.col("single") == 2, two).otherwise(F.col("single")).alias("distance"))
    far = found.where("single > 2").select("word", "candidate", "freq", osa_udf("word", "candidate").alias("distance"))
    return near.unionByName(far).where(F.col("distance") <= limit)


def suggested(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """Word, candidate, distance: the nearest known word (candidate, freq), a doubled letter first, then by frequency; none where the next one as near is nearly as frequent."""
    found = fuzzy_pairs(unknown, known)
    doubled = F.exists(F.sequence(F.lit(1), F.length("candidate") - 1), lambda i: (F.substring("candidate", i, F.lit(1)) == F.substring("candidate", i + 1, F.lit(1))) & (F.concat(F.substring("candidate", F.lit(1), i), F.substring("candidate", i + 2, F.lit(99))) == F.col("word")))
    found = found.withColumn("plain", ~((F.col("distance") == 1) & (F.length("candidate") == F.length("word") + 1) & doubled))
    rank = F.struct("distance", "plain", (-F.col("freq")).alias("r"), "candidate")
    best = found.groupBy("word").agg(F.slice(F.sort_array(F.collect_list(rank)), 1, 2).alias("top"))
    first, second = F.col("top")[0], F.get("top", F.lit(1))
    alone = second.isNull() | (second["distance"] > first["distance"]) | (second["plain"] != first["plain"])
    sure = alone | (-first["r"] >= F.when(first["distance"] == 2, 4).otherwise(2) * -second["r"])
    return best.where(sure).select("word", first["candidate"].alias("candidate"), first["distance"].alias("distance"))


def fuzzy_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for the plain words of all documents outside of the dictionary (A17), among its words; the word counts are a table read twice."""
    from emendata.plans.catalog import spread

    docs = spread(shipped(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("word").rlike("^[a-z]{3,32}$")).cache()
    known = counts.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS)
    unknown = counts.join(F.broadcast(known.select("word")), "word", "left_anti").select("word")
    return suggested(unknown, known.withColumnsRenamed({"word": "candidate", "n": "freq"}))


#: A word, a gap and the word again; matches don't overlap, so `a a a` holds one.
REPEATED = r"(?i)(?<![A-Za-z0-9_])(?!(?:had|that)[ \t])([A-Za-z]+)([ \t]+)\1(?![A-Za-z0-9_])"


def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, I4 over the sentences of all documents: how many words each repeats."""
    from emendata.plans.catalog import sentence_rows

    rows = sentence_rows(shipped(spark), sf_dir).where(F.col("item").rlike(REPEATED))
    return rows.select("doc_id", "pos", F.size(F.regexp_extract_all("item", F.lit(REPEATED), F.lit(0))).cast("long").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"c17_align": align, "c18_e5_e6_fuzzy_spelling": fuzzy_spelling, "e3_i4_repeated_words": repeated_words}


def oracle_sql() -> dict[str, str]:
    """Repeated words by runs of equal words between blank gaps instead of a pattern with a back reference: every second one of a run."""
    from emendata.plans.dialect import Duck
    from emendata.plans.statements import sentences

    d = Duck()
    parts = d.explode(f"(SELECT doc_id, pos AS sent, item FROM ({sentences(d)}) s) u", "regexp_extract_all(item, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')", "doc_id, sent").replace("AS pos, unnest", "AS spot, unnest", 1)
    near = f"SELECT *, lag(lower(item)) OVER w AS gap, lag(lower(item), 2) OVER w AS before FROM ({parts}) p WINDOW w AS (PARTITION BY doc_id, sent ORDER BY spot)"
    words = f"SELECT *, before = lower(item) AND regexp_matches(gap, '^[ \\t]+$') AS again FROM ({near}) n WHERE regexp_matches(item, '^[A-Za-z]+$')"
    runs = f"SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sent ORDER BY spot) AS run FROM ({words}) v"
    placed = f"SELECT *, row_number() OVER (PARTITION BY doc_id, sent, run ORDER BY spot) AS k FROM ({runs}) r"
    return {"e3_i4_repeated_words": f"SELECT doc_id, sent AS pos, count(*) AS n FROM ({placed}) x WHERE k % 2 = 0 AND lower(item) NOT IN ('had', 'that') GROUP BY doc_id, sent"}
