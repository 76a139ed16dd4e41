"""Scoring corrections against references, and choosing a policy from the scores: relational over arrays of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emendata.functions import tags as tag_language
from emendata.functions import text as T

EDITS = "array<struct<start:int,stop:int,tokens:array<string>>>"
_edits = T.over_arrow(lambda a, b: [{"start": i, "stop": j, "tokens": list(t)} for i, j, t in tag_language.edits(a, b)], EDITS)
_normalized = T.over_arrow(T.normalized, "string")


def edits_of(source: str | Column, target: str | Column) -> Column:
    """C17, L1: the default scorer."""
    return _edits(F.col(source) if isinstance(source, str) else source, F.col(target) if isinstance(target, str) else target)


#: L1, L2: scorers by name; callers add their own (source and other text to an array of edits).
SCORERS = {"approximate": edits_of}


def scorer(name: str):
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name}; there are {sorted(SCORERS)}")
    return SCORERS[name]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(1.0)).otherwise(a.cast("double") / b)


def edit_metrics(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """H1: precision and recall of edits, 1 where undefined, and their F0.5."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"edit_precision": p, "edit_recall": r, "edit_f0_5": F.lit(1.25) * p * r / F.greatest(F.lit(1e-12), F.lit(0.25) * p + r)}


def corpus_f05(tp: Column, fp: Column, fn: Column) -> Column:
    """H3: F0.5 from counts at once; 1 where there is nothing to find and nothing was found."""
    return F.when(tp + fp + fn == 0, F.lit(1.0)).otherwise(F.lit(1.25) * tp / (F.lit(1.25) * tp + fp + F.lit(0.25) * fn))


def padded(ids: Column, multiple: int = 8) -> dict[str, Column]:
    """Ids filled with zeros up to a multiple, and the mask of the real ones."""
    n = (F.ceil(F.size(ids) / F.lit(multiple)) * multiple).cast("int") - F.size(ids)
    fill = lambda x: F.array_repeat(F.lit(x), n)
    return {"ids": F.concat(ids, fill(0)), "mask": F.concat(F.transform(ids, lambda _: F.lit(1)), fill(0))}


def best_references(rows: DataFrame, by: str = "approximate") -> DataFrame:
    """For each row the counts against its best reference: by F0.5, then most true, fewest false, fewest missed edits, then the first.

    rows: id, source, references, corrected, category. Every distinct pair of texts is aligned once.
    """
    each = rows.select("id", "source", "corrected", "category", F.posexplode("references").alias("ref", "reference"))
    pairs = each.select("source", F.col("corrected").alias("other")).unionByName(each.select("source", F.col("reference").alias("other"))).distinct()
    aligned = pairs.withColumns({"edits": scorer(by)("source", "other"), "same": _normalized(F.col("source")) == _normalized(F.col("other"))})
    side = lambda name, edits, same: aligned.select("source", F.col("other").alias(name), F.col("edits").alias(edits), F.col("same").alias(same))
    each = each.join(side("corrected", "p", "unchanged"), ["source", "corrected"]).join(side("reference", "g", "clean"), ["source", "reference"])
    tp, fp, fn = F.size(F.array_intersect("p", "g")), F.size(F.array_except("p", "g")), F.size(F.array_except("g", "p"))
    each = each.withColumns({"tp": tp.cast("long"), "fp": fp.cast("long"), "fn": fn.cast("long")})
    each = each.withColumns({"f": edit_metrics(F.col("tp"), F.col("fp"), F.col("fn"))["edit_f0_5"], "exact": _normalized(F.col("corrected")) == _normalized(F.col("reference"))})
    best = F.max(F.struct("f", "tp", (-F.col("fp")).alias("a"), (-F.col("fn")).alias("b"), (-F.col("ref")).alias("c"))).alias("best")
    out = each.groupBy("id", "category").agg(best, F.bool_or("clean").alias("clean"), F.bool_or("exact").alias("exact"), F.bool_and("unchanged").alias("unchanged"))
    return out.select("id", "category", "best.tp", (-F.col("best.a")).alias("fp"), (-F.col("best.b")).alias("fn"), (-F.col("best.c")).cast("int").alias("reference"), "clean", (F.col("clean") & ~F.col("unchanged")).alias("clean_changed"), "exact")


def corpus_scores(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Sums over rows of best_references, for all and, given a column, by its values."""
    n = lambda c: F.count_if(F.col(c))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")] + [F.count("*").alias("sentences"), n("exact").alias("exact"), n("clean").alias("clean_sentences"), n("clean_changed").alias("clean_changed")]
    grouped = scored.groupingSets([[], [F.col(by)]], F.col(by)) if by else scored.groupBy()
    out = grouped.agg(*sums)
    rate = F.when(F.col("clean_sentences") > 0, F.col("clean_changed") / F.col("clean_sentences"))
    return out.withColumns(edit_metrics(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("clean_rate", rate)


def qualified(precision: float = 0.95, clean: float = 0.02, support: int = 25, suffix: str = "") -> Column:
    c = lambda name: F.col(name + suffix)
    return (c("predicted_edits") >= max(support, 1)) & (c("inference_failures") == 0) & (c("edit_precision") >= precision) & F.coalesce(c("clean_rate") <= clean, F.lit(False))


def choose(candidates: DataFrame, **policy) -> DataFrame:
    """The threshold of the highest F0.5 among qualified candidates, the higher of equals; null if none qualifies."""
    best = F.max(F.when(qualified(**policy), F.struct("edit_f0_5", "threshold")))
    free = F.max(F.struct("edit_f0_5", "threshold"))
    return candidates.agg(best.alias("b"), free.alias("f")).select(F.col("b.threshold").alias("selected"), F.col("f.threshold").alias("unconstrained"), F.col("b").isNull().alias("disabled"))


def choose_joint(int8: DataFrame, fp32: DataFrame, **policy) -> DataFrame:
    """The threshold at which both candidates qualify with the best lesser F0.5."""
    other = fp32.select("threshold", *[F.col(c).alias(f"{c}_b") for c in ("predicted_edits", "inference_failures", "edit_precision", "clean_rate", "edit_f0_5")])
    both = int8.join(other, "threshold", "full").where(qualified(**policy) & qualified(suffix="_b", **policy))
    best = both.agg(F.max(F.struct(F.least("edit_f0_5", "edit_f0_5_b").alias("f"), "threshold")).alias("b"))
    return best.select(F.col("b.threshold").alias("selected"), F.col("b").isNull().alias("disabled"))


def ascend(support: dict[str, int], start: float, grid: list[float], measure, least: int = 20) -> tuple[dict[str, float], float]:
    """Category thresholds above the start, in order of names and grid, each kept if the measured F0.5 rises (measure gives None where the policy fails).

    The loop is over the grid alone; `measure` is a query over all rows.
    """
    chosen, best = {}, measure({})
    for name in sorted(k for k, n in support.items() if n >= least):
        for t in (t for t in grid if t > start):
            got = measure({**chosen, name: t})
            if got is not None and (best is None or got > best):
                chosen, best = {**chosen, name: t}, got
    return chosen, best


FLAGS = ("meaning_preserved", "errors_resolved", "no_new_errors", "necessary_edits_only", "protected_text_preserved")


def flags_reward(flags: Column) -> Column:
    """The share of flags that hold, 0 where meaning or protected text is lost."""
    n = sum((flags[x].cast("int") for x in FLAGS), F.lit(0))
    return F.when(flags["meaning_preserved"] & flags["protected_text_preserved"], n / F.lit(5.0)).otherwise(0.0)


def calibration(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Agreement of two rounds of verdicts with the expected flags and each other; unsafe rewards; passing or not.

    cases: id, expected; verdicts: id, round (0 or 1), flags.
    """
    rows = cases.join(verdicts, "id")
    right = sum(((F.col(f"flags.{x}") == F.col(f"expected.{x}")).cast("int") for x in FLAGS), F.lit(0))
    unsafe = (~F.col("expected.meaning_preserved") | ~F.col("expected.protected_text_preserved")) & (flags_reward(F.col("flags")) > 0)
    critical = sum(((~F.col(f"expected.{x}") & F.col(f"flags.{x}")).cast("int") for x in (FLAGS[0], FLAGS[4])), F.lit(0))
    rounds = rows.groupBy("round").agg((F.sum(right) / (5 * F.count("*"))).alias("agreement"), F.count_if(unsafe).alias("unsafe"), F.sum(critical).alias("critical"))
    pair = verdicts.groupBy("id").agg(F.min_by("flags", "round").alias("a"), F.max_by("flags", "round").alias("b"))
    same = sum(((F.col(f"a.{x}") == F.col(f"b.{x}")).cast("int") for x in FLAGS), F.lit(0))
    repeat = pair.agg((F.sum(same) / (5 * F.count("*"))).alias("repeat_agreement"))
    out = rounds.agg(F.min("agreement").alias("least_agreement"), F.sum("unsafe").alias("unsafe"), F.sum("critical").alias("critical")).join(F.broadcast(repeat))  # one row each
    passed = (F.col("least_agreement") >= 0.95) & (F.col("repeat_agreement") >= 0.98) & (F.col("unsafe") == 0) & (F.col("critical") == 0)
    return out.withColumn("passed", passed)


def chain_breaks(log: DataFrame) -> DataFrame:
    """Entries of a hash-chained log whose previous hash is not that of the entry before (64 zeros for the first), or whose own hash is wrong.

    log: ordinal, previous_sha256, body, entry_sha256; an entry's hash is of `previous` and body. A neighbour comes by ordinal, so that no task sorts the log.
    """
    before = log.select((F.col("ordinal") + 1).alias("ordinal"), F.col("entry_sha256").alias("_before"))
    rows = log.join(before, "ordinal", "left")
    linked = F.col("previous_sha256") == F.coalesce("_before", F.lit("0" * 64))
    own = F.col("entry_sha256") == F.sha2(F.concat("previous_sha256", F.lit("\n"), "body"), 256)
    return rows.select("ordinal", F.when(~linked, "chain").when(~own, "entry").alias("fault")).where("fault is not null")


def stage_join(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """Id and fault (missing, extra, repeated) of ids that do not match one to one."""
    a, b = (x.groupBy("id").agg(F.count("*").alias(name)) for x, name in ((wanted, "a"), (got, "b")))
    fault = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when((F.col("a") > 1) | (F.col("b") > 1), "repeated")
    return a.join(b, "id", "full").select("id", fault.alias("fault")).where("fault is not null")


def matched_predictions(population: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions with their rows; id, place and hash of the source must agree, or the row has a fault."""
    rows = population.select("id", "index", F.sha2("source", 256).alias("_sha"), "source").join(predictions.select("id", F.col("index").alias("_i"), "sourceSha256", "corrected"), "id", "full")
    fault = F.when(F.col("_i").isNull() & F.col("sourceSha256").isNull(), "missing").when(F.col("index").isNull(), "extra").when(F.col("index") != F.col("_i"), "order").when(F.col("_sha") != F.col("sourceSha256"), "source")
    return rows.select("id", "source", "corrected", fault.alias("fault"))
