"""Building a corpus of pairs: validation, keys, admission, decontamination, conflicts, samples, splits, labels.

A pair table has source and target; row order is an explicit ordinal. Exact keys (NFC, case folding) come over Arrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emendata.functions import text as T

_normalized, _key, _canonical, _keys, _family = (T.over_arrow(f, kind) for f, kind in ((T.normalized, "string"), (T.key, "string"), (T.canonical, "string"), (T.keys, "array<string>"), (T.lexical_family, "string")))
_BLANK = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
#: Categories, reasons' patterns and licences.
CATEGORIES = "agreement articles prepositions verb-tense spelling punctuation word-order clean mixed".split()
CONTACT = "https?://|[\\p{L}\\p{N}_][\\p{L}\\p{N}_.+-]*@[\\p{L}\\p{N}_.-]+\\.[a-zA-Z]{2,}(?:[^\\p{L}\\p{N}_]|$)|(?:^|[^\\p{L}\\p{N}_])(?:sk-|AKIA)[A-Za-z0-9]{12,}"
PERMISSIVE = "MIT Apache-2.0 CC0-1.0 CC-BY-4.0".split()


def normalized(x: str | Column) -> Column:
    return _normalized(F.col(x) if isinstance(x, str) else x)


def key(x: str | Column) -> Column:
    return _key(F.col(x) if isinstance(x, str) else x)


def canonical(x: str | Column) -> Column:
    return _canonical(F.col(x) if isinstance(x, str) else x)


def keys(x: str | Column) -> Column:
    return _keys(F.col(x) if isinstance(x, str) else x)


def family(x: str | Column) -> Column:
    return _family(F.col(x) if isinstance(x, str) else x)


def stripped(x: str) -> Column:
    return F.regexp_replace(x, f"^{_BLANK}+|{_BLANK}+$", "")


def bucket(digest: Column) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(100))


def split_of(digest: Column) -> Column:
    """80, 10 and 10 of 100 by the first 32 bits of a hash."""
    return F.when(bucket(digest) < 80, "train").when(bucket(digest) < 90, "dev").otherwise("test")


def _contact(x: Column) -> Column:
    """Whether x has a contact or secret; every match holds one of four parts, so that most texts need no matching."""
    return (F.contains(x, F.lit("@")) | F.contains(x, F.lit("://")) | F.contains(x, F.lit("sk-")) | F.contains(x, F.lit("AKIA"))) & x.rlike(CONTACT)


def validated(pairs: DataFrame, expected: str | Column | None = None) -> DataFrame:
    """Pairs, stripped, with reject_reason: the first check that fails, null for a valid pair. A null category is `expected` (also by row, null for none), or else mixed."""
    wanted = expected if isinstance(expected, Column) else F.lit(expected or None)
    category = F.coalesce(*(["category"] if "category" in pairs.columns else []), wanted, F.lit("mixed"))
    rows = pairs.withColumns({"_s": stripped("source"), "_t": stripped("target"), "_c": category})
    rows = rows.withColumn("_equal", normalized("_s") == normalized("_t"))
    length = lambda c: F.length(c).between(3, 600)
    words = lambda c: (F.length(c) > 160) & (F.size(F.split(c, f"{_BLANK}+")) > 80)
    both = F.concat_ws(" ", "_s", "_t")
    reason = F.when(F.col("source").isNull() | F.col("target").isNull(), "schema").when(~F.col("_c").isin(CATEGORIES), "category")
    if expected is not None:
        reason = reason.when(F.col("_c") != wanted, "category_mismatch")
    reason = reason.when(~length("_s") | ~length("_t"), "length").when(both.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), "control_character")
    reason = reason.when(~F.col("_s").rlike("[A-Za-z]") | ~F.col("_t").rlike("[A-Za-z]"), "no_english_letters").when(_contact(both), "contact_or_secret_pattern")
    reason = reason.when((F.col("_c") == "clean") != F.col("_equal"), "clean_mismatch").when(words("_s") | words("_t"), "word_limit")
    return rows.withColumns({"source": F.col("_s"), "target": F.col("_t"), "category": F.col("_c"), "reject_reason": reason}).drop("_s", "_t", "_c", "_equal")


def identified(pairs: DataFrame) -> DataFrame:
    """pair_id (case kept), clean_group (of the target, or the pair's own family_id), source_key and target_key."""
    rows = pairs.withColumns({"_s": normalized("source"), "_t": normalized("target"), "_ks": key("source"), "_kt": key("target")})
    own = F.col("family_id") if "family_id" in pairs.columns else F.lit(None).cast("string")
    return rows.withColumns({
        "pair_id": F.sha2(F.concat("_s", F.lit("\0"), "_t"), 256),
        "clean_group": F.coalesce(own, F.sha2("_kt", 256)),
        "source_key": F.sha2("_ks", 256),
        "target_key": F.sha2("_t", 256),
    }).drop("_s", "_t", "_ks", "_kt")


def held_keys(held: DataFrame) -> DataFrame:
    """All keys of sources, targets and references of held-out rows."""
    texts = F.array_compact(F.concat(F.array("source", "target"), F.coalesce("references", F.array().cast("array<string>"))))
    return held.select(F.explode(texts).alias("t")).distinct().select(F.explode(keys("t")).alias("k")).distinct()


def decontaminated(pairs: DataFrame, held: DataFrame, row: str = "ordinal") -> DataFrame:
    """G1: pairs of which no text has a held-out key, raw or canonical."""
    mine = pairs.select(row, F.explode(F.array_distinct(F.array_compact(F.array("source", "target")))).alias("t")).select(row, F.explode(keys("t")).alias("k"))
    hit = mine.join(held_keys(held), "k", "left_semi").select(row).distinct()
    return pairs.join(hit, row, "left_anti")


def admitted(rows: DataFrame, weak: bool = False) -> DataFrame:
    """Admission reason in order (null if admitted) and whether a row may be published."""
    teacher = F.coalesce(F.col("origin") == "teacher-screened", F.lit(False))
    evidence = (F.col("admission_status") == "screened") & (F.col("review_status") == "machine-verified") & F.col("family_id").rlike("^[0-9a-f]{64}$") & F.col("run_fingerprint").rlike("^[0-9a-f]{64}$")
    refused = (F.col("review_status") == "quarantined") | F.col("status").isin("quarantined", "unsupported", "duplicate") | (F.col("admission_status") != "screened")
    no = F.lit(False)
    reason = F.when(F.coalesce("evaluation_only", no), "evaluation_only").when(F.coalesce(refused, no), "not_admitted")
    reason = reason.when(teacher & ~F.coalesce(F.col("split") == "train", no), "teacher_heldout").when(teacher & ~F.coalesce(evidence, no), "teacher_evidence_missing")
    licensed = F.coalesce(F.col("license").isin(PERMISSIVE), no)
    reason = reason.when(~licensed, "license_unverified")
    if not weak:
        reason = reason.when(~F.coalesce(F.col("review_status") == "human-reviewed", no), "unreviewed")
    return rows.withColumns({"reject_reason": reason, "publishable": licensed & F.coalesce("release_eligible", F.lit(True))})


def first_wins(pairs: DataFrame) -> DataFrame:
    """One row for each source_key, conflicting sources gone: the first row, or the first reviewed one of the same target."""
    reviewed = F.coalesce("reviewed", F.lit(False)) if "reviewed" in pairs.columns else F.lit(False)
    row = F.struct(*pairs.columns)
    groups = pairs.groupBy("source_key").agg(F.min(F.struct((~reviewed).alias("late"), "ordinal", row.alias("row"))).alias("best"), F.min("target_key").alias("a"), F.max("target_key").alias("b"))
    return groups.where("a = b").select("best.row.*")


def bounded_sample(pairs: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """Of the first row of each source the `limit` least by seeded hash; those whose source conflicts go after that, unreplaced."""
    return pairs.join(F.broadcast(sampled(pairs, limit, seed)), "ordinal").select(*pairs.columns, "priority")


def sampled(pairs: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """Ordinal and priority of the sample; of a pair only its ordinal and digests, 32 bytes each, are shuffled."""
    target = F.unhex(F.sha2("target", 256))
    each = pairs.select(F.unhex("source_key").alias("k"), "ordinal", F.unhex("pair_id").alias("id"), target.alias("t"))
    firsts = each.groupBy("k").agg(F.min(F.struct("ordinal", "id")).alias("r"), F.min("t").alias("a"), F.max("t").alias("b"))
    chosen = firsts.withColumn("priority", F.sha2(F.concat(F.lit(f"{seed}:"), F.lower(F.hex("r.id"))), 256)).orderBy("priority").limit(limit)
    return chosen.where("a = b").select("r.ordinal", "priority")


def first_accepted(rows: DataFrame, limit: int, most_scanned: int) -> DataFrame:
    """Of the first `most_scanned` rows those without a reject_reason, `limit` at most, in order."""
    return rows.where((F.col("ordinal") < most_scanned) & F.col("reject_reason").isNull()).orderBy("ordinal").limit(limit)


def derived_controls(selected: DataFrame, seen: DataFrame) -> DataFrame:
    """F8: the targets of a quarter of the changed rows, by pair_id, as clean pairs; not those whose text is a source already."""
    fourth = F.pmod(F.conv(F.substring("pair_id", 1, 8), 16, 10).cast("long"), F.lit(4)) == 0
    rows = selected.where((F.col("category") != "clean") & fourth).select(F.col("target").alias("source"), "target", F.lit("clean").alias("category"))
    rows = identified(rows).join(seen.select("source_key").distinct(), "source_key", "left_anti")
    return rows.groupBy("pair_id").agg(F.min(F.struct("source", "target", "category", "clean_group", "source_key", "target_key")).alias("r")).select("pair_id", "r.*")


def split_reviewed(pairs: DataFrame) -> DataFrame:
    """A clean group with a reviewed row is split by its hash, others train; unreviewed rows outside train are dropped (split null)."""
    groups = pairs.where("reviewed").select("clean_group", F.lit(True).alias("_held")).distinct()
    rows = pairs.join(groups, "clean_group", "left")
    split = F.when(F.col("_held").isNull(), "train").otherwise(split_of(F.col("clean_group")))
    return rows.withColumn("split", F.when((split == "train") | F.col("reviewed"), split)).drop("_held")


def tagged(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Pairs with tags and alignment_reason; each distinct pair is aligned once."""
    from emendata.operators import custom, tagging

    once = pairs.select(source, target).distinct().withColumns({"_a": tagging.tokens(F.col(source)), "_b": tagging.tokens(F.col(target))})
    once = tagging.tagged(once.withColumn("_e", custom.edits_udf("_a", "_b")), "_e", "_a", "_b").drop("_a", "_b", "_e")
    return pairs.join(once, [source, target])


def label_inventory(rows: DataFrame, most: int) -> DataFrame:
    """Tag and label number: KEEP is 0, then the most frequent tags of training rows, of equals the one seen first by (clean_group, source_key)."""
    seen = rows.where("split = 'train'").select("clean_group", "source_key", F.posexplode("tags").alias("pos", "tag")).where("tag != 'KEEP'")
    counts = seen.groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct("clean_group", "source_key", "pos")).alias("first"))
    chosen = counts.orderBy(F.desc("n"), "first").limit(most - 1)
    ranked = chosen.withColumn("label", F.row_number().over(Window.orderBy(F.desc("n"), "first")))  # most - 1 rows at most
    keep = rows.sparkSession.createDataFrame([("KEEP", None, 0)], "tag string, n long, label int")
    return keep.unionByName(ranked.select("tag", "n", "label"))


def shared_labels(rows: DataFrame) -> DataFrame:
    """One inventory for all arms: KEEP and, in order, every tag that any arm's training rows have."""
    tags = rows.where("split = 'train'").select(F.explode("tags").alias("tag")).distinct()
    return tags.agg(F.concat(F.array(F.lit("KEEP")), F.array_sort(F.array_except(F.collect_set("tag"), F.array(F.lit("KEEP"))))).alias("labels"))


def by_status(ledger: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows of each recipe by status, and how many of them the tags and the guards can express."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return ledger.groupBy("recipe").agg(*counts, F.sum("alignment").alias("alignment"), F.sum("guarded").alias("guarded"))


def shortened(pairs: DataFrame) -> DataFrame:
    """Pairs in canonical form, with the reason why that makes them useless: the edit is gone, or fewer than four tokens are left."""
    rows = pairs.withColumns({"_a": canonical("source"), "_b": canonical("target")})
    few = lambda c: F.size(F.regexp_extract_all(c, F.lit("\\p{L}+(?:['’]\\p{L}+)*|[0-9]+|[^\\p{L}\\p{N}_\\s]"), F.lit(0))) < 4
    reason = F.when((F.col("_a") == F.col("_b")) & (normalized("source") != normalized("target")), "normalization_erased_edit").when(few("_a") | few("_b"), "fragment")
    return rows.withColumns({"source": F.col("_a"), "target": F.col("_b"), "reject_reason": reason}).drop("_a", "_b")


def supported(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the flag that every tag is a label."""
    known = labels.agg(F.collect_set("tag").alias("_known"))  # as many as there are labels
    return rows.join(F.broadcast(known)).withColumn("supported", F.size(F.array_except("tags", "_known")) == 0).drop("_known")


def coverage(rows: DataFrame) -> DataFrame:
    """H9: per split and category the population, and how much of it can be tagged and is in the vocabulary."""
    n = lambda c: F.count_if(c)
    taggable = F.col("alignment_reason").isNull()
    return rows.groupBy("split", "category").agg(F.count("*").alias("population"), n(taggable).alias("taggable"), n(~taggable).alias("unrepresentable"), n(taggable & F.col("supported")).alias("supported"), n(taggable & ~F.col("supported")).alias("unsupported_vocabulary"))


def without_cross_split(rows: DataFrame, row: str = "id") -> DataFrame:
    """Rows of which a source or reference, by key, occurs in another split go, on both sides; then repeats within a split."""
    texts = rows.select(row, "split", F.explode(F.concat(F.array("source"), "references")).alias("t")).withColumn("k", key("t"))
    several = texts.groupBy("k").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a != b")
    hit = texts.join(several, "k", "left_semi").select(row).distinct()
    kept = rows.join(hit, row, "left_anti").withColumn("_k", key("source"))
    return kept.groupBy("split", "_k", "references").agg(F.min_by(F.struct(*rows.columns), "ordinal").alias("r")).select("r.*")


def quota_mixture(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most n/2 human and n/4 rule rows, the first by seeded hash, and whatever comes next by it up to n."""
    ranked = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), "pair_id"), 256))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("_h"))  # the rank's limit prunes before the shuffle
    quota = F.when(F.col("kind") == "human", n // 2).when(F.col("kind") == "rule", n // 4).otherwise(0)
    first = ranked.withColumn("_r", place).where((F.col("_r") <= n // 2) & (F.col("_r") <= quota)).drop("_r")
    rest = ranked.join(first.select("pair_id"), "pair_id", "left_anti")
    room = rows.sparkSession.range(1).select(F.lit(n).alias("n"))
    have = first.agg(F.count("*").alias("have"))
    next_ = rest.orderBy("_h").limit(n).withColumn("_r", F.row_number().over(Window.orderBy("_h"))).join(F.broadcast(have.join(room))).where(F.col("_r") <= F.col("n") - F.col("have"))  # n rows at most
    return first.unionByName(next_.select(*first.columns)).drop("_h")


def equal_composition(counts: dict[str, int], templates: int, rows: int) -> tuple[int, int]:
    """Rows of each arm, and of each weak source in the mixed one: half templates, the rest shared equally, nothing left over."""
    unit = 2 * len(counts)
    most = min([rows, templates, *(n * unit for n in counts.values())])
    return most - most % unit, most // unit


def latest_by_source(rows: DataFrame, limit: int) -> DataFrame:
    """The last row of each source, the first `limit` by the source's hash."""
    last = rows.groupBy("source").agg(F.max_by(F.struct(*rows.columns), "ordinal").alias("r")).select("r.*")
    return last.withColumn("_h", F.sha2("source", 256)).orderBy("_h").limit(limit).drop("_h")


def spread_domains(jobs: DataFrame, domains: list[str], block: int = 8) -> DataFrame:
    """In each block of jobs the domains in the order of a seeded digest; one job of four is informal."""
    names = F.array(*map(F.lit, domains))
    at = F.floor(F.col("job") / block)
    drawn = F.array_sort(F.transform(names, lambda d: F.struct(F.sha2(F.concat_ws(":", F.lit("domain"), at.cast("string"), d), 256).alias("h"), d.alias("d"))))
    return jobs.withColumns({"domain": F.get(drawn, F.pmod("job", F.lit(block)).cast("int"))["d"], "register": F.when(F.pmod("job", F.lit(4)) == 3, "informal").otherwise("neutral")})
