"""Formats of correction corpora as DataFrames. A line table has columns value and ordinal.

What can't be a pair gets a reject_reason; what shows that a source is not what it should be fails the read.
"""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIR = "source string, target string, category string, license string, origin string"
#: Licences that an imported commit may have; the longest line.
COMMIT_LICENSES = "MIT Apache-2.0 CC0-1.0 CC-BY-4.0".split()
LONGEST = 1_000_000


def checked(value: Column, holds: Column, message: str) -> Column:
    """value where the condition holds; anything else fails the read."""
    return F.when(F.coalesce(holds, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def jsonl(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """A14."""
    return spark.read.schema(schema).json(path)


def columns(spark: SparkSession, path: str) -> DataFrame:
    """The two columns of a Parquet corpus."""
    return spark.read.parquet(path).select(F.col("input").alias("source"), F.col("output").alias("target"))


def tsv_lines(lines: DataFrame) -> DataFrame:
    """A4: exactly two fields a line."""
    fields = F.split("value", "\t", -1)
    rows = lines.select("ordinal", checked(fields, F.size(fields) == 2, "a line has not two fields").alias("f"))
    return rows.select("ordinal", F.col("f")[0].alias("source"), F.col("f")[1].alias("target"))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return tsv_lines(spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())).drop("ordinal")


def parallel(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two line tables paired by ordinal; counts must match."""
    both = left.withColumnRenamed("value", "source").join(right.withColumnRenamed("value", "target"), "ordinal", "full")
    whole = F.col("source").isNotNull() & F.col("target").isNotNull()
    return both.select("ordinal", checked(F.col("source"), whole, "the members differ in length").alias("source"), "target")


def references(source: DataFrame, *others: DataFrame) -> DataFrame:
    """A line table of sources with line tables of references, by ordinal; the counts match and no line is blank."""
    rows = source.withColumnRenamed("value", "source")
    for k, other in enumerate(others):
        rows = rows.join(other.withColumnRenamed("value", f"_r{k}"), "ordinal", "full")
    texts = [F.col("source"), *(F.col(f"_r{k}") for k in range(len(others)))]
    whole = F.forall(F.array(*texts), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    return rows.select("ordinal", checked(F.col("source"), whole, "a line is missing or blank").alias("source"), F.array(*texts[1:]).alias("references"))


def word_diff(lines: DataFrame) -> DataFrame:
    """[-deleted-] and {+inserted+} marks to pairs; marks that are left give a reject reason."""
    text = F.trim(F.translate("value", "\t", " "))
    side = lambda keep, drop: F.trim(F.regexp_replace(F.regexp_replace(text, keep, " $1 "), drop, " "))
    source = side(r" *\[-(.*?)-\] *", r" *\{\+.*?\+\} *")
    target = side(r" *\{\+(.*?)\+\} *", r" *\[-.*?-\] *")
    left = F.concat(source, target).rlike(r"\[-|-\]|\{\+|\+\}")
    return lines.select("ordinal", source.alias("source"), target.alias("target"), F.when(left, "invalid_wdiff").alias("reject_reason"))


def with_metadata(lines: DataFrame, group: str = "file", key: str = "url") -> DataFrame:
    """Lines without their `###key: value` headers, each with the last header value before it in its file."""
    header = F.trim(F.regexp_extract("value", r"^###([^:]*):?(.*)$", 1))
    value = F.when(header == key, F.trim(F.regexp_extract("value", r"^###([^:]*):?(.*)$", 2)))
    order = Window.partitionBy(group).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(key, F.last(value, ignorenulls=True).over(order)).where(~F.col("value").startswith("###"))


def repository_slug(url: str | Column) -> Column:
    """owner/name of a repository, from its address or as it is; null if it is neither."""
    x = F.col(url) if isinstance(url, str) else url
    path = F.when(x.startswith("https://"), F.regexp_extract(x, r"^https://github\.com/([^?#]*)$", 1)).otherwise(x)
    path = F.when(x.startswith("https://"), F.regexp_replace(F.btrim(path, F.lit("/")), r"\.git$", "")).otherwise(path)
    return F.when(path.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), path)


COMMIT = "repo string, commit string, edits array<struct<src:struct<lang:string,text:string,path:string>,tgt:struct<lang:string,text:string>,is_typo:boolean>>"


def licensed(rows: DataFrame, proofs: DataFrame) -> DataFrame:
    """Rows (repo, revision) with license and the reason why it can't be used; proofs: key (repo@revision), license, license_sha256, revision."""
    mine = proofs.select(F.col("key").alias("_key"), F.col("license").alias("_license"), F.col("license_sha256").alias("_sha"), F.col("revision").alias("_revision"))
    rows = rows.join(mine, F.concat_ws("@", "repo", "revision") == F.col("_key"), "left")
    open_ = F.coalesce(F.col("_license").isin(COMMIT_LICENSES), F.lit(False))
    proven = ~open_ | (F.col("_sha").isNotNull() & (F.col("_revision") == F.col("revision")))
    return rows.withColumns({"license": checked(F.col("_license"), proven, "a licence's proof is not its commit's"), "_open": open_}).drop("_key", "_license", "_sha", "_revision")


def commits(lines: DataFrame, proofs: DataFrame) -> DataFrame:
    """Commit records to pairs: an edit each, with its first reject reason."""
    rows = lines.select(F.from_json("value", COMMIT).alias("c")).select(checked(repository_slug("c.repo"), repository_slug("c.repo").isNotNull(), "not a repository").alias("repo"), F.col("c.commit").alias("revision"), F.posexplode("c.edits").alias("n", "e"))
    rows = licensed(rows, proofs)
    english = F.coalesce((F.col("e.src.lang") == "eng") & (F.col("e.tgt.lang") == "eng"), F.lit(False))
    reason = F.when(~english, "non_english").when(~F.coalesce("e.is_typo", F.lit(False)), "not_classified_typo").when(~F.col("_open"), "source_license_unverified")
    return rows.select("repo", "revision", F.concat_ws(":", "repo", "revision", "n").alias("corpus_record_id"), F.col("e.src.text").alias("source"), F.col("e.tgt.text").alias("target"), F.when(F.col("_open"), F.col("license")).alias("license"), reason.alias("reject_reason"))


def table_rows(edits: DataFrame, repositories: list[str], budget: int) -> DataFrame:
    """Typo edits in documentation of the repositories, in the order of repository, commit and edit, within one budget."""
    slug = repository_slug("repo")
    text = F.lower("source_path").rlike(r"\.(md|rst|txt)$")
    rows = edits.withColumn("repo", slug).where(F.col("repo").isin(sorted(repositories)) & (F.col("source_lang") == "eng") & (F.col("target_lang") == "eng") & F.col("is_typo") & text)
    return rows.orderBy("repo", "commit_hash", "edit_number").limit(budget)


def m2_blocks(text: DataFrame) -> DataFrame:
    """A1: blocks (block, value) of texts (block, value) read with blank lines as separators: no blank lines in them, none empty."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    longest = F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0))
    return text.withColumn("value", checked(F.array_join(lines, "\n"), longest <= LONGEST, "a line is too long")).where("value != ''")


def _annotations(blocks: DataFrame) -> DataFrame:
    """block, words, notes (start, stop, kind, tokens, annotator) of blocks, their form checked."""
    lines = F.split("value", "\n")
    words = F.filter(F.split(F.regexp_replace(lines[0], "^S ", ""), r"\s+"), lambda x: x != "")
    fields = F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.split(x, r"\|\|\|", -1))
    right = lines[0].startswith("S ") & F.forall(fields, lambda f: (F.size(f) == 6) & f[0].rlike(r"^A \s*-?[0-9]+\s+-?[0-9]+\s*$"))
    rows = blocks.select("block", checked(words, right, "not an annotated block").alias("words"), fields.alias("f"))
    at = lambda f, k: F.split(F.trim(F.substring(f[0], 3, 1000)), r"\s+")[k].cast("int")
    new = lambda f: F.when(f[2] == "-NONE-", F.filter(F.split(f[2], " "), lambda x: F.lit(False))).otherwise(F.filter(F.split(f[2], r"\s+"), lambda x: x != ""))
    notes = F.transform("f", lambda f: F.struct(at(f, 0).alias("start"), at(f, 1).alias("stop"), f[1].alias("kind"), new(f).alias("tokens"), f[5].alias("annotator")))
    rows = rows.select("block", "words", notes.alias("notes"))
    inside = lambda n: F.when(n["kind"] == "noop", (n["start"] == -1) & (n["stop"] == -1)).otherwise((n["start"] >= 0) & (n["start"] <= n["stop"]) & (n["stop"] <= F.size("words")))
    return rows.withColumn("notes", checked(F.col("notes"), F.forall("notes", inside), "an edit lies outside of its sentence"))


def _edited(words: str, edits: str) -> Column:
    """The words with sorted edits put in place of their spans."""
    none = F.filter(words, lambda x: F.lit(False))

    def step(acc: Column, e: Column) -> Column:
        return F.struct(e["stop"].alias("at"), F.concat(acc["out"], F.slice(words, acc["at"] + 1, F.greatest(e["start"] - acc["at"], F.lit(0))), e["tokens"]).alias("out"))

    return F.aggregate(edits, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: F.concat_ws(" ", F.concat(acc["out"], F.slice(words, acc["at"] + 1, F.size(words)))))


def _by_annotator(rows: DataFrame) -> DataFrame:
    annotators = F.when(F.size("notes") == 0, F.array(F.lit("0"))).otherwise(F.array_sort(F.array_distinct(F.transform("notes", lambda n: n["annotator"]))))
    own = rows.withColumn("annotator", F.explode(annotators))
    mine = F.filter("notes", lambda n: (n["annotator"] == F.col("annotator")) & (n["kind"] != "noop"))
    own = own.withColumn("_unresolved", F.exists(mine, lambda n: n["kind"] == "UNK"))
    ordered = F.array_sort(F.transform(mine, lambda n, i: F.struct(n["start"].alias("start"), n["stop"].alias("stop"), i.alias("i"), n["tokens"].alias("tokens"))))
    own = own.withColumn("edits", ordered)
    overlap = F.exists(F.transform("edits", lambda e, i: F.coalesce(e["stop"] > F.get("edits", i + 1)["start"], F.lit(False))), lambda x: x)
    return own.withColumn("_overlap", overlap)


def m2(blocks: DataFrame) -> DataFrame:
    """A2: blocks of an S line and A lines to a pair for each annotator; unresolved and overlapping annotations are rejected."""
    own = _by_annotator(_annotations(blocks))
    reason = F.when(F.col("_unresolved"), "unresolved_annotation").when(F.col("_overlap"), "overlapping_annotation")
    text = lambda c: F.when(reason.isNull(), c)
    return own.select("block", "annotator", text(F.concat_ws(" ", "words")).alias("source"), text(_edited("words", "edits")).alias("target"), reason.alias("reject_reason"))


def m2_references(blocks: DataFrame, annotators: tuple[str, ...] = ("0", "1")) -> DataFrame:
    """Blocks to a source and a reference of each annotator, all of whom must be there; overlaps fail."""
    own = _by_annotator(_annotations(blocks))
    target = checked(_edited("words", "edits"), ~F.col("_overlap"), "overlapping edits")
    rows = own.groupBy("block").agg(F.first(F.concat_ws(" ", "words")).alias("source"), F.array_sort(F.collect_list(F.struct("annotator", target.alias("t")))).alias("r"))
    names = F.transform("r", lambda x: x["annotator"])
    return rows.select("block", "source", checked(F.transform("r", lambda x: x["t"]), names == F.array(*map(F.lit, annotators)), "an annotator is missing").alias("references"))


def members(archives: DataFrame, wanted: list[str] | None = None, most_bytes: int = 250_000_000) -> DataFrame:
    """Member and text of the files in tar archives (path, content, as `binaryFile` reads them).

    Names that leave the archive, oversized members and missing wanted ones fail the read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                    for m in archive:
                        if m.name.startswith("/") or ".." in m.name.split("/"):
                            raise ValueError("a member's name leaves the archive")
                        if not m.isfile() or wanted is not None and m.name not in wanted:
                            continue
                        if m.size > most_bytes:
                            raise ValueError("a member is too large")
                        found.append((m.name, archive.extractfile(m).read().decode()))
                if wanted is not None and {x for x, _ in found} != set(wanted):
                    raise ValueError("a required member is missing")
                yield pd.DataFrame(found, columns=["member", "text"])

    return archives.select("content").mapInPandas(run, "member string, text string")


def dialogs(files: DataFrame) -> DataFrame:
    """Utterances of dialogs: dialog, index, source and distinct references in order, from orig, corr and (if there) corr2 files of one length."""
    part = F.regexp_extract("member", r"/(orig|corr|corr2)/", 1)
    rows = files.where(F.col("member").endswith(".txt") & (part != "")).select(part.alias("part"), F.regexp_replace(F.regexp_replace("member", r"/(orig|corr|corr2)/", "/"), r"\.txt$", "").alias("dialog"), F.split(F.regexp_replace("text", "\n$", ""), "\n").alias("lines"))
    side = lambda name: rows.where(F.col("part") == name).select("dialog", F.col("lines").alias(name))
    both = side("orig").join(side("corr"), "dialog", "left").join(side("corr2"), "dialog", "left")
    even = (F.size("orig") == F.size("corr")) & (F.col("corr2").isNull() | (F.size("orig") == F.size("corr2")))
    both = both.withColumn("orig", checked(F.col("orig"), even, "a dialog is not aligned"))
    each = both.select("dialog", F.posexplode("orig").alias("index", "source"), "corr", "corr2")
    refs = F.array_distinct(F.transform(F.array_compact(F.array(F.get("corr", F.col("index")), F.get("corr2", F.col("index")))), F.trim))
    whole = (F.trim("source") != "") & F.forall(refs, lambda x: x != "")
    return each.select("dialog", "index", F.trim("source").alias("source"), checked(refs, whole, "an utterance or reference is empty").alias("references"))


def evaluation(rows: DataFrame) -> DataFrame:
    """Evaluation rows (ordinal, id, source, target, references) with their ids and references; empty references and repeated ids fail."""
    refs = F.coalesce("references", F.array("target"))
    whole = F.col("source").isNotNull() & (F.size(refs) > 0) & F.forall(refs, lambda x: x.isNotNull())
    rows = rows.select("ordinal", F.coalesce("id", F.concat(F.lit("sample-"), F.col("ordinal").cast("string"))).alias("id"), "source", checked(refs, whole, "not an evaluation row").alias("references"))
    return rows.withColumn("id", checked(F.col("id"), F.count("*").over(Window.partitionBy("id")) == 1, "an id is repeated"))


def verified(files: DataFrame, pins: DataFrame, most_bytes: int) -> DataFrame:
    """Path and fault of files (path, content) against pinned hashes (path, sha256)."""
    rows = pins.join(files, "path", "left")
    fault = F.when(F.col("content").isNull(), "missing").when(F.octet_length("content") > most_bytes, "size").when(F.sha2("content", 256) != F.col("sha256"), "hash")
    return rows.select("path", fault.alias("fault"))


def proof(files: DataFrame) -> DataFrame:
    """Licence proofs of files (key, content in base64, spdx): the hash of the decoded text, where the licence may be used."""
    usable = F.col("spdx").isin(COMMIT_LICENSES)
    return files.select("key", F.when(usable, F.col("spdx")).alias("license"), F.when(usable, F.sha2(F.unbase64(F.regexp_replace("content", r"\s", "")), 256)).alias("license_sha256"))


def spec_faults(spec: dict) -> list[str]:
    """What is wrong with a corpus's description."""
    checks = {
        "id": bool(re.fullmatch(r"[a-z0-9][a-z0-9_-]*", str(spec.get("id", "")))),
        "format": spec.get("format") in FORMATS,
        "split": spec.get("split") == "train",
        "release_eligible": isinstance(spec.get("release_eligible"), bool),
    }
    return [name for name, right in checks.items() if not right]


def asset_faults(labels: list[str], thresholds: dict[str, float], least: float, vocabulary: list[str]) -> list[str]:
    """What is wrong with a model's labels, thresholds and vocabulary."""
    checks = {
        "labels": bool(labels) and labels[0] == "KEEP" and len(set(labels)) == len(labels),
        "thresholds": 0 <= least <= 1 and all(least <= t <= 1 for t in thresholds.values()),
        "vocabulary": {"[CLS]", "[SEP]", "[UNK]"} <= set(vocabulary),
    }
    return [name for name, right in checks.items() if not right]


#: A10: a format's name and what reads it (from a path, or from line, block and archive tables).
FORMATS: dict[str, Callable] = {"jsonl": jsonl, "tsv": tsv, "parallel": parallel, "wdiff": word_diff, "metadata": with_metadata, "commits": commits, "table": table_rows, "m2": m2, "m2-tar": members, "parquet": columns}
