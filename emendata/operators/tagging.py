"""The edit language as column expressions: which tokens stand for each source token, the tags that name them, and back.

A pair's token edits (spans of the source and what replaces them) say for every source token which tokens stand in its
place; a tag is the name of that list seen from the token. Everything but the sequence matcher is a native expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens, and most tokens of one payload.
TOKEN, MOST = "\\p{L}+(?:['’]\\p{L}+)*|[0-9]+|[^\\p{L}\\p{N}_\\s]", 4
#: What a suffix operation takes from the end of a word and puts there.
SUFFIXES = {"ADD_S": ("", "s"), "REMOVE_S": ("s", ""), "ADD_ES": ("", "es"), "REMOVE_ES": ("es", ""), "Y_TO_IES": ("y", "ies"), "IES_TO_Y": ("ies", "y")}


def tokens(text: Column) -> Column:
    """C5."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def rendered(words: Column, schema: int = 2) -> Column:
    """Tokens as text, marks attached; in the second schema brackets too."""
    text = F.regexp_replace(F.array_join(words, " "), "\\s+([.,!?;:])", "$1")
    return text if schema == 1 else F.regexp_replace(F.regexp_replace(text, "\\s+([)\\]}])", "$1"), "([(\\[{])\\s+", "$1")


def preserved(word: Column, new: Column) -> Column:
    """New in the case of word."""
    first = F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(new)).when(word.rlike("^[A-Z]"), first).otherwise(new)


def suffixed(word: Column, name: str) -> Column:
    """The suffix operation on an ASCII word; null where it can't be done."""
    old, new = SUFFIXES[name]
    stem = F.substring(F.lower(word), F.lit(1), F.length(word) - len(old))
    can = word.rlike("^[A-Za-z]+$") & F.lower(word).endswith(old) & (F.length(word) > len(old))
    return F.when(can, preserved(word, F.concat(stem, F.lit(new))))


def cased(word: Column) -> dict[str, Column]:
    return {"LOWER": F.lower(word), "UPPER": F.upper(word), "TITLE": F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))}


def slots(words: Column, edits: Column) -> Column:
    """Per source token the tokens that stand for it. A replacement of equal length goes token by token, others MOST to a token; what is inserted stands after the token before it, or before the first."""

    def slot(w: Column, i: Column) -> Column:
        none = F.array().cast("array<string>")
        new = lambda found: F.coalesce(F.try_element_at(found, F.lit(1))["words"], none)
        inserted = lambda at: new(F.filter(edits, lambda e: (e["start"] == at) & (e["stop"] == at)))
        over = F.try_element_at(F.filter(edits, lambda e: (e["start"] <= i) & (i < e["stop"])), F.lit(1))
        k, size = i - over["start"], F.size(over["words"])
        part = F.when(size == over["stop"] - over["start"], F.slice(over["words"], k + 1, 1)).otherwise(F.slice(over["words"], k * MOST + 1, MOST))
        body = F.when(over.isNull(), F.array(w)).otherwise(part)
        return F.concat(F.when(i == 0, inserted(F.lit(0))).otherwise(none), body, inserted(i + 1))

    return F.transform(words, slot)


def tag(word: Column, slot: Column) -> Column:
    """The least tag by which word becomes the tokens of slot."""
    n, alone = F.size(slot), F.try_element_at(slot, F.lit(1))
    out = F.when((n == 1) & (alone == word), "KEEP").when(n == 0, "DELETE")
    for name, done in cased(word).items():
        out = out.when((n == 1) & (alone == done), f"CASE:{name}")
    for name in SUFFIXES:
        out = out.when((n == 1) & (alone == suffixed(word, name)), f"SUFFIX:{name}")
    out = out.when((n > 1) & (alone == word), F.concat(F.lit("APPEND_EXACT:"), rendered(F.slice(slot, F.lit(2), F.greatest(n - 1, F.lit(0))))))
    out = out.when((n > 1) & (F.try_element_at(slot, F.lit(-1)) == word), F.concat(F.lit("PREPEND_EXACT:"), rendered(F.slice(slot, F.lit(1), F.greatest(n - 1, F.lit(0))))))
    return out.otherwise(F.concat(F.lit("REPLACE_EXACT:"), rendered(slot)))


def decoded(word: Column, name: Column) -> Column:
    """C11: the tokens that a tag makes of word; null for a tag outside of the language."""
    kind, value = F.substring_index(name, ":", 1), F.regexp_replace(name, "^[A-Z_]+:", "")
    out = F.when(name == "KEEP", F.array(word)).when(name == "DELETE", F.array().cast("array<string>"))
    out = out.when(kind == "REPLACE", F.array(preserved(word, value))).when(kind == "APPEND", F.array(word, value))
    out = out.when(kind == "REPLACE_EXACT", tokens(value)).when(kind == "APPEND_EXACT", F.concat(F.array(word), tokens(value))).when(kind == "PREPEND_EXACT", F.concat(tokens(value), F.array(word)))
    for case, done in cased(word).items():
        out = out.when(name == f"CASE:{case}", F.array(done))
    for suffix in SUFFIXES:
        done = suffixed(word, suffix)
        out = out.when((name == f"SUFFIX:{suffix}") & done.isNotNull(), F.array(done))
    return out


def category(name: Column) -> Column:
    """C14."""
    kind = F.substring_index(name, ":", 1)
    value = F.when(name.contains(":"), F.regexp_replace(name, "^[^:]*:", "")).otherwise(name)
    out = F.when(kind.isin("KEEP", "DELETE", "CASE", "SUFFIX"), F.lower(kind)).when(~value.rlike("[\\p{L}\\p{N}_]"), "punctuation")
    return out.when(kind.isin("APPEND", "APPEND_EXACT"), "append").when(kind == "PREPEND_EXACT", "prepend").otherwise("replace")


def reason(words: Column, edits: Column, made: Column) -> Column:
    """Why a pair has no tags; null if it has."""
    long = lambda test: F.exists(edits, test)
    inserted = long(lambda e: (e["start"] == e["stop"]) & (F.size(e["words"]) > MOST))
    replaced = long(lambda e: (e["start"] < e["stop"]) & (F.size(e["words"]) > MOST * (e["stop"] - e["start"])))
    combined = F.exists(F.zip_with(words, made, lambda w, s: F.size(s) - (F.array_contains(s, w) & (F.size(s) > 1)).cast("int")), lambda n: n > MOST)
    return F.when(F.size(words) == 0, "empty_source_tokens").when(inserted, "insertion_payload_limit").when(replaced, "replacement_payload_limit").when(combined, "combined_payload_limit")


def tagged(pairs: DataFrame, edits: str = "edits", source: str = "source_tokens", target: str = "target_tokens") -> DataFrame:
    """Pairs (token arrays and edits) with tags and alignment_reason; tags are checked by decoding them. Pairs without edits, most of them, need no slots."""
    rows = pairs.withColumn(edits, F.coalesce(edits, F.expr("array()").cast(pairs.schema[edits].dataType)))
    equal = F.size(edits) == 0
    rows = rows.withColumn("_slots", F.when(~equal, slots(F.col(source), F.col(edits))))
    keep = F.array_repeat(F.lit("KEEP"), F.size(source))
    rows = rows.withColumn("_tags", F.when(equal, keep).otherwise(F.zip_with(source, "_slots", tag)))
    rows = rows.withColumn("_why", F.when(equal, F.when(F.size(source) == 0, "empty_source_tokens")).otherwise(reason(F.col(source), F.col(edits), F.col("_slots"))))
    back = F.when(equal, F.col(source)).otherwise(F.flatten(F.zip_with(source, "_tags", decoded)))
    why = F.coalesce("_why", F.when(~F.coalesce(back == F.col(target), F.lit(False)), "alignment_roundtrip"))
    # a generator, as filters on what it makes are not pushed below it, where they would tag every pair once more
    rows = rows.select("*", F.inline(F.array(F.struct(why.alias("alignment_reason")))))
    return rows.withColumn("tags", F.when(F.col("alignment_reason").isNull(), F.col("_tags"))).drop("_slots", "_tags", "_why")
