"""Spans of text as rows: rules' suggestions, protected spans, the interval anti join, greedy selection and application.

A text gives its matches as rows (id, start, stop) by marking them and splitting; what crosses the network are lengths
and matched words, not texts. Overlaps are joined on (id, position bin), so that a long text's spans are spread over its
bins, and only islands of overlapping spans meet in one array for the greedy fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emendata.operators.tagging import preserved

#: The curated spellings.
SPELLINGS = {
    "recieve": "receive", "recieved": "received", "recieving": "receiving", "beleive": "believe", "beleived": "believed", "freinds": "friends",
    "seperate": "separate", "neccessary": "necessary", "definately": "definitely", "tommorow": "tomorrow", "becuase": "because", "freind": "friend",
    "writting": "writing", "grammer": "grammar", "thier": "their", "adress": "address", "avaliable": "available", "realy": "really",
    "succesful": "successful", "diffrent": "different", "peopel": "people", "buisness": "business", "importent": "important", "teh": "the",
}
#: Subjects and the verbs that agree with them.
VERBS = {"i": {"is": "am", "are": "am", "has": "have"}, **{s: {"are": "is", "am": "is", "have": "has"} for s in ("he", "she", "it")}, **{s: {"is": "are", "am": "are", "has": "have"} for s in ("we", "they", "you")}}
#: Verbs of habits, who has them, and how often.
HABITS = {"go": "goes", "work": "works", "walk": "walks", "write": "writes", "play": "plays", "learn": "learns", "travel": "travels", "cook": "cooks", "wait": "waits", "talk": "talks", "sleep": "sleeps", "run": "runs", "study": "studies", "watch": "watches"}
OWNERS, HEADS, OFTEN = "my your our his her their the a".split(), "friend teacher neighbor student child colleague manager".split(), "morning day evening night week".split()
#: Characters that join words into one for the spelling rule.
_WORD = "\\p{L}\\p{M}\\p{N}\\p{Pc}\\x{200C}\\x{200D}"
_JOIN = "'’\\x{2010}\\x{2011}-"

#: White space as browsers' patterns see it; an ASCII word's edges.
_S, _NOT_S = "[\\s\\x{A0}\\x{FEFF}\\p{Z}]", "[^\\s\\x{A0}\\x{FEFF}\\p{Z}"
_EDGE, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Rules by precedence: group 1 is what must stand before, group 2 the marked piece.
RULES = {
    "spelling": f"(?i)(?<![{_WORD}])(?<![{_WORD}][{_JOIN}])()({'|'.join(SPELLINGS)})(?![{_WORD}])(?![{_JOIN}][{_WORD}])",
    "pronoun": f"(?i)(^|[.!?]{_S}+)((?:i|he|she|it|we|they|you)[ \\t]+(?:is|are|am|has|have)){_END}",
    "repeated": f"(?i){_EDGE}()((?!(?:had|that)[ \\t])([A-Za-z]+)[ \\t]+\\3){_END}",
    "habit": f"(?i)((?:^|[.!?]{_S}+)(?:{'|'.join(OWNERS)})[ \\t]+(?:{'|'.join(HEADS)})[ \\t]+)({'|'.join(HABITS)}){_END}(?=[^.!?\\n]*{_EDGE}every[ \\t]+(?:{'|'.join(OFTEN)}){_END}[^.!?\\n]*(?:\\.|\\z))",
}
#: What of the marked piece is kept: the subject of a verb, the first of two equal words.
_KEPT = {"pronoun": "^[A-Za-z]+[ \\t]+", "repeated": "^[A-Za-z]+"}
#: Protected spans: code, addresses of pages and people; paths, dotted names and tags.
PROTECTED = {
    "address": f"()((`+)(?s:.*?)(?:(?<!`)\\3(?!`)|\\z)|(?:https?://|www\\.){_NOT_S}]+|{_EDGE}(?=[A-Za-z0-9_]){_NOT_S}@]+@{_NOT_S}@]+\\.{_NOT_S}@]+)",
    "name": f"()((?:\\.\\.?[/\\\\]|[/\\\\])[\\p{{L}}\\p{{N}}_./\\\\-]+|{_EDGE}(?=[A-Za-z0-9_])[\\p{{L}}\\p{{N}}_-]+(?:[./\\\\][\\p{{L}}\\p{{N}}_-]+)+|[#@][\\p{{L}}\\p{{N}}_]+)",
}
#: What a text, in lower case, holds one of where a pattern has a match: one without any needs no matching.
NEEDED = {RULES["spelling"]: tuple(SPELLINGS), RULES["habit"]: ("every",), PROTECTED["address"]: ("`", "://", "www.", "@")}
#: Marks around a match: code points that are no characters; where a text holds one, it counts as a third.
_OPEN, _CLOSE, _OTHER = "﷐", "﷑", "﷒"
#: Positions of one bin of the interval join.
BIN = 1024


def marked(docs: DataFrame, patterns: dict[str, str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, rule and pieces of every text and pattern that it matches: what lies between matches and, at odd places, their marked pieces."""
    clean = F.translate(F.col(text), _OPEN + _CLOSE, _OTHER + _OTHER)
    pieces = lambda p: F.split(F.regexp_replace(clean, p, f"$1{_OPEN}$2{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")
    may = lambda p: reduce(lambda a, b: a | b, (F.contains(F.col("_lower"), F.lit(part)) for part in NEEDED[p]))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), (F.when(may(p), pieces(p)) if p in NEEDED else pieces(p)).alias("pieces")) for name, p in patterns.items())))
    return docs.withColumn("_lower", F.lower(text)).select(F.col(key).alias("key"), each.alias("r")).where(F.size("r.pieces") > 1).select("key", "r.rule", "r.pieces")


def found(docs: DataFrame, patterns: dict[str, str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, rule, start, stop and piece of every match's marked piece, in code points; matches of a pattern don't overlap."""
    rows = marked(docs, patterns, text, key).select("key", "rule", F.posexplode("pieces").alias("pos", "piece"))
    rows = rows.select("key", "rule", "pos", F.length("piece").alias("n"), F.when(F.col("pos") % 2 == 1, F.col("piece")).alias("piece"))
    stop = F.sum("n").over(Window.partitionBy("key", "rule").orderBy("pos"))
    return rows.withColumn("stop", stop).where("piece is not null").select("key", "rule", (F.col("stop") - F.col("n")).alias("start"), "stop", "piece")


def totals(docs: DataFrame, patterns: dict[str, str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, rule, n, and the sums of the matches' starts and stops and of their characters beyond 16 bits: each text is folded where it stands."""
    beyond = lambda x: F.when(F.octet_length(x) == F.length(x), 0).otherwise(F.length(F.regexp_replace(x, "[^\\x{10000}-\\x{10FFFF}]", "")))
    names = ("n", "starts", "stops", "wide")

    def step(acc: Column, x: Column) -> Column:
        stop = acc["at"] + F.length(x)
        more = {"n": F.lit(1), "starts": acc["at"], "stops": stop, "wide": beyond(x)}
        return F.struct((~acc["inside"]).alias("inside"), stop.alias("at"), *(F.when(acc["inside"], acc[c] + more[c]).otherwise(acc[c]).alias(c) for c in names))

    zero = F.struct(F.lit(False).alias("inside"), *(F.lit(0).cast("long").alias(c) for c in ("at", *names)))
    folded = marked(docs, patterns, text, key).select("key", "rule", F.aggregate("pieces", zero, step).alias("t"))
    return folded.groupBy("key", "rule").agg(*(F.sum(f"t.{c}").alias(c) for c in names))


def _looked_up(table: dict[str, str], x: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for item in table.items() for v in item)), x)


def suggestions(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, rank (the rule's precedence), rule, start, stop, original and replacement of every rule's matches, overlapping ones too."""
    rows = found(docs, RULES, text, key)
    kept = F.lit("")
    for rule, pattern in _KEPT.items():
        kept = F.when(F.col("rule") == rule, F.regexp_extract("piece", pattern, 0)).otherwise(kept)
    rows = rows.withColumn("kept", kept).withColumn("original", F.expr("substr(piece, length(kept) + 1)"))
    verb = F.lower("original")
    agreeing = F.lit(None).cast("string")
    for subject, table in VERBS.items():
        agreeing = F.when(F.regexp_extract(F.lower("kept"), "^[a-z]+", 0) == subject, _looked_up(table, verb)).otherwise(agreeing)
    new = F.when(F.col("rule") == "spelling", _looked_up(SPELLINGS, verb)).when(F.col("rule") == "pronoun", agreeing).when(F.col("rule") == "habit", _looked_up(HABITS, verb))
    new = F.when(F.col("rule") == "repeated", "").otherwise(preserved(F.col("original"), new))
    rank = F.array_position(F.array(*(F.lit(r) for r in RULES)), F.col("rule")).cast("int")
    return rows.withColumn("replacement", new).where("replacement is not null").select("key", rank.alias("rank"), "rule", (F.col("start") + F.length("kept")).alias("start"), "stop", "original", "replacement")


def _binned(spans: DataFrame) -> DataFrame:
    first, last = (F.floor(x / BIN) for x in (F.col("start"), F.col("stop") - 1))
    return spans.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))


def apart(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Spans (key, start, stop, ...) that none of the others (key, start, stop) overlaps: an anti join on key and bin."""
    near = _binned(others.select("key", F.col("start").alias("_a"), F.col("stop").alias("_b")).withColumnsRenamed({"_a": "start", "_b": "stop"})).withColumnsRenamed({"start": "_a", "stop": "_b"})
    met = _binned(spans.select("key", "start", "stop").distinct()).join(near, ["key", "bin"]).where("start < _b and _a < stop").select("key", "start", "stop").distinct()
    return spans.join(met, ["key", "start", "stop"], "left_anti")


def selected(spans: DataFrame, *order: str) -> DataFrame:
    """In the given order, each span that overlaps none kept before. Only spans that overlap directly or through others meet, in islands."""
    place = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.max("stop").over(place.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_opens", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_opens").over(place.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")
    rest = [c for c in spans.columns if c not in order and c != "key"]
    item = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rest))
    overlaps = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
    islands = rows.groupBy("key", "_island").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    none = F.filter("_all", lambda x: F.lit(False))
    kept = F.aggregate("_all", none, lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return islands.select("key", F.explode(kept).alias("_x")).select("key", "_x.*").select(*spans.columns)


def analysed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rules' suggestions that touch nothing protected and no suggestion of a rule before."""
    free = apart(suggestions(docs, text, key), found(docs, PROTECTED, text, key))
    return selected(free, "rank", "start")


def applied(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Docs that have spans (key, start, stop, replacement; not overlapping) with n and corrected."""
    mine = spans.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "replacement"))).alias("_edits"))
    rows = docs.join(mine, F.col(key) == F.col("_key"))
    start = lambda i: F.coalesce(F.get("_edits", i - 1)["stop"], F.lit(0))
    parts = F.transform("_edits", lambda e, i: F.concat(F.substring(text, (start(i) + 1).cast("int"), (e["start"] - start(i)).cast("int")), e["replacement"]))
    tail = F.substring(text, (F.element_at("_edits", -1)["stop"] + 1).cast("int"), F.length(text))
    return rows.withColumns({"n": F.size("_edits").cast("long"), "corrected": F.concat(F.array_join(parts, ""), tail)}).drop("_key", "_edits")
