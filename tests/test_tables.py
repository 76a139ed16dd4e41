"""Queries over given tables that SQL can't express, against plain Python over the smallest tables."""

from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from emendata.operators import custom, tagging
from emendata.plans import catalog, tables

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tagged(spark):
    return tables._tagged(spark, AT).select("ordinal", "lang", "source_tokens", "target_tokens", "tags", "alignment_reason").collect()


def plain_decoded(word, tag):
    kind, _, value = tag.partition(":")
    tokens = [r for r in __import__("regex").findall(tagging.TOKEN.replace("\\\\", "\\"), value)]
    if kind == "SUFFIX":
        old, new = tagging.SUFFIXES[value]
        stem = word.lower()[: len(word) - len(old)] + new
        stem = stem.upper() if len(word) > 1 and word == word.upper() else stem[:1].upper() + stem[1:] if word[:1].isascii() and word[:1].isupper() else stem
        return [stem]
    return {"KEEP": [word], "DELETE": [], "REPLACE_EXACT": tokens, "APPEND_EXACT": [word, *tokens], "PREPEND_EXACT": [*tokens, word], "CASE": [{"LOWER": word.lower(), "UPPER": word.upper(), "TITLE": word[:1].upper() + word[1:].lower()}.get(value)]}[kind]


def test_tags_make_the_target(tagged):
    assert tagged and sum(r["alignment_reason"] is None for r in tagged) >= len(tagged) - 2
    for r in tagged:
        if r["tags"] is not None:
            assert [t for w, tag in zip(r["source_tokens"], r["tags"], strict=True) for t in plain_decoded(w, tag)] == r["target_tokens"]


def test_categories_and_inventory(spark, tagged):
    tags = Counter(t for r in tagged for t in r["tags"] or [])
    by = Counter()
    for t, n in tags.items():
        kind, _, value = t.partition(":")
        by["keep" if t == "KEEP" else "delete" if t == "DELETE" else kind.lower() if kind in ("CASE", "SUFFIX") else "punctuation" if not any(c.isalnum() or c == "_" for c in value) else {"APPEND_EXACT": "append", "PREPEND_EXACT": "prepend"}.get(kind, "replace")] += n
    by.update(r["alignment_reason"] for r in tagged if r["alignment_reason"])
    assert {r["name"]: r["n"] for r in tables.tag_categories(spark, AT).collect()} == by
    rows = tables.tag_inventory(spark, AT).orderBy("label").collect()
    assert rows[0]["tag"] == "KEEP" and [r["n"] for r in rows[1:]] == sorted((r["n"] for r in rows[1:]), reverse=True)
    assert sum(r["population"] for r in tables.tag_coverage(spark, AT).collect()) == len(tagged)


def test_hand_made_tags(spark):
    cases = {
        ("She go home", "She goes home"): ["KEEP", "SUFFIX:ADD_ES", "KEEP"], ("a b c", "a c"): ["KEEP", "DELETE", "KEEP"], ("ok", "OK"): ["CASE:UPPER"], ("home", "go home now"): None,
        ("boss", "bos"): ["SUFFIX:REMOVE_S"], ("yes", "y"): ["SUFFIX:REMOVE_ES"], ("play", "plaies"): ["SUFFIX:Y_TO_IES"], ("ties", "ty"): ["SUFFIX:IES_TO_Y"],
        ("x y", "x , y"): ["APPEND_EXACT:,", "KEEP"], ("b", "a b"): ["PREPEND_EXACT:a"], ("a", "b c"): ["REPLACE_EXACT:b c"], ("a b", "p q r s t u v w x"): None,
    }
    rows = spark.createDataFrame(list(cases), "source string, target string").withColumns({"source_tokens": tagging.tokens(F.col("source")), "target_tokens": tagging.tokens(F.col("target"))})
    got = {(r["source"], r["target"]): r for r in tagging.tagged(rows.withColumn("edits", custom.edits_udf("source_tokens", "target_tokens"))).collect()}
    for pair, want in cases.items():
        if want is not None:
            assert got[pair]["tags"] == want, pair
    assert got["a b", "p q r s t u v w x"]["alignment_reason"] == "replacement_payload_limit"
    assert tagging.category(F.lit("x")) is not None


def test_best_references(spark):
    """Counts of all sources against the best of their targets, by plain sets of edits."""
    pairs = {(r["source"], r["target"], r["lang"]) for r in catalog.derived_pairs(spark, AT).collect() if r["source"] != r["target"]}
    regex = __import__("regex")
    token = regex.compile(tagging.TOKEN)
    edits = lambda a, b: {(i, j, tuple(b[k:n])) for op, i, j, k, n in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal"}
    refs = {}
    for s, t, lang in pairs:
        refs.setdefault((s, lang), set()).add(t)
    want = Counter()
    for (s, lang), targets in refs.items():
        tidy = regex.sub(r"(?i)\b([A-Za-z]+)([ \t]+)\1\b", r"\1", s)
        a = token.findall(s)
        best = None
        for t in sorted(targets):
            p, g = edits(a, token.findall(tidy)), edits(a, token.findall(t))
            tp, fp, fn = len(p & g), len(p - g), len(g - p)
            q, r = tp / (tp + fp) if tp + fp else 1.0, tp / (tp + fn) if tp + fn else 1.0
            key = (1.25 * q * r / max(1e-12, 0.25 * q + r), tp, -fp, -fn)
            best = max(best, key) if best else key
        for name in ("all", lang):
            want[name, "tp"] += best[1]
            want[name, "fp"] -= best[2]
            want[name, "fn"] -= best[3]
            want[name, "sentences"] += 1
    got = {(r["lang"], c): r[c] for r in tables.best_references(spark, AT).collect() for c in ("tp", "fp", "fn", "sentences")}
    assert got == dict(want)


def test_edits_by_name(spark):
    rows = tables.edits_by_name(spark, AT).collect()
    plain = custom._pairs(spark, AT).collect()
    for r in rows:
        mine = [custom.edits(list(p["source"]), list(p["target"])) for p in plain if p["lang"] == r["lang"]]
        assert r["pairs"] == sum(map(bool, mine)) and r["inserted"] == sum(i == j for e in mine for i, j, _ in e) and r["deleted"] == sum(not w for e in mine for _, _, w in e)
