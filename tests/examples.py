"""Queries over small tables of their own, with the rows that they must give written out.

The given tables hold no correction pairs, annotated blocks, tags or suggestions; these do, with the edge cases of each
operator. Expected rows are fixed by hand from the operator's definition, so the comparison doesn't share code with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emendata.functions import tags, text
from emendata.operators import corpus, scoring
from emendata.session import shipped
from emendata.sources import readers

_SQL = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@dataclass(frozen=True)
class Example:
    given: str
    rows: list[tuple]
    run: Callable[[DataFrame], DataFrame]
    columns: str
    expected: list[tuple]

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(shipped(spark).createDataFrame(self.rows, self.given))

    def sql(self) -> str:
        fields = [c.split() for c in self.columns.split(", ")]

        def literal(v) -> str:
            return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

        names = [f"CAST(c{i} AS {_SQL[kind]}) AS {name}" for i, (name, kind) in enumerate(fields)]
        rows = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in self.expected)
        return f"SELECT {', '.join(names)} FROM (VALUES {rows}) t({', '.join(f'c{i}' for i in range(len(fields)))})"


def each(run: Callable[..., list[tuple]], columns: str) -> Callable[[DataFrame], DataFrame]:
    """A table function: the rows that `run` makes of each row, over Arrow batches."""
    names = [c.split()[0] for c in columns.split(", ")]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [x for row in batch.itertuples(index=False, name=None) for x in run(*row)]
            yield pd.DataFrame({n: pd.Series([x[i] for x in made], dtype=object) for i, n in enumerate(names)})

    return lambda df: df.mapInPandas(over, columns)


_PAIRS = "ordinal long, source string, target string"


def _pieces(word: str) -> list[int]:
    return text.word_pieces(word, {w: i for i, w in enumerate("[PAD] [UNK] [CLS] [SEP] i have a book . she ##s cafe 中 , it '".split())})


def _unit_chunks(i: int, body: str) -> list[tuple]:
    return [(i, k, " ".join(w for w, _, _ in chunk)) for k, chunk in enumerate(text.chunks(body, lambda w: 9 if w == "huge" else 1, 6))]


def _scored(df: DataFrame) -> DataFrame:
    best = scoring.best_references(df)
    total = scoring.corpus_scores(best, "category")
    return total.select(F.coalesce("category", F.lit("all")).alias("category"), "tp", "fp", "fn", "sentences", "exact", "clean_sentences", "clean_changed", F.round("edit_f0_5", 9).alias("f"), F.round("clean_rate", 9).alias("clean_rate"))


_BLOCK = "S He go home\nA 1 2|||R:VERB|||goes|||REQUIRED|||-NONE-|||0\nA 1 2|||R:VERB|||went|||REQUIRED|||-NONE-|||1\nA 2 3|||U:NOUN|||-NONE-|||REQUIRED|||-NONE-|||1"
_COMMIT = '{"repo":"https://github.com/a/b.git","commit":"c1","edits":[{"src":{"lang":"eng","text":"teh cat","path":"x.md"},"tgt":{"lang":"eng","text":"the cat"},"is_typo":true},{"src":{"lang":"fra","text":"x","path":"y"},"tgt":{"lang":"eng","text":"y"},"is_typo":true},{"src":{"lang":"eng","text":"x","path":"y"},"tgt":{"lang":"eng","text":"y"},"is_typo":false}]}'


def _proofs(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([("a/b@c1", "MIT", "f" * 64, "c1"), ("a/c@c2", "GPL-3.0", "f" * 64, "c2")], "key string, license string, license_sha256 string, revision string")


def _lines(df: DataFrame, part: str) -> DataFrame:
    return df.where(F.col("part") == part).select("ordinal", "value")


def _chain(rows: list[tuple[str, str | None]]) -> list[tuple]:
    """A hash-chained log of bodies; an entry with an own hash given is a forged one."""
    from hashlib import sha256

    out, before = [], "0" * 64
    for i, (body, forged) in enumerate(rows):
        own = forged or sha256(f"{before}\n{body}".encode()).hexdigest()
        out.append((i, before, body, own))
        before = own
    return out


def _held(df: DataFrame) -> DataFrame:
    rows = [("Held out here", "x", ["Another one is it n't"]), ("STRASSE now", None, None)]
    return df.sparkSession.createDataFrame(rows, "source string, target string, references array<string>")


def _labels(df: DataFrame) -> DataFrame:
    """Pairs to tags, split, labels, coverage: the vocabulary is of training rows alone."""
    rows = corpus.tagged(corpus.split_reviewed(corpus.identified(df).withColumn("reviewed", F.lit(True)))).withColumn("split", F.when(F.col("ordinal") < 5, "train").otherwise("dev"))
    return corpus.coverage(corpus.supported(rows.withColumn("category", F.lit("mixed")), corpus.label_inventory(rows, 3)))


_CANDIDATE = "threshold double, predicted_edits int, inference_failures int, edit_precision double, clean_rate double, edit_f0_5 double"
_GRID = [(0.5, 100, 0, 0.90, 0.01, 0.80), (0.7, 80, 0, 0.96, 0.02, 0.70), (0.8, 60, 0, 0.97, 0.01, 0.70), (0.9, 20, 0, 0.99, 0.0, 0.75), (0.95, 40, 1, 0.99, 0.0, 0.9), (0.99, 30, 0, 0.99, None, 0.9)]
_YES = {x: True for x in scoring.FLAGS}


def _calibrate(df: DataFrame) -> DataFrame:
    cases = df.where("round = 0").select("id", "expected")
    out = scoring.calibration(cases, df.select("id", "round", "flags"))
    return out.select(F.round("least_agreement", 6).alias("least_agreement"), F.round("repeat_agreement", 6).alias("repeat_agreement"), "unsafe", "critical", "passed")


E: dict[str, Example] = {
    "c1_c4_exact_keys": Example("id long, t string", [(1, "Café  au lait"), (2, "Café au lait"), (3, "STRASSE"), (4, "Straße"), (5, "do n't stop ."), (6, "It 's ( fine )")], lambda d: d.select("id", corpus.normalized("t").alias("n"), corpus.key("t").alias("k"), corpus.canonical("t").alias("c"), F.array_join(corpus.keys("t"), "|").alias("ks")), "id long, n string, k string, c string, ks string", [(1, "Café au lait", "café au lait", "Café au lait".replace("é", "e ́"), "cafe ́ au lait|café au lait"), (2, "Café au lait", "café au lait", "Café au lait", "café au lait"), (3, "STRASSE", "strasse", "STRASSE", "strasse"), (4, "Straße", "strasse", "Straße", "strasse"), (5, "do n't stop .", "do n't stop .", "don't stop.", "do n't stop .|don't stop."), (6, "It 's ( fine )", "it 's ( fine )", "It's (fine)", "it 's ( fine )|it's (fine)")]),
    "c6_word_spans": Example("id long, t string", [(1, "\U0001f600 You're ready."), (2, "a1 b_2")], each(lambda i, t: [(i, *x) for x in text.split_words(t)], "id long, word string, start int, stop int"), "id long, word string, start int, stop int", [(1, "\U0001f600", 0, 2), (1, "You're", 3, 9), (1, "ready", 10, 15), (1, ".", 15, 16), (2, "a", 0, 1), (2, "1", 1, 2), (2, "b", 3, 4), (2, "2", 5, 6)]),
    "c8_whole_words": Example("id long, t string", [(1, "café-bar o’clock freind_name x2 -y")], each(lambda i, t: [(i, *x) for x in text.spelling_words(t)], "id long, word string, start int, stop int"), "id long, word string, start int, stop int", [(1, "café-bar", 0, 8), (1, "o’clock", 9, 16), (1, "freind_name", 17, 28), (1, "x2", 29, 31), (1, "y", 33, 34)]),
    "c14_every_category": Example("tag string", [("DELETE",), ("APPEND:the",), ("APPEND_EXACT:.",), ("APPEND:,",), ("PREPEND_EXACT:a b",), ("PREPEND_EXACT:(",), ("REPLACE:the",), ("REPLACE:_",)], each(lambda t: [(t, tags.tag_category(t))], "tag string, category string"), "tag string, category string", [("DELETE", "delete"), ("APPEND:the", "append"), ("APPEND_EXACT:.", "punctuation"), ("APPEND:,", "punctuation"), ("PREPEND_EXACT:a b", "prepend"), ("PREPEND_EXACT:(", "punctuation"), ("REPLACE:the", "replace"), ("REPLACE:_", "replace")]),
    "c19_delete_keys_two": Example("word string", [("abc",), ("abcdefghi",)], each(lambda w: [(w, len(text.delete_keys(w, 2)), " ".join(text.delete_keys(w, 2)[:4]))], "word string, n int, first string"), "word string, n int, first string", [("abc", 7, "a ab abc ac"), ("abcdefghi", 29, "abcde abcdef abcdefg abcdeg")]),
    "c20_families": Example("id long, t string", [(1, "I have two cats!"), (2, "i have 7 cats"), (3, "I have twelve cats"), (4, "Don’t"), (5, "don't .")], lambda d: d.select("id", corpus.family("t").alias("f")).select("id", F.dense_rank().over(Window.orderBy("f")).alias("r")).groupBy("r").agg(F.min("id").alias("first"), F.count("*").alias("n")).select("first", "n"), "first long, n long", [(1, 2), (3, 1), (4, 2)]),
    "c21_word_pieces": Example("word string", [("Shes",), ("xyz",), ("Café",), ("a中",), ("it's",), ("a" * 101,), ("́",)], each(lambda w: [(w, " ".join(map(str, _pieces(w))))], "word string, ids string"), "word string, ids string", [("Shes", "9 10"), ("xyz", "1"), ("Café", "11"), ("a中", "6 12"), ("it's", "14 15 1"), ("a" * 101, "1"), ("́", "1")]),
    "c22_chinese": Example("c string", [("中",), ("㐀",), ("\U00020001",), ("豈",), ("a",), ("あ",), ("\U0002f800",)], each(lambda c: [(c, text.is_chinese(c))], "c string, chinese boolean"), "c string, chinese boolean", [("中", True), ("㐀", True), ("\U00020001", True), ("豈", True), ("a", False), ("あ", False), ("\U0002f800", True)]),
    "c24_repository_slug": Example("url string", [("https://github.com/a/b.git",), ("https://github.com/a/b/",), ("a/b.c",), ("https://gitlab.com/a/b",), ("https://github.com/a/b?x=1",), ("a/b/c",), ("https://github.com/a",)], lambda d: d.select("url", readers.repository_slug("url").alias("slug")), "url string, slug string", [("https://github.com/a/b.git", "a/b"), ("https://github.com/a/b/", "a/b"), ("a/b.c", "a/b.c"), ("https://gitlab.com/a/b", None), ("https://github.com/a/b?x=1", None), ("a/b/c", None), ("https://github.com/a", None)]),
    "n1_n4_exact_identities": Example(_PAIRS + ", family_id string", [(1, "He go", "He goes", None), (2, "he go", "He goes", None), (3, "He  go", "he goes", None), (4, "He go", "He goes", "fam")], lambda d: corpus.identified(d).select("ordinal", *[(F.dense_rank().over(Window.orderBy(F.expr(f"min(ordinal) over (partition by {c})")))).alias(c) for c in ("pair_id", "clean_group", "source_key", "target_key")]), "ordinal long, pair_id int, clean_group int, source_key int, target_key int", [(1, 1, 1, 1, 1), (2, 2, 1, 1, 1), (3, 3, 1, 1, 2), (4, 1, 2, 1, 1)]),
    "d1_validate_exact": Example("ordinal long, source string, target string, category string", [(1, None, "abc", "mixed"), (2, "abc", "abd", "odd"), (3, " ab ", "abcd", None), (4, "abc\x01", "abcd", None), (5, "12345", "abc", None), (6, "abc", "12345", None), (7, "see https://x.y", "abc", None), (8, "mail a.b@c.org now", "abc", None), (9, "abc", "AKIA123456789012", None), (10, "Same text", "Same  text", "mixed"), (11, "One", "Two", "clean"), (12, "w " * 81, "w", None), (13, "w " * 81, "ww w", None), (14, "He go.", "He goes.", "agreement"), (15, "Café x", "Café x", "clean"), (16, "abc", "x" * 601, None)], lambda d: corpus.validated(d).select("ordinal", F.coalesce("reject_reason", F.lit("ok")).alias("reason")), "ordinal long, reason string", [(1, "schema"), (2, "category"), (3, "length"), (4, "control_character"), (5, "no_english_letters"), (6, "no_english_letters"), (7, "contact_or_secret_pattern"), (8, "contact_or_secret_pattern"), (9, "contact_or_secret_pattern"), (10, "clean_mismatch"), (11, "clean_mismatch"), (12, "length"), (13, "word_limit"), (14, "ok"), (15, "ok"), (16, "length")]),
    "d1_category_mismatch": Example("ordinal long, source string, target string, category string", [(1, "He go.", "He goes.", "agreement"), (2, "He go.", "He goes.", "articles"), (3, "He go.", "He goes.", None)], lambda d: corpus.validated(d, "agreement").select("ordinal", F.coalesce("reject_reason", F.lit("ok")).alias("reason")), "ordinal long, reason string", [(1, "ok"), (2, "category_mismatch"), (3, "ok")]),
    "e15_chunks": Example("id long, t string", [(1, "I have a book. I have"), (2, "a b c d e f g"), (3, "a huge b"), (4, "")], each(_unit_chunks, "id long, chunk int, words string"), "id long, chunk int, words string", [(1, 0, "I have a book"), (1, 1, "."), (1, 2, "I have"), (2, 0, "a b c d"), (2, 1, "e f g"), (3, 0, "a"), (3, 1, "b")]),
    "g1_exact_decontamination": Example(_PAIRS, [(1, "HELD out  here", "x y"), (2, "fine", "another one is itn't"), (3, "Another one is it n't", "z"), (4, "clean", "also clean"), (5, "straße now", "ok")], lambda d: corpus.decontaminated(d, _held(d)).select("ordinal"), "ordinal long", [(4,)]),
    "g5_d22_stage_join": Example("side string, id long", [("want", 1), ("want", 2), ("want", 3), ("got", 1), ("got", 3), ("got", 3), ("got", 4)], lambda d: scoring.stage_join(d.where("side = 'want'").select("id"), d.where("side = 'got'").select("id")), "id long, fault string", [(2, "missing"), (3, "repeated"), (4, "extra")]),
    "h4_g14_best_reference": Example("id long, source string, references array<string>, corrected string, category string", [(1, "he go home", ["he goes home", "he went home"], "he went home", "verb"), (2, "she is fine", ["she is fine"], "she was fine", "verb"), (3, "a cat sat", ["a cat sat", "the cat sat"], "a cat sat", "article"), (4, "teh dog run", ["the dog runs", "the dog ran"], "the dog run", "spelling"), (5, "one two", ["one three"], "one  two", "spelling")], _scored, "category string, tp long, fp long, fn long, sentences long, exact long, clean_sentences long, clean_changed long, f double, clean_rate double", [("all", 2, 1, 2, 5, 2, 2, 1, 0.625, 0.5), ("article", 0, 0, 0, 1, 1, 1, 0, 1.0, 0.0), ("spelling", 1, 0, 2, 2, 0, 0, 0, 0.714285714, None), ("verb", 1, 1, 0, 2, 1, 1, 1, 0.555555556, 1.0)]),
    "h16_h17_calibration": Example("id string, round int, expected map<string,boolean>, flags map<string,boolean>", [("a", 0, _YES, _YES), ("a", 1, _YES, _YES), ("b", 0, _YES | {"meaning_preserved": False}, _YES), ("b", 1, _YES | {"meaning_preserved": False}, _YES | {"meaning_preserved": False})], _calibrate, "least_agreement double, repeat_agreement double, unsafe long, critical long, passed boolean", [(0.9, 0.9, 1, 1, False)]),
    "i1_i2_g11_first_wins": Example(_PAIRS + ", reviewed boolean", [(1, "a b", "A b", False), (2, "A  B", "A b", True), (3, "x y", "x z", True), (4, "X y", "x w", False), (5, "k", "K", False), (6, "k", "K", False)], lambda d: corpus.first_wins(corpus.identified(d)).select("ordinal", "target"), "ordinal long, target string", [(2, "A b"), (5, "K")]),
    "i7_hash_chain_faults": Example("ordinal long, previous_sha256 string, body string, entry_sha256 string", [*_chain([("a", None), ("b", None), ("c", "e" * 64), ("d", None)]), (9, "0" * 64, "x", "y")][:4] + [(4, "1" * 64, "e", "f")], scoring.chain_breaks, "ordinal long, fault string", [(2, "entry"), (4, "chain")]),
    "j9_threshold": Example(_CANDIDATE, _GRID, scoring.choose, "selected double, unconstrained double, disabled boolean", [(0.8, 0.99, False)]),
    "j10_joint_threshold": Example(_CANDIDATE, _GRID, lambda d: scoring.choose_joint(d, d.withColumns({"edit_f0_5": F.when(F.col("threshold") == 0.7, 0.9).otherwise(F.col("edit_f0_5") - 0.1), "edit_precision": F.col("edit_precision")})), "selected double, disabled boolean", [(0.7, False)]),
    "g10_dialog_overlap": Example("ordinal long, id string, split string, source string, references array<string>", [(1, "a", "train", "Hello you", ["Hello, you"]), (2, "b", "test", "hello  YOU", ["x"]), (3, "c", "train", "same", ["s"]), (4, "d", "train", "same", ["s"]), (5, "e", "dev", "own", ["o"])], lambda d: corpus.without_cross_split(d).select("id"), "id string", [("c",), ("e",)]),
    "h9_h10_d9_coverage": Example(_PAIRS, [(1, "he go home", "he goes home"), (2, "she go out", "she goes out"), (3, "it do run", "it does run"), (4, "a b", "p q r s t u v w x"), (5, "we go now", "we goes now"), (6, "the the cat", "the cat")], _labels, "split string, category string, population long, taggable long, unrepresentable long, supported long, unsupported_vocabulary long", [("train", "mixed", 4, 3, 1, 3, 0), ("dev", "mixed", 2, 2, 0, 1, 1)]),
    "a1_a2_m2": Example("block long, value string", [(1, _BLOCK), (2, "\nS Fine .\n\n"), (3, "S a b c\nA 0 2|||X|||x|||R|||-|||0\nA 1 3|||X|||y|||R|||-|||0"), (4, "S a b\nA 0 1|||UNK|||x|||R|||-|||0"), (5, "S a b\nA -1 -1|||noop|||-NONE-|||R|||-|||0\nA 2 2|||M|||c d|||R|||-|||1"), (6, " \n ")], lambda d: readers.m2(readers.m2_blocks(d)), "block long, annotator string, source string, target string, reject_reason string", [(1, "0", "He go home", "He goes home", None), (1, "1", "He go home", "He went", None), (2, "0", "Fine .", "Fine .", None), (3, "0", None, None, "overlapping_annotation"), (4, "0", None, None, "unresolved_annotation"), (5, "0", "a b", "a b", None), (5, "1", "a b", "a b c d", None)]),
    "a4_tsv": Example("ordinal long, value string", [(0, "a\tb"), (1, "c d\t")], readers.tsv_lines, "ordinal long, source string, target string", [(0, "a", "b"), (1, "c d", "")]),
    "a5_a11_ordinal_join": Example("part string, ordinal long, value string", [(p, i, f"{p}{i}") for p in ("s", "r", "q") for i in range(3)], lambda d: readers.references(_lines(d, "s"), _lines(d, "r"), _lines(d, "q")).select("ordinal", "source", F.array_join("references", "|").alias("refs")), "ordinal long, source string, refs string", [(0, "s0", "r0|q0"), (1, "s1", "r1|q1"), (2, "s2", "r2|q2")]),
    "a6_word_diff": Example("ordinal long, value string", [(0, "a [-b-] {+c+} d"), (1, "x [-y"), (2, "one{+ two+}[-x-] three\tfour"), (3, "[-a-]{+b+}")], readers.word_diff, "ordinal long, source string, target string, reject_reason string", [(0, "a b d", "a c d", None), (1, "x [-y", "x [-y", "invalid_wdiff"), (2, "one x three four", "one  two three four", None), (3, "a", "b", None)]),
    "a6b_i8_metadata": Example("file string, ordinal long, value string", [("f", 0, "early"), ("f", 1, "###url: u1"), ("f", 2, "one"), ("f", 3, "###page: p"), ("f", 4, "two"), ("f", 5, "###url: u2"), ("f", 6, "three"), ("g", 0, "other")], lambda d: readers.with_metadata(d).select("file", "ordinal", "value", "url"), "file string, ordinal long, value string, url string", [("f", 0, "early", None), ("f", 2, "one", "u1"), ("f", 4, "two", "u1"), ("f", 6, "three", "u2"), ("g", 0, "other", None)]),
    "a7_g4_commits": Example("value string", [(_COMMIT,), (_COMMIT.replace("a/b.git", "a/c").replace("c1", "c2"),)], lambda d: readers.commits(d, _proofs(d)), "repo string, revision string, corpus_record_id string, source string, target string, license string, reject_reason string", [("a/b", "c1", "a/b:c1:0", "teh cat", "the cat", "MIT", None), ("a/b", "c1", "a/b:c1:1", "x", "y", "MIT", "non_english"), ("a/b", "c1", "a/b:c1:2", "x", "y", "MIT", "not_classified_typo"), ("a/c", "c2", "a/c:c2:0", "teh cat", "the cat", None, "source_license_unverified"), ("a/c", "c2", "a/c:c2:1", "x", "y", None, "non_english"), ("a/c", "c2", "a/c:c2:2", "x", "y", None, "not_classified_typo")]),
    "a8_table_pages": Example("repo string, commit_hash string, edit_number int, source_lang string, target_lang string, is_typo boolean, source_path string", [("https://github.com/b/b", "2", 0, "eng", "eng", True, "R.MD"), ("https://github.com/a/a", "9", 1, "eng", "eng", True, "x.txt"), ("https://github.com/a/a", "9", 0, "eng", "eng", True, "x.rst"), ("https://github.com/a/a", "1", 0, "eng", "eng", True, "x.py"), ("https://github.com/a/a", "2", 0, "eng", "fra", True, "x.md"), ("https://github.com/c/c", "0", 0, "eng", "eng", True, "x.md"), ("https://github.com/b/b", "3", 0, "eng", "eng", True, "y.md")], lambda d: readers.table_rows(d, ["b/b", "a/a"], 3).select("repo", "commit_hash", "edit_number"), "repo string, commit_hash string, edit_number int", [("a/a", "9", 0), ("a/a", "9", 1), ("b/b", "2", 0)]),
    "a12_dialogs": Example("member string, text string", [("x/orig/d1.txt", "hello\nhow are you\n"), ("x/corr/d1.txt", "Hello\nHow are you?\n"), ("x/corr2/d1.txt", "Hello\nHow're you?\n"), ("x/orig/d2.txt", "ok"), ("x/corr/d2.txt", "OK"), ("x/README.txt", "no")], lambda d: readers.dialogs(d).select("dialog", "index", "source", F.array_join("references", "|").alias("refs")), "dialog string, index int, source string, refs string", [("x/d1", 0, "hello", "Hello"), ("x/d1", 1, "how are you", "How are you?|How're you?"), ("x/d2", 0, "ok", "OK")]),
    "a13_m2_references": Example("block long, value string", [(1, _BLOCK), (2, "S a b\nA -1 -1|||noop|||-NONE-|||R|||-|||0\nA 1 2|||X|||c|||R|||-|||1")], lambda d: readers.m2_references(d).select("block", "source", F.array_join("references", "|").alias("refs")), "block long, source string, refs string", [(1, "He go home", "He goes home|He went"), (2, "a b", "a b|a c")]),
    "a18_evaluation_rows": Example("ordinal long, id string, source string, target string, references array<string>", [(0, None, "a", "b", None), (1, "own", "c", None, ["d", "e"])], lambda d: readers.evaluation(d).select("id", "source", F.array_join("references", "|").alias("refs")), "id string, source string, refs string", [("sample-0", "a", "b"), ("own", "c", "d|e")]),
    "a20_n14_proofs": Example("key string, content string, spdx string", [("a", "TUlU\nIExpY2Vuc2U=", "MIT"), ("b", "eA==", "GPL-3.0")], readers.proof, "key string, license string, license_sha256 string", [("a", "MIT", "abb2896dc3c2a9402f901b88d5035cf0a83d5cf7c17e73642cdf562b0b9d3bc5"), ("b", None, None)]),
    "j8_composition": Example("rows int, templates int, a int, b int", [(100, 90, 50, 40), (100, 200, 5, 40), (7, 9, 9, 9)], each(lambda r, t, a, b: [corpus.equal_composition({"a": a, "b": b}, t, r)], "effective int, each int"), "effective int, each int", [(88, 22), (20, 5), (4, 1)]),
    "j12_last_of_source": Example("ordinal long, source string, v int", [(1, "a", 1), (2, "b", 2), (3, "a", 3)], lambda d: corpus.latest_by_source(d, 5).select("source", "v"), "source string, v int", [("a", 3), ("b", 2)]),
}


def every() -> dict[str, Example]:
    import examples_corpus

    return E | examples_corpus.E


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: example.query for name, example in every().items()}


def oracle_sql() -> dict[str, str]:
    return {name: example.sql() for name, example in every().items()}
