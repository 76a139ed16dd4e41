"""Sums by text and counts of pieces, made where the texts stand."""

from pyspark.sql import functions as F

from emendata.operators import corpus, pieces, spans
from emendata.plans import tables
from emendata.plans.catalog import statement
from emendata.plans.dialect import Spark
from emendata.plans.statements import CONTACT, reason


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_totals_of_texts_with_one_id(spark):
    rows = spark.createDataFrame([(1, "ab c𝒳d, e"), (1, "f gh"), (2, "..."), (3, None)], "doc_id long, text string")
    got = spans.totals(rows, {"word": "()(\\p{L}+)", "mark": "()([.,])"})
    assert sorted(map(tuple, got.collect())) == [(1, "mark", 1, 6, 7, 0), (1, "word", 5, 0 + 3 + 8 + 0 + 2, 2 + 6 + 9 + 1 + 4, 1), (2, "mark", 3, 3, 6, 0)]
    assert "Window" not in plan(got)


def test_sizes_of_word_lists(spark):
    words = spark.createDataFrame([("ab", 3), ("abc", 2), ("b", 1)], "word string, n long")
    known = pieces.vocabulary(words)
    long_ = "a" * (pieces.LONGEST + 1)
    lists = [["ab", "ab", "b"], [], None, ["cab", "abcab"], [long_, "é"]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, words array<string>").coalesce(1)
    trie = pieces.Trie([r[0] for r in known.collect()])
    got = pieces.sizes(rows, known)
    assert dict(map(tuple, got.collect())) == {i: sum(len(trie.cut(w)) for w in x or []) for i, x in enumerate(lists)}
    assert "Exchange" not in plan(got) and "Join" not in plan(got)


def test_contacts_are_found_behind_the_parts_they_need(spark):
    texts = ["a@b.co", "see http://x", "x https://", "sk-abcdefghijkl", "AKIAabcdefghijkl", "sk-short", "a@b", "plain text", "ask-abcdefghijkl", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string").coalesce(1)
    sql = Spark().found("x", CONTACT)
    got = [tuple(r) for r in rows.orderBy("i").select(F.expr(sql), F.col("x").rlike(CONTACT), corpus._contact(F.col("x"))).collect()]
    assert [x[0] for x in got] == [x[1] for x in got] == [x[2] for x in got] and sum(x[0] is True for x in got) == 5
    assert "contains" in sql


def test_word_limit_by_one_word(spark):
    rows = spark.createDataFrame([(n, " ".join(["a"] * n)) for n in (80, 81)], "ordinal long, target string").withColumn("source", F.col("target"))
    assert {r["ordinal"]: r["reason"] for r in rows.select("ordinal", F.expr(reason(Spark())).alias("reason")).collect()} == {80: None, 81: "word_limit"}
    wanted = F.when(F.col("ordinal") == 81, "clean")
    got = corpus.validated(rows.withColumn("category", F.lit("clean")), wanted)
    assert {r["ordinal"]: r["reject_reason"] for r in got.collect()} == {80: None, 81: "word_limit"}
    got = corpus.validated(rows.withColumn("category", F.lit("spelling")), wanted)  # the category is asked for in one row alone
    assert {r["ordinal"]: r["reject_reason"] for r in got.collect()} == {80: "clean_mismatch", 81: "category_mismatch"}


def test_unknown_words_of_small_and_large_lists(spark, tmp_path, monkeypatch):
    texts = ["One one ONE two it's 3. Two!", "two three İ", "three, four"]
    spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(tuple, statement("g15_known_words")(spark, str(tmp_path)).collect()))
    for most in (0, 1, 20_000):
        monkeypatch.setattr(tables, "_FREQUENT", most)
        assert sorted(map(tuple, tables.unknown_words(spark, str(tmp_path)).collect())) == want


def test_rules_are_tried_only_where_a_text_holds_what_they_need(spark):
    texts = ["I RECIEVE it.", "recieved", "My friend walk EVERY day.", "my friend walk there", "see `x` or a@b.co", "HTTP://x and http://y", "www.a", "", None]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(1)
    patterns = spans.RULES | spans.PROTECTED
    bare = {name: f"{p}(?:)" for name, p in patterns.items()}  # the same patterns, unknown to NEEDED
    got = sorted(map(tuple, spans.marked(docs, patterns).collect()))
    assert got == sorted(map(tuple, spans.marked(docs, bare).collect())) and {x[1] for x in got} >= {"spelling", "habit", "address"}
    assert "contains" in plan(spans.marked(docs, patterns)).lower() and "contains" not in plan(spans.marked(docs, bare)).lower()
