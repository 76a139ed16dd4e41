from pyspark.sql import functions as F

from emendata.operators import custom
from emendata.operators.custom import applied, edits, fuzzy_pairs, osa_distance
from emendata.plans import catalog
from emendata.sources import readers
from emendata.streaming import drafts


def test_osa_against_full_matrix():
    assert [osa_distance(*x, 2) for x in (("teh", "the"), ("ca", "abc"), ("", "ab"), ("a", "a"), ("abcd", "xyz"))] == [1, 3, 2, 0, 3]


def test_edits_round_trip():
    for a, b in (("a b c", "a c"), ("a a a", "a"), ("", "x y"), ("x", "")):
        assert applied(a.split(), edits(a.split(), b.split())) == b.split()


def test_flagship_runs(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").count() > 0


def test_every_statement_has_sql():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_word_diff_and_metadata(spark):
    lines = spark.createDataFrame([("a [-b-] {+c+} d", 0), ("x [-y", 1)], "value string, ordinal long")
    rows = {r["ordinal"]: r for r in readers.word_diff(lines).collect()}
    assert (rows[0]["source"], rows[0]["target"], rows[0]["reject_reason"]) == ("a b d", "a c d", None)
    assert rows[1]["reject_reason"] == "invalid_wdiff"
    lines = spark.createDataFrame([("###url: u1", 0, "f"), ("one", 1, "f"), ("two", 2, "f"), ("###url: u2", 3, "f"), ("three", 4, "f")], "value string, ordinal long, file string")
    assert [r["url"] for r in readers.with_metadata(lines).orderBy("ordinal").collect()] == ["u1", "u1", "u2"]


def test_m2(spark):
    block = "S He go home\nA 1 2|||R:VERB|||goes|||REQUIRED|||-NONE-|||0\nA 1 2|||R:VERB|||went|||REQUIRED|||-NONE-|||1\nA 2 3|||U:NOUN|||-NONE-|||REQUIRED|||-NONE-|||1"
    rows = readers.m2(spark.createDataFrame([(1, block), (2, "S Fine .")], "block long, value string")).orderBy("block", "annotator").collect()
    assert [r["target"] for r in rows] == ["He goes home", "He went", "Fine ."]
    assert all(r["reject_reason"] is None for r in rows)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = drafts.latest_drafts(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, drafts.latest_drafts(events).collect()))


def test_fuzzy_pairs_against_brute_force(spark):
    common = ["abcdef", "word", "letters", "government", "other", "the"]
    rare = ["xbcdey", "wxoryd", "lettres", "govrenmnet", "ohtre", "eht", "governmentxy", "abc", "wo", "ab"]
    got = {(r["word"], r["candidate"], r["distance"]) for r in fuzzy_pairs(spark.createDataFrame([(w,) for w in rare], "word string"), spark.createDataFrame([(w, 30) for w in common], "candidate string, freq long")).collect()}
    assert got == {(a, b, d) for a in rare for b in common if (d := osa_distance(a, b, 2)) <= (1 if len(a) < 5 else 2)}


def test_alignment_round_trips_over_all_documents(spark):
    at = "/root/testdata/sf0.001"
    pairs = {r["ordinal"]: (r["source"], r["target"]) for r in custom._pairs(spark, at).collect()}
    rows = custom.align(spark, at).collect()
    assert len(rows) == sum(a != b for a, b in pairs.values())
    for r in rows:
        source, target = pairs[r["ordinal"]]
        assert applied(list(source), [(e["start"], e["stop"], e["words"]) for e in r["edits"]]) == list(target)
