import io
import tarfile

import pytest
from pyspark.sql import functions as F

from emendata.operators import corpus, scoring
from emendata.sources import readers, sinks


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "ordinal long, value string")


@pytest.mark.parametrize(
    ("make", "message"),
    [
        (lambda s: readers.tsv_lines(lines(s, "a\tb\tc")), "two fields"),
        (lambda s: readers.parallel(lines(s, "a", "b"), lines(s, "a")), "differ in length"),
        (lambda s: readers.references(lines(s, "a"), lines(s, " ")), "missing or blank"),
        (lambda s: readers.m2(s.createDataFrame([(1, "no source line")], "block long, value string")), "annotated block"),
        (lambda s: readers.m2(s.createDataFrame([(1, "S a\nA 0 1|||x|||y")], "block long, value string")), "annotated block"),
        (lambda s: readers.m2(s.createDataFrame([(1, "S a\nA 0 5|||X|||y|||R|||-|||0")], "block long, value string")), "outside"),
        (lambda s: readers.m2(s.createDataFrame([(1, "S a\nA 0 0|||noop|||-NONE-|||R|||-|||0")], "block long, value string")), "outside"),
        (lambda s: readers.m2_references(s.createDataFrame([(1, "S a")], "block long, value string")), "annotator"),
        (lambda s: readers.evaluation(s.createDataFrame([(0, "x", "a", "b", None), (1, "x", "a", "b", None)], "ordinal long, id string, source string, target string, references array<string>")), "repeated"),
        (lambda s: readers.dialogs(s.createDataFrame([("x/orig/d.txt", "a\nb"), ("x/corr/d.txt", "a")], "member string, text string")), "aligned"),
        (lambda s: readers.commits(lines(s, '{"repo":"a/b","commit":"c","edits":[{"src":{"lang":"eng","text":"a","path":"p"},"tgt":{"lang":"eng","text":"b"},"is_typo":true}]}').select("value"), s.createDataFrame([("a/b@c", "MIT", None, "c")], "key string, license string, license_sha256 string, revision string")), "proof"),
    ],
)
def test_broken_sources_fail(spark, make, message):
    with pytest.raises(Exception, match=message):
        make(spark).collect()


@pytest.mark.parametrize(("name", "wanted", "message"), [("../x", None, "leaves"), ("/x", None, "leaves"), ("a", ["b"], "missing")])
def test_archives_are_checked(spark, name, wanted, message):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        info = tarfile.TarInfo(name)
        info.size = 1
        archive.addfile(info, io.BytesIO(b"x"))
    df = spark.createDataFrame([("p", bytearray(out.getvalue()))], "path string, content binary")
    with pytest.raises(Exception, match=message):
        readers.members(df, wanted).collect()


def test_m2_files_in_blocks(spark, tmp_path):
    (tmp_path / "x.m2").write_text("S a b\nA 0 1|||X|||c|||R|||-|||0\n\n\n\nS d\n")
    text = spark.read.text(str(tmp_path / "x.m2"), lineSep="\n\n").withColumn("block", F.monotonically_increasing_id())
    rows = readers.m2(readers.m2_blocks(text)).select("source", "target").collect()
    assert sorted(map(tuple, rows)) == [("a b", "c b"), ("d", "d")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", "b"), ("dev", "c", "d")], "split string, source string, target string")
    sinks.write_splits(rows, str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits" / "split=dev")).first()["source"] == "c"
    with pytest.raises(Exception, match="exist"):
        sinks.write_splits(rows, str(tmp_path / "splits"))
    one = sinks.write_immutable(rows, str(tmp_path / "shard"))
    assert sinks.write_immutable(rows.orderBy(F.desc("source")), str(tmp_path / "shard")) == one
    with pytest.raises(ValueError):
        sinks.write_immutable(rows.limit(1), str(tmp_path / "shard"))
    last = sinks.append_log(spark, str(tmp_path / "log"), ["x", "y"])
    sinks.append_log(spark, str(tmp_path / "log"), ["z"], last)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 3 and scoring.chain_breaks(log).count() == 0
    broken = log.withColumn("body", F.when(F.col("ordinal") == 1, "forged").otherwise(F.col("body")))
    assert [tuple(r) for r in scoring.chain_breaks(broken).collect()] == [(1, "entry")]


def test_parquet_corpus_reads_its_two_columns(spark, tmp_path):
    spark.createDataFrame([("a", "b", 1)], "input string, output string, more int").write.parquet(str(tmp_path / "c"))
    rows = readers.columns(spark, str(tmp_path / "c"))
    assert tuple(rows.first()) == ("a", "b") and "more" not in rows._jdf.queryExecution().executedPlan().toString()


def test_labels_and_vocabulary(spark):
    rows = corpus.tagged(corpus.identified(spark.createDataFrame([(1, "he go", "he goes"), (2, "a b", "a b"), (3, "i is", "i am")], "ordinal long, source string, target string"))).withColumn("split", F.lit("train"))
    labels = corpus.label_inventory(rows, 2).orderBy("label").collect()
    assert [r["label"] for r in labels] == [0, 1] and labels[0]["tag"] == "KEEP"
    assert corpus.supported(rows, corpus.label_inventory(rows, 2)).where("supported").count() == 2
