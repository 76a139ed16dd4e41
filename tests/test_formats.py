import json
import tarfile

import pytest
from pyspark.sql import functions as F

from emendata.sources import formats

BLOCK = "S He go home\nA 1 2|||R:VERB|||goes|||REQUIRED|||-NONE-|||0\nA 1 2|||R:VERB|||went|||REQUIRED|||-NONE-|||1\nA 2 3|||U:NOUN|||-NONE-|||REQUIRED|||-NONE-|||1"
ODD = ["S Fine .", "S a b c\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0", "S x y\nA 0 1|||UNK|||q|||REQUIRED|||-NONE-|||0", "S x y z\nA 0 2|||R|||q|||REQUIRED|||-NONE-|||0\nA 1 3|||R|||r|||REQUIRED|||-NONE-|||0"]


@pytest.fixture(scope="module")
def known(spark):
    return formats.registered(spark)


def load(spark, kind, path, **options):
    return spark.read.format("emendata_pairs").options(kind=kind, **options).load(str(path))


@pytest.mark.parametrize("size", [1, 7, 50, 97, 10_000_000])
def test_m2_cut_anywhere(known, tmp_path, size):
    blocks = [BLOCK, *ODD] * 6
    (tmp_path / "a.m2").write_text("\n\n" + "\n\n\n".join(blocks) + "\n")
    reader = formats.PairReader({"kind": "m2", "path": str(tmp_path), "block_bytes": str(size)})
    rows = load(known, "m2", tmp_path, block_bytes=size).collect() if size > 20 else [r for piece in reader.partitions() for r in reader.read(piece)]
    got = sorted(map(repr, (tuple(r)[2:] for r in rows)))
    want = [("He go home", "He goes home", "0", None), ("He go home", "He went", "1", None), ("Fine .", "Fine .", "0", None), ("a b c", "a b c", "0", None), ("x y", None, "0", "unresolved_annotation"), ("x y z", None, "0", "overlapping_annotation")]
    assert got == sorted(map(repr, want * 6))


def test_lines_partitions_and_filters(known, tmp_path):
    (tmp_path / "a.tsv").write_text("".join(f"s{i} é\tt{i}\n" for i in range(500)))
    rows = load(known, "tsv", tmp_path, block_bytes=100)
    assert rows.rdd.getNumPartitions() > 20 and {(r["source"], r["target"]) for r in rows.collect()} == {(f"s{i} é", f"t{i}") for i in range(500)}
    some = rows.where("target = 't7' or false").where(F.col("source").isNotNull())
    assert [r["source"] for r in some.collect()] == ["s7 é"]
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()  # the reader took it over
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.wdiff").write_text("a [-b-] {+c+} d\nx [-y\n\n")
    assert {tuple(r)[2:] for r in load(known, "wdiff", tmp_path / "b").collect()} == {("a b d", "a c d", None, None), ("x [-y", "x [-y", None, "invalid_wdiff")}
    (tmp_path / "b" / "x.wdiff").write_text("one\ttwo\tthree\n")
    with pytest.raises(Exception):
        load(known, "tsv", tmp_path / "b").collect()


def test_archive_members(known, tmp_path):
    names = {}
    for k in range(3):
        names[f"m{k}.tsv"] = "".join(f"{k}-{i}\tt\n" for i in range(40))
        (tmp_path / f"m{k}.tsv").write_text(names[f"m{k}.tsv"])
    (tmp_path / "in").mkdir()
    with tarfile.open(tmp_path / "in" / "all.tar", "w") as t:
        for name in names:
            t.add(tmp_path / name, name)
    rows = load(known, "tsv", tmp_path / "in", members="m0.tsv,m2.tsv", block_bytes=60).collect()
    assert sorted(r["source"] for r in rows) == sorted(f"{k}-{i}" for k in (0, 2) for i in range(40))
    with pytest.raises(Exception):
        load(known, "tsv", tmp_path / "in", members="absent").collect()


def test_immutable_splits(spark, known, tmp_path):
    at = str(tmp_path / "out")
    rows = spark.createDataFrame([("train" if i % 3 else "dev", f"s{i}", i) for i in range(100)], "split string, source string, i long")
    bad = rows.repartition(4).withColumn("source", F.when(F.col("i") == 57, F.raise_error(F.lit("a task fails"))).otherwise(F.col("source")))
    with pytest.raises(Exception):
        bad.write.format("emendata_splits").mode("append").save(at)
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").rglob("*.jsonl"))
    rows.repartition(3).write.format("emendata_splits").mode("append").save(at)
    got = [json.loads(x) for f in (tmp_path / "out").rglob("*.jsonl") for x in f.read_text().splitlines()]
    assert sorted(r["i"] for r in got) == list(range(100)) and all(r["split"] == ("train" if r["i"] % 3 else "dev") for r in got)
    manifest = json.loads((tmp_path / "out" / "_manifest.json").read_text())
    assert {s: m["rows"] for s, m in manifest.items()} == {"train": 66, "dev": 34}
    rows.repartition(5).write.format("emendata_splits").mode("append").save(at)  # the same rows are accepted
    with pytest.raises(Exception, match="other rows"):
        rows.where("i > 0").write.format("emendata_splits").mode("append").save(at)
    assert not list((tmp_path / "out").glob("_staged*")) and json.loads((tmp_path / "out" / "_manifest.json").read_text()) == manifest
