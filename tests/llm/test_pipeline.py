from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emendata.llm import common, jaccard_join, language_id, lines, mixing, packing

TEXT = "The cat sat on the mat and looked at the bird in the tree. " * 4


@pytest.fixture
def given(spark, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(900_001, TEXT, "en", "a", 1), (900_002, TEXT, "en", "a", 1), (900_002, TEXT, "en", "a", 1), (900_003, None, "en", None, 0), (None, TEXT + "And more of it here, too.", None, "b", 1), (900_004, "", "en", "a", 0), (900_005, "0 1 2", "en", "a", 5)]
    rows = real.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")).withColumn("extra", F.lit("kept"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages_and_run(spark, given):
    docs = common.table(spark, given, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, docs, given), "test")
        assert after.columns == docs.columns and stage(spark, docs.limit(0), given).count() == 0, name
        if "mixing" not in name:
            assert after.count() <= docs.count()
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, given).collect()
    want = Counter(r["doc_id"] for r in docs.collect())
    assert sum(r["length"] for r in pieces if r["start"] == 0) > 0 and {r["doc_id"] for r in pieces} == set(want)
    whole = corpus_pipeline.run(spark, given).collect()
    assert sorted((r["length"], r["doc_tokens"]) for r in whole) == sorted((r["length"], r["doc_tokens"]) for r in pieces)


def test_copies_go(spark, given):
    docs = common.table(spark, given, "documents")
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.language(spark, docs, given), given)
    same = kept.where(F.col("text") == TEXT).collect()
    assert len(same) == 1 and kept.where("text is null or doc_id in (900004, 900005)").count() == 0
    stub = "own words that no other document has at all here"
    long = "a passage of many words that recurs in two documents as it is, and a second sentence of it"
    two = spark.createDataFrame([(1, long, "en", "a", 9), (2, f"{long}\n{stub}\n{stub} x y z {stub}", "en", "a", 9), (3, f"{long}\nbye", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, two, given).collect()}
    assert set(got) == {1, 2, 3} and got[2][0].startswith(stub) and got[2][1] == len(got[2][0]) and got[3] == ("bye", 3)


def test_own_lines_stay(spark):
    """A document that loses most of its text keeps what no other has; one of which nothing is left goes."""
    passage = "a passage of many words that recurs in two documents as it is, word for word"
    rows = [(1, passage), (2, f"{passage}\nbye now own line"), (3, f"{passage}\n \n"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: passage, 2: "bye now own line", 4: "", 5: None}


CLASHING = ["lang_pred", "score", "held_out", "n_lines", "n_dropped", "kept_share", "_drop", "_id", "_th", "_row", "_text", "mix_copy", "mix_key", "_steps", "_parts", "_source", "_salt", "_u", "_count", "rank", "ids", "n", "cid", "passed_0"]


def test_clashing_columns_pass_through(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, odd, ""), "clash")
        assert after.columns == odd.columns, name
        for r in after.collect():
            assert all(r[c] == f"{c}-{r['doc_id']}" for c in CLASHING), name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() > 0


def test_run_by_brute_force(spark):
    """The stages by other ways: SQL for line dedup and mixing, all pairs for the join, the tokenizer itself for packing; language ID by its rows, which have tests of their own."""
    at = "/root/testdata/sf0.001"
    docs = common.table(spark, at, "documents")
    told = {r["doc_id"]: r for r in language_id.language_rows(docs).collect()}
    rows = [r.asDict() for r in docs.collect() if told[r["doc_id"]]["lang_pred"] != "und" and told[r["doc_id"]]["score"] >= 0.25]

    def sql(query, rows):
        con = duckdb.connect()
        con.register("documents", pd.DataFrame(rows))
        return con.execute(query).fetchdf().to_dict("records")

    texts = {r["doc_id"]: r for r in sql(f"SELECT doc_id, text, n_dropped FROM ({lines.lines_sql()}) x", rows)}
    rows = [r | {"text": texts[r["doc_id"]]["text"]} for r in rows if not texts[r["doc_id"]]["n_dropped"] or texts[r["doc_id"]]["text"].strip(" \t\n\v\f\r")]
    known = jaccard_join.Known()
    sets = [set(jaccard_join.shingles(r["text"], known).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: rows[i]["doc_id"])
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b, key=order.index)] = min(a, b, key=order.index)
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    copies = sql(f"SELECT doc_id, text FROM ({mixing.MIX_SQL}) x", rows)
    own = packing.encoder(packing.tokenizer_path())
    want = Counter((r["doc_id"], len(own.whole(r["text"])) // np.dtype(own.kind).itemsize + 1) for r in copies)
    pieces = corpus_pipeline.run(spark, at).collect()
    got = Counter()
    for r in pieces:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert {k: n * k[1] for k, n in want.items()} == dict(got)
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in pieces)
    for (s, o, n), (t, p, _) in zip(spots, spots[1:], strict=False):
        assert p == (o + n if s == t else 0)


def test_temporaries_go(spark, tmp_path):
    keep: list[str] = []
    with common.temporaries(spark):
        first = common.written(spark.range(3), "gone")
        held = common.written(first, "kept", keep=keep)
    assert held.count() == 3
    with pytest.raises(Exception):
        first.count()
    common.discard(spark, keep)
