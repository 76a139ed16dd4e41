"""Clashing columns, empty tables, repeated rows, nulls and very long texts, for every query over documents and pages."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from emendata.llm import chat, fingerprints, html_text, jaccard_join, language_id, lines, lm_scoring, mixing, packing, quality, simhash_balls, token_alignment, turn_repair
from emendata.llm.common import ready

CLASHING = ["lang_pred", "score", "held_out", "n_lines", "n_dropped", "_drop", "_id", "_th", "_row", "_text", "mix_copy", "mix_key", "_steps", "_parts", "_source", "_salt", "_u", "_count", "rank", "ids", "n", "cid", "fp", "root", "block", "fingerprint", "kept", "class_id", "n_links", "near_edited", "sequence_id", "start", "n_words"]
OVER_DOCUMENTS = {
    "op1": packing.pack_rows, "op2": fingerprints.fingerprint_rows, "op5": mixing.mix_rows, "op6": language_id.language_rows, "op8": lines.line_rows,
    "op9": jaccard_join.jaccard_classes, "op11": token_alignment.alignment_rows, "op12": simhash_balls.simhash_components,
}
OVER_LABELS = {"op7": lm_scoring.score_rows, "op10": quality.quality_rows}
LONG = " ".join(f"word{i % 977} und the {i % 13}" for i in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    ready(spark)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 4 = 0")
    odd = [(900_001, LONG, "en", "a", 1), (900_002, None, None, None, None), (None, "No id here, but words.", "en", "b", 1), (900_003, "", "en", "a", 0), (900_004, "Twice, the same row.", "en", "a", 1), (900_004, "Twice, the same row.", "en", "a", 1)]
    return real.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


def rows(df):
    return Counter(map(repr, df.collect()))


@pytest.mark.parametrize("name", [*OVER_DOCUMENTS, *OVER_LABELS])
def test_other_columns_repeats_nulls_and_long_texts(spark, docs, labels, name):
    run = OVER_DOCUMENTS.get(name) or (lambda d: OVER_LABELS[name](d, labels))
    plain = run(docs)
    ids = Counter(r["doc_id"] for r in plain.select("doc_id").collect())
    assert (900_001 in ids or name == "op5") and (name in ("op1", "op5") or ids == Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
    odd = docs.withColumns({c: F.lit("mine") for c in CLASHING if c not in docs.columns})
    if name != "op1":  # its windows depend on nothing else either, but pieces of equal documents may swap
        assert rows(run(odd)) == rows(plain)
    else:
        total = lambda df: df.agg(F.sum("length"), F.count_distinct("doc_id")).first()
        assert total(run(odd)) == total(plain)
    assert run(docs.limit(0)).count() == 0


def test_empty_labels(docs, labels):
    for run in OVER_LABELS.values():
        assert run(docs, labels.limit(0)).count() == docs.count()


def test_pages_and_conversations(spark):
    pages = ready(spark).read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40)
    odd = pages.withColumns({c: F.lit("mine") for c in CLASHING})
    assert rows(html_text.extract_rows(odd)) == rows(html_text.extract_rows(pages)) and html_text.extract_rows(pages.limit(0)).count() == 0
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert rows(turn_repair.repair_rows(talk.withColumns({c: F.lit("mine") for c in CLASHING}))) == rows(turn_repair.repair_rows(talk))
    assert chat.chat_rows(talk.limit(0)).select("conv_id").collect()[0][0] == -7  # the fixed conversation alone
