"""Queries with expected rows (see `examples`): corpus building, generation, policies, verdicts, incremental behaviour."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emendata.functions import text
from emendata.operators import corpus, custom, policies, scoring
from examples import Example, each
from emendata.sources import readers, sinks


def _archive(**files: str) -> bytearray:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        for name, body in files.items():
            info = tarfile.TarInfo(name.replace("__", "/") + ".txt")
            info.size = len(body.encode())
            archive.addfile(info, io.BytesIO(body.encode()))
    return bytearray(out.getvalue())


def _fault(run) -> str:
    try:
        return str(run())
    except ValueError as e:
        return f"refused: {e}"


def _answers(*wrong: str) -> tuple:
    """A critic's answers for an error pair: all yes, but for those named."""
    return tuple(x not in wrong for x in policies.CRITIC)


_CRITIC = ", ".join(f"{x} boolean" for x in policies.CRITIC)
_CLEAN = tuple(x not in ("source_has_error", "correction_is_necessary") for x in policies.CRITIC)
_ADMIT = "ordinal long, origin string, review_status string, status string, admission_status string, split string, license string, family_id string, run_fingerprint string, evaluation_only boolean, release_eligible boolean"
_HEX = "a" * 64


def _ids(df: DataFrame) -> DataFrame:
    """Pairs with pair_id, as the samples take them."""
    return corpus.identified(df)


def _sampled(df: DataFrame) -> DataFrame:
    """How many of the two least priorities stay, as the conflict goes after the choice."""
    rows = corpus.bounded_sample(_ids(df), 3)
    return rows.agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.count_if(F.col("source") == "c").alias("conflicting"))


def _mixture(df: DataFrame) -> DataFrame:
    rows = corpus.quota_mixture(df, 8)
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def _scores(df: DataFrame) -> DataFrame:
    """J11 over a table of scores by thresholds of two categories."""
    table = {(r["a"], r["b"]): r["f"] for r in df.collect()}
    chosen, best = scoring.ascend({"a": 30, "b": 25, "c": 5}, 0.5, [0.5, 0.7, 0.9], lambda t: table.get((t.get("a", 0.5), t.get("b", 0.5))))
    return df.sparkSession.createDataFrame([(k, v, best) for k, v in chosen.items()], "category string, threshold double, best double")


def _planner(df: DataFrame) -> DataFrame:
    """Families dealt to recipes in turn, in batches."""
    rows = df.withColumns({"recipe": F.pmod("family", F.lit(3)), "place": F.floor(F.col("family") / 3)})
    return rows.groupBy("recipe", F.floor(F.col("place") / 2).alias("batch")).agg(F.array_join(F.array_sort(F.collect_list("family")), ",").alias("families"))


def _templates(df: DataFrame) -> DataFrame:
    """Every subject with every verb and tail, the verb agreeing."""
    lists = lambda *xs: F.array(*map(F.lit, xs))
    rows = df.select("subject", "third", F.explode(lists("go", "read")).alias("verb")).withColumn("tail", F.explode(lists("home", "daily")))
    form = F.when(F.col("third"), F.when(F.col("verb") == "go", "goes").otherwise(F.concat("verb", F.lit("s")))).otherwise(F.col("verb"))
    return rows.select(F.format_string("%s %s %s.", "subject", form, "tail").alias("clean"))


def _spread(df: DataFrame) -> DataFrame:
    rows = corpus.spread_domains(df, [f"d{i}" for i in range(8)])
    block = F.floor(F.col("job") / 8).alias("block")
    return rows.groupBy(block).agg(F.count_distinct("domain").alias("domains"), F.count_if(F.col("register") == "informal").alias("informal"))


def _chunked(i: int, body: str, failing: int) -> list[tuple]:
    """Proposals of a sentence's windows, none if one of them fails."""
    edits = []
    for k, window in enumerate(text.chunks(body, lambda w: 1, 6)):
        if k == failing:
            return [(i, True, 0)]
        edits += [w for w, _, _ in window if w == "teh"]
    return [(i, False, len(edits))]


def _release(df: DataFrame) -> DataFrame:
    required = df.sparkSession.createDataFrame([("quality", "a", "s1"), ("quality", "b", "s1"), ("pilot", "p", "s1"), ("devices", "d", "s1"), ("store", "x", "s1")], "gate string, check string, source_sha256 string")
    return policies.readiness(df, required, "2025-06-01")


def _gate(df: DataFrame) -> DataFrame:
    return policies.timing_gate(df).select(F.round("speedup", 6).alias("speedup"), (F.col("low") <= F.col("high")).alias("ordered"), "status")


_TRIAL = "trial int, " + ", ".join(f"{n}_{s} double" for n in policies.WEIGHTS for s in ("before", "after"))
_PROFILE = "kind string, id int, name string, parent int, index int, delta long"
_NODES = [("n", 1, "(root)", None, None, None), ("n", 2, "main", 1, None, None), ("n", 3, "work", 2, None, None), ("n", 4, "(idle)", 1, None, None), ("n", 5, "", 2, None, None)]
_SAMPLES = [("s", 3, None, None, 0, 10), ("s", 4, None, None, 1, 20), ("s", 2, None, None, 2, 30), ("s", 5, None, None, 3, -5), ("s", 3, None, None, 4, 15)]

E: dict[str, Example] = {
    "c18_bounded_distance": Example("a string, b string, most int", [("teh", "the", 2), ("ca", "abc", 3), ("ca", "abc", 2), ("", "ab", 2), ("abcd", "xyz", 2), ("same", "same", 1), ("ab", "ba", 1)], each(lambda a, b, k: [(a, b, custom.osa_distance(a, b, k))], "a string, b string, d int"), "a string, b string, d int", [("teh", "the", 1), ("ca", "abc", 3), ("ca", "abc", 3), ("", "ab", 2), ("abcd", "xyz", 3), ("same", "same", 0), ("ab", "ba", 1)]),
    "c26_c27_json": Example("id long, t string", [(1, '{"b": 1, "a": [true, null]}'), (2, '{"a": 1, "a": 2}'), (3, '{"a": NaN}'), (4, '{"é": "x"}')], each(lambda i, t: [(i, _fault(lambda: policies.canonical_json(policies.strict_json(t))))], "id long, made string"), "id long, made string", [(1, '{"a":[true,null],"b":1}'), (2, "refused: repeated key"), (3, "refused: NaN is not JSON"), (4, '{"é":"x"}')]),
    "c28_token_usage": Example("id long, t string", [(1, '{"prompt_tokens": 5, "other": 9, "prompt_tokens_details": {"cached_tokens": 2, "x": 1}}'), (2, '{"total_tokens": true, "input_tokens": -1, "output_tokens": 1.5}'), (3, '{"prompt_tokens_details.cached_tokens": 4}')], each(lambda i, t: [(i, k, float(v)) for k, v in policies.usage(policies.strict_json(t)).items()], "id long, name string, n double"), "id long, name string, n double", [(1, "prompt_tokens", 5.0), (1, "prompt_tokens_details.cached_tokens", 2.0), (2, "output_tokens", 1.5), (3, "prompt_tokens_details.cached_tokens", 4.0)]),
    "d5_d6_admission": Example(_ADMIT, [(1, "x", "human-reviewed", None, None, None, "MIT", None, None, True, None), (2, "x", "quarantined", None, None, None, "MIT", None, None, None, None), (3, "x", "human-reviewed", "duplicate", None, None, "MIT", None, None, None, None), (4, "teacher-screened", "machine-verified", "screened", "screened", "dev", "MIT", _HEX, _HEX, None, None), (5, "teacher-screened", "machine-verified", "screened", "screened", "train", "MIT", "short", _HEX, None, None), (6, "teacher-screened", "machine-verified", "screened", "screened", "train", "MIT", _HEX, _HEX, None, False), (7, "x", "human-reviewed", None, None, None, "GPL", None, None, None, None), (8, "x", "weak", None, None, None, "CC0-1.0", None, None, None, None)], lambda d: corpus.admitted(d, weak=True).select("ordinal", F.coalesce("reject_reason", F.lit("ok")).alias("reason"), "publishable"), "ordinal long, reason string, publishable boolean", [(1, "evaluation_only", True), (2, "not_admitted", True), (3, "not_admitted", True), (4, "teacher_heldout", True), (5, "teacher_evidence_missing", True), (6, "ok", False), (7, "license_unverified", False), (8, "ok", True)]),
    "d19_messages": Example("id long, t string", [(1, '{"target":"background","action":"analyze","requestId":"r","text":"x","useAI":true}'), (2, '{"target":"page","action":"analyze","requestId":"r","text":"x","useAI":true}'), (3, '{"target":"offscreen","action":"analyze","requestId":"r","text":7,"useAI":true}'), (4, '{"target":"offscreen","action":"analyze","requestId":"r","text":"x","useAI":1}')], each(lambda i, t: [(i, policies.message_fault(policies.strict_json(t)))], "id long, fault string"), "id long, fault string", [(1, None), (2, "target"), (3, "text"), (4, "useAI")]),
    "e16_failed_windows": Example("id long, t string, failing int", [(1, "teh a b c teh", -1), (2, "teh a b c teh", 1), (3, "teh", 5)], each(_chunked, "id long, failed boolean, proposals int"), "id long, failed boolean, proposals int", [(1, False, 2), (2, True, 0), (3, False, 1)]),
    "e18_l9_n9_answers": Example("id long, source string, candidate string, spec string", [(1, "a", "b", "v1"), (2, "a", "b", "v1"), (3, "a", "c", "v1"), (4, "a", "b", "v2")], lambda d: policies.answered_once(d, d.where("id = 3").select(F.sha2(F.concat_ws(":", F.sha2("source", 256), F.sha2("candidate", 256), "spec"), 256).alias("identity"), F.lit("yes").alias("answer"))), "id long, answer string, ask boolean", [(1, None, True), (2, None, False), (3, "yes", False), (4, None, True)]),
    "g3_reviewed_split": Example("id long, clean_group string, reviewed boolean", [(1, "00000050" + "0" * 56, True), (2, "00000050" + "0" * 56, False), (3, "00000005" + "0" * 56, True), (4, "00000055" + "0" * 56, False), (5, "0000005f" + "0" * 56, True)], lambda d: corpus.split_reviewed(d).select("id", "split"), "id long, split string", [(1, "dev"), (2, None), (3, "train"), (4, "train"), (5, "test")]),
    "g7_predictions": Example("id string, index int, source string, i int, sha string, corrected string", [("a", 0, "x", 0, "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881", "X"), ("b", 1, "y", 2, "a1fce4363854ff888cff4b8e7875d600c2682390412a8cf79b37d0b11148b0fa", "Y"), ("c", 2, "z", 2, "bad", "Z")], lambda d: scoring.matched_predictions(d.select("id", "index", "source"), d.select("id", F.col("i").alias("index"), F.col("sha").alias("sourceSha256"), "corrected").unionByName(d.where("id = 'a'").select(F.lit("e").alias("id"), F.lit(9).alias("index"), F.lit("s").alias("sourceSha256"), F.lit("q").alias("corrected")))).select("id", "fault"), "id string, fault string", [("a", None), ("b", "order"), ("c", "source"), ("e", "extra")]),
    "g12_siblings": Example("generated_id string, source string, target string, status string", [("f1", "a", "a", "screened"), ("f1", "b", "a", "screened"), ("f2", "c", "d", "screened"), ("f2", "d", "d", "quarantined")], lambda d: policies.screened_siblings(d).select("generated_id", "source"), "generated_id string, source string", [("f1", "a"), ("f1", "b")]),
    "g16_dialog_leak": Example("dialog_id string, held boolean", [("d1", True), ("d1", False), ("d2", False), (None, False), (None, True)], lambda d: policies.without_dialogs(d.where("not held"), d.where("held"))[0].select("dialog_id"), "dialog_id string", [("d2",), (None,)]),
    "h6_challenge": Example("family string, clean boolean, source string, target string, actual string, suggestions int", [("a", True, "x", "x", "x", 0), ("a", False, "y", "z", "z", 1), ("b", False, "y", "z", "y", 0), ("b", False, "y", "z", "w", 2), ("b", True, "x", "x", "q", 1)], lambda d: policies.challenge(d).withColumn("family", F.coalesce("family", F.lit("all"))), "family string, sentences long, exact long, clean_sentences long, clean_preserved long, erroneous long, corrected long, abstained long, partial long", [("all", 5, 2, 2, 1, 3, 1, 1, 1), ("a", 2, 2, 1, 1, 1, 1, 0, 0), ("b", 3, 0, 1, 0, 2, 0, 1, 1)]),
    "h18_logit_parity": Example("side string, id string, values array<double>", [("a", "p", [0.1, 0.9]), ("b", "p", [0.1002, 0.9]), ("a", "q", [0.5, 0.4]), ("b", "q", [0.4, 0.5]), ("a", "r", [1.0]), ("b", "r", [1.0, 2.0])], lambda d: policies.logit_parity(d.where("side = 'a'").drop("side"), d.where("side = 'b'").drop("side")).select("id", F.round("most", 6).alias("most"), "argmax", "passed"), "id string, most double, argmax boolean, passed boolean", [("p", 0.0002, True, True), ("q", 0.1, False, False), ("r", None, None, False)]),
    "h21_i12_profile": Example(_PROFILE, _NODES + _SAMPLES, lambda d: policies.profile(d.where("kind = 'n'").select("id", "name", "parent"), d.where("kind = 's'").select("index", "id", "delta"), 100), "path string, total long, own long", [("main", 50, 5), ("main;(anonymous)", 25, 25), ("main;work", 20, 20)]),
    "i10_domains": Example("job long", [(i,) for i in range(16)], _spread, "block long, domains long, informal long", [(0, 8, 2), (1, 8, 2)]),
    "j1_bounded_sample": Example("ordinal long, source string, target string", [(1, "c", "x y"), (2, "c", "x z"), (3, "d", "e"), (4, "D", "e")], _sampled, "n long, first long, conflicting long", [(1, 3, 0)]),
    "j4_mixture": Example("pair_id string, kind string", [(f"h{i}", "human") for i in range(9)] + [(f"r{i}", "rule") for i in range(9)] + [("t0", "other")], lambda d: _mixture(d).agg(F.sum("n").alias("n"), F.count_if((F.col("kind") == "human") & (F.col("n") >= 4)).alias("human"), F.count_if((F.col("kind") == "rule") & (F.col("n") >= 2)).alias("rule")), "n long, human long, rule long", [(8, 1, 1)]),
    "j11_category_thresholds": Example("a double, b double, f double", [(0.5, 0.5, 0.6), (0.7, 0.5, 0.65), (0.9, 0.5, 0.62), (0.7, 0.7, 0.64), (0.7, 0.9, 0.7)], _scores, "category string, threshold double, best double", [("a", 0.7, 0.7), ("b", 0.9, 0.7)]),
    "k2_k4_requests": Example("field string, ordinal long, text string, current string", [("f", 1, "a", "ab"), ("f", 2, "ab", "ab"), ("g", 3, "x", "y"), ("h", 4, "q", "q")], lambda d: policies.superseded(d, 2), "field string, ordinal long, fate string", [("f", 1, "superseded"), ("f", 2, "current"), ("g", 3, "stale"), ("h", 4, "refused")]),
    "k5_k6_published": Example("id long, rules string, model string, elapsed_ms long", [(1, "r", "m", 10), (2, "r", None, None), (3, "r", "m", 31000), (4, "r", "m", 90001)], lambda d: policies.published(d.select("id", F.col("rules").alias("result")), d.where("model is not null").select("id", F.col("model").alias("result"), "elapsed_ms")), "id long, result string, state string", [(1, "m", "model"), (2, "r", "rules"), (3, "r", "retried on the other backend"), (4, "r", "failed")]),
    "k7_resumed": Example("id string, attempt int, status string", [("a", 1, "failed"), ("a", 2, "done"), ("b", 1, "started"), ("c", None, None), ("d", 1, "failed")], lambda d: policies.resumed(d.select("id").distinct(), d.where("attempt is not null")), "id string, action string, attempt int", [("a", "skip", 3), ("b", "rerun interrupted", 2), ("c", "run", 1), ("d", "rerun", 2)]),
    "k8_l8_verdicts": Example("ordinal long, source string, target string, corrected string, grammatical boolean, " + _CRITIC, [(1, "a", "b", "b", False, *_answers()), (2, "a", "b", "b", False, *_answers()), (3, "c", "d", "d", False, *_answers()), (4, "c", "e", "e", False, *_answers()), (5, "f", "f", "f", True, *_CLEAN), (6, "g", "g", "x", True, *_CLEAN), (7, "h", "i", "i", True, *_answers()), (8, "j", "k", "k", False, *_answers("minimal_edit")), (9, "l", "m", "n", False, *_answers()), (10, "o", "p", None, False, *_answers())], lambda d: policies.screened(d).select("ordinal", "status", "reason"), "ordinal long, status string, reason string", [(1, "screened", None), (2, "duplicate", "duplicate_source"), (3, "quarantined", "conflicting_source"), (4, "quarantined", "conflicting_source"), (5, "screened", None), (6, "quarantined", "clean_identity_changed"), (7, "quarantined", "repair_grammaticality_disagreement"), (8, "quarantined", "critic_semantic_disagreement"), (9, "quarantined", "repair_target_disagreement"), (10, "quarantined", "repair_row_schema")]),
    "l4_timing_gate": Example(_TRIAL, [(i, 10.0, 8.0, 20.0, 16.0 + 0.1 * (i % 2), 5.0, 4.0) for i in range(6)], _gate, "speedup double, ordered boolean, status string", [(0.198503, True, "accepted")]),
    "l5_expected_reward": Example("id long, gold int, probabilities array<double>", [(1, 0, [0.5, 0.3, 0.2]), (2, 1, [0.5, 0.3, 0.2]), (3, 2, [0.0, 0.0, 1.0])], lambda d: policies.expected_rewards(d).select("id", F.round("expected", 9).alias("expected")), "id long, expected double", [(1, -1.5), (2, -1.2), (3, 1.0)]),
    "l11_readiness_gates": Example("gate string, source_sha256 string, performed_at string, checks array<struct<id:string,passed:boolean>>", [("quality", "s1", "2025-05-01", [("a", True), ("b", True)]), ("pilot", "s1", "2025-01-01", [("p", True)]), ("devices", "s0", "2025-05-01", [("d", True)])], _release, "gate string, fault string", [("quality", None), ("pilot", "stale"), ("devices", "assets"), ("store", "missing")]),
    "a3_archive_members": Example("path string, content binary", [("x", _archive(a__m2="S a\n", b__note="no"))], lambda d: readers.members(d, ["a/m2.txt"]), "member string, text string", [("a/m2.txt", "S a\n")]),
    "a16_a19_configs": Example("id string, format string, split string, release boolean, labels array<string>, least double, most double", [("c4-x", "parquet", "train", True, ["KEEP", "A"], 0.5, 0.9), ("Bad id", "zip", "dev", None, ["A", "A"], 0.9, 0.5)], each(lambda i, f, s, r, labels, a, b: [(i, ",".join(readers.spec_faults({"id": i, "format": f, "split": s, "release_eligible": r})), ",".join(readers.asset_faults(list(labels), {"x": b}, a, ["[CLS]", "[SEP]", "[UNK]"])))], "id string, spec string, assets string"), "id string, spec string, assets string", [("c4-x", "", ""), ("Bad id", "id,format,split,release_eligible", "labels,thresholds")]),
    "a20_n11_pins": Example("path string, content binary, sha256 string", [("a", bytearray(b"x"), "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"), ("b", bytearray(b"y"), "0"), ("c", bytearray(b"zzzzz"), "0")], lambda d: readers.verified(d.select("path", "content"), d.select("path", "sha256").unionByName(d.sparkSession.createDataFrame([("d", "1")], "path string, sha256 string")), 4), "path string, fault string", [("a", None), ("b", "hash"), ("c", "size"), ("d", "missing")]),
    "a21_templates": Example("subject string, third boolean", [("She", True), ("They", False)], _templates, "clean string", [("She goes home.",), ("She goes daily.",), ("She reads home.",), ("She reads daily.",), ("They go home.",), ("They go daily.",), ("They read home.",), ("They read daily.",)]),
    "a22_j14_jobs": Example("family long", [(i,) for i in range(8)], _planner, "recipe long, batch long, families string", [(0, 0, "0,3"), (0, 1, "6"), (1, 0, "1,4"), (1, 1, "7"), (2, 0, "2,5")]),
    "b2_manifest": Example("split string, source string, target string, clean_group string", [("train", "a", "b", "g1"), ("train", "c", "b", "g1"), ("dev", "d", "e", "g2")], lambda d: sinks.manifest(d).select("split", "n", "groups"), "split string, n long, groups long", [("train", 2, 1), ("dev", 1, 1)]),
    "b6_exports": Example("id long, status string", [(1, "screened"), (2, "quarantined"), (3, "duplicate"), (4, "started")], lambda d: sinks.exports(d).select("id", "export"), "id long, export string", [(1, "train"), (2, "quarantine"), (3, "quarantine"), (4, "pending")]),
    "n8_blinded_ids": Example("row string, fingerprint string", [("r1", "f"), ("r1", "g"), ("r2", "f")], each(lambda r, f: [(r, f, len(policies.blind_id(r, f)), policies.blind_id(r, f) == policies.blind_id("r1", "f"))], "row string, fingerprint string, n int, first boolean"), "row string, fingerprint string, n int, first boolean", [("r1", "f", 26, True), ("r1", "g", 26, False), ("r2", "f", 26, False)]),
    "n12_provenance": Example("lang string, source string, license string", [("en", "b", "MIT"), ("en", "a", "MIT"), ("en", "b", "MIT"), ("de", "c", None)], lambda d: d.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set(F.to_json(F.struct("license", "source")))), ";").alias("kinds")), "lang string, kinds string", [("en", '{"license":"MIT","source":"a"};{"license":"MIT","source":"b"}'), ("de", '{"source":"c"}')]),
    "d8_canonical_filters": Example("ordinal long, source string, target string", [(1, "I do n't know it", "I don't know it"), (2, "Go on", "Go on now"), (3, "She go to it .", "She goes to it ."), (4, "It 's the same one", "It 's the same one")], lambda d: corpus.shortened(d).select("ordinal", "source", "target", "reject_reason"), "ordinal long, source string, target string, reject_reason string", [(1, "I don't know it", "I don't know it", "normalization_erased_edit"), (2, "Go on", "Go on now", "fragment"), (3, "She go to it.", "She goes to it.", None), (4, "It's the same one", "It's the same one", None)]),
    "h11_shared_labels": Example("arm string, split string, tags array<string>", [("a", "train", ["KEEP", "X"]), ("b", "train", ["A", "KEEP"]), ("b", "dev", ["Z"])], lambda d: corpus.shared_labels(d).select(F.array_join("labels", ",").alias("labels")), "labels string", [("KEEP,A,X",)]),
    "h12_by_status": Example("recipe string, status string, alignment int, guarded int", [("r1", "screened", 1, 1), ("r1", "quarantined", 1, 0), ("r2", "screened", 0, 0)], lambda d: corpus.by_status(d, ["screened", "quarantined"]), "recipe string, screened long, quarantined long, alignment long, guarded long", [("r1", 1, 1, 2, 1), ("r2", 1, 0, 0, 0)]),
    "l10_receipts": Example("arm string, seed int, population_sha256 string, score double", [("a", 1, "p", 0.5), ("a", 2, "p", 0.7), ("b", 1, "p", 0.4), ("b", 2, "q", 0.4), ("c", 1, "p", 0.9)], lambda d: policies.receipts(d).select("arm", F.round("score", 6).alias("score"), "fault"), "arm string, score double, fault string", [("a", 0.6, None), ("b", 0.4, "population"), ("c", 0.9, "seeds")]),
    "n5_n10_run_identities": Example("id long, stored string, config string", [(1, None, '{"b":1,"a":2}'), (2, "x", '{"a":1}')], each(lambda i, s, c: [(i, _fault(lambda: policies.resumable(s, policies.strict_json(c))[:8]))], "id long, made string"), "id long, made string", [(1, "d3626ac3"), (2, "refused: the run began with another configuration")]),
    "a15_held_keys": Example("source string, target string, references array<string>", [("Do n't go", None, None), ("A  b", "Café", ["a B", "X ."])], lambda d: corpus.held_keys(d), "k string", [("do n't go",), ("don't go",), ("a b",), ("café",), ("x .",), ("x.",)]),
    "e19_padded": Example("id long, ids array<int>", [(1, [5, 6, 7]), (2, list(range(1, 9))), (3, [])], lambda d: d.select("id", *[F.array_join(c, ",").alias(k) for k, c in scoring.padded(F.col("ids")).items()]), "id long, ids string, mask string", [(1, "5,6,7,0,0,0,0,0", "1,1,1,0,0,0,0,0"), (2, "1,2,3,4,5,6,7,8", "1,1,1,1,1,1,1,1"), (3, "", "")]),
    "h3_corpus_f05": Example("tp int, fp int, fn int", [(8, 2, 4), (0, 0, 0), (0, 3, 0)], lambda d: d.select("tp", "fp", "fn", F.round(scoring.corpus_f05(F.col("tp"), F.col("fp"), F.col("fn")), 9).alias("f")), "tp int, fp int, fn int, f double", [(8, 2, 4, 0.769230769), (0, 0, 0, 1.0), (0, 3, 0, 0.0)]),
    "j2_first_accepted": Example("ordinal long, reject_reason string", [(0, None), (1, "length"), (2, None), (3, None), (4, None), (9, None)], lambda d: corpus.first_accepted(d, 3, 4).select("ordinal"), "ordinal long", [(0,), (2,), (3,)]),
}
