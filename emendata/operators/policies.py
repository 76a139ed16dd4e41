"""Decisions over measurements, verdicts, logs and messages."""

from __future__ import annotations

import json
import math
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seeds, weights and limits of the timing gate, rewards, token fields, critic's questions.
GATE = {"seed": 143271, "draws": 10_000, "trials": 5, "speedup": 0.05, "regression": 0.15, "p95": 0.25}
WEIGHTS = {"unchanged": 0.1, "edited": 0.6, "fresh": 0.3}
REWARDS = {"correct_edit": 1.0, "damage_clean_token": -3.0, "missed_edit": -1.0, "incorrect_edit": -5.0}
USAGE = frozenset("prompt_tokens completion_tokens total_tokens input_tokens output_tokens cache_creation_input_tokens cache_read_input_tokens cached_tokens audio_tokens reasoning_tokens accepted_prediction_tokens rejected_prediction_tokens".split())
USAGE_DETAILS = frozenset("prompt_tokens_details completion_tokens_details input_tokens_details output_tokens_details".split())
CRITIC = "source_has_error target_is_grammatical correction_is_necessary minimal_edit meaning_preserved register_preserved".split()


def canonical_json(value: object) -> str:
    """One form for equal values."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object) -> str:
    return sha256((value if isinstance(value, str) else canonical_json(value)).encode()).hexdigest()


def strict_json(text: str) -> object:
    """JSON without repeated keys and without numbers that JSON doesn't have."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def never(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=once, parse_constant=never)


def usage(value: object, prefix: str = "") -> dict[str, float]:
    """Known token counts, those of details under dotted names."""
    out: dict[str, float] = {}
    for k, v in value.items() if isinstance(value, dict) else ():
        head, _, tail = k.partition(".")
        number = isinstance(v, int | float) and not isinstance(v, bool) and v >= 0 and math.isfinite(v)
        if (k in USAGE or head in USAGE_DETAILS and tail in USAGE) and number:
            out[prefix + k] = v
        elif k in USAGE_DETAILS:
            out |= usage(v, f"{prefix}{k}.")
    return out


def blind_id(row: str, fingerprint: str) -> str:
    """An id that tells nothing of its row."""
    return f"r-{digest([fingerprint, row, 'blind-request-v1'])[:24]}"


def resumable(stored: str | None, config: dict) -> str:
    """The fingerprint of a run's configuration; a run that began with another one can't go on."""
    own = digest(config)
    if stored not in (None, own):
        raise ValueError("the run began with another configuration")
    return own


def message_fault(value: dict) -> str | None:
    """The first field of a check message that is wrong."""
    checks = {
        "target": value.get("target") in ("background", "offscreen"),
        "action": value.get("action") == "analyze",
        "requestId": isinstance(value.get("requestId"), str) and len(value["requestId"]) < 160,
        "text": isinstance(value.get("text"), str) and len(value["text"]) <= 6000,
        "useAI": isinstance(value.get("useAI"), bool),
    }
    return next((k for k, right in checks.items() if not right), None)


# --- verdicts


def repair_reason(clean: Column, target: Column, corrected: Column, grammatical: Column) -> Column:
    """A blinded repair of the source must find it clean or not, as it is, and come to the target."""
    missing = corrected.isNull() | grammatical.isNull()
    return F.when(missing, "repair_row_schema").when(grammatical != clean, "repair_grammaticality_disagreement").when((corrected != target) & clean, "clean_identity_changed").when(corrected != target, "repair_target_disagreement")


def critic_reason(clean: Column, answers: dict[str, Column]) -> Column:
    """A critic must answer every question as the pair is: an error and a necessary correction unless it is clean, all else yes."""
    wrong, missing = F.lit(False), F.lit(False)
    for name in CRITIC:
        missing = missing | answers[name].isNull()
        wrong = wrong | (answers[name] != (~clean if name in ("source_has_error", "correction_is_necessary") else F.lit(True)))
    return F.when(missing, "critic_row_schema").when(wrong, "critic_semantic_disagreement")


def screened(rows: DataFrame) -> DataFrame:
    """Status and reason of rows in order of arrival: screened, a duplicate of one, or quarantined, and all of a source whose targets conflict."""
    clean = F.col("source") == F.col("target")
    reason = F.coalesce(repair_reason(clean, F.col("target"), F.col("corrected"), F.col("grammatical")), critic_reason(clean, {n: F.col(n) for n in CRITIC}))
    own = rows.withColumn("_reason", reason)
    good = own.where("_reason is null").groupBy("source").agg(F.min("ordinal").alias("_first"), (F.min("target") != F.max("target")).alias("_conflict"))
    out = own.join(good, "source", "left")
    late = F.when(F.col("_conflict"), "conflicting_source").when(F.col("ordinal") != F.col("_first"), "duplicate_source")
    reason = F.coalesce("_reason", late)
    status = F.when(reason.isNull(), "screened").when(reason == "duplicate_source", "duplicate").otherwise("quarantined")
    return out.withColumns({"reason": reason, "status": status}).select(*rows.columns, "status", "reason")


def screened_siblings(rows: DataFrame) -> DataFrame:
    """Screened variants whose clean sibling, the row that their family was made from, is screened too."""
    clean = rows.where((F.col("source") == F.col("target")) & (F.col("status") == "screened")).select("generated_id").distinct()
    return rows.where("status = 'screened'").join(clean, "generated_id", "left_semi")


def without_dialogs(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of dialogs that are not held out, and those that are (there should be none)."""
    ids = held.select("dialog_id").where("dialog_id is not null").distinct()
    return rows.join(ids, "dialog_id", "left_anti"), rows.join(ids, "dialog_id", "left_semi")


def answered_once(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Each request with its cached answer by identity; a null answer is to be asked, once for equal requests (ask)."""
    key = F.sha2(F.concat_ws(":", F.sha2("source", 256), F.sha2("candidate", 256), "spec"), 256)
    rows = requests.withColumn("identity", key).join(cache.select("identity", "answer"), "identity", "left")
    first = rows.where("answer is null").groupBy("identity").agg(F.min("id").alias("_ask"))
    return rows.join(first, "identity", "left").select("id", "answer", (F.col("_ask") == F.col("id")).eqNullSafe(True).alias("ask"))


# --- measurements


def challenge(rows: DataFrame) -> DataFrame:
    """H6: of all rows and by family: exact, clean ones preserved, errors corrected, abstained, partly wrong. rows: family, clean, source, target, actual, suggestions (their number)."""
    n = F.count_if
    clean, right, none = F.col("clean"), F.col("actual") == F.col("target"), F.col("suggestions") == 0
    out = rows.groupingSets([[], [F.col("family")]], F.col("family")).agg(
        F.count("*").alias("sentences"), n(right).alias("exact"), n(clean).alias("clean_sentences"), n(clean & none).alias("clean_preserved"),
        n(~clean).alias("erroneous"), n(~clean & right).alias("corrected"), n(~clean & none).alias("abstained"),
    )
    return out.withColumn("partial", F.col("erroneous") - F.col("corrected") - F.col("abstained"))


def logit_parity(before: DataFrame, after: DataFrame, tolerance: float = 5e-4) -> DataFrame:
    """Per id the greatest difference of two rows of values, whether their first greatest values stand at one place, and both within the tolerance."""
    both = before.select("id", F.col("values").alias("a")).join(after.select("id", F.col("values").alias("b")), "id", "full")
    most = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    best = lambda c: F.array_position(c, F.array_max(c))
    sized = F.size("a").eqNullSafe(F.size("b")) & F.col("a").isNotNull() & F.col("b").isNotNull()
    same = best(F.col("a")) == best(F.col("b"))
    return both.select("id", F.when(sized, most).alias("most"), F.when(sized, same).alias("argmax"), F.coalesce(sized & same & (most < tolerance), F.lit(False)).alias("passed"))


def timing_gate(trials: DataFrame) -> DataFrame:
    """L4: is the later arm faster? trials: trial, and before and after of each workload (`unchanged`, `edited`, `fresh`) in ms.

    The weighted mean of log ratios of each trial is resampled with a fixed linear congruential generator; draws and
    trials are few, the resamples are summed by an aggregate over their draws.
    """
    ratio = sum((F.lit(w) * F.log(F.col(f"{name}_after") / F.col(f"{name}_before")) for name, w in WEIGHTS.items()), F.lit(0.0))
    worst = trials.agg(*[F.percentile(F.col(f"{n}_after") / F.col(f"{n}_before"), 0.5).alias(n) for n in WEIGHTS]).select(F.greatest(*WEIGHTS).alias("w"))
    rows = trials.select((F.row_number().over(Window.orderBy("trial")) - 1).alias("at"), ratio.alias("r"))  # a few trials
    n = rows.count()
    seed, draws = GATE["seed"], []
    for k in range(GATE["draws"] * n):
        seed = (seed * 1664525 + 1013904223) % 2**32
        draws.append((k // n, seed * n // 2**32))
    drawn = trials.sparkSession.createDataFrame(draws, "sample int, at int").join(F.broadcast(rows), "at")
    speed = drawn.groupBy("sample").agg((1 - F.exp(F.avg("r"))).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("s"))  # draws of one number
    place = lambda q: F.get("s", F.floor((F.size("s") - 1) * F.lit(q)).cast("int"))
    out = speed.select(place(0.025).alias("low"), place(0.975).alias("high")).join(F.broadcast(rows.agg((1 - F.exp(F.avg("r"))).alias("speedup")))).join(F.broadcast(worst))
    status = F.when(F.lit(n < GATE["trials"]), "inconclusive").when((F.col("w") - 1 > GATE["regression"]) | (F.col("high") < GATE["speedup"]), "rejected").when(F.col("low") >= GATE["speedup"], "accepted").otherwise("inconclusive")
    return out.select("speedup", "low", "high", status.alias("status"))


def expected_rewards(tokens: DataFrame) -> DataFrame:
    """Of each token (id, gold, probabilities by label) the reward that its policy expects: the baseline."""
    reward = lambda k: F.when(F.col("gold") == 0, F.when(k == 0, 0.0).otherwise(REWARDS["damage_clean_token"])).when(k == 0, REWARDS["missed_edit"]).when(k == F.col("gold"), REWARDS["correct_edit"]).otherwise(REWARDS["incorrect_edit"])
    return tokens.select("id", F.aggregate(F.transform("probabilities", lambda p, k: p * reward(k)), F.lit(0.0), lambda a, x: a + x).alias("expected"))


def profile(nodes: DataFrame, samples: DataFrame, start: int) -> DataFrame:
    """Inclusive and own time of every stack of functions in a sampled profile.

    nodes: id, name, parent (null for the root); samples: index, id, delta. Times are cumulated, samples put in order
    of time, and each one's span counted to its stack and all stacks above it; idle, program and root leaves don't count.
    """
    stacks = nodes.where("parent is null").select("id", F.array().cast("array<string>").alias("stack"))
    level, children = stacks, nodes.where("parent is not null")
    while (level := children.join(level.withColumnRenamed("id", "parent"), "parent").select("id", F.concat("stack", F.array(F.when(F.col("name") == "", "(anonymous)").otherwise(F.col("name")))).alias("stack"))).limit(1).count():
        stacks = stacks.unionByName(level)
    timed = samples.withColumn("at", F.lit(start) + F.sum("delta").over(Window.orderBy("index")))  # one capture is one sequence
    spans = timed.withColumn("span", F.col("at") - F.coalesce(F.lag("at").over(Window.orderBy("at", "index")), F.lit(start)))
    active = spans.join(nodes.select("id", "name"), "id").where(~F.col("name").isin("(idle)", "(program)", "(root)")).join(stacks, "id")
    each = active.select("span", "stack", F.explode(F.sequence(F.lit(1), F.size("stack"))).alias("depth"))
    return each.groupBy(F.array_join(F.slice("stack", F.lit(1), F.col("depth")), ";").alias("path")).agg(F.sum("span").alias("total"), F.sum(F.when(F.col("depth") == F.size("stack"), F.col("span")).otherwise(0)).alias("own"))


def readiness(gates: DataFrame, required: DataFrame, now: str) -> DataFrame:
    """Gate and fault: every required check passed, by evidence of the release that is at most 90 days old. gates: gate, source_sha256, performed_at, checks; required: gate, check, source_sha256."""
    wanted = required.groupBy("gate").agg(F.collect_set("check").alias("wanted"), F.first("source_sha256").alias("sha"))
    rows = wanted.join(gates, "gate", "left")
    passed = F.transform(F.filter("checks", lambda c: c["passed"]), lambda c: c["id"])
    age = F.datediff(F.lit(now).cast("date"), F.to_date("performed_at"))
    fault = F.when(F.col("checks").isNull(), "missing").when(F.col("sha") != F.col("source_sha256"), "assets").when((age > 90) | (age < 0) | age.isNull(), "stale")
    fault = fault.when(F.size(F.array_distinct(F.transform("checks", lambda c: c["id"]))) < F.size("checks"), "repeated").when(F.size(F.array_except("wanted", passed)) > 0, "checks")
    return rows.select("gate", fault.alias("fault"))


# --- incremental behaviour


def superseded(messages: DataFrame, most: int = 32) -> DataFrame:
    """K2, K4: what becomes of a request: superseded by a later one of its field before it is answered, refused beyond `most` waiting fields, stale if its text changed, or current. messages: field, ordinal, text, current (the field's text at the answer)."""
    own = Window.partitionBy("field").orderBy("ordinal")
    fields = messages.groupBy("field").agg(F.min("ordinal").alias("_opened"))
    place = fields.withColumn("_place", F.row_number().over(Window.orderBy("_opened"))).drop("_opened")  # a session's fields
    rows = messages.withColumn("_next", F.lead("ordinal").over(own)).join(place, "field")
    fate = F.when(F.col("_place") > most, "refused").when(F.col("_next").isNotNull(), "superseded").when(F.col("text") != F.col("current"), "stale").otherwise("current")
    return rows.select("field", "ordinal", fate.alias("fate"))


def published(rules: DataFrame, model: DataFrame) -> DataFrame:
    """K6: per request the model's result once it is there, the rules' until then, never the other way round; K5: a model's answer after 30 s counts as none, after 90 s the request fails."""
    rows = rules.select("id", F.col("result").alias("r")).join(model.select("id", F.col("result").alias("m"), "elapsed_ms"), "id", "left")
    state = F.when(F.col("elapsed_ms") > 90_000, "failed").when(F.col("elapsed_ms") > 30_000, "retried on the other backend").when(F.col("m").isNull(), "rules").otherwise("model")
    return rows.select("id", F.when(state == "model", F.col("m")).otherwise(F.col("r")).alias("result"), state.alias("state"))


def resumed(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """K7: what to do with jobs (id) by their last attempt in a ledger (id, attempt, status): done ones are skipped, started ones were interrupted and run again."""
    last = ledger.groupBy("id").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempt"))
    rows = jobs.join(last, "id", "left")
    action = F.when(F.col("status") == "done", "skip").when(F.col("status") == "started", "rerun interrupted").when(F.col("status").isNotNull(), "rerun").otherwise("run")
    return rows.select("id", action.alias("action"), (F.coalesce("attempt", F.lit(0)) + 1).cast("int").alias("attempt"))


def receipts(rows: DataFrame) -> DataFrame:
    """Arms of a comparison with their mean score and a fault where an arm was measured on another population, or not once for each seed. rows: arm, seed, population_sha256, score."""
    seeds = rows.agg(F.count_distinct("seed").alias("_seeds"), F.mode("population_sha256", True).alias("_population"))
    arms = rows.groupBy("arm").agg(F.avg("score").alias("score"), F.count("*").alias("n"), F.count_distinct("seed").alias("k"), F.min("population_sha256").alias("a"), F.max("population_sha256").alias("b"))
    fault = F.when((F.col("a") != F.col("_population")) | (F.col("b") != F.col("_population")), "population").when((F.col("k") != F.col("_seeds")) | (F.col("n") != F.col("_seeds")), "seeds")
    return arms.join(F.broadcast(seeds)).select("arm", "score", fault.alias("fault"))  # one row
