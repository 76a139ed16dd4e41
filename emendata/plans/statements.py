"""Declarative plans of the relational operators, by name; each takes a dialect and gives its statement.

Names begin with the inventory's operator ids. Conventions: sentences are the pieces of a text at line breaks and
after `.`, `!` or `?`; a key is the lower-cased text with runs of white space as one blank; every order-dependent
operator has an explicit order column.
"""

from __future__ import annotations

from collections.abc import Callable

from emendata.plans.dialect import CONTACT

TOKEN = r"\p{L}+(?:[\x27’]\p{L}+)*|[0-9]+|[^\p{L}\p{N}_\s]"
#: Splits by bucket of 100.
SPLIT = "CASE WHEN {b} < 80 THEN 'train' WHEN {b} < 90 THEN 'dev' ELSE 'test' END"


def key(d, x: str) -> str:
    return f"lower(trim({d.replace(x, '[ \\t\\r\\n\\f]+', ' ')}))"


def sentences(d, table: str = "documents", columns: str = "doc_id, lang, source") -> str:
    pieces = d.lines(f"regexp_replace(text, {d.text('([.!?])[ ]+')}, {d.text(d.back + '1')} || chr(10){_g(d)})")
    return f"SELECT * FROM ({d.explode(table, pieces, columns)}) s0 WHERE trim(item) <> ''"


def _g(d) -> str:
    return ", 'g'" if d.back == "\\" else ""


def pairs(d) -> str:
    """A correction table made of sentences: source has its first article doubled or dropped, by hash; target is the sentence."""
    return f"""SELECT doc_id, pos, lang, source AS origin, item AS target, doc_id * 100000 + pos AS ordinal,
      CASE WHEN {d.hex32(d.sha('item'))} % 3 = 0 THEN {d.replace('item', '\\b(the|of|de|und) ', d.back + '1 ' + d.back + '1 ')}
           WHEN {d.hex32(d.sha('item'))} % 3 = 1 THEN {d.replace('item', '\\b(and|to|la) ', '')} ELSE item END AS source
      FROM ({sentences(d)}) s1"""


def words(d) -> str:
    toks = d.all("lower(text)", r"\p{L}+")
    return f"SELECT item AS word, count(*) AS n FROM ({d.explode('documents', toks, 'doc_id')}) w0 GROUP BY item"


def reason(d) -> str:
    """First failing check of a pair, in order; null if it is valid. Cheap tests stand before patterns, words are counted by blanks."""
    n = lambda x: f"length({x}) - length(replace({x}, ' ', '')) + 1"
    src, tgt = (f"trim({d.replace(x, '[ \\t\\r\\n\\f]+', ' ')})" for x in ("source", "target"))
    return f"""CASE WHEN source IS NULL OR target IS NULL THEN 'schema'
      WHEN length(trim(source)) < 3 OR length(trim(source)) > 600 OR length(trim(target)) < 3 OR length(trim(target)) > 600 THEN 'length'
      WHEN {d.found("source || target", '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')} THEN 'control_character'
      WHEN NOT {d.found('source', '[A-Za-z]')} OR NOT {d.found('target', '[A-Za-z]')} THEN 'no_english_letters'
      WHEN {d.found("source || ' ' || target", CONTACT)} THEN 'contact_or_secret_pattern'
      WHEN {d.over('target', n(tgt), 80)} OR {d.over('source', n(src), 80)} THEN 'word_limit' END"""


def split_of(d, x: str) -> str:
    return SPLIT.format(b=f"{d.hex32(d.sha(x))} % 100")


def flagship(d) -> str:
    return anti(d, f"""WITH s AS (SELECT doc_id, pos, lang, item, {key(d, 'item')} AS k FROM ({sentences(d)}) s1),
    held AS (SELECT DISTINCT {key(d, 'item')} AS k FROM ({sentences(d, 'benchmark', 'item_id')}) b1),
    clean AS (SELECT s.* FROM s LEFT ANTI JOIN held ON s.k = held.k),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM clean),
    checked AS (SELECT lang, {split_of(d, 'k')} AS split, CASE WHEN length(item) > 600 THEN 'length' WHEN {d.found('item', CONTACT)} THEN 'contact_or_secret_pattern' ELSE 'ok' END AS reason FROM firsts WHERE r = 1)
    SELECT split, lang, reason, count(*) AS n FROM checked GROUP BY split, lang, reason""")


def anti(d, sql: str) -> str:
    return sql if d.back == "$" else sql.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")


def _metrics(tp: str, fp: str, fn: str) -> str:
    """Edit precision, recall (1 when undefined) and F0.5."""
    p = f"CASE WHEN {tp} + {fp} = 0 THEN CAST(1 AS DOUBLE) ELSE CAST({tp} AS DOUBLE) / ({tp} + {fp}) END"
    r = f"CASE WHEN {tp} + {fn} = 0 THEN CAST(1 AS DOUBLE) ELSE CAST({tp} AS DOUBLE) / ({tp} + {fn}) END"
    return f"round(CAST({p} AS DOUBLE), 9) AS edit_precision, round(CAST({r} AS DOUBLE), 9) AS edit_recall, round(CAST(1.25 AS DOUBLE) * ({p}) * ({r}) / greatest(CAST(1e-12 AS DOUBLE), CAST(0.25 AS DOUBLE) * ({p}) + ({r})), 9) AS f05"


def judged(d) -> str:
    """Predictions against labels: a document is predicted bad if its symbols are over a share of its length."""
    share = f"length({d.replace('d.text', '[^#*$%&|<>!]', '')}) * 1.0 / greatest(length(d.text), 1)"
    return f"SELECT d.doc_id, d.lang, d.source, l.quality = 0 AS gold, l.toxic, {share} AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def tokens_of(d) -> str:
    return f"SELECT doc_id, pos AS sent, item AS sentence, {d.all('item', TOKEN)} AS toks FROM ({sentences(d)}) s2"


def token_rows(d) -> str:
    return d.explode(f"({tokens_of(d)}) t0", "toks", "doc_id, sent, sentence")


def logits(d) -> str:
    return d.explode("embeddings", "embedding", "vec_id, label")


S: dict[str, Callable] = {
    "flagship_sentence_corpus": flagship,
    "b2_manifest_counts": lambda d: f"SELECT origin, count(*) AS n, count(DISTINCT {key(d, 'target')}) AS groups, min({d.sha('target')}) AS least_sha FROM ({pairs(d)}) p GROUP BY origin",
    "c1_c2_keys": lambda d: f"SELECT doc_id, pos, {key(d, 'item')} AS k FROM ({sentences(d)}) s1",
    "c5_tokenize": lambda d: f"SELECT doc_id, sent, {d.join('toks', ' ')} AS spaced, {d.size('toks')} AS n FROM ({tokens_of(d)}) t",
    "c7_render": lambda d: f"SELECT doc_id, sent, {d.replace(d.join('toks', ' '), ' +([.,!?;:])', d.back + '1')} AS v1, {d.replace(d.replace(d.replace(d.join('toks', ' '), ' +([.,!?;:])', d.back + '1'), ' +([)}\\]])', d.back + '1'), '([({\\[]) +', d.back + '1')} AS v2 FROM ({tokens_of(d)}) t",
    "c9_preserve_case": lambda d: f"SELECT word, CASE WHEN length(word) > 1 AND word = upper(word) THEN upper(repl) WHEN {d.found('word', '^[A-Z]')} THEN upper(substr(repl, 1, 1)) || substr(repl, 2) ELSE repl END AS kept, CASE WHEN word = upper(word) THEN upper(repl) WHEN {d.found('word', '^[A-Z]')} THEN upper(substr(repl, 1, 1)) || lower(substr(repl, 2)) ELSE repl END AS kept_rules FROM (SELECT DISTINCT item AS word, substr(lower(item), 2) || 'xY' AS repl FROM ({d.explode('documents', d.all('text', '[A-Za-z]+'), 'doc_id')}) w) v",
    "c24_c25_urls": lambda d: f"SELECT page_id, nullif({d.group('url', '^https?://(?:www[.])?([^/?#]+)/([^/?#]+)', 1)}, '') || '/' || nullif({d.group('url', '^https?://(?:www[.])?([^/?#]+)/([^/?#]+)', 2)}, '') AS slug, nullif({d.group('url', '^(https?://[^/?#]+)', 1)}, '') || '/*' AS site FROM pages",
    "c28_json_usage": lambda d: f"SELECT event_id, {d.json('props', 'k')} AS k, {d.json('props', 'page')} AS page, {d.json('props', 'ref')} AS ref FROM events",
    "n6_priority": lambda d: f"SELECT ordinal, {d.sha('''concat('7:', CAST(ordinal AS VARCHAR(20)))''')} AS priority FROM ({pairs(d)}) p",
    "n7_j3_dialog_split": lambda d: f"SELECT conv_id, {split_of(d, '''concat('42:', CAST(conv_id AS VARCHAR(20)))''')} AS split, count(*) AS turns FROM conversations GROUP BY conv_id",
    "n9_judge_identity": lambda d: f"SELECT ordinal, {d.sha(d.sha('source') + ''' || ':' || ''' + d.sha('target') + ''' || ':v1' ''')} AS id FROM ({pairs(d)}) p",
    "n12_provenance_set": lambda d: f"SELECT lang, count(DISTINCT source) AS sources, min(source) AS first, max(source) AS last FROM documents GROUP BY lang",
    "d1_d2_validate_pair": lambda d: f"SELECT origin, coalesce({reason(d)}, 'ok') AS reason, count(*) AS n FROM ({pairs(d)}) p GROUP BY origin, coalesce({reason(d)}, 'ok')",
    "g3_admission_lookup": lambda d: f"SELECT source, CASE WHEN l.doc_id IS NULL THEN 'not_admitted' WHEN l.toxic = 1 THEN 'quarantined' WHEN l.quality = 0 THEN 'evidence_missing' ELSE 'ok' END AS reason, count(*) AS n, min(CASE WHEN coalesce(l.toxic, 1) = 0 THEN 1 ELSE 0 END) = 1 AS publishable FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source, CASE WHEN l.doc_id IS NULL THEN 'not_admitted' WHEN l.toxic = 1 THEN 'quarantined' WHEN l.quality = 0 THEN 'evidence_missing' ELSE 'ok' END",
    "d22_population_checks": lambda d: "SELECT count(CASE WHEN d.doc_id IS NULL THEN 1 END) AS missing, count(CASE WHEN l.doc_id IS NULL THEN 1 END) AS extra, count(*) - count(DISTINCT coalesce(d.doc_id, l.doc_id)) AS repeated FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id",
    "e19_padding": lambda d: f"SELECT doc_id, sent, {d.size('toks')} AS n, CAST(ceil({d.size('toks')} / 8.0) * 8 AS BIGINT) AS padded FROM ({tokens_of(d)}) t",
    "f7_reference_controls": lambda d: f"SELECT target AS clean, min(ordinal) AS first FROM ({pairs(d)}) p GROUP BY target",
    "f2_f6_corruption_pairs": lambda d: f"SELECT ordinal, source, target, CASE WHEN source = target THEN 'unchanged' WHEN length(source) > length(target) THEN 'duplicate' ELSE 'dropped' END AS family FROM ({pairs(d)}) p",
    "g1_decontaminate": lambda d: anti(d, f"SELECT s.doc_id, s.pos FROM (SELECT doc_id, pos, {key(d, 'item')} AS k FROM ({sentences(d)}) s1) s LEFT ANTI JOIN (SELECT DISTINCT {key(d, 'item')} AS k FROM ({sentences(d, 'benchmark', 'item_id')}) b1) h ON s.k = h.k"),
    "g2_overlap": lambda d: anti(d, f"SELECT s.doc_id, count(*) AS n FROM (SELECT doc_id, {key(d, 'item')} AS k FROM ({sentences(d)}) s1) s LEFT SEMI JOIN (SELECT DISTINCT {key(d, 'item')} AS k FROM ({sentences(d, 'benchmark', 'item_id')}) b1) h ON s.k = h.k GROUP BY s.doc_id"),
    "g3_g4_left_lookup": lambda d: "SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN 'source_license_unverified' ELSE 'ok' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "g5_stage_full_join": lambda d: "SELECT coalesce(a.doc_id, b.doc_id) AS id, a.doc_id IS NULL AS missing, b.doc_id IS NULL AS extra FROM documents a FULL OUTER JOIN labels b ON a.doc_id = b.doc_id",
    "g14_multi_reference": lambda d: f"SELECT sk, {d.size(d.listed('target', 'ordinal'))} AS refs, min(target) AS least FROM (SELECT {key(d, 'source')} AS sk, target, ordinal FROM ({pairs(d)}) p) q GROUP BY sk",
    "g15_known_words": lambda d: anti(d, f"SELECT t.doc_id, count(*) AS unknown FROM ({token_rows(d)}) t LEFT ANTI JOIN (SELECT word FROM ({words(d)}) w WHERE n >= 3) v ON lower(t.item) = v.word GROUP BY t.doc_id"),
    "h1_h3_h5_edit_metrics": lambda d: f"SELECT lang, tp, fp, fn, {_metrics('tp', 'fp', 'fn')} FROM (SELECT lang, count(CASE WHEN gold AND score > 0.05 THEN 1 END) AS tp, count(CASE WHEN NOT gold AND score > 0.05 THEN 1 END) AS fp, count(CASE WHEN gold AND score <= 0.05 THEN 1 END) AS fn FROM ({judged(d)}) j GROUP BY lang) k",
    "h2_trainer_metrics": lambda d: f"SELECT round(CAST(tp AS DOUBLE) / greatest(1, tp + fp), 9) AS p, round(CAST(tp AS DOUBLE) / greatest(1, tp + fn), 9) AS r, round(CAST(fp AS DOUBLE) / nullif(clean, 0), 9) AS clean_fp_rate FROM (SELECT count(CASE WHEN gold AND score > 0.05 THEN 1 END) AS tp, count(CASE WHEN NOT gold AND score > 0.05 THEN 1 END) AS fp, count(CASE WHEN gold AND score <= 0.05 THEN 1 END) AS fn, count(CASE WHEN NOT gold THEN 1 END) AS clean FROM ({judged(d)}) j) k",
    "h6_h19_grouping": lambda d: f"SELECT lang, source, count(*) AS n, count(CASE WHEN gold THEN 1 END) AS bad FROM ({judged(d)}) j GROUP BY GROUPING SETS ((), (lang), (source))",
    "h8_reason_counts": lambda d: f"SELECT reason, count(*) AS n FROM (SELECT coalesce({reason(d)}, 'ok') AS reason FROM ({pairs(d)}) p) r GROUP BY reason",
    "h9_coverage": lambda d: f"SELECT lang, split, count(*) AS population, count(CASE WHEN source <> target THEN 1 END) AS changed FROM (SELECT lang, source, target, {split_of(d, 'target')} AS split FROM ({pairs(d)}) p) q GROUP BY lang, split",
    "h12_recipe_pivot": lambda d: "SELECT event_type, count(CASE WHEN value < 10 THEN 1 END) AS low, count(CASE WHEN value >= 10 AND value < 50 THEN 1 END) AS mid, count(CASE WHEN value >= 50 THEN 1 END) AS high FROM events GROUP BY event_type",
    "h13_h14_ledger_sums": lambda d: "SELECT user_id, count(*) AS n, round(coalesce(sum(value), 0), 4) AS total, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id",
    "h15_all_safe": lambda d: "SELECT quality, count(*) AS n, min(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) = 1 AS all_safe, round(avg(CASE WHEN toxic = 1 THEN 0.0 ELSE (quality + 1) / 2.0 END), 9) AS reward FROM labels GROUP BY quality",
    "i1_g11_first_wins": lambda d: f"SELECT ordinal, target FROM (SELECT ordinal, target, row_number() OVER (PARTITION BY {key(d, 'source')} ORDER BY ordinal) AS r FROM ({pairs(d)}) p) q WHERE r = 1",
    "i2_reviewed_upgrade": lambda d: f"SELECT doc_id, k FROM (SELECT d.doc_id, d.k, row_number() OVER (PARTITION BY d.k ORDER BY coalesce(l.quality, -1) DESC, d.doc_id) AS r FROM (SELECT doc_id, {d.sha('text')} AS k FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id) q WHERE r = 1",
    "i3_canonical_min": lambda d: f"SELECT {d.sha('text')} AS k, min(concat(source, ':', CAST(doc_id AS VARCHAR(20)))) AS least FROM documents GROUP BY {d.sha('text')}",
    "i5_i6_offsets": lambda d: f"SELECT doc_id, pos, CAST(coalesce(sum(length(item) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, lag(length(item)) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ({sentences(d)}) s",
    "i8_carry_forward": lambda d: f"SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END{') IGNORE NULLS' if d.back == '$' else ' IGNORE NULLS)'} OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM conversations",
    "i9_top_per_group": lambda d: "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) q WHERE r <= 5",
    "i11_k1_latest": lambda d: "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) q WHERE r = 1",
    "i12_deltas": lambda d: f"SELECT event_id, {d.seconds('ts')} - lag({d.seconds('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events",
    "j1_hash_sample": lambda d: f"SELECT ordinal FROM (SELECT ordinal, {d.sha('''concat('42:', CAST(ordinal AS VARCHAR(20)))''')} AS h FROM ({pairs(d)}) p) q ORDER BY h LIMIT 500",
    "j2_k9_prefix_budget": lambda d: "SELECT event_id FROM (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM events) q WHERE spent <= 100",
    "j6_interval_coalesce": lambda d: "WITH e AS (SELECT l_orderkey AS k, l_linenumber AS o, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + 3 AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e), g AS (SELECT *, sum(CASE WHEN top IS NULL OR a > top THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m) SELECT k, CAST(island AS BIGINT) AS island, min(a) AS a, max(b) AS b FROM g GROUP BY k, island",
    "j14_round_robin": lambda d: "SELECT doc_id % 10 AS recipe, count(*) AS jobs, min(doc_id) AS first FROM documents GROUP BY doc_id % 10",
    "j15_split_reassignment": lambda d: f"SELECT k, split FROM (SELECT {d.sha('text')} AS k, {split_of(d, 'source')} AS split, row_number() OVER (PARTITION BY {d.sha('text')} ORDER BY source, doc_id) AS r FROM documents) q WHERE r = 1",
    "set_operations": lambda d: f"SELECT 'both' AS kind, k FROM (SELECT {key(d, 'item')} AS k FROM ({sentences(d)}) a INTERSECT SELECT {key(d, 'item')} AS k FROM ({sentences(d, 'benchmark', 'item_id')}) b) x UNION SELECT 'benchmark only', k FROM (SELECT {key(d, 'item')} AS k FROM ({sentences(d, 'benchmark', 'item_id')}) b EXCEPT SELECT {key(d, 'item')} AS k FROM ({sentences(d)}) a) y",
    "k2_k4_superseded": lambda d: f"SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS newer, {d.seconds('lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} - {d.seconds('ts')} < 60000000 AS superseded FROM events",
    "k3_k10_sessions": lambda d: f"WITH g AS (SELECT user_id, event_id, ts, CASE WHEN {d.seconds('ts')} - lag({d.seconds('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 600000000 THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(event_id) AS last FROM s GROUP BY user_id, session",
    "g3_verdict_lookup": lambda d: "SELECT d.doc_id, coalesce(l.quality, -1) AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "k8_late_conflict": lambda d: f"SELECT k, count(DISTINCT source) AS owners, count(DISTINCT source) = 1 AS admitted FROM (SELECT {d.sha('text')} AS k, source FROM documents) x GROUP BY k",
    "l5_reward_table": lambda d: "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 1 THEN -3 WHEN toxic = 0 THEN -1 ELSE -5 END AS reward FROM labels",
    "l11_readiness": lambda d: f"SELECT count(*) >= 25 AS enough, max(CASE WHEN gold THEN 1 ELSE 0 END) = 1 AS has_errors, round(avg(CASE WHEN NOT gold AND score > 0.05 THEN 1.0 ELSE 0.0 END), 9) <= 0.02 AS clean FROM ({judged(d)}) j",
}
