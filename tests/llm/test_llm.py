import hashlib
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emendata.llm import chat, fingerprints, html_text, jaccard_join, language_id, lines, lm_scoring, mixing, packing, quality

ROWS = [(1, "The cat sat on the mat. " * 20, "en", "a"), (2, "The cat sat on the mat. " * 20, "en", "a"), (3, None, "en", None), (4, "", None, "b"), (None, "El gato come pescado.", "es", "b"), (6, "x" * 50_000, "en", "a"), (7, "0 1 2 !!", "en", "a"), (7, "0 1 2 !!", "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_packing_holds_every_id_once(spark, docs):
    rows = packing.pack(docs, window=64).collect()
    own = packing.encoder(packing.tokenizer_path())
    want = Counter(np.append(np.frombuffer(own.whole(t or ""), own.kind), 2).astype("<u4").tobytes() for _, t, *_ in ROWS)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert sum(len(r["ids"]) for r in rows) == sum(len(k) * n for k, n in want.items())
    for doc in (1, 3, 4, 6, None):
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        assert b"".join(p["ids"] for p in pieces) in want
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 64
    assert packing.pack(docs.limit(0)).count() == 0


def test_encoder_equals_tokenizer(real):
    own = packing.Encoder(packing.tokenizer_path())
    for text in ["Café ²³ it's <x> don't", "", "ΑΣ Ωm", "a\0b", "<|endoftext|> a", *[r["text"] for r in real.limit(60).collect()]]:
        assert own(text) == own.whole(text)


def test_fingerprints(spark, docs):
    rows = fingerprints.fingerprint_rows(docs).collect()
    assert len(rows) == len(ROWS)
    order = sorted(((d, t or "") for d, t, *_ in ROWS), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = {(d, len(t), hashlib.sha256(fingerprints.edited_text(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order)}
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows} == want
    a, b = fingerprints.chunks([b"", b"abc"])
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) == 0
    text = np.random.default_rng(1).integers(32, 127, 5000, np.uint8).tobytes()
    one, two = fingerprints.chunks([text, b"inserted " + text])
    assert fingerprints.likeness(one, two) > 0.95 and (fingerprints.read_form(fingerprints.written_form(one))[0] == one[0]).all()


def test_html(spark):
    model = html_text.default_model()
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; t</h1><p>Some long text, with words and more words here.<p>And  another\n paragraph of plain text, too.</article><footer>&copy; x</footer>"
    assert model.texts([page, None, ""]) == ["T & t Some long text, with words and more words here. And another paragraph of plain text, too.", "", ""]
    body = "<article><h1>Head line</h1><p>Some long text, with words and more words here. And more words.</p><p>Another one, with a comma and more words.</p></article>"
    want = "Head line Some long text, with words and more words here. And more words. Another one, with a comma and more words."
    for page in (f"<html><head><title>x</title>{body}", f"<head><script>a<b</script>{body}", f"<body><noscript>{body}</noscript>"):
        assert model.texts([page]) == [want]
    assert model.texts(["plain text &amp;\n no element", "Hello <b>big</b><script>x</script> world"]) == ["plain text & no element", "Hello big world"]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def recall_and_precision(model, pages):
    hit = missed = wrong = 0
    for page, good in pages:
        nodes = html_text.parse(page)
        content = html_text.Forest([nodes]).marginals(model.unary, model.pair)[0] > 0.5
        for x, c in zip(nodes, content, strict=True):
            for _, t in x.runs:
                hit, missed, wrong = hit + (c and t in good), missed + (not c and t in good), wrong + (c and t not in good)
    return hit / (hit + missed), hit / (hit + wrong)


@pytest.mark.parametrize("family", html_text.FAMILIES)
def test_html_on_families_of_layouts_that_were_held_out(family):
    rest = tuple(x for x in html_text.FAMILIES if x != family)
    recall, precision = recall_and_precision(html_text.train(html_text.labelled_pages(300, families=rest)), html_text.labelled_pages(60, seed=5, families=(family,)))
    assert recall > 0.9 and precision > 0.8


def test_html_parser_is_linear():
    import time

    def took(n):
        start = time.perf_counter()
        html_text.parse("<b>x" * n + "<p>y" * n)
        html_text.parse("<div>" * n + "<tr>" * n + "<li>" * n + "</i>" * n)
        return time.perf_counter() - start

    took(2000)
    assert took(32_000) < 40 * took(2000)


def test_marginals_against_all_labellings():
    model, nodes = html_text.default_model(), html_text.parse("<div><p>a b</p><nav>c</nav></div>")
    forest = html_text.Forest([nodes])
    got = forest.marginals(model.unary, model.pair)[0]
    n, sums, total = len(nodes), np.zeros(len(nodes)), 0.0
    local = np.bincount(forest.row, model.unary[forest.col], n)
    for k in range(2**n):
        y = [k >> i & 1 for i in range(n)]
        p = np.exp(sum(local[i] * y[i] for i in range(n)) + sum(model.pair[forest.edge[i], y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0))
        total += p
        sums += p * np.array(y)
    assert np.allclose(got, sums / total)


def test_chat_round_trip_and_layouts(spark):
    turns = [("user", "a\\"), ("assistant", "</s>[INST] \\[/INST] <s>"), ("cri\ntic\\n\\\\<s>", "x\n[/ROLE]</s>"), ("system", None), ("assistant", ""), ("\\", "\\" * 1_000_000 + "<s>")]
    df = spark.createDataFrame([(turns,)], "turns array<struct<role:string,text:string>>").withColumn("turns", chat.canonical(F.col("turns")))
    row = chat.read_back(chat.render(df)).first()
    assert [tuple(t) for t in row["turns_read"]] == [(r, t or "") for r, t in turns]
    assert [row["formatted"][s["start"] : s["stop"]] for s in row["loss_spans"]][1] == ""
    records = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"id":3,"prompt":"q","response":"a"}', '{"instruction":"q","output":"a"}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"turns":[{"turn":1,"role":"user","text":"q"},{"turn":2,"role":"assistant","text":"a"}]}', '{"messages":[]}', '{"other":1}', "no json", '{"prompt":"q"}', None]
    got = [r["turns"] if r["turns"] is None else [tuple(t) for t in r["turns"]] for r in chat.turns_from_json(spark.createDataFrame([(x,) for x in records], "p string"), "p").collect()]
    assert got == [[("user", "q"), ("assistant", "a")]] * 5 + [[]] + [None] * 4
    with pytest.raises(ValueError):
        chat.render(df.withColumn("formatted", F.lit("x")))


def test_chat_rows_on_every_layout(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", None), (3, 0, "system", ""), (3, 1, "user", "q"), (3, 2, "assistant", "a"), (4, 0, None, "x"), (None, 0, "user", "n"), (5, 0, "cri\ntic", "<s>"), (5, 0, "cri\ntic", "<s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in chat.chat_rows(df).collect()}
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64"}))
    assert got == set(con.execute(chat.CHAT_SQL).fetchall()) and len(got) == 7


def test_mixing_rates(spark, docs):
    many = spark.range(4000).selectExpr("id doc_id", "if(id % 4 = 0, 'x', 'y') source")
    counts = Counter(r["source"] for r in mixing.mix(many, {"x": 3.0, "y": 1.0}).collect())
    assert abs(counts["x"] - 3000) < 250 and abs(counts["y"] - 1000) < 150
    assert mixing.mix(docs).columns == [*docs.columns, "mix_copy", "mix_key"] and mixing.mix(docs.limit(0)).count() == 0


def test_language(spark, docs, real):
    rows = language_id.language_rows(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.language_rows(docs).collect()}
    assert got[3] == got[4] == got[7] == "und" and len(got) == 7


def test_language_by_brute_force(real):
    """Out-of-place sums by plain ranks of plain strings."""
    texts = {"a": "the cat sat on the mat and the hat", "b": "el gato se sienta en la alfombra"}

    def ranks(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        padded = [f" {w} " for w in words]
        counts = Counter()
        joined = " " + " ".join(words) + " "
        counts.update(c for c in joined if c != " ")
        counts.update(joined[i : i + 2] for i in range(len(joined) - 1))
        counts.update(joined[i : i + 3] for i in range(len(joined) - 2) if joined[i + 1] != " ")
        del padded
        return counts

    for text in texts.values():
        mine = language_id.ranking(text, 10_000)
        assert len(mine) == len(ranks(text)) and sorted(Counter(language_id.grams(text).tolist()).values()) == sorted(ranks(text).values())
    profiles = language_id.Profiles({k: language_id.ranking(t, 400).tolist() for k, t in texts.items()})
    for text in ("the mat", "la alfombra", "cat gato"):
        own = language_id.ranking(text, 400).tolist()
        sums = {}
        for k, t in texts.items():
            at = {g: i for i, g in enumerate(language_id.ranking(t, 400).tolist())}
            sums[k] = sum(abs(at[g] - i) if g in at else 400 for i, g in enumerate(own))
        best = min(sums, key=lambda k: (sums[k], k))
        assert profiles.predict(text) == (best, pytest.approx(1 - sums[best] / (400 * len(own))))


def test_lm_scores_labels_that_were_held_out(spark, docs):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    rows = lm_scoring.score_rows(real, labels.where(half == 0)).join(labels.where(half == 1), "doc_id").where("score is not null").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g < b for g in good for b in bad]) > 0.6  # a good row is nearer the target than a bad one
    assert all(r["score"] is None for r in lm_scoring.score_rows(docs, labels.limit(0)).collect())


def test_lines(spark, docs):
    assert lines.line_rows(docs).count() == len(ROWS) and lines.line_rows(docs.limit(0)).count() == 0
    body = "one two three four five six seven eight nine"
    made = spark.createDataFrame([(1, f"{body} 17\nown line here"), (2, f"{body} 23\nanother of mine")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.line_rows(made).collect()}
    assert got == {1: f"{body} 17\nown line here", 2: "another of mine"}


def test_unlike_lines_of_a_leaf_change_nothing(spark):
    body = "one two three four five six seven eight nine"
    rows = [(i, f"{body} {name}") for i, name in enumerate(["anna", "bob", "carl", "dora", "emil", "fay"])]
    odd = [(10, "one two three four aa bb cc dd ee ff")]
    other = [(20 + i, f"one two three four v w x y z {name}\n\n") for i, name in enumerate("klm")]
    for given, want in ((rows, [0, 1, 1, 1, 1, 1]), (rows + odd, [0, 1, 1, 1, 1, 1, 0]), (rows + odd + other, [0, 1, 1, 1, 1, 1, 0, 0, 1, 1])):
        df = spark.createDataFrame(given, "doc_id long, text string")
        got = sorted(tuple(r) for r in lines.line_rows(df).select("doc_id", "text", "n_lines", "n_dropped").collect())
        assert [x[3] for x in got] == want
        con = duckdb.connect()
        con.register("documents", df.toPandas())
        assert sorted(con.execute(f"SELECT doc_id, text, n_lines, n_dropped FROM ({lines.lines_sql()}) x").fetchall()) == got


def test_lines_left_by_bitmap(spark):
    df = spark.createDataFrame([("a\nb\n\nc\nd", [1, 3]), ("x", [0]), ("p\nq\n", [2])], "text string, d array<int>")
    assert [r[0] for r in df.select(lines.without(F.col("text"), F.col("d"))).collect()] == ["a\n\nd", "", "p\nq"]


def brute_links(texts, threshold=0.8):
    known = jaccard_join.Known()
    own = [jaccard_join.shingles(t, known) for t in texts]
    sizes, both = np.array(list(map(len, own))), jaccard_join.intersections(own)
    plain = [set(x.tolist()) for x in own]
    for i in range(0, len(own), 7):
        assert all(both[i, j] == len(plain[i] & plain[j]) for j in range(len(own)) if j != i)
    like = (both >= threshold * (sizes[:, None] + sizes - both) - 1e-9) & (both > 0)
    np.fill_diagonal(like, False)
    return like


@pytest.mark.parametrize("bounds", [{}, {"BUCKET": 20, "SIGNATURES": 10, "BLOCK": 12, "BLOCK_TOKENS": 3000, "BROADCAST_MEMBERS": 0}])
def test_jaccard_against_brute_force(spark, docs, real, bounds, monkeypatch):
    for name, value in bounds.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = [(r["doc_id"], r["text"]) for r in real.collect()]
    like = brute_links([t for _, t in rows])
    assert {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_classes(real).collect()} == {d: int(n) for (d, _), n in zip(rows, like.sum(1), strict=True)}
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert {(1, 1, 1), (2, 1, 1), (3, 3, 0), (7, 7, 1)} <= got


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_jaccard_recall_near_the_threshold(spark, threshold):
    """Planted pairs whose likeness is just over the threshold."""
    rng, rows = np.random.default_rng(4), []
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        cut = int(200 * (1 - threshold) / 2)  # two contiguous parts share 200 - cut words
        rows += [(2 * k, " ".join(words[: 200 - cut + 1])), (2 * k + 1, " ".join(words[cut - 1 :]))]
    like = brute_links([t for _, t in rows], threshold)
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).agg(F.sum("n_links")).first()[0]
    assert like.sum() >= 250 and 0.98 * like.sum() <= got <= like.sum()


def test_one_of_each_class(spark):
    a, b = "one two three four five six seven", "other words that are not the same ones"
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "y"), (None, a, "z"), (None, a, "z"), (None, None, "n"), (None, None, "n"), (5, "", "e")] + [(None, f"{a} {i} {i + 1} {i + 2} {i + 3}", "many") for i in range(1500)]
    got = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"), broadcast_rows=0).collect()
    kept = Counter((r["doc_id"], r["text"]) for r in got)
    assert kept[1, a] == kept[1, b] == 1 and (2, b) not in kept and (None, a) not in kept and kept[None, None] == 2 and kept[5, ""] == 1
    assert sum(r["source"] == "many" for r in got) == 1500 and max(n for k, n in kept.items() if k[1]) == 1
    same = spark.createDataFrame([(3, a, "p"), (3, a, "q"), (3, a, "q")], "doc_id long, text string, source string")
    assert jaccard_join.one_of_each(same).count() == 1 and jaccard_join.one_of_each(same.limit(0)).count() == 0


def test_quality_counts(spark, docs):
    assert quality.base_counts("a b c d a b c\n\nx\nx") == [9, 9, 0, 1, 6]
    assert quality.base_counts(None) == [0, 0, 0, 0, 0] and quality.base_counts("a\u00a0b #|") == [2, 5, 2, 0, 0]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.quality_rows(docs, labels).count() == len(ROWS)
    assert quality.quality_rows(docs, labels.limit(0)).where("kept = base_failed").count() == 0  # the base rules alone


def test_quality_distances_by_brute_force(spark, real):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    own = quality.fit(real, labels)

    def divergence(a, b):
        p, q = a / max(a.sum(), 1), b / max(b.sum(), 1)
        m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
        half = lambda r: sum(x * np.log2(x / y) for x, y in zip(r, m, strict=True) if x)
        return np.sqrt(max(0, (half(p) + half(q)) / 2))

    for r in real.where("n_chars > 300").limit(25).collect():
        text, counts = r["text"], Counter(quality.words_of(r["text"]))
        n = sum(counts.values())
        classes = min(divergence(quality.class_counts(text).astype(float), x) for x in own.classes.values()) * np.sqrt(len(text) / (len(text) + quality.SMALL))
        known = {k: [counts[w] for w in v] for k, v in own.words.items()}
        words = min(divergence(np.array([*v, n - sum(v)], float), own.shares[k]) for k, v in known.items()) * np.sqrt(n / (n + quality.SMALL))
        got = own.distances(text)
        assert np.isclose(got[0], classes) and (got[1] is None) == (n < 50) and (got[1] is None or np.isclose(got[1], words))


def test_quality_of_labels_that_were_held_out(spark):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    own = quality.fit(real, labels.where(half == 0))
    rows = quality.judged(real.join(labels.where(half == 1), "doc_id").select("doc_id", "text", "quality"), own).where("not base_failed").collect()
    kept = {q: np.mean([r["kept"] for r in rows if r["quality"] == q]) for q in (0, 1)}
    assert kept[1] > 0.95 and kept[0] < 0.5


def test_lm_counts_every_pair(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 3000)
    monkeypatch.setattr(lm_scoring, "BUCKET_WORDS", 2000)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40_000)]
    rows = [(i, " ".join(words[k] for k in rng.zipf(1.3, 60) % 40_000) if i % 50 else None, i % 3 == 0) for i in range(600)]
    rows += [(600, "w1 common pair", True), (601, "w1 common pair", True)]
    sums = [Counter(), Counter()]
    for _, text, good in rows:
        w = (text or "").split()
        for s in sums[: 1 + good]:
            s.update(w)
            s.update(zip([None, *w], w, strict=False))
            s.update(("first", x) for x in [None, *w][: len(w)])
    size = len({x for x in sums[0] if isinstance(x, str)})
    total = [sum(n for x, n in s.items() if isinstance(x, str)) for s in sums]

    def loss(k, w):
        s = sums[k]
        p = [0.5 * (s[b] + 1) / (total[k] + size) + 0.5 * s[a, b] / max(s["first", a], 1) for a, b in zip([None, *w], w, strict=False)]
        return -np.mean(np.log(p))

    got = {r["doc_id"]: r for r in lm_scoring.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i,) for i, _, good in rows if good], "doc_id long")).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        if not text:
            assert got[i]["n_tokens"] == 0 and got[i]["score"] is None
        else:
            w = text.split()
            assert got[i]["n_tokens"] == len(w) and np.isclose(got[i]["target_loss"], loss(1, w)) and np.isclose(got[i]["background_loss"], loss(0, w))


def test_mixing_rates_over_one_part(spark):
    few = spark.createDataFrame([(i, "x") for i in range(40)] + [(100, None)] + [(i, "y") for i in range(200, 210)], "doc_id long, source string")
    made = mixing.mix(few, {"x": 2.0, "y": 1.0}, rows=60_000.0).collect()  # 1000 times each of x, 2000 times each of y
    each = Counter(r["doc_id"] for r in made)
    x, y = np.array([each[i] for i in range(40)]), np.array([each[i] for i in range(200, 210)])
    assert abs(x.mean() - 1000) < 25 and 15 < x.std() < 60 and abs(y.mean() - 2000) < 70 and 100 not in each
    assert len({(r["doc_id"], r["mix_copy"]) for r in made}) == len(made)
    assert made == mixing.mix(few, {"x": 2.0, "y": 1.0}, rows=60_000.0).collect()


def test_neighbours_are_the_best_by_bm25(real):
    own = packing.encoder(packing.tokenizer_path())
    ids = [np.append(np.frombuffer(own(r["text"]), own.kind), np.array(2, own.kind)) for r in real.limit(80).collect()]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=own.size)
    mean = sum(map(len, ids)) / len(ids)
    index = packing.Index([(i, 0, 0, x) for i, x in enumerate(ids)], packing.Statistics(df, len(ids), sum(map(len, ids))))
    index.unused[::9] = False

    def bm25(query, doc):
        tf = Counter(doc.tolist())
        idf = lambda t: np.log1p((len(ids) - df[t] + 0.5) / (df[t] + 0.5))
        return sum(idf(t) * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(doc) / mean)) for t in set(query.tolist()) if t in tf)

    for seed in (0, 9, 33):
        scores = np.array([bm25(ids[seed], x) if index.unused[i] else 0 for i, x in enumerate(ids)])
        got = index.neighbours(ids[seed])
        assert set(got.tolist()) == set(np.flatnonzero(scores).tolist()) and (np.diff(scores[got]) < 1e-4).all()


def test_chunks_by_a_plain_gear_hash():
    """Boundaries by the definition, a byte at a time."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 110, n, np.uint8).tobytes() for n in (0, 1, 11, 12, 500, 4000)] + [b"a" * 1000]
    for text, (_, lengths) in zip(texts, fingerprints.chunks(texts), strict=True):
        sizes, start = [], 0
        for i in range(len(text)):
            h = 0
            for b in text[max(0, i - 31) : i + 1]:
                h = (h * 2 + int(fingerprints._GEAR[b])) % 2**32
            size = i + 1 - start
            bits = fingerprints.STRICT_BITS if size < fingerprints.NORMAL else fingerprints.LOOSE_BITS
            if size == fingerprints.GREATEST or size >= fingerprints.LEAST and h >> (32 - bits) == 0:
                sizes.append(size)
                start = i + 1
        sizes += [len(text) - start] if start < len(text) else []
        assert sum(sizes) == len(text) and set(lengths.tolist()) == set(sizes)


def test_fingerprints_of_hot_and_null_ids(spark):
    rows = [(7, f"hot {i} " * 5) for i in range(300)] + [(None, f"null {i} " * 5) for i in range(200)] + [(100 + i, f"doc {i}") for i in range(500)] + [(9, None)]
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), crc32(x[1].encode()), x[1]))
    want = Counter((d, hashlib.sha256(fingerprints.edited_text(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.fingerprint_rows(df).collect()) == want
    assert max(r["count"] for r in fingerprints.ranked(df).groupBy("part").count().collect()) < 0.4 * len(rows)
    assert fingerprints.fingerprint_rows(df.limit(0)).count() == 0


def test_mixing_many_sources_without_broadcast(spark, docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = mixing.mix(docs)
    assert sorted(map(tuple, rows.collect()), key=repr) == want
    keys = [r["mix_key"] for r in rows.collect()]
    assert keys == sorted(keys)


def agreeing(rows):
    """Groups of the lines by brute force: all pairs that agree at enough places, closed."""
    split = [r.split() for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(split):
        for j in range(i):
            if len(a) == len(split[j]) and a[:4] == split[j][:4] and sum(x == y for x, y in zip(a, split[j], strict=True)) * 100 >= 70 * len(a):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_lines_that_agree_with_no_frequent_one_still_meet(spark):
    """Leaves with several planted templates: each must be found whatever else is more frequent in its bands."""
    pair = ["aa bb cc dd p q r s t u", "aa bb cc dd p q R S t U"]
    frequent = ["aa bb cc dd p q zx zz yy ww"] * 3
    rng = np.random.default_rng(8)
    planted = []
    for k in range(40):
        words = [f"w{x}" for x in "".join(rng.choice(list("abcdefgh"), 8))]
        base = ["one", "two", "three", f"leaf{'abcd'[k % 4]}", *words, "x", "y", "z", "end"]
        planted.append(" ".join(base))
        varied = list(base)
        for spot in rng.choice(np.arange(4, len(base)), 4, replace=False):
            varied[spot] = f"v{chr(97 + k % 26)}{'pqrst'[k % 5]}"
        planted.append(" ".join(varied))
    for rows in (pair, pair + frequent, planted):
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        got = sorted(tuple(r) for r in lines.line_rows(df).select("doc_id", "text", "n_lines", "n_dropped").collect())
        group = agreeing(rows)
        want = [int(group.index(g) != i) for i, g in enumerate(group)]
        wrong = sum(x[3] != w for x, w in zip(got, want, strict=True))
        assert wrong <= 0.03 * len(rows), (wrong, len(rows))
        con = duckdb.connect()
        con.register("documents", df.toPandas())
        assert sorted(con.execute(f"SELECT doc_id, text, n_lines, n_dropped FROM ({lines.lines_sql()}) x").fetchall()) == got


def test_lines_behind_many_unlike_ones_of_their_band_still_meet(spark, monkeypatch):
    """More than TOPS frequent lines share the only band of a pair that agrees, and none of them joins."""
    frequent = [f"aa bb cc dd p q f{c}x f{c}y f{c}z f{c}w" for c in "abcdefghijkl" for _ in range(3)]
    pair = ["aa bb cc dd p q r s t u", "aa bb cc dd p q R S t U"]
    rows = [(1, "\n".join(frequent)), (2, pair[0]), (3, pair[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (lines.BLOCK, 1, 3):  # several blocks too
        monkeypatch.setattr(lines, "BLOCK", block)
        assert {r["doc_id"]: r["n_dropped"] for r in lines.line_rows(df).collect()} == {1: 0, 2: 0, 3: 1}
