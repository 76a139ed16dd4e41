"""Operator 8, line dedup by a log-template tree. DataFrame and SQL functions only.

The tree has a fixed depth: a line falls by its token count, then by its first LEADING tokens, fields with a
digit being `<*>`. Lines with one masked text are one template. In a leaf that holds several, each joins the most
frequent line that agrees with it at SIMILARITY of the positions or more, that one joins its own, and so on: the
lines that end at one form a group, and the positions at which they differ are the template's variable fields. An
unlike line in the leaf stays by itself and changes nothing for the others. Each line is held against the TOPS most
frequent ones of its leaf; one that agrees with none of them is held against all the others that may agree with it:
positions are dealt into bands, one more than may differ, so that two lines which agree enough have a band in common,
and a band's pairs are compared in blocks. No line is left out. (The SQL gives up a band in which a round joins none.)

A template that recurs across documents is dropped wherever it is not in its first document (of the least id):
copies of whole documents thus leave one whole. Recurring: in two documents for lines of LONG tokens or more, in
SHORT_DOCS for shorter ones, which also happen to be equal and are not generalised beyond digits.

Shuffled are the texts once and hashes of lines. Templates with more than one in HOT_SHARE of all lines, of which
there are HOT_SHARE at most, are broadcast; no other key has more lines than that.

Defined cases: null text stays null; blank lines are never dropped; rows with one id are one document, and keep
what they share; null ids are one id, the least; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emendata.llm.common import discard, written

LEADING, SIMILARITY, LONG, SHORT_DOCS = 4, 0.7, 8, 10
#: Lines of a leaf that the others are held against first.
TOPS = 8
#: Lines of a band on each side of a block of pairs (about 8 bytes a token).
BLOCK = 2_000
#: Leaves with several templates that may be broadcast (8 bytes each); beyond, their join is shuffled. Rows about lines of such leaves (100 bytes each).
BROADCAST_LEAVES, BROADCAST_LINES = 100_000, 50_000
#: A template is hot if it has more than one of so many lines.
HOT_SHARE = 5_000
#: Documents that hold such lines, by id (8 bytes each), that may be broadcast.
BROADCAST_HOLDERS = 500_000
_BLANKS = "[\\x09\\x0B-\\x0D\\x20]+"


def _keys(docs: DataFrame) -> DataFrame:
    """docs with _id (null ids are the least) and _th, the hash that tells rows of one id apart."""
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("_th", F.xxhash64("text"))


def masked_lines(docs: DataFrame) -> DataFrame:
    """_id, _th, pos, n (tokens) and masked text of the non-blank lines of docs (with keys)."""
    lines = docs.select("_id", "_th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.where(F.btrim("line", F.lit(" \t\v\f\r")) != "")  # not by the masked text, which the optimiser would then make twice
    # most lines need no regular expression beyond this one
    plain = ~F.col("line").rlike("[0-9\\x09\\x0B-\\x0D]|  ")
    bare = F.trim(F.regexp_replace("line", _BLANKS, " "))
    lines = lines.withColumn("masked", F.when(plain, F.trim("line")).otherwise(F.regexp_replace(bare, "[^ 0-9]*+[0-9][^ ]*", "<*>")))
    n = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return lines.select("_id", "_th", "pos", n.alias("n"), "masked")


def _leaf() -> Column:
    return F.xxhash64("n", F.substring_index("masked", " ", LEADING))


def _bands(n: Column) -> Column:
    """How many bands the positions after the leading ones fall into: one more than may differ."""
    return F.least(n - LEADING, F.floor(n * F.lit(round(100 - 100 * SIMILARITY)) / 100).cast("int") + 1)


def _side(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def _agree(tokens: str, others: Column) -> Column:
    """Whether two lines of one leaf agree at SIMILARITY of the places."""
    same = F.aggregate(F.zip_with(tokens, others, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return same * 100 >= F.size(tokens) * F.lit(round(100 * SIMILARITY))


def banded(lines: DataFrame) -> DataFrame:
    """leaf, band, part, m, seen and tokens of lines in each of their bands: two that agree enough have a band in common."""
    n, cuts = F.size("tokens"), _bands(F.size("tokens"))
    edge = lambda k: F.floor((k * (n - LEADING) + cuts - 1) / cuts).cast("int")
    band = lines.withColumn("band", F.explode(F.sequence(F.lit(0), cuts - 1)))
    start, stop = edge(F.col("band")), edge(F.col("band") + 1)
    return band.select("leaf", "band", F.xxhash64(F.slice("tokens", start + LEADING + 1, stop - start)).alias("part"), "m", "seen", "tokens")


def most_frequent_alike(late: DataFrame, others: DataFrame) -> DataFrame:
    """m of late lines and the most frequent one of others before them that agrees (root), from all pairs with a band in common.

    late, others: leaf, m, seen, tokens. A band's pairs are compared in blocks of BLOCK lines by as many, each in a task, and only a line's best leaves it.
    """
    key = ["leaf", "band", "part"]
    left, right = banded(late), banded(others)
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    cuts = blocks(left, "i_cuts").join(blocks(right, "j_cuts"), key)
    own = lambda name: F.pmod(F.xxhash64("m", F.lit("block")), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = left.join(cuts, key).withColumn("i", own("i_cuts")).select(*key, "i", every("j_cuts").alias("j"), "m", "seen", "tokens")
    right = right.join(cuts, key).withColumn("j", own("j_cuts")).select(*key, every("i_cuts").alias("i"), "j", F.struct("seen", "m").alias("top"), F.col("tokens").alias("others"))
    near = left.join(right, [*key, "i", "j"]).where((F.struct("seen", "m") < F.col("top")) & _agree("tokens", F.col("others")))
    return near.groupBy("m").agg(F.max("top").alias("top")).select("m", F.col("top.m").alias("root"))


def groups(distinct: DataFrame) -> DataFrame:
    """m and root of the lines that join another one; distinct: leaf, m (md5), seen, tokens (hashes) of masked lines."""
    order = Window.partitionBy("leaf").orderBy(F.desc("seen"), F.desc("m"))
    # the TOPS first lines of the leaf that come before a line: the first that agrees is the most frequent of all
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tops = {f"_{k}": F.nth_value(F.struct("m", "tokens"), k).over(before) for k in range(1, TOPS + 1)}
    first = F.coalesce(*(F.when(_agree("tokens", F.col(f"{c}.tokens")), F.col(f"{c}.m")) for c in tops))
    ranked = distinct.select("leaf", "m", "seen", "tokens", F.row_number().over(order).alias("rank"), *(c.alias(name) for name, c in tops.items()))
    used: list[str] = []
    led = written(ranked.where("rank > 1").select("leaf", "m", "rank", first.alias("root")), "led", keep=used)
    # a line that agrees with none of these is held against all the others before it
    tree, late = led.where("root is not null").select("m", "root"), led.where(F.col("root").isNull() & (F.col("rank") > TOPS + 1))
    left = late.count()
    if left:
        leaves = _side(late.select("leaf").distinct(), left, BROADCAST_LEAVES)
        others = written(distinct.join(leaves, "leaf", "left_semi").join(led.where(F.col("rank") > TOPS).join(leaves, "leaf", "left_semi").select("m"), "m", "left_semi").select("leaf", "m", "seen", "tokens"), "others", keep=used)
        tree = tree.unionByName(most_frequent_alike(others.join(_side(late.select("m"), left, BROADCAST_LINES), "m", "left_semi"), others))
    tree = written(tree, "tree")
    discard(tree.sparkSession, used)
    rows = tree.count()
    while tree.select(F.col("root").alias("m")).distinct().join(tree, "m", "left_semi").limit(1).count():  # halves the depth
        above = tree.select(F.col("m").alias("root"), F.col("root").alias("further"))
        tree = written(tree.join(_side(above, rows, BROADCAST_LINES), "root", "left").select("m", F.coalesce("further", "root").alias("root")), "tree")
    return tree


def recurring(docs: DataFrame) -> DataFrame:
    """_id, _th and the positions of the lines to drop, for documents (with keys) that have any."""
    masked = masked_lines(docs)
    # 128 bits for a line, 64 for a leaf (lines of two leaves in one would agree at too few positions)
    own = lambda: (F.xxhash64("masked").alias("h1"), F.xxhash64(F.lit("second"), "masked").alias("h2"))
    lines = written(masked.select("_id", "_th", "pos", "n", *own(), _leaf().alias("leaf")), "lines")
    several = lines.where(F.col("n") >= LONG).groupBy("leaf").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("_id").alias("c"), F.max("_id").alias("d"))
    several = written(several.where("a != b and c != d").select("leaf"), "leaves")
    side = _side(several, several.count(), BROADCAST_LEAVES)
    # the texts of those leaves, from their documents alone
    where = written(lines.where(F.col("n") >= LONG).join(side, "leaf", "left_semi").select("_id").distinct(), "holders")
    again = masked_lines(docs.join(_side(where, where.count(), BROADCAST_HOLDERS), "_id", "left_semi")).where(F.col("n") >= LONG).withColumn("leaf", _leaf()).join(side, "leaf", "left_semi")
    distinct = again.groupBy("leaf", "n", "masked").agg(F.count("*").alias("seen"))
    used: list[str] = []
    distinct = written(distinct.select("leaf", "n", F.md5("masked").alias("m"), "seen", *own(), F.transform(F.split("masked", " "), lambda x: F.xxhash64(x)).alias("tokens")), "distinct", keep=used)
    tree = groups(distinct)
    keys = distinct.select("m", "h1", "h2")
    general = tree.join(keys, "m").join(keys.select(F.col("m").alias("root"), F.col("h1").alias("k1"), F.col("h2").alias("k2")), "root").select("h1", "h2", "k1", "k2")
    general = written(general.unionByName(general.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "k1", "k2").distinct()), "general")
    discard(docs.sparkSession, used)
    # each line's text once, then each group's
    ids = (F.min("first").alias("first"), F.max("last").alias("last"))
    long_ = lines.where(F.col("n") >= LONG).groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.count("*").alias("lines"))
    long_ = long_.join(_side(general, general.count(), BROADCAST_LINES), ["h1", "h2"], "left").where("k1 is not null or first != last")
    long_ = written(long_.select("h1", "h2", F.coalesce("k1", "h1").alias("k1"), F.coalesce("k2", "h2").alias("k2"), "first", "last", "lines"), "long")
    whole = long_.groupBy("k1", "k2").agg(*ids).where("first != last").drop("last")
    short = lines.where(F.col("n") < LONG).groupBy("h1", "h2", "_id").agg(F.count("*").alias("lines")).groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.count("*").alias("docs"), F.sum("lines").alias("lines"))
    seen = long_.drop("first", "last").join(whole, ["k1", "k2"]).select("h1", "h2", "first", "lines").unionByName(short.where(F.col("docs") >= SHORT_DOCS).drop("docs"))
    seen = written(seen, "seen")
    hot = F.col("lines") > F.lit(lines.count() / HOT_SHARE)
    some = lines.select("_id", "_th", "pos", "h1", "h2")
    hot, cold = F.broadcast(seen.where(hot).drop("lines")), seen.where(~hot).drop("lines")
    found = some.join(hot, ["h1", "h2"]).unionByName(some.join(hot, ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"]))
    return found.where(F.col("_id") != F.col("first")).groupBy("_id", "_th").agg(F.array_sort(F.collect_set("pos")).alias("_drop"))


def without(text: Column, drop: Column) -> Column:
    """The lines of text but those at the places of drop (sorted), in time linear in both."""
    before = F.concat(F.array(F.lit(-1)), F.slice(drop, 1, F.size(drop) - 1))
    marks = F.concat(F.array_join(F.zip_with(drop, before, lambda a, b: F.concat(F.repeat(F.lit("0,"), a - b - 1), F.lit("1"))), ","))
    both = F.arrays_zip(F.split(text, "\n").alias("line"), F.split(marks, ",").alias("mark"))
    return F.array_join(F.transform(F.filter(both, lambda x: F.coalesce(x["mark"], F.lit("0")) != "1"), lambda x: x["line"]), "\n")


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", ""))


def dedup_lines(docs: DataFrame, share: bool = False) -> DataFrame:
    """docs with the text that stays, n_lines and n_dropped; with `share` also kept_share, the share of letters and digits that stays."""
    made = ["n_lines", "n_dropped", *(["kept_share"] if share else [])]
    if clash := sorted({*made, "_drop", "_id", "_th"} & set(docs.columns)):
        raise ValueError(f"the input already has columns {clash}")
    keyed = _keys(docs)
    joined = keyed.join(recurring(keyed.select("_id", "_th", "text")), ["_id", "_th"], "left")
    whole, kept = F.col("_drop").isNull(), without(F.col("text"), F.col("_drop"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    counts = [F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.when(whole, 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped")]
    if share:
        counts.append(F.when(whole, 1.0).otherwise(_letters(kept) / F.greatest(_letters(F.col("text")), F.lit(1))).alias("kept_share"))
    return joined.select(*[c if c != "text" else F.when(whole, F.col("text")).otherwise(kept).alias("text") for c in docs.columns], *counts)


def line_rows(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text"))


def lines_sql(table: str = "documents") -> str:
    """The same rows in DuckDB's SQL, for tables without repeated or null ids."""
    most = round(100 - 100 * SIMILARITY)
    return rf"""
WITH RECURSIVE split_ AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {table}),
masked AS (SELECT doc_id, pos, regexp_replace(trim(regexp_replace(line, '[\x09\x0B-\x0D\x20]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM split_),
lines AS (SELECT doc_id, pos, m, string_split(m, ' ') AS t, len(string_split(m, ' ')) AS n FROM masked WHERE m <> ''),
led AS (SELECT *, n || ' ' || array_to_string(t[1:{LEADING}], ' ') AS leaf FROM lines),
several AS (SELECT leaf FROM led WHERE n >= {LONG} GROUP BY leaf HAVING min(m) <> max(m) AND min(doc_id) <> max(doc_id)),
kinds AS (SELECT leaf, n, md5(m) AS id, count(*) AS seen, any_value(t) AS t, least(n - {LEADING}, n * {most} // 100 + 1) AS cuts FROM led WHERE n >= {LONG} AND leaf IN (SELECT leaf FROM several) GROUP BY leaf, n, m),
dealt AS (SELECT *, unnest(range(0, cuts)) AS band FROM kinds),
bands AS (SELECT leaf, id, seen, band, t[{LEADING} + (band * (n - {LEADING}) + cuts - 1) // cuts + 1 : {LEADING} + ((band + 1) * (n - {LEADING}) + cuts - 1) // cuts] AS part FROM dealt),
tokens AS (SELECT id, n, unnest(t) AS token, generate_subscripts(t, 1) AS spot FROM kinds),
rounds AS (
  SELECT 0 AS r, leaf, band, part, id, seen, CAST(NULL AS VARCHAR) AS up FROM bands
  UNION ALL
  SELECT * FROM (
    WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY leaf, band, part ORDER BY seen DESC, id DESC) AS k, {TOPS} * CAST(pow(2, r) AS BIGINT) AS tops FROM rounds WHERE up IS NULL),
    near AS (SELECT DISTINCT a.id, b.id AS top, b.seen AS top_seen FROM ranked a JOIN ranked b ON a.leaf = b.leaf AND a.band = b.band AND a.part = b.part AND b.k < a.k AND b.k <= b.tops),
    alike AS (SELECT p.id, p.top, p.top_seen FROM near p JOIN tokens x ON x.id = p.id JOIN tokens y ON y.id = p.top AND y.spot = x.spot GROUP BY p.id, p.top, p.top_seen, x.n HAVING count(*) FILTER (x.token = y.token) * 100 >= x.n * {100 - most}),
    found AS (SELECT id, top AS up FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY top_seen DESC, top DESC) AS r FROM alike) a WHERE r = 1),
    going AS (SELECT DISTINCT leaf, band, part FROM ranked WHERE id IN (SELECT id FROM found))
    SELECT x.r + 1, x.leaf, x.band, x.part, x.id, x.seen, CAST(NULL AS VARCHAR) AS up FROM ranked x JOIN going g ON x.leaf = g.leaf AND x.band = g.band AND x.part = g.part WHERE x.k > x.tops AND x.id NOT IN (SELECT id FROM found)
    UNION ALL SELECT NULL, NULL, NULL, NULL, id, NULL, up FROM found) z),
ups AS (SELECT id, up FROM rounds WHERE up IS NOT NULL),
chains AS (SELECT id, up AS root FROM ups UNION ALL SELECT c.id, u.up FROM chains c JOIN ups u ON c.root = u.id),
roots AS (SELECT id, root FROM chains WHERE root NOT IN (SELECT id FROM ups)),
tagged AS (SELECT l.doc_id, l.pos, l.n, coalesce(r.root, md5(l.m)) AS key FROM led l LEFT JOIN roots r ON r.id = md5(l.m)),
seen AS (SELECT key, n, min(doc_id) AS first FROM tagged GROUP BY key, n HAVING count(DISTINCT doc_id) >= CASE WHEN n >= {LONG} THEN 2 ELSE {SHORT_DOCS} END),
drops AS (SELECT t.doc_id, t.pos FROM tagged t JOIN seen s ON t.key = s.key AND t.n = s.n WHERE t.doc_id <> s.first),
rest AS (SELECT s.doc_id, count(*) AS n_lines, count(d.pos) AS n_dropped, coalesce(string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (d.pos IS NULL), '') AS text
  FROM split_ s LEFT JOIN drops d ON s.doc_id = d.doc_id AND s.pos = d.pos GROUP BY s.doc_id)
SELECT k.doc_id, CASE WHEN k.text IS NULL THEN NULL ELSE r.text END AS text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped FROM {table} k LEFT JOIN rest r USING (doc_id)
"""
