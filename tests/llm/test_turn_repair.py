"""Operator 13 against every edit sequence of short conversations, its SQL, and long, odd and empty inputs."""

import hashlib
import itertools
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
from pyspark.sql import functions as F

from emendata.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def every_repair(turns):
    """(cost, audit, lines) of every edit sequence with up to three insertions before each turn and at the end."""
    inserts = [(3 * n, "I" * n, list(x)) for n in range(4) for x in itertools.product("ua", repeat=n)]
    paths = [(c, w, o) for c, w, o in inserts]
    for initial, fault in turns:
        extra = 3 * (fault == "t")
        edits = [(4, "D", [])]
        if fault != "d":
            edits += [(extra, "K", [initial]), (3 + extra, "R", ["u"]), (3 + extra, "R", ["a"])]
        steps = [(c + d, w + x, o + p) for c, w, o in edits for d, x, p in inserts]
        paths = [(c + d, w + x, o + p) for c, w, o in paths for d, x, p in steps if c + d <= 20]
    return min((c, w) for c, w, o in paths if LEGAL.fullmatch("".join(o)))


def test_cheapest_by_all_sequences():
    kinds = list(itertools.product("sua?", "-td"))
    for n in (0, 1):
        for turns in itertools.product(kinds, repeat=n):
            assert tr.cheapest("".join(map("".join, turns))) == every_repair(turns)
    rng = random.Random(5)
    for _ in range(60):
        turns = [rng.choice(kinds) for _ in range(2)]
        assert tr.cheapest("".join(map("".join, turns))) == every_repair(turns)


def by_layers(turns):
    """Another way for longer ones: the least (cost, audit) of each state after each turn."""
    best = {0: (0, "")}
    add = lambda to, key: best.__setitem__(to, min(best.get(to, key), key))
    for turn in [*turns, None]:
        for to, state in ((2, 0), (2, 1), (2, 3), (3, 2)):
            if state in best:
                add(to, (best[state][0] + 3, best[state][1] + "I"))
        if turn is None:
            return min(best[s] for s in (0, 3) if s in best)
        (initial, fault), before, best = turn, best, {}
        for state, (cost, audit) in before.items():
            add(state, (cost + 4, audit + "D"))
            if fault != "d":
                for x, to in tr.NEXT[state].items():
                    if x == initial or x != "s":
                        add(to, (cost + 3 * (fault == "t") + 3 * (x != initial), audit + ("K" if x == initial else "R")))


def test_cheapest_of_long_conversations():
    rng = random.Random(6)
    for n in [*range(3, 60), 3000]:
        turns = [(rng.choice("ssuuuaaa?"), rng.choice("---td")) for _ in range(n)]
        assert tr.cheapest("".join(map("".join, turns))) == by_layers(turns)


def plain(rows):
    """The contract row by row, in Python."""
    out, groups = [], {}
    for conv, turn, role, text in rows:
        mine = groups.setdefault(conv, [])
        text, role = " " if text is None else text, " " if role is None else role
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, turns = set(), Counter(), []
        for _, role, text in mine:
            end = text.rstrip(tr.BLANKS)
            fault = "b" if not end else "d" if (role, text) in seen else "-" if end[-1] in ".!?" else "t"
            seen.add((role, text))
            faults[fault] += 1
            turns.append((role[:1] if role[:1] in ("s", "u", "a") else "?", "d" if fault == "b" else fault))
        cost, audit = by_layers(turns)
        have = [t for t, *_ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        lines, state, left = [], 0, iter(mine)
        for w in audit:
            _, role, text = (0, "", "") if w == "I" else next(left)
            if w != "D":
                role = role if w == "K" else "assistant" if state == 2 else "user"
                state = tr.NEXT[state][role[0]]
                lines.append(f"{role}:{text}")
        gaps = max(have) - min(have) + 1 - len(set(have)) if have else 0
        out.append((conv, gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_whole_table_by_sql_and_python(spark):
    at = "/root/testdata/sf0.01/conversations.parquet"
    rng = random.Random(9)
    texts = ["Yes.", "no", " \n", "", None, "Why?  ", "a ", "x\r\nb!\n", "Éa 😀."]
    odd = [(rng.choice([None, -1, -2, -3]), rng.choice([None, 0, 1, 2, 7, 10**9]), rng.choice(["system", "user", "assistant", "tool", "", None, "sue"]), rng.choice(texts)) for _ in range(120)]
    real = spark.read.parquet(at).select("conv_id", "turn", "role", "text")
    rows = real.unionByName(spark.createDataFrame(odd, SCHEMA))
    want = plain([tuple(r) for r in rows.collect()])
    got = tr.repair_rows(rows.withColumns({c: F.lit("mine") for c in ("fault", "seen", "copy", "cost", "gaps")}))
    assert got.columns == COLUMNS and Counter(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.register("given", rows.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    con.sql("CREATE VIEW conversations AS SELECT * FROM given")
    found = con.sql(tr.REPAIR_SQL)
    assert found.columns == COLUMNS and Counter(found.fetchall()) == want


def test_long_dropped_and_empty(spark, monkeypatch):
    monkeypatch.setattr(tr, "SPOOLED", 50)  # texts go to the file
    drops = next(t for t in range(1000) if crc32(f"5:{t}".encode()) % 20 == 0)
    long = [(1, t, "user" if t % 2 else "assistant", "Ends well. " * (3 if t else 40_000)) for t in range(4000)]
    rows = [*long, (5, drops, "user", "a.")]
    got = Counter(map(tuple, tr.repair_rows(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows)
    assert (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert tr.repair_rows(spark.createDataFrame([], SCHEMA)).count() == 0
