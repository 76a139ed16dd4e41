"""Operator 13, conversation structure repair: Dijkstra over the implicit (turn index, grammar state) edit lattice.

A repaired conversation's role initials are `(s?(ua)+)?`. A node of the lattice is the number of turns consumed and the
grammar's state; its edges keep, rerole, delete a turn or insert an empty one. The queue's key is (cost, audit), the
audit being the edits' initials so far; the first accepting end node that leaves the queue is the answer. Audits are
paths in the tree of settled nodes, compared from where they part (jump pointers find that in a logarithm of steps), so
that a long conversation's nodes don't each hold a string.

Faults are column expressions, duplicates a window; one shuffle by conversation serves the window and the repair. The
audit and the digest are one sequential cell of each conversation, so that its turns meet in one task, however many: it
holds some hundred bytes for each turn and edit, the texts go to a spooled file beyond SPOOLED bytes.

Defined cases: null roles and texts count as one space, as do null ids and turns in the damage's key; the null id is one
conversation, null turns come first and have no gaps. Rows of the same turn are in the order of role and text. A role's
initial is its first character, none for an empty role, which is never legal. Repeated rows are duplicates. Conversations
that lose all rows have zeros, an empty audit and the digest of nothing. Of other columns none is read, whatever its
name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emendata.llm.common import released

#: Fixed values of the damage: remainders of crc32 by 20.
DROP, EMPTY, STRIP, REPEAT, AS_USER, KINDS = 0, 1, 2, 3, 4, 20
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
ROLE = {"u": "user", "a": "assistant"}
#: Grammar: from each state the initials that may follow and the states that they lead to; a text may end in ENDS.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
#: Texts of one conversation that stay in memory; conversations' forms that a task remembers, up to so many turns.
SPOOLED, FORMS, FORM_TURNS = 32_000_000, 50_000, 64


class Step:
    """An edit at the end of a path: its cost so far, where it leads, and the path before it."""

    __slots__ = ("cost", "turn", "state", "letter", "before", "depth", "jump")

    def __init__(self, cost: int, turn: int, state: int, letter: str, before: Step | None):
        self.cost, self.turn, self.state, self.letter, self.before = cost, turn, state, letter, before
        self.depth = before.depth + 1 if before else 0
        if not before:
            self.jump = self
        else:
            far = before.jump
            self.jump = far.jump if before.depth - far.depth == far.depth - far.jump.depth else before

    def __lt__(self, other: Step) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b = self.at(other.depth), other.at(self.depth)
        if a is b:  # one audit begins with the other
            return self.depth < other.depth
        while a.before is not b.before:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.before, b.before)
        return a.letter < b.letter

    def at(self, depth: int) -> Step:
        """The step of this path with that depth, itself if it is not as deep."""
        step = self
        while step.depth > depth:
            step = step.jump if step.jump.depth >= depth else step.before
        return step

    def audit(self) -> str:
        out, step = [], self
        while step.before:
            out.append(step.letter)
            step = step.before
        return "".join(reversed(out))


def cheapest(turns: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; a turn is two characters: its role's initial (s, u, a or another) and its fault (- none, t truncated, d to delete)."""
    n, queue, settled = len(turns) // 2, [Step(0, 0, 0, "", None)], set()
    while True:
        now = heapq.heappop(queue)
        node = now.turn, now.state
        if node in settled:
            continue
        settled.add(node)
        if now.turn == n and now.state in ENDS:
            return now.cost, now.audit()
        ways = NEXT[now.state]
        for initial, state in ways.items():
            if initial in ROLE:
                heapq.heappush(queue, Step(now.cost + INSERT, now.turn, state, "I", now))
        if now.turn == n:
            continue
        own, fault = turns[2 * now.turn], turns[2 * now.turn + 1]
        heapq.heappush(queue, Step(now.cost + DELETE, now.turn + 1, now.state, "D", now))
        if fault == "d":
            continue
        more = now.cost + TRUNCATED * (fault == "t")
        for initial, state in ways.items():
            if initial == own:
                heapq.heappush(queue, Step(more + KEEP, now.turn + 1, state, "K", now))
            elif initial in ROLE:
                heapq.heappush(queue, Step(more + REROLE, now.turn + 1, state, "R", now))


def repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The lines `role:text` that the audit makes of the turns."""
    state = 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        if letter != "K":
            initial = next(x for x in NEXT[state] if x in ROLE)
            role = ROLE[initial]
        state = NEXT[state][role[0]]
        yield f"{role}:{text}"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with the fixed damage; a dropped row stays as one with null role and text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % KINDS
    text = F.when(kind == EMPTY, "").when(kind == STRIP, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(kind == AS_USER, "user").otherwise(name("role"))
    gone = lambda c: F.when(kind != DROP, c)
    times = F.sequence(F.lit(1), F.when(kind == REPEAT, 2).otherwise(1))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), gone(role).alias("role"), gone(text).alias("text"), F.explode(times).alias("copy"))
    return out.drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """Per conv_id of rows (conv_id, turn, role, text; null role and text: no turn): faults, cost, audit and the digest of the repaired lines."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    end = F.rtrim("text", F.lit(BLANKS))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    dealt = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").withColumn("seen", seen)
    fault = F.when(F.col("role").isNull(), None).when(end == "", "b").when(F.col("seen") > 1, "d").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-")
    dealt = dealt.withColumn("fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen").drop("seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict[str, tuple[int, str]] = {}
        every = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True))
        out: list[tuple] = []
        for conv, turns in itertools.groupby(every, key=lambda r: r[0]):
            count, form, last, illegal = dict.fromkeys("bdt-", 0), [], None, 0
            least = most = before = None
            distinct = 0
            with tempfile.SpooledTemporaryFile(SPOOLED, "w+", encoding="utf-8", newline="") as held:
                for _, turn, role, text, fault in turns:
                    if fault is None:
                        continue
                    count[fault] += 1
                    initial = role[:1]
                    illegal += last is not None and last + initial not in ("su", "ua", "au")
                    last = initial
                    form.append((initial if initial and initial in "sua" else "?") + ("d" if fault == "b" else fault))
                    if turn is not None and (least is None or turn != before):
                        least = turn if least is None else least
                        most, before, distinct = turn, turn, distinct + 1
                    held.write(f"{len(role)} {len(text)}\n{role}{text}")
                held.seek(0)
                key = "".join(form)
                found = forms.get(key)
                if found is None:
                    found = cheapest(key)
                    if len(form) <= FORM_TURNS and len(forms) < FORMS:
                        forms[key] = found
                digest, first = hashlib.sha256(), True
                for line in repaired(found[1], _read(held)):
                    digest.update((line if first else "\n" + line).encode())
                    first = False
            gaps = 0 if least is None else most - least + 1 - distinct
            out.append((conv, gaps, count["b"], count["d"], count["t"], illegal, *found, digest.hexdigest()))
            if len(out) >= 1000:
                yield _rows(out)
        if out:
            yield _rows(out)

    def _read(held) -> Iterator[tuple[str, str]]:
        while head := held.readline():
            a, b = map(int, head.split())
            yield held.read(a), held.read(b)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
        out.clear()
        return batch

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(rows.schema["conv_id"].dataType), *[pa.int64()] * 6, pa.string(), pa.string()]
    return dealt.mapInArrow(released(run), schema)


def repair_rows(rows: DataFrame) -> DataFrame:
    """The fixed damage, found and repaired, of all conversations."""
    return repair(damaged(rows))


#: The same rows in plain SQL: CRC-32 by its table, and instead of a queue the best (cost, audit) of the four states after each turn.
REPAIR_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT)] || range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i) x) y),
named AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (
  SELECT n.*, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM named n, bits),
harmed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM kinds WHERE kind <> 0) z),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM harmed),
turns AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS near FROM turns),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE WHEN fault = 'b' THEN 1 END) AS blank,
    count(CASE WHEN fault = 'd' THEN 1 END) AS duplicate, count(CASE WHEN fault = 't' THEN 1 END) AS truncated,
    count(CASE WHEN near NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal,
    list(struct_pack(r := left(role, 1), f := fault, role := role, body := text) ORDER BY i) AS own FROM faults GROUP BY conv_id),
steps AS (
  SELECT conv_id, own, 0 AS i, {'c': 0, 'w': '', 'o': ''} AS s0, CAST(NULL AS STRUCT(c INTEGER, w VARCHAR, o VARCHAR)) AS s1,
    CAST(NULL AS STRUCT(c INTEGER, w VARCHAR, o VARCHAR)) AS s2, CAST(NULL AS STRUCT(c INTEGER, w VARCHAR, o VARCHAR)) AS s3 FROM counted
  UNION ALL
  SELECT conv_id, own, i + 1,
    CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + 4, 'w': s0.w || 'D', 'o': s0.o} END,
    list_sort(list_filter([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 4, 'w': s1.w || 'D', 'o': s1.o} END,
      CASE WHEN free AND t.r = 's' AND s0 IS NOT NULL THEN {'c': s0.c + more, 'w': s0.w || 'K', 'o': s0.o || line} END], lambda x: x IS NOT NULL))[1],
    list_sort(list_filter([CASE WHEN u IS NOT NULL THEN {'c': u.c + 4, 'w': u.w || 'D', 'o': u.o} END]
      || list_transform(list_filter([s0, s1, a], lambda x: free AND x IS NOT NULL), lambda x:
        {'c': x.c + more + CASE WHEN t.r = 'u' THEN 0 ELSE 3 END, 'w': x.w || CASE WHEN t.r = 'u' THEN 'K' ELSE 'R' END, 'o': x.o || CASE WHEN t.r = 'u' THEN line ELSE chr(10) || 'user:' || t.body END}), lambda x: x IS NOT NULL))[1],
    list_sort(list_filter([CASE WHEN a IS NOT NULL THEN {'c': a.c + 4, 'w': a.w || 'D', 'o': a.o} END]
      || list_transform(list_filter([u], lambda x: free AND x IS NOT NULL), lambda x:
        {'c': x.c + more + CASE WHEN t.r = 'a' THEN 0 ELSE 3 END, 'w': x.w || CASE WHEN t.r = 'a' THEN 'K' ELSE 'R' END, 'o': x.o || CASE WHEN t.r = 'a' THEN line ELSE chr(10) || 'assistant:' || t.body END}), lambda x: x IS NOT NULL))[1]
  FROM (
    SELECT *, own[i + 1] AS t, chr(10) || own[i + 1].role || ':' || own[i + 1].body AS line, own[i + 1].f IN ('-', 't') AS free,
      CASE WHEN own[i + 1].f = 't' THEN 3 ELSE 0 END AS more,
      list_sort(list_filter([s3, CASE WHEN u IS NOT NULL THEN {'c': u.c + 3, 'w': u.w || 'I', 'o': u.o || chr(10) || 'assistant:'} END], lambda x: x IS NOT NULL))[1] AS a
    FROM (SELECT *, list_sort(list_filter([s2] || list_transform(list_filter([s0, s1, s3], lambda x: x IS NOT NULL), lambda x: {'c': x.c + 3, 'w': x.w || 'I', 'o': x.o || chr(10) || 'user:'}), lambda x: x IS NOT NULL))[1] AS u FROM steps) p
    WHERE i < len(own)) q),
done AS (
  SELECT conv_id, list_sort(list_filter([s0, s3, CASE WHEN u IS NOT NULL THEN {'c': u.c + 3, 'w': u.w || 'I', 'o': u.o || chr(10) || 'assistant:'} END], lambda x: x IS NOT NULL))[1] AS best
  FROM (SELECT *, list_sort(list_filter([s2] || list_transform(list_filter([s0, s1, s3], lambda x: x IS NOT NULL), lambda x: {'c': x.c + 3, 'w': x.w || 'I', 'o': x.o || chr(10) || 'user:'}), lambda x: x IS NOT NULL))[1] AS u
    FROM steps WHERE i = len(own)) p)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.w, '') AS audit, sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counted ON k.conv_id IS NOT DISTINCT FROM counted.conv_id
LEFT JOIN done ON k.conv_id IS NOT DISTINCT FROM done.conv_id
"""
