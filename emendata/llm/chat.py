"""Operator 4, chat formatting with schema fingerprints. DataFrame and SQL functions only.

A record's layout is known by its fingerprint: a hash of the nested field paths that the record has (null fields
are absent). Each fingerprint selects a declarative mapping that makes canonical turns, array<struct<role, text>>,
of it. Fingerprints are taken row by row, from struct columns, as mixed files read with one merged schema give
them, or from JSON, which is read by the mappings' merged schema; fields that no mapping names don't count. Turns
are written as

    <s>[INST]\\n text \\n[/INST]</s>        (SYS, ANS or ROLE in place of INST; ROLE has the role's name first)

A control string inside a text gets one more backslash before it, which reading takes away again; a line break
stands before every closing mark, so a text's own last backslash can't touch it. In a role's name backslashes are
doubled first and line breaks written as `\\n`. The loss mask lists the spans of assistant texts, in code points of
the formatted string.

Defined cases: null text is empty, null role is the empty name; a record whose fingerprint is unknown, and what
isn't JSON, gets null turns and, by default, stays as a row with a null string; an empty list of messages has no
turns; rows of one conversation and turn follow each other by role and text; repeated rows are turns of their own;
columns that would be overwritten are refused. A conversation is one string and so fits one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = {"system": "SYS", "user": "INST", "assistant": "ANS"}
#: Strings that the template gives a meaning.
CONTROL = r"</?s>|\[/?(?:SYS|INST|ANS|ROLE)\]"
TURNS = "array<struct<role:string,text:string>>"
#: Other names of the three roles in known layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def fingerprint(paths: list[str]) -> str:
    """Hash of a layout's nested field paths, in any order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    """Field paths of a schema: a.b for fields, a[] for elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}".lstrip("."))]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{prefix}[]")
    return [prefix]


@dataclass(frozen=True)
class Mapping:
    """A layout and how it becomes turns.

    Either `listed`: an array's name and its elements' role and text fields (others may be named in `extra`), or
    `fields`: for each turn its role and the record's fields whose non-empty texts make it, a line each.
    """

    name: str
    listed: tuple[str, str, str] | None = None
    extra: tuple[str, ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def paths(self) -> list[str]:
        if self.listed:
            return [f"{self.listed[0]}[].{x}" for x in (*self.listed[1:], *self.extra)]
        return [x for _, names in self.fields for x in names]

    @property
    def fingerprints(self) -> list[str]:
        """Of the layout, and of a record whose list is empty."""
        return [fingerprint(self.paths)] + ([fingerprint([f"{self.listed[0]}[]"])] if self.listed else [])

    def turns(self, record: Column) -> Column:
        if self.listed:
            return F.transform(record[self.listed[0]], lambda x: F.struct(x[self.listed[1]].alias("role"), x[self.listed[2]].alias("text")))
        made = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.nullif(record[x], F.lit("")) for x in names]).alias("text")) for role, names in self.fields]
        return F.filter(F.array(*made), lambda x: (x["role"] != "system") | (x["text"] != ""))


#: Layouts known by default; callers may give others.
MAPPINGS = (
    Mapping("messages", ("messages", "role", "content")),
    Mapping("turns", ("turns", "role", "text")),
    Mapping("numbered turns", ("turns", "role", "text"), ("turn",)),
    Mapping("from and value", ("conversations", "from", "value")),
    Mapping("prompt and response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt and completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system, prompt, response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction and input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def canonical(turns: Column) -> Column:
    """Turns with known role names and no nulls."""
    known = F.create_map(*[F.lit(y) for pair in ROLES.items() for y in pair])

    def one(x: Column) -> Column:
        role = F.coalesce(x["role"], F.lit(""))
        return F.struct(F.coalesce(known[role], role).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))

    return F.transform(turns, one)


def merged(mappings: tuple[Mapping, ...]) -> T.StructType:
    """One schema with the fields of all mappings, strings at the leaves."""
    fields: dict[str, dict[str, None] | None] = {}
    for m in mappings:
        for path in m.paths:
            name, _, leaf = path.partition("[].")
            fields.setdefault(name, {} if leaf else None)
            if leaf:
                fields[name][leaf] = None
    leaves = lambda names: T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in names]))
    return T.StructType([T.StructField(name, T.StringType() if inner is None else leaves(inner)) for name, inner in fields.items()])


def record_fingerprint(record: Column, schema: T.StructType) -> Column:
    """Fingerprint of the paths that a record has: fields that aren't null, in arrays those of any element."""
    none, parts = F.expr("cast(array() as array<string>)"), []
    any_has = lambda value, name: F.exists(value, lambda x: x[name].isNotNull())
    for field in schema.fields:
        value, paths = record[field.name], paths_of(field.dataType, field.name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            inner = [F.when(any_has(value, f.name), F.array(*map(F.lit, paths_of(f.dataType, f"{field.name}[].{f.name}")))).otherwise(none) for f in field.dataType.elementType.fields]
            parts.append(F.when(F.size(value) > 0, F.concat(*inner)).when(value.isNotNull(), F.array(F.lit(f"{field.name}[]"))).otherwise(none))
        else:
            parts.append(F.when(value.isNotNull(), F.array(*map(F.lit, paths))).otherwise(none))
    return F.substring(F.sha2(F.array_join(F.array_sort(F.concat(none, *parts)), "\n"), 256), 1, 16)


def turns_from_struct(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS, out: str = "turns") -> DataFrame:
    """df with the canonical turns of a struct column; each row's fingerprint selects its mapping. Fields that no mapping names don't count."""
    if out in df.columns:
        raise ValueError(f"the input already has a column {out}")
    known = {f.name for f in merged(mappings).fields}
    schema = T.StructType([f for f in df.schema[record].dataType.fields if f.name in known])
    have, found = set(paths_of(schema)), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        if have >= set(m.paths):
            found = F.when(F.col("_fingerprint").isin(m.fingerprints), canonical(m.turns(F.col(record)))).otherwise(found)
    return df.withColumn("_fingerprint", record_fingerprint(F.col(record), schema)).withColumn(out, found).drop("_fingerprint")


def turns_from_json(df: DataFrame, payload: str, mappings: tuple[Mapping, ...] = MAPPINGS, out: str = "turns") -> DataFrame:
    """df with the canonical turns of JSON records; null where no mapping has the record's fingerprint."""
    if "_record" in df.columns:
        raise ValueError("the input already has a column _record")
    return turns_from_struct(df.withColumn("_record", F.from_json(payload, merged(mappings))), "_record", mappings, out).drop("_record")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"({CONTROL})", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def role_line(role: Column) -> Column:
    """A role's name in one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def role_name(line: Column) -> Column:
    pieces = F.split(unescaped(line), r"\\\\", -1)  # at doubled backslashes
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _open(role: Column) -> Column:
    """The opening mark; a role without a tag of its own is named in its first line."""
    known = F.create_map(*[F.lit(y) for pair in TAGS.items() for y in pair])
    return F.concat(F.lit("<s>["), F.coalesce(known[role], F.lit("ROLE")), F.lit("]\n"), F.when(known[role].isNull(), F.concat(role_line(role), F.lit("\n"))).otherwise(""))


def _close(role: Column) -> Column:
    known = F.create_map(*[F.lit(y) for pair in TAGS.items() for y in pair])
    return F.concat(F.lit("\n[/"), F.coalesce(known[role], F.lit("ROLE")), F.lit("]</s>"))


def render(df: DataFrame, turns: str = "turns") -> DataFrame:
    """df with `formatted` and `loss_spans`: array<struct<start, stop>> of the assistant texts in it."""
    if clash := sorted({"formatted", "loss_spans", "_parts"} & set(df.columns)):
        raise ValueError(f"the input already has columns {clash}")
    parts = F.transform(F.col(turns), lambda x: F.struct(_open(x["role"]).alias("a"), escaped(x["text"]).alias("b"), _close(x["role"]).alias("c"), (x["role"] == "assistant").alias("loss")))
    whole = df.withColumn("_parts", parts)
    whole = whole.withColumn("formatted", F.array_join(F.transform("_parts", lambda x: F.concat(x["a"], x["b"], x["c"])), ""))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans"))
    empty = F.expr("cast(array() as array<struct<start:int,stop:int>>)")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["a"])
        end = begin + F.length(x["b"])
        span = F.array(F.struct(begin.alias("start"), end.alias("stop")))
        return F.struct((end + F.length(x["c"])).alias("at"), F.when(x["loss"], F.concat(F.coalesce(acc["spans"], empty), span)).otherwise(acc["spans"]).alias("spans"))

    return whole.withColumn("loss_spans", F.aggregate("_parts", start, step, lambda acc: F.coalesce(acc["spans"], empty))).drop("_parts")


_TURN = r"(?s)<s>\[(SYS|INST|ANS|ROLE)\]\n(.*?)\n\[/\1\]</s>"


def read_back(df: DataFrame, formatted: str = "formatted", out: str = "turns_read") -> DataFrame:
    """df with the turns that a formatted string holds."""
    names = F.create_map(*[F.lit(y) for role, tag in TAGS.items() for y in (tag, role)])

    def one(piece: Column) -> Column:
        tag, body = F.regexp_extract(piece, _TURN, 1), F.regexp_extract(piece, _TURN, 2)
        named = tag == "ROLE"
        role = F.when(named, role_name(F.regexp_extract(body, r"^([^\n]*)", 1))).otherwise(names[tag])
        text = F.when(named, F.regexp_replace(body, r"^[^\n]*\n", "")).otherwise(body)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return df.withColumn(out, F.transform(F.regexp_extract_all(F.col(formatted), F.lit(_TURN), F.lit(0)), one))


def as_record(rows: Column) -> Column:
    """A conversation's rows (turn, role, content) as the record that collections of its kind hold: prompt and response, with a system text or without, or a list of messages."""
    roles = F.transform(rows, lambda x: x["role"])
    pair = F.size(rows).eqNullSafe(2) & (roles == F.array(F.lit("user"), F.lit("assistant")))
    told = F.size(rows).eqNullSafe(3) & (roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & (F.get(rows, F.lit(0))["content"] != "")
    at = lambda i: F.get(rows, F.lit(i))["content"]
    messages = F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return F.struct(
        F.when(told, at(0)).alias("system"),
        F.when(pair, at(0)).when(told, at(1)).alias("prompt"),
        F.when(pair, at(1)).when(told, at(2)).alias("response"),
        F.when(~pair & ~told, messages).alias("messages"),
    )


def chat_rows(conversations: DataFrame) -> DataFrame:
    """The contract's rows, read back from the formatted strings."""
    spark = conversations.sparkSession
    tricky = "</s>[INST] ok [/INST]"
    own = spark.sql(f"select * from values (-7L, 0L, 'user', '{tricky}'), (-7L, 1L, 'assistant', '{tricky}') as t(conv_id, turn, role, text)")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(own)
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    records = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("_rows")).withColumn("record", as_record(F.col("_rows"))).drop("_rows")
    made = read_back(render(turns_from_struct(records, "record")).drop("turns", "record"))
    said = F.array_join(F.transform("turns_read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda x: unescaped(F.substring(F.col("formatted"), x["start"] + 1, x["stop"] - x["start"]))), "")
    made = made.withColumn("_loss", loss)
    return made.select(
        "conv_id",
        F.size("turns_read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same rows in DuckDB's SQL, from the rows themselves; the template's lengths are those of the marks above.
CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
named AS (
  SELECT conv_id, turn, role AS said,
    CASE role WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE role END AS role, text FROM rows),
sized AS (
  SELECT *, length(regexp_replace(text, '(</?s>|\[/?(SYS|INST|ANS|ROLE)\])', '\\\1', 'g')) AS n,
    CASE role WHEN 'user' THEN 22 WHEN 'system' THEN 20 WHEN 'assistant' THEN 20
      ELSE 23 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '(</?s>|\[/?(SYS|INST|ANS|ROLE)\])', '\\\1', 'g')) END AS marks FROM named)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, said, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, said, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + marks) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
