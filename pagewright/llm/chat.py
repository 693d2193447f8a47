"""Chat formatting: schema fingerprints pick a declarative mapping to canonical turns, which a reversible template marks up.

The loss mask of a formatted conversation is a list of spans of code points: the escaped text of each assistant turn.

Native: built-in functions only. Every layout of a prompt, instruction or message record is described by the sorted list
of its nested field paths; the hash of the paths that a record fills is the fingerprint that selects its mapping. Record columns
that no layout claims are ignored, so extra columns and clashing names do no harm.

Edge cases: a null text or role counts as empty; a null turn sorts first; equal turns are ordered by role, then text, so
repeated rows all stay; a table without rows gives no rows. A turn of any length is one string; nothing is cut.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Canonical turns.
TURNS = "array<struct<role:string,text:string>>"

#: Layouts: field paths -> expression for the canonical turns ([] marks the elements of an array).
LAYOUTS = {
    ("messages[].content", "messages[].role"): "transform(messages, m -> struct(m.role as role, m.content as text))",
    ("conversations[].from", "conversations[].value"): "transform(conversations, m -> struct(case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, m.`value` as text))",
    ("prompt", "response"): "array(struct('user' as role, prompt as text), struct('assistant' as role, response as text))",
    ("completion", "prompt"): "array(struct('user' as role, prompt as text), struct('assistant' as role, completion as text))",
    ("instruction", "output"): "array(struct('user' as role, instruction as text), struct('assistant' as role, output as text))",
    ("input", "instruction", "output"): "array(struct('user' as role, concat_ws('\\n', instruction, nullif(input, '')) as text), struct('assistant' as role, output as text))",
    ("instruction", "output", "system"): "array(struct('system' as role, system as text), struct('user' as role, instruction as text), struct('assistant' as role, output as text))",
    ("turns[].role", "turns[].text"): "transform(turns, m -> struct(m.role as role, m.text as text))",
}

#: Escapes, in the order in which they are written; they are undone in the opposite order. None contains another's target.
ESCAPES = (("\\", "\\e"), ("#", "\\h"), ("<", "\\l"))
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"


def paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The paths of all leaves below a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(names) -> int:
    """60-bit hash of the sorted paths, the same on every platform."""
    return int(hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:15], 16)


def fingerprint_of(names: Column) -> Column:
    """fingerprint() of an array of paths."""
    return F.conv(F.substring(F.sha2(F.array_join(F.array_sort(names), "\n"), 256), 1, 15), 16, 10).cast("long")


#: What a fingerprint selects: the paths of its layout, and the expression for its turns.
MAPPINGS = {fingerprint(k): (k, v) for k, v in LAYOUTS.items()}


def _top(path: str) -> str:
    return path.split("[")[0].split(".")[0]


def filled(kind: T.StructType, inner) -> Column:
    """The paths that a row fills: of those that some mapping reads, the ones below its top-level fields that are not null."""
    claimed = {p for key, _ in MAPPINGS.values() for p in key}
    fields = {f.name: [p for p in paths(T.StructType([f])) if p in claimed] for f in kind.fields}
    lists = [F.when(inner(f).isNotNull(), F.array(*map(F.lit, own))).otherwise(F.array().cast("array<string>")) for f, own in fields.items() if own]
    return F.flatten(F.array(*lists)) if lists else F.array().cast("array<string>")


def canonical(df: DataFrame, record: str | None = None) -> DataFrame:
    """df plus schema_fp and turns: each row's record (a struct column, or df's own columns) in canonical turns.

    A record may mix layouts: its columns are the union of all layouts that occur, and a row fills those of its own. The
    fingerprint of the paths that a row fills, among the fields that mappings read, selects its mapping. Rows whose fingerprint
    selects none keep it, and get null turns: their layout is not known, or they fill fields of several.
    """
    kind = df.schema[record].dataType if record else df.schema
    have = set(paths(kind))
    inner = (lambda name: F.col(record)[name]) if record else F.col
    known = {fp: (key, turns) for fp, (key, turns) in MAPPINGS.items() if set(key) <= have}
    tops = sorted({_top(p) for key, _ in known.values() for p in key})
    work = df.withColumns({"__fp": fingerprint_of(filled(kind, inner)), **{f"__{t}": inner(t) for t in tops}})
    turns = F.lit(None).cast(TURNS)
    for fp, (key, expression) in known.items():
        for t in sorted({_top(p) for p in key}):
            expression = _renamed(expression, t)
        turns = F.when(F.col("__fp") == fp, F.expr(expression).cast(TURNS)).otherwise(turns)
    return work.select(*df.columns, F.col("__fp").alias("schema_fp"), turns.alias("turns"))


def _renamed(expression: str, name: str) -> str:
    import re

    return re.sub(rf"(?<![\w.`'])({name})(?![\w'`(])(?!\s+as\b\s+role)", rf"`__{name}`", expression)


def escaped(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escaped(F.coalesce(turn["role"], F.lit(""))), F.lit(":"), F.lit("\\c")), F.lit(BETWEEN))


def _body(turn: Column) -> Column:
    return escaped(F.coalesce(turn["text"], F.lit("")))


def formatted(turns: Column) -> Column:
    """The template: '### role: text</turn>' and a line end for each turn, with control strings inside role and text escaped."""
    return F.array_join(F.transform(turns, lambda x: F.concat(_header(x), _body(x), F.lit(CLOSE))), "")


def loss_spans(turns: Column) -> Column:
    """The loss mask over the formatted text: (first code point, code points) of each assistant turn's escaped text."""
    size = lambda c: F.length(c).cast("long")

    def step(done, turn):
        start = done["at"] + size(_header(turn))
        span = F.array(F.struct(start.alias("start"), size(_body(turn)).alias("n")))
        spans = F.when(turn["role"] == "assistant", F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct((start + size(_body(turn)) + len(CLOSE)).alias("at"), spans.alias("spans"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,n:bigint>>").alias("spans"))
    return F.aggregate(turns, begin, step)["spans"]


def masked(text: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, s["start"].cast("int") + 1, s["n"].cast("int")))), "")


def parsed(text: Column) -> Column:
    """The canonical turns, read back from a formatted conversation."""
    pieces = F.filter(F.split(text, F.lit("</turn>\n")), lambda p: p != "")
    at = lambda p: F.instr(p, BETWEEN)
    role = lambda p: F.replace(F.substr(p, F.lit(len(OPEN) + 1), at(p) - F.lit(len(OPEN) + 1)), F.lit("\\c"), F.lit(":"))
    return F.transform(pieces, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(F.substr(p, at(p) + F.lit(len(BETWEEN)))).alias("text")))


def format_chats(df: DataFrame, record: str | None = None) -> DataFrame:
    """df plus schema_fp, turns, formatted and loss_spans."""
    return canonical(df, record).withColumns({"formatted": formatted(F.col("turns")), "loss_spans": loss_spans(F.col("turns"))})


#: The conversation that the query adds: its texts hold the template's own control strings.
PROBE = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation: counts and digests of what is read back from the formatted text and cut out by the mask.

    The table's conversations are message lists, of one layout or another by their number; conversation -7 is a prompt with its response.
    """
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    message = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    even = F.coalesce(F.col("conv_id") % 2 == 0, F.lit(True))
    layout = {
        "messages": F.when(even, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))),
        "turns": F.when(~even, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))),
    }
    text = lambda c: F.lit(c).cast("string")
    chats = lists.select("conv_id", F.struct(*(c.alias(n) for n, c in layout.items()), text(None).alias("prompt"), text(None).alias("response")).alias("record"))
    none = [F.lit(None).cast(chats.schema["record"].dataType[n].dataType).alias(n) for n in layout]
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.struct(*none, text(PROBE).alias("prompt"), text(PROBE).alias("response")).alias("record"))
    chats = chats.unionByName(probe)
    out = format_chats(chats, "record").select("conv_id", "schema_fp", "formatted", parsed(F.col("formatted")).alias("back"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    out = out.withColumn("said", said)
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "schema_fp",
    )


ORACLE = {
    "op5_chat_format": f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, length(role) + length(text) + 15 + 1
  + (length(role) - length(replace(role, '\\', ''))) + (length(role) - length(replace(role, '#', ''))) + (length(role) - length(replace(role, '<', ''))) + (length(role) - length(replace(role, ':', '')))
  + (length(text) - length(replace(text, '\\', ''))) + (length(text) - length(replace(text, '#', ''))) + (length(text) - length(replace(text, '<', ''))) - 2 AS n FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  CASE conv_id WHEN -7 THEN {fingerprint(("prompt", "response"))} ELSE CASE WHEN coalesce(conv_id % 2 = 0, true) THEN {fingerprint(("messages[].content", "messages[].role"))} ELSE {fingerprint(("turns[].role", "turns[].text"))} END END AS schema_fp
FROM e GROUP BY conv_id""",
}
QUERIES = {"op5_chat_format": op5_chat_format}
