"""Conversation structure repair: the cheapest edits that give each conversation a legal order of roles.

Roles, by their initials, must read (s?(ua)+)?: perhaps a system turn, then user and assistant in pairs, or nothing. Keeping a turn
costs nothing, giving it another role 3, deleting it 4, inserting an empty user or assistant turn 3; a truncated turn that stays
costs 3 more, and blank and duplicate turns must go. The audit is the initials of the edits in order (K, R, D, I); of equally cheap
ones the least in ASCII order is taken, which fixes the roles of the repaired turns too.

Conversations are dealt by the hash of their id and stand in order within a partition. Each batch of BATCH turns goes through one
recursive DuckDB query: every recursion advances all conversations of the batch by one turn and keeps, for each state of the
grammar, the least cost and its least audit. Only flags and initials reach DuckDB. A conversation longer than the batch is
continued: the states of its last turn are where the next batch begins. Two audits of equal cost for the same turns and state are
never prefixes of each other, so the least audit of the whole is the least one extended.

A conversation is one row of the result, so its turns are held by one task; there is no other limit. Audits are strings that grow
turn by turn: a conversation of n turns costs about n * n bytes of copying.

Edge cases: null roles and texts read as one space; null turns come first; equal turns are ordered by role and text; repeated rows
are duplicates. A null conv_id is a conversation of its own. Rows marked as gone count for nothing, but their conversation stays in
the result: without other rows it has zeros and no turns. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, lean, table
from .crcsql import crc_sql

#: Turns that DuckDB works on at once, and its memory.
BATCH, MEMORY = 8192, "256MB"
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: State -> initial -> state. E: nothing yet; S, U, A: after a turn with that initial. E and A may be the end.
GRAMMAR = {"E": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def inserted(state: str) -> dict[str, int]:
    """The states that insertions alone can lead to, with the number of insertions."""
    out, now = {state: 0}, state
    while (after := GRAMMAR[now].get("u") or GRAMMAR[now].get("a")) not in out:
        out[after] = out[now] + 1
        now = after
    return out


def edges() -> list[tuple[str, str, str, str, int]]:
    """(state, letters, needed initial or '', state after, cost): some insertions, then one edit of the next turn."""
    out = []
    for state in GRAMMAR:
        for between, n in inserted(state).items():
            at = ("I" * n, INSERT * n)
            out.append((state, at[0] + "D", "", between, at[1] + DELETE))
            for initial, after in GRAMMAR[between].items():
                out.append((state, at[0] + "K", initial, after, at[1]))
                if initial != "s":
                    out.append((state, at[0] + "R", "", after, at[1] + REROLE))
    return out


def ends() -> list[tuple[str, str, int]]:
    """(state, letters, cost): the insertions that end a conversation legally."""
    return [(state, "I" * n, INSERT * n) for state in GRAMMAR for last, n in inserted(state).items() if last in "EA"]


def _values(rows: list[tuple]) -> str:
    return ", ".join(str(r) for r in rows)


#: flags: c, pos, initial, dead, truncated; frontier: c, pos, state, cost, audit. One step takes every conversation to its next turn.
STEPS = f"""
WITH RECURSIVE edges(state, letters, initial, after, cost) AS MATERIALIZED (VALUES {_values(edges())}),
walk(c, state, pos, cost, audit) USING KEY (c, state) AS (
  SELECT c, state, pos, cost, audit FROM frontier
  UNION
  SELECT c, after, pos, best.cost, best.audit FROM (
    SELECT w.c, e.after, w.pos + 1 AS pos,
      min({{'cost': w.cost + e.cost + CASE WHEN f.truncated AND NOT suffix(e.letters, 'D') THEN {TRUNCATED} ELSE 0 END, 'audit': w.audit || e.letters}}) AS best
    FROM walk AS w JOIN flags AS f ON f.c = w.c AND f.pos = w.pos + 1 JOIN edges AS e ON e.state = w.state
    WHERE suffix(e.letters, 'D') OR NOT f.dead AND (e.initial = '' OR e.initial = f.initial)
    GROUP BY w.c, e.after, w.pos)
)
SELECT c, pos, state, cost, audit FROM walk WHERE pos = (SELECT max(w.pos) FROM walk AS w WHERE w.c = walk.c)"""
FINISHED = f"""
WITH ends(state, letters, cost) AS (VALUES {_values(ends())})
SELECT c, best.cost, best.audit FROM (
  SELECT r.c, min({{'cost': r.cost + e.cost, 'audit': r.audit || e.letters}}) AS best FROM reached AS r JOIN ends AS e USING (state) GROUP BY r.c)
ORDER BY c"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with planted faults: the CRC-32 of conv_id:turn decides. Dropped rows stay, marked as gone."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), n.alias("n"))
    return out.select(
        "conv_id",
        "turn",
        F.when(F.col("n") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("n") == 0).alias("gone"),
        F.explode(F.when(F.col("n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) dealt and ordered by conversation, with each turn's first fault and its place.

    fault: blank, duplicate, truncated or null; initial: of the role; illegal: not allowed after the turn before; fresh: the first
    turn with its number.
    """
    rows = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    group, order = [F.col("conv_id"), F.col("gone")], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    said = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    along = Window.partitionBy(*group).orderBy(*order)
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag("initial").over(along), F.col("initial"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault: Column = F.when(last == "", "blank").when(F.col("again") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    out = rows.repartition("conv_id").withColumns({"initial": initial, "again": F.row_number().over(said)})
    before = F.lag("turn").over(along)
    out = out.withColumns({"fault": fault, "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)), "fresh": F.col("turn").isNotNull() & (before.isNull() | (before != F.col("turn")))})
    out = out.select("conv_id", "gone", "turn", "role", "text", "initial", "fault", "illegal", "fresh")
    return out.sortWithinPartitions(*group, *order)


class _Repairs:
    """The conversations of one partition, as they come by."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self.frontier: dict[int, list[tuple]] = {}
        self.open: dict[int, dict] = {}
        self.pending: list[tuple] = []
        self.last, self.n = object(), 0

    def add(self, b: pa.RecordBatch):
        """Takes rows in; gives the conversations that are settled now."""
        names = ("conv_id", "gone", "turn", "role", "text", "initial", "fault", "illegal", "fresh")
        for conv, gone, turn, role, text, initial, fault, illegal, fresh in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            if conv != self.last:
                if len(self.pending) >= BATCH:
                    yield from self.settle(True)
                self.last, self.n = conv, self.n + 1
                self.open[self.n] = {"conv_id": conv, "turns": [], "fresh": 0, "illegal": 0, "least": None, "most": None, "blank": 0, "duplicate": 0, "truncated": 0}
                self.frontier[self.n] = [(self.n, 0, "E", 0, "")]
            if gone:
                continue
            if len(self.pending) >= 2 * BATCH:
                yield from self.settle(False)
            one = self.open[self.n]
            one["turns"].append((role, text))
            one["fresh"] += fresh
            one["illegal"] += illegal
            if fault:
                one[fault] += 1
            if turn is not None:
                one["least"] = turn if one["least"] is None else one["least"]
                one["most"] = turn
            self.pending.append((self.n, len(one["turns"]), initial, fault in ("blank", "duplicate"), fault == "truncated"))

    def settle(self, whole: bool):
        """Advance all conversations to the last turn that is here; unless whole, the last conversation goes on."""
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        flags = pa.table([pa.array(c, k) for c, k in zip(zip(*self.pending, strict=True) if self.pending else [()] * 5, kinds, strict=True)], names=["c", "pos", "initial", "dead", "truncated"])
        starts = [x for own in self.frontier.values() for x in own]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        frontier = pa.table([pa.array(c, k) for c, k in zip(zip(*starts, strict=True) if starts else [()] * 5, kinds, strict=True)], names=["c", "pos", "state", "cost", "audit"])
        self.db.register("flags", flags)
        self.db.register("frontier", frontier)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE reached AS {STEPS}")
        self.pending, self.frontier = [], {}
        if not whole:
            self.frontier[self.n] = self.db.execute("SELECT c, pos, state, cost, audit FROM reached WHERE c = ?", [self.n]).fetchall()
            self.db.execute("DELETE FROM reached WHERE c = ?", [self.n])
        out = [self._row(self.open.pop(c), cost, audit) for c, cost, audit in self.db.execute(FINISHED).fetchall()]
        if out:
            yield out

    @staticmethod
    def _row(one: dict, cost: int, audit: str) -> tuple:
        gaps = 0 if one["least"] is None else one["most"] - one["least"] + 1 - one["fresh"]
        return (one["conv_id"], gaps, one["blank"], one["duplicate"], one["truncated"], one["illegal"], cost, audit, repaired(one["turns"], audit))


def repaired(turns: list[tuple[str, str]], audit: str) -> list[dict]:
    """The turns after the edits of an audit."""
    out: list[dict] = []
    left, state = iter(turns), "E"
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter == "K":
            state = GRAMMAR[state][role[0]]
        else:
            role = "user" if "u" in GRAMMAR[state] else "assistant"
            state = GRAMMAR[state][role[0]]
        out.append({"role": role, "text": text})
    return out


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of rows (conv_id, turn, role, text, gone): its faults, the cost, the audit and the repaired turns."""

    def run(batches):
        work = _Repairs()
        schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
        for b in batches:
            for done in work.add(b):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        for done in work.settle(True):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return flagged(bounded(rows)).mapInArrow(lean(run), _RESULT)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return repair(damaged(rows)).withColumn("repaired_sha256", F.sha2(said, 256)).drop("repaired")


_BLANK = r"[^\x20\x09-\x0D]"
ORACLE = {
    "op12_repair": f"""
WITH RECURSIVE {crc_sql("k", "SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS t FROM conversations")},
r AS (
  SELECT conv_id, turn, CASE WHEN c % 20 = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE c % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN c % 20 = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM conversations JOIN k ON k.t = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') WHERE c % 20 <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    left(role, 1) AS i, regexp_extract(text, '({_BLANK})[\\x20\\x09-\\x0D]*\\z', 1) AS z FROM r),
f AS MATERIALIZED (
  SELECT conv_id, pos, turn, role, text, i, CASE WHEN z = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM o),
g(a, i, b) AS (VALUES ('E', 's', 'S'), ('E', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'), ('A', 'u', 'U')),
ins(a, b, w) AS (VALUES ('E', 'E', ''), ('E', 'U', 'I'), ('E', 'A', 'II'), ('S', 'S', ''), ('S', 'U', 'I'), ('S', 'A', 'II'), ('U', 'U', ''), ('U', 'A', 'I'), ('A', 'A', ''), ('A', 'U', 'I')),
w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 'E' AS state, 0 AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, state, best.cost, best.audit FROM (
    SELECT conv_id, pos, state, min({{'cost': cost, 'audit': audit}}) AS best FROM (
      SELECT w.conv_id, f.pos, s.b AS state, w.cost + 3 * length(ins.w) + s.cost AS cost, w.audit || ins.w || s.letter AS audit
      FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN ins ON ins.a = w.state,
      LATERAL (
        SELECT ins.b AS b, 4 AS cost, 'D' AS letter
        UNION ALL SELECT g.b, CASE f.fault WHEN 't' THEN 3 ELSE 0 END, 'K' FROM g WHERE g.a = ins.b AND g.i = f.i AND f.fault NOT IN ('b', 'd')
        UNION ALL SELECT g.b, CASE f.fault WHEN 't' THEN 6 ELSE 3 END, 'R' FROM g WHERE g.a = ins.b AND g.i <> 's' AND f.fault NOT IN ('b', 'd')) AS s)
    GROUP BY conv_id, pos, state)),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
d AS (SELECT w.conv_id, min({{'cost': w.cost + 3 * length(ins.w), 'audit': w.audit || ins.w}}) AS best FROM w LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id
  JOIN ins ON ins.a = w.state AND ins.b IN ('E', 'A') WHERE w.pos = coalesce(n.n, 0) GROUP BY w.conv_id),
e AS (SELECT conv_id, unnest(range(1, length(best.audit) + 1)) AS nth, best.audit AS audit FROM d),
p AS (SELECT conv_id, nth, audit[nth] AS letter, count(*) FILTER (audit[nth] <> 'I') OVER v AS pos, count(*) FILTER (audit[nth] <> 'D') OVER v AS place FROM e WINDOW v AS (PARTITION BY conv_id ORDER BY nth)),
q AS (SELECT p.*, f.role, f.text, coalesce(bool_or(p.letter = 'K' AND f.i = 's') OVER (PARTITION BY p.conv_id), false) AS led FROM p LEFT JOIN f ON p.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos),
t AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY nth) AS said
  FROM q WHERE letter <> 'D' GROUP BY conv_id)
SELECT d.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  CAST(d.best.cost AS BIGINT) AS cost, d.best.audit AS audit, sha256(coalesce(t.said, '')) AS repaired_sha256
FROM d LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM d.conv_id""",
}
QUERIES = {"op12_repair": op12_repair}
