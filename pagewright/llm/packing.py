"""Best-fit packing with certified bounds: documents as token pieces, in as few sequences of a fixed length as can be found.

Pieces are dealt at random to partitions of about DEAL pieces, and each partition packs its own by best-fit decreasing. Dual
feasible functions give a lower bound of its sequences: an exact fraction, so that the bounds of partitions can be held against
the bound of the whole. A partition whose count is that bound is certified and final. One with a gap lets go the documents of
its loosest sequences, about twice the gap's room; the released documents of all partitions are dealt anew, to as few partitions
as they fill, and best-fit decreasing runs again. That ends when the number of all sequences is the rounded-up bound of all
lengths, when no partition has a gap, or when a round saves nothing; a round that saves nothing is taken back.

Only lengths decide: the driver learns the histogram of lengths (as many rows as a sequence has places) and counts. A task holds
the numbers of its pieces, never their texts.

Edge cases: a null text is empty, and an empty document is its end mark alone. Rows with equal or null doc_id are documents of
their own. A text of any length is one value; it is cut from the end, so its first piece may be shorter. An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpeids
from .common import bounded, cut, drop, lean, table

#: Tokens of a sequence, and the id that ends each document.
ROOM, END = 2048, 0
#: Pieces that a partition packs, about.
DEAL = 1 << 16
#: Rounds of packing at most; each but the first handles what the one before released.
ROUNDS = 8
#: Released room, in gaps.
RELEASED = 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("released", pa.bool_())])


def token_pieces(docs: DataFrame, room: int = ROOM, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document (doc_id, text)."""

    def run(batches):
        ids = bpeids.loaded(path)
        end = END.to_bytes(4, "little")
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = memoryview(ids.encode([text])[0] + end if text else end)
                n = len(data) // 4
                cuts = [0, *range(n % room or room, n + 1, room)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, v in zip(rows, (doc, k, a, z - a, zlib.crc32(data[4 * a : 4 * z])), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _PIECES)


def lower_bound(counts: np.ndarray) -> Fraction:
    """The largest lower bound of the sequences for counts[x] pieces of length x (x up to the room), over three families of dual
    feasible functions: lengths with small pieces left out and large ones rounded up, lengths rounded to k-ths, and lengths
    counted by how many small pieces fit beside them. Exact; bounds of parts add up to a bound of the whole."""
    room = len(counts) - 1
    counts = counts.astype(object)
    x = np.arange(room + 1)
    many, mass = np.cumsum(counts), np.cumsum(counts * x)
    best = Fraction(int(mass[-1]), room)
    for e in range(1, room // 2 + 1):
        large = int(many[-1] - many[room - e])
        best = max(best, large + Fraction(int(mass[room - e] - mass[e - 1]), room))
    here = np.flatnonzero(counts != 0)
    n = counts[here]
    for k in range(1, 65):
        exact = here * (k + 1) % room == 0
        best = max(best, Fraction(int((n * np.where(exact, here * k, here * (k + 1) // room * room)).sum()), room * k))
    for e in range(1, room // 2 + 1):
        fit = room // e
        value = np.where(2 * here > room, fit - (room - here) // e, np.where(here >= e, 1, 0))
        best = max(best, Fraction(int((n * value).sum()), fit))
    return best


def best_fit(lengths: list[int], room: int = ROOM) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing of lengths in falling order: the bin and the offset of each, and what is left free in each bin."""
    bins: list[int] = []
    offsets: list[int] = []
    free: list[int] = []
    of: list[list[int]] = [[] for _ in range(room + 1)]
    have = 0  # bit r: there is a bin with r places free
    for n in lengths:
        fits = have >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = of[r].pop()
            if not of[r]:
                have &= ~(1 << r)
        else:
            r, b = room, len(free)
            free.append(room)
        bins.append(b)
        offsets.append(room - r)
        free[b] = left = r - n
        if left:
            of[left].append(b)
            have |= 1 << left
    return bins, offsets, free


def released(lengths: np.ndarray, free: np.ndarray, room: int = ROOM) -> np.ndarray:
    """Which bins a partition lets go: none if its bound certifies their number, else the loosest ones."""
    gap = len(free) - lower_bound(np.bincount(lengths, minlength=room + 1))
    out = np.zeros(len(free), bool)
    if gap > 0:
        order = np.argsort(-free, kind="stable")
        enough = int(np.searchsorted(np.cumsum(free[order]), float(RELEASED * gap * room))) + 1
        out[order[:enough]] = free[order[:enough]] > 0
    return out


def _packed(room: int, turn: int):
    def run(batches):
        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("uid", "ascending")]))
        lengths = rows.column("length").to_numpy()
        bins, offsets, free = best_fit(lengths.tolist(), room)
        bins = np.array(bins)
        gone = released(lengths, np.array(free), room)[bins]
        first = turn << 56 | TaskContext.get().partitionId() << 28
        out = [rows.column(c).combine_chunks() for c in _PACKED.names[:6]]
        out += [pa.array(bins + first), pa.array(offsets, pa.int64()), pa.array(gone)]
        yield from pa.Table.from_arrays(out, schema=_PACKED).to_batches(max_chunksize=1 << 14)

    return run


def pack(pieces: DataFrame, room: int = ROOM, deal: int = DEAL) -> DataFrame:
    """pieces plus sequence_id and offset. pieces: doc_id, piece, start, length (1 to room), ids_crc32."""
    pieces = cut(pieces.withColumn("uid", F.monotonically_increasing_id()))
    counts = np.zeros(room + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # as many rows as a sequence has places at most
        counts[r["length"]] = r["n"]
    full, least = int(counts[room]), -(-lower_bound(counts) // 1)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = [pieces.where(F.col("length") == room).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, n, closed = pieces.where(F.col("length") < room), int(counts.sum()) - full, full
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select("uid", *columns).schema) + ", sequence_id long, offset long, released boolean"
    last = None
    for turn in range(ROUNDS):
        dealt = rest.select("uid", *columns).repartition(n // deal + 1, F.xxhash64("uid", F.lit(turn)))
        now = cut(dealt.mapInArrow(lean(_packed(room, turn)), kind))
        found = {r["released"]: r for r in now.groupBy("released").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).collect()}
        bins = {k: found[k]["bins"] if k in found else 0 for k in (True, False)}
        if last is not None and bins[True] + bins[False] >= last:
            done.append(rest.select(*columns, "sequence_id", "offset"))  # nothing saved: the packing before stands
            drop(now)
            break
        done.append(now.where(~F.col("released")).select(*columns, "sequence_id", "offset"))
        closed, last = closed + bins[False], bins[True]
        rest, n = now.where("released"), found[True]["n"] if True in found else 0
        if not n or closed + last <= least or turn == ROUNDS - 1:
            done.append(rest.select(*columns, "sequence_id", "offset"))
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, packed into sequences of 2048."""
    return pack(token_pieces(table(spark, sf_dir, "documents", "doc_id", "text")))


#: SQL can't encode texts; tests/llm holds pieces against the tokenizers library and packings against brute force.
ORACLE: dict[str, str] = {}
QUERIES = {"op11_best_fit": op11_best_fit}
