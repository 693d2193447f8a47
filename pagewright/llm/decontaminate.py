"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles into classes [2^i, 2^(i+1)). For each class every document is cut into
windows of 2^(i+2) shingles that start every 2^(i+1), so an item lies whole in some window and the two sets differ in size
by a bounded factor. An item and a window are candidates if they agree in any of HASHES MinHash values: at containment 0.8
the Jaccard similarity is at least 0.16, and a pair is missed with probability (1 - 0.16)^128 < 3e-10. Candidates are verified
exactly: containment is the share of the item's distinct shingles that occur anywhere in the document.

Items and documents meet in joins: of MinHash values, then of the shingles of candidates, so a benchmark of any size costs one
scan of the documents. All that a task holds of the benchmark is a Bloom filter of BITS bits, whatever the number of items. A
window can only agree with an item in a hash function whose least value is attained by one of the item's shingles, so windows
without such shingles are not hashed and values of others are not sent; a fuller filter lets more through to the joins, and
drops no pair. Signatures are kept per window while it is handled; arrays of HASHES values are made for STEP shingles at once.

Edge cases: items of one to four words have one shingle, all their words, and are found as a run of these words in a
document; items without words match nothing. Null and empty documents match nothing. Rows with a null id are left out;
repeated item rows give one result, repeated documents too; where rows with one item_id differ the largest text counts, where rows
with one doc_id do, the one with most in common. Very long documents are searched whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import cut, drop, keyed, lean, small, table

HASHES = 128
#: Bits of the filter that every task holds: 16 MB.
BITS = 1 << 27
PROBES = 4
#: Shingles hashed by all functions at once (4 MB).
STEP = 1 << 12
#: In place of a size class: shingles of items of any size.
ANY = 63
_rng = np.random.Generator(np.random.PCG64(9))
MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
INVERSE = np.array([pow(int(m), -1, 1 << 64) for m in MULTIPLY], np.uint64)
FUNCTION = np.arange(HASHES, dtype=np.uint64) * wh.P


def _minima(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least value of each hash function over shingles s and the shingle that attains it: the functions have inverses."""
    low = (s[:STEP, None] * MULTIPLY + ADD).min(0)
    for i in range(STEP, len(s), STEP):
        low = np.minimum(low, (s[i : i + STEP, None] * MULTIPLY + ADD).min(0))
    return low, (low - ADD) * INVERSE


def _tagged(g: np.ndarray, k: int, size: int) -> np.ndarray:
    """Shingles of k words as keys of one size class."""
    return wh.mix(g ^ wh.U((k * 64 + size) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _values(low: np.ndarray, k: int, size: int) -> np.ndarray:
    """MinHash values as join keys that differ between functions, words of a shingle and classes."""
    return wh.mix(_tagged(low, k, size) + FUNCTION)


def _place(keys: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The places of keys in a filter of that many bits (a power of two)."""
    return ((keys + wh.U(probe) * ((keys >> wh.U(32)) | wh.U(1))) & wh.U(bits - 1)).astype(np.int64)


class Filter:
    """A Bloom filter over 64-bit words: may(keys) gives the indexes of keys that may be in it."""

    def __init__(self, bits: int, at: np.ndarray, words: np.ndarray):
        self.bits, self.words = bits, np.zeros(bits >> 6, np.uint64)
        self.words[at] = words.view(np.uint64)

    def may(self, keys: np.ndarray) -> np.ndarray:
        left = np.arange(len(keys))
        for probe in range(PROBES):
            at = _place(keys[left], probe, self.bits)
            left = left[(self.words[at >> 6] >> (at & 63).astype(np.uint64)) & wh.U(1) == 1]
        return left


def _item_rows(batches):
    """Each item's words a shingle, class, distinct shingles, join keys and the keys that the filter holds for it."""
    for b in batches:
        out = []
        for i, _, data, offsets in wh.chunks(b.column(1)):
            h, bounds, _, _ = wh.words(data, offsets)
            g, at = wh.shingles(h, bounds)
            for r in np.flatnonzero(np.diff(at)):
                s, k = np.unique(g[at[r] : at[r + 1]]), min(int(bounds[r + 1] - bounds[r]), wh.SHINGLE)
                size = int(at[r + 1] - at[r]).bit_length() - 1
                low, least = _minima(s)
                own = _tagged(s, k, ANY)
                held = np.concatenate([own, _tagged(np.unique(least), k, size)])
                out.append((b.column(0)[i + int(r)].as_py(), k, size, len(s), own.view(np.int64), _values(low, k, size).view(np.int64), held.view(np.int64)))
        if out:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item_id", "k", "size", "n_shingles", "shingles", "minima", "held"])


def _filter_rows(bits: int):
    """The words of a filter that hold these keys, combined for each batch."""

    def run(batches):
        for b in batches:
            keys = pc.list_flatten(b.column(0)).to_numpy().view(np.uint64)
            places = np.unique(np.concatenate([_place(keys, p, bits) for p in range(PROBES)]))
            word, first = np.unique(places >> 6, return_index=True)
            if len(word):
                held = np.bitwise_or.reduceat(wh.U(1) << (places & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(held.view(np.int64))], ["at", "bits"])

    return run


def _keys(g: np.ndarray, at: np.ndarray, k: int, sizes: list[int], known: Filter):
    """(row, key) of MinHash values of windows, then of shingles of the rows that have such values, each once a row."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    near = known.may(_tagged(g, k, ANY))
    rows, values = [], []
    for size in sizes if len(near) else ():
        may = near[known.may(_tagged(g[near], k, size))]
        row = np.searchsorted(at, may, "right") - 1
        stride = 2 << size
        window = (may - at[row]) // stride
        both = np.concatenate([np.stack([row, window]), np.stack([row, np.maximum(window - 1, 0)])], axis=1)
        for r, w in np.unique(both, axis=1).T:
            lo = at[r] + w * stride
            low, least = _minima(np.unique(g[lo : min(lo + 2 * stride, at[r + 1])]))
            sent = known.may(_tagged(least, k, size))
            rows.append(np.full(len(sent), r))
            values.append(_values(low, k, size)[sent])
    if not rows or not sum(map(len, rows)):
        return none, none
    found = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(values)]), axis=1)
    row = np.searchsorted(at, near, "right") - 1
    of = np.isin(row, found[0].astype(np.int64))
    own = np.unique(np.stack([row[of].astype(np.uint64), _tagged(g[near[of]], k, ANY)]), axis=1)
    return (found[0].astype(np.int64), found[1]), (own[0].astype(np.int64), own[1])


def _scanner(known, classes: dict[int, list[int]]):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, _, data, offsets in wh.chunks(b.column(2)):
                h, bounds, _, _ = wh.words(data, offsets)
                for k, sizes in classes.items():
                    g, at = wh.shingles(h, bounds, k, short=False) if k == wh.SHINGLE else _runs(h, bounds, k)
                    for minimum, (row, key) in zip((True, False), _keys(g, at, k, sizes, known.value), strict=True):
                        if len(row):
                            columns = [pa.array(ids[i + row]), pa.array(texts[i + row]), pa.array(key.view(np.int64)), pa.array(np.full(len(row), minimum))]
                            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "key", "minimum"])

    return run


def _runs(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of k words, hashed as the one shingle of a text of k words is."""
    counts = np.diff(bounds)
    n = np.maximum(counts - k + 1, 0)
    at = np.zeros(len(bounds), np.int64)
    np.cumsum(n, out=at[1:])
    start = np.repeat(bounds[:-1] - at[:-1], n) + np.arange(at[-1])
    out = np.zeros(len(start), np.uint64)
    for d in range(k):
        out += h[start + d] * wh.MIX[d] + wh.U(d + 1)
    return wh.mix(out), at


def contaminated(docs: DataFrame, benchmark: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common): documents that hold num / den or more of an item's distinct shingles."""
    spark = docs.sparkSession
    docs = keyed(docs, "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    items = keyed(benchmark, "item_id", "text").groupBy("item_id").agg(F.max("text").alias("text"))
    schema = "item_id long, k int, size int, n_shingles long, shingles array<long>, minima array<long>, held array<long>"
    items = cut(items.mapInArrow(lean(_item_rows), schema))
    # At most BITS / 64 rows, and five times the bits of a length, whatever the benchmark.
    words = items.select("held").mapInArrow(_filter_rows(BITS), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    classes: dict[int, list[int]] = {}
    for r in sorted(items.select("k", "size").distinct().collect()):
        classes.setdefault(r.k, []).append(r.size)
    known = spark.sparkContext.broadcast(Filter(BITS, words.column("at").to_numpy(), words.column("bits").to_numpy()))
    seen = cut(docs.mapInArrow(lean(_scanner(known, classes)), "doc_id long, text_hash long, key long, minimum boolean"))
    known.unpersist()
    row = ["doc_id", "text_hash"]
    minima = items.select("item_id", F.explode("minima").alias("key"))
    pairs = seen.where("minimum").join(small(minima, 16), "key").select(*row, "item_id").distinct()
    wanted = pairs.join(small(items.select("item_id", "n_shingles", F.explode("shingles").alias("key")), 24), "item_id")
    own = seen.where("not minimum").select(*row, "key").distinct()
    both = wanted.join(own, [*row, "key"]).groupBy(*row, "item_id", "n_shingles").agg(F.count("*").alias("n_common"))
    both = cut(both.where(F.col("n_common") * den >= F.col("n_shingles") * num))
    drop(seen, items)
    return both.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_common").alias("n_common"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and the item that it holds."""
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE = {
    "op9_decontaminate": f"""
WITH d AS (SELECT doc_id, {wh.SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {wh.SQL_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
s AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k))
SELECT doc_id, i.item_id, n AS n_shingles, count(*) AS n_common
FROM s JOIN i USING (k, g) JOIN n ON n.item_id = i.item_id
GROUP BY doc_id, i.item_id, n HAVING count(*) * 5 >= 4 * n""",
}
QUERIES = {"op9_decontaminate": op9_decontaminate}
