"""N-gram Jaccard join with Bayesian candidate pruning.

Texts whose shingle sets are equal form one class, so copies cost one row. Class representatives that agree in a band of
four MinHash values are candidates; at Jaccard 0.8 a pair of sets shares no band with probability (1 - 0.8^4)^32 < 5e-8.
Candidates are compared 16 MinHash values at a time, and a pair goes once the posterior probability (uniform prior) that it
reaches the threshold falls below TOLERANCE; the rest are verified exactly on their shingle sets. Candidates meet in blocks:
the components of the band graph, cut into pieces of bounded bytes, each pair of pieces a group of its own. A block emits
link counts and one edge a linked row, never its pairs.

Edge cases: null and empty texts and texts without words have no shingles: no link, a class of their own. Texts of one to
four words have one shingle and link only with equal ones. Rows that repeat a doc_id are one document, and where their texts
differ the one with the largest fingerprint counts; rows with a null doc_id are left out. Very long texts are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import components, cut, keyed, lean, partitions, runs, small, table

BANDS, WIDTH, STEP, TOLERANCE = 32, 4, 16, 1e-9
HASHES = BANDS * WIDTH
#: Rows and bytes of shingle sets in a piece of a block.
PIECE_ROWS, PIECE_BYTES = 768, 12 << 20
_rng = np.random.Generator(np.random.PCG64(41))
MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES minimum values of a set of 64-bit hashes, as uint32."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(out, (s[i : i + 4096, None] * MULTIPLY + ADD).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    """BANDS keys of each row of signatures, as int64."""
    x = sig.reshape(*sig.shape[:-1], BANDS, WIDTH).astype(np.uint64)
    h = np.zeros(x.shape[:-1], np.uint64)
    for k in range(WIDTH):
        h = wh.mix(h ^ x[..., k] * wh.MIX[k])
    return wh.mix(h + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n compared values, the fewest matches that keep a pair: P(J >= t | m of n) = P(Binomial(n + 1, t) <= m) >= tolerance."""
    out = np.zeros(HASHES + 1, int)
    for n in range(1, HASHES + 1):
        term, total, m = (1 - threshold) ** (n + 1), 0.0, 0
        while m <= n:
            total += term
            if total >= tolerance:
                break
            term *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out[n] = m
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """192 bits that tell sets apart."""
    return np.array([len(s), s.sum(), np.bitwise_xor.reduce(wh.mix(s))], np.uint64).tobytes()


def _sketch(batches):
    for b in batches:
        ids, fp, keys = b.column(0).to_numpy(zero_copy_only=False), [], []
        hit = np.zeros(b.num_rows, bool)
        for r, s in wh.sets(b.column(1)):
            hit[r] = True
            fp.append(fingerprint(s))
            keys.append(bands(minhash(s)))
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(fp, pa.binary()), lists], ["doc_id", "fp", "bands"])


def _sets(batches):
    for b in batches:
        rows, sig, packed, fp = [], [], [], b.column(3).to_pylist()
        for r, s in wh.sets(b.column(1)):
            if fingerprint(s) != fp[r]:  # another row with this doc_id stands for the document
                continue
            rows.append(r)
            sig.append(minhash(s).tobytes())
            packed.append(s.tobytes())
        kept = b.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), pa.array(sig, pa.binary()), pa.array(packed, pa.binary()), pa.array([len(x) for x in packed], pa.int64())], ["doc_id", "c", "sig", "s", "size"])


def verify(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether each pair's Jaccard similarity is num / den or more, exactly."""
    size = np.array([len(s) for s in sets])
    if len(i) <= 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[token] > 1
        _, token = np.unique(token[shared], return_inverse=True)
        owner, width = owner[shared], 4096
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(token.max(initial=-1)) + 1, width):
            part = (token >= lo) & (token < lo + width)
            m = np.zeros((len(sets), width), np.float32)
            m[owner[part], token[part] - lo] = 1
            m = m[:, m.any(0)]
            both += m @ m.T
        both = both[i, j].astype(np.int64)
    return both * den >= num * (size[i] + size[j] - both)


def linked(sig: np.ndarray, sets: list[np.ndarray], num: int, den: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The links (i < j) among the rows; split: only pairs of a row before it and a row from it on."""
    keys, n = bands(sig), len(sig)
    may = np.zeros((n, n), bool)
    for b in range(BANDS):
        may |= keys[:, b][:, None] == keys[:, b][None, :]
    i, j = np.nonzero(np.triu(may, 1) if split is None else may[:split, split:])
    if split is not None:
        j = j + split
    least, same = least_matches(num / den), np.zeros(len(i), np.int64)
    for at in range(0, HASHES, STEP):
        same += np.concatenate([(sig[i[x : x + 65536], at : at + STEP] == sig[j[x : x + 65536], at : at + STEP]).sum(1) for x in range(0, len(i), 65536)] or [same])
        keep = same >= least[at + STEP]
        i, j, same = i[keep], j[keep], same[keep]
    ok = verify(sets, i, j, num, den)
    return i[ok], j[ok]


def roots(n: int, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of n rows the reachable row of smallest order."""
    best = np.arange(n)
    if len(i):
        rank = np.argsort(np.argsort(order, kind="stable"), kind="stable")
        low = rank.copy()
        while True:
            old = low.copy()
            np.minimum.at(low, i, old[j])
            np.minimum.at(low, j, old[i])
            low = np.minimum(low, low[np.argsort(rank)[low]])
            if (low == old).all():
                break
        best = np.argsort(rank)[low]
    return best


def _blocks(num: int, den: int):
    def run(batches):
        """Rows come sorted by (c, lo, hi, side); a group is a block."""
        for g in runs(batches, "c", "lo", "hi"):
            if g.num_rows < 2:
                continue
            ids, mult, side = (g.column(c).to_numpy() for c in ("doc_id", "mult", "side"))
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            sets = [np.frombuffer(x, np.uint64) for x in g.column("s").to_pylist()]
            split = None if g.column("lo")[0] == g.column("hi")[0] else int((side == 0).sum())
            i, j = linked(sig, sets, num, den, split)
            if len(i):
                n = np.bincount(i, mult[j], len(ids)) + np.bincount(j, mult[i], len(ids))
                at = np.flatnonzero(n)
                root = ids[roots(len(ids), i, j, ids)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(root[at]), pa.array(n[at].astype(np.int64))], ["a", "b", "n"])

    return run


def jaccard_join(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, class_id, n_links, kept): every document, the smallest doc_id reachable by links, and its number of links.

    docs needs doc_id (long) and text; other columns are ignored. Links join documents whose shingle sets have a Jaccard
    similarity of num / den or more; kept marks one document of each class, the one with the smallest doc_id.
    """
    spark = docs.sparkSession
    docs = keyed(docs, "doc_id", "text")
    sketch = docs.mapInArrow(lean(_sketch), "doc_id long, fp binary, bands array<long>").groupBy("doc_id").agg(F.max(F.struct("fp", "bands")).alias("m"))
    sketch = cut(sketch.select("doc_id", "m.fp", "m.bands"))
    classes = cut(sketch.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.first("bands").alias("bands")))
    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    leader = banded.groupBy("band", "key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = cut(banded.join(leader, ["band", "key"]).groupBy("rep").agg(F.min("lead").alias("least"), F.collect_set("lead").alias("leads")))
    # A row hangs on its least lead; only the leads themselves, joined by the rows that have several, need rounds.
    ties = near.where("size(leads) > 1").select("least", F.explode("leads").alias("lead")).where("lead <> least").distinct()
    led = components(ties, "lead", "least").select(F.col("node").alias("least"), "component")
    group = near.join(small(led, 16), "least", "left").select(F.col("rep").alias("doc_id"), F.coalesce("component", "least").alias("c"))
    group = cut(group.join(classes.select(F.col("rep").alias("doc_id"), "mult", "fp"), "doc_id"))
    sets = docs.join(small(group.select("doc_id", "c", "fp"), 48), "doc_id").select("doc_id", "text", "c", "fp")
    sets = cut(sets.mapInArrow(lean(_sets), "doc_id long, c long, sig binary, s binary, size long").dropDuplicates(["doc_id"]))
    pieces = sets.groupBy("c").agg(F.greatest(F.ceil(F.count("*") / PIECE_ROWS), F.ceil(F.sum("size") / PIECE_BYTES)).alias("pieces"))
    pieces = cut(pieces)
    placed = sets.join(small(pieces, 16), "c").join(small(group.select("doc_id", "mult"), 16), "doc_id")
    placed = placed.withColumn("p", F.expr("cast(pmod(xxhash64(doc_id), pieces) as int)"))
    placed = placed.withColumn("o", F.explode(F.expr("sequence(0, cast(pieces as int) - 1)")))
    placed = placed.select("c", F.least("p", "o").alias("lo"), F.greatest("p", "o").alias("hi"), F.when(F.col("p") <= F.col("o"), 0).otherwise(1).alias("side"), "doc_id", "mult", "sig", "s")
    total = sets.agg(F.sum("size")).first()[0] or 0
    blocks = placed.repartition(partitions(spark, total, 8 << 20), "c", "lo", "hi").sortWithinPartitions("c", "lo", "hi", "side", "doc_id")
    found = cut(blocks.mapInArrow(lean(_blocks(num, den)), "a long, b long, n long"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("rep"), "n")
    joined = components(found).select(F.col("node").alias("rep"), "component")
    named = cut(classes.select("fp", "rep", "mult").join(small(counts, 16), "rep", "left").join(small(joined, 16), "rep", "left"))
    member = sketch.select("doc_id", "fp").join(named, "fp")
    member = member.select("doc_id", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = docs.select("doc_id").distinct().join(member, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class and its number of links."""
    return jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = {
    "op6_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {wh.SQL_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING count(*) * 5 >= 4 * (na.n + nb.n - count(*))),
r(doc_id, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.t),
c AS (SELECT doc_id, min(t) AS class_id FROM r GROUP BY doc_id)
SELECT c.doc_id, class_id, (SELECT count(*) FROM l WHERE l.a = c.doc_id) AS n_links, c.doc_id = class_id AS kept FROM c""",
}
QUERIES = {"op6_jaccard_join": op6_jaccard_join}
