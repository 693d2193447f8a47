"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are compared within their label. Equal vectors form one class. The upper level of a label's tree is a net of bounded
size: every vector goes to the nearest of its centres, a cell keeps its covering radius, and a pair of cells goes, before anything
is shuffled, when the distance of the centres exceeds the sum of the radii and the chord that belongs to the threshold. Cells are
cut into blocks of bounded size. Each pair of blocks that is left is a task of its own that builds a cover tree over either block
(nested levels, the radius halves from level to level, every node keeps its covering radius) and walks both trees at once,
dropping pairs of nodes by the same bound. A node whose next level would hardly gather vectors, as with vectors spread evenly
over many dimensions, stays a leaf. What is left at the leaves is verified by the cosine in double precision, so the links are
exact. A task emits link counts and one edge a linked vector, never its pairs.

Edge cases: vectors that are null, of length zero, zero, or that hold null or non-finite components, and vectors with a null
label link with nothing and are their own component. Vectors of different lengths never link. Repeated vectors link with each
other; rows with a null vec_id are left out; rows that repeat a vec_id are one vector, the one with the largest label, then
embedding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, drop, keyed, lean, runs, small, table

#: Distinct vectors in a block at most about, and in a leaf; centres of all labels at most about.
BLOCK, LEAF, CENTRES = 8192, 64, 2048
#: A level is made only if its centres gather this many vectors each; looked at when so many centres are chosen.
GATHER, LOOK = 2.0, 32
SLACK = 1e-7


class Node:
    """center: a row; rows: those of a leaf; radius: the largest distance of a row below from the center."""

    __slots__ = ("center", "radius", "rows", "kids")

    def __init__(self, center: int, radius: float, rows=None, kids=None):
        self.center, self.radius, self.rows, self.kids = center, radius, rows, kids


def build(x: np.ndarray) -> Node:
    """A cover tree over unit vectors: a node's children are a net of half its level's radius that holds the node's own center."""

    def grow(center: int, rows: np.ndarray, far: np.ndarray, level: float) -> Node:
        radius = float(far.max(initial=0))
        if len(rows) <= LEAF or radius <= 1e-9:
            return Node(center, radius, rows=rows)
        while level / 2 >= radius:
            level /= 2
        half, kids, own = level / 2, [], x[rows]
        near, owner, c = far.copy(), np.zeros(len(rows), np.int64), [center]
        while True:
            k = int(near.argmax())
            if near[k] <= half:
                break
            if len(c) >= LOOK and len(c) & len(c) - 1 == 0 and (near <= half).sum() < GATHER * len(c):
                return Node(center, radius, rows=rows)
            d = np.sqrt(np.maximum(2 - 2 * (own @ own[k]), 0))
            closer = d < near
            near[closer], owner[closer] = d[closer], len(c)
            near[k], owner[k] = 0, len(c)
            c.append(int(rows[k]))
        order = np.argsort(owner, kind="stable")
        for k, part in enumerate(np.split(order, np.cumsum(np.bincount(owner, minlength=len(c)))[:-1])):
            kids.append(grow(c[k], rows[part], near[part], half))
        return Node(center, radius, kids=kids)

    rows = np.arange(len(x))
    far = np.sqrt(np.maximum(2 - 2 * (x @ x[0]), 0))
    far[0] = 0
    return grow(0, rows, far, 2.0)


def below(node: Node) -> list[np.ndarray]:
    return [node.rows] if node.kids is None else [r for k in node.kids for r in below(k)]


def dual(x: np.ndarray, a: Node, y: np.ndarray, b: Node, chord: float):
    """Candidate (rows of x, rows of y): leaf pairs whose bounds let some pair be within chord."""
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if p.kids is None and q.kids is None:
            yield p.rows, q.rows
            continue
        left = p.kids if p.kids is not None and (q.kids is None or p.radius >= q.radius or len(p.kids) < 64) else [p]
        right = q.kids if q.kids is not None and (p.kids is None or q.radius >= p.radius or len(q.kids) < 64 or left == [p]) else [q]
        ca, cb = np.array([n.center for n in left]), np.array([n.center for n in right])
        ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        d = np.sqrt(np.maximum(2 - 2 * (x[ca] @ y[cb].T), 0))
        keep = d <= ra[:, None] + rb[None, :] + chord + SLACK
        single = (np.array([n.kids is None and len(n.rows) == 1 for n in left])[:, None] & np.array([n.kids is None and len(n.rows) == 1 for n in right])[None, :]) & keep
        i, j = np.nonzero(single)
        if len(i):
            one, two = np.array([n.rows[0] if n.rows is not None and len(n.rows) else -1 for n in left]), np.array([n.rows[0] if n.rows is not None and len(n.rows) else -1 for n in right])
            yield np.stack([one[i], two[j]]), None
        todo += [(left[s], right[t]) for s, t in zip(*np.nonzero(keep & ~single), strict=True)]


def close_pairs(v: np.ndarray, w: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with cosine >= least between rows of v and w (None: i < j within v), by double precision."""
    unit = lambda m: m / np.sqrt((m * m).sum(1))[:, None]
    x = unit(v)
    y = x if w is None else unit(w)
    chord = float(np.sqrt(max(2 - 2 * least, 0)))
    a = build(x)
    b = a if w is None else build(y)
    ii, jj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, q in dual(x, a, y, b, chord):
        if q is None:
            i, j = p
        else:
            parts = [np.zeros((2, 0), np.int64)]
            for k in range(0, len(p), 512):  # leaves of any size, by products of bounded size
                for m in range(0, len(q), 4096):
                    s, t = np.nonzero(x[p[k : k + 512]] @ y[q[m : m + 4096]].T >= least - 1e-9)
                    parts.append(np.stack([p[k + s], q[m + t]]))
            i, j = np.concatenate(parts, axis=1)
            if w is None:
                i, j = i[i != j], j[i != j]
        ii.append(i)
        jj.append(j)
    i, j = np.concatenate(ii), np.concatenate(jj)
    if w is None:
        i, j, w = np.minimum(i, j), np.maximum(i, j), v
        i, j = i[i != j], j[i != j]
    code = np.unique(i * len(w) + j)
    i, j = code // len(w), code % len(w)
    norm = lambda m: (m * m).sum(1)
    ok = np.concatenate([(v[i[k : k + 16384]] * w[j[k : k + 16384]]).sum(1) / np.sqrt(norm(v[i[k : k + 16384]]) * norm(w[j[k : k + 16384]])) >= least for k in range(0, len(i), 16384)] or [np.zeros(0, bool)])
    return i[ok], j[ok]


def merged(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row reachable by the pairs."""
    low = np.arange(n)
    while True:
        old = low.copy()
        np.minimum.at(low, i, old[j])
        np.minimum.at(low, j, old[i])
        low = np.minimum(low, low[low])
        if (low == old).all():
            return low


def _pairs(least: float):
    def run(batches):
        """Rows come sorted by (g, lo, hi, side, vec_id); a group is a pair of blocks."""
        for f in runs(batches, "g", "lo", "hi"):
            ids, mult, side = (f.column(c).to_numpy() for c in ("vec_id", "mult", "side"))
            v = f.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            if f.column("lo")[0] == f.column("hi")[0]:
                i, j = close_pairs(v, None, least)
            else:
                split = int((side == 0).sum())
                if not 0 < split < len(v):
                    continue
                i, j = close_pairs(v[:split], v[split:], least)
                j = j + split
            if len(i):
                n = np.bincount(i, mult[j], len(ids)) + np.bincount(j, mult[i], len(ids))
                order = np.argsort(ids)
                rank = np.argsort(order)
                root = ids[order[merged(len(ids), rank[i], rank[j])[rank]]]
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(root[at]), pa.array(n[at].astype(np.int64))], ["a", "b", "n"])

    return run


def _nearest(shared):
    """Rows (g, embedding, ...) with the number of the nearest centre of their g, its vector and the distance; -1: g has none."""

    def run(batches):
        centres: dict[str, np.ndarray] = shared.value
        for b in batches:
            g, n = b.column("g").to_pylist(), b.num_rows
            cell, far, where = np.full(n, -1, np.int32), np.zeros(n), {}
            for k, x in enumerate(g):
                if x in centres:
                    where.setdefault(x, []).append(k)
            for x, rows in where.items():
                v = np.array(b.column("embedding").take(pa.array(rows)).to_pylist())
                v /= np.sqrt((v * v).sum(1))[:, None]
                dot = v @ centres[x].T
                cell[rows] = dot.argmax(1)
                far[rows] = np.sqrt(np.maximum(2 - 2 * dot.max(1), 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])

    return run


def _cells(classes: DataFrame, least: float, block: int) -> DataFrame:
    """(g, cell, ways): for each cell the cells (o, blocks) that it must be compared with; blocks: in how many it is cut."""
    cells = classes.groupBy("g", "cell").agg(F.max("far").alias("r"), F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("centre").alias("c"))
    a = cells.select("g", "cell", "r", "c", "blocks")
    b = cells.select(F.col("g").alias("g2"), F.col("cell").alias("o"), F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("blocks").alias("blocks2"))
    gap = F.sqrt(F.aggregate(F.zip_with("c", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    chord = (2 - 2 * least) ** 0.5 + SLACK
    pairs = a.join(b, F.col("g") == F.col("g2")).where((F.col("cell") == F.col("o")) | (gap <= F.col("r") + F.col("r2") + chord))
    return pairs.groupBy("g", "cell", "blocks").agg(F.collect_list(F.struct("o", F.col("blocks2").alias("blocks"))).alias("ways"))


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of one label with cosine >= least are linked."""
    spark = vectors.sparkSession
    rows = keyed(vectors, "vec_id", "embedding", "label").groupBy("vec_id").agg(F.max(F.struct("label", "embedding")).alias("m"))
    rows = cut(rows.select("vec_id", "m.embedding", "m.label"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Scaled by a power of two, which rounds nothing: squares of very large or small components stay in range. The struct in an array
    # of one binds the scale, so that it is found once a row.
    scale = F.pow(F.lit(2.0), -F.greatest(F.lit(-1000.0), F.floor(F.log2(F.array_max(F.transform(v, F.abs)))).cast("double")))
    scaled = F.transform(F.array(F.struct(v.alias("v"), scale.alias("k"))), lambda s: F.transform(s["v"], lambda x: x * s["k"] + F.lit(0.0)))[0]
    good = rows.where(F.coalesce(fine, F.lit(False))).withColumn("embedding", scaled)
    good = good.withColumn("g", F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string")))
    good = good.withColumn("h", F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256))
    classes = cut(good.groupBy("g", "h").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("mult"), F.first("embedding").alias("embedding")))
    n = classes.count()
    share = min(1 / BLOCK, CENTRES / max(n, 1))
    # About one vector in BLOCK of each label is a centre; a label of one block has no use for them.
    wide = classes.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    picked = classes.where(F.pmod(F.xxhash64("h", F.lit("centre")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).join(wide, "g").select("g", "embedding").collect()
    nets: dict[str, list] = {}
    for r in picked:
        nets.setdefault(r.g, []).append(r.embedding)
    nets = {g: np.array(x) / np.linalg.norm(np.array(x), axis=1)[:, None] for g, x in nets.items() if len(x) > 1}
    shared = spark.sparkContext.broadcast(nets)
    schema = "g string, h string, vec_id long, mult long, embedding array<double>, cell int, far double"
    near = classes.mapInArrow(lean(_nearest(shared)), schema)
    table_ = [(g, k, c.tolist()) for g, x in nets.items() for k, c in enumerate(x)]
    centres = spark.createDataFrame(table_, "g string, cell int, centre array<double>")
    near = cut(near)
    cells = near.join(small(cut(centres), 8 * 1024), ["g", "cell"], "left") if table_ else near.withColumn("centre", F.lit(None).cast("array<double>"))
    ways = cut(_cells(cells, least, BLOCK))
    placed = near.join(small(ways, 64), ["g", "cell"])
    placed = placed.withColumn("p", F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)")).withColumn("way", F.explode("ways"))
    placed = placed.withColumn("q", F.explode(F.expr("sequence(0, way.blocks - 1)")))
    me, other = F.col("cell").cast("long") * (1 << 32) + F.col("p"), F.col("way.o").cast("long") * (1 << 32) + F.col("q")
    placed = placed.select("g", F.least(me, other).alias("lo"), F.greatest(me, other).alias("hi"), F.when(me <= other, 0).otherwise(1).alias("side"), "vec_id", "mult", "embedding")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // BLOCK + 1)
    found = cut(placed.repartition(parts, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "side", "vec_id").mapInArrow(lean(_pairs(least)), "a long, b long, n long"))
    drop(near, ways)
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("rep"), "n")
    joined = components(found).select(F.col("node").alias("rep"), "component")
    named = classes.select("g", "h", F.col("vec_id").alias("rep"), "mult").join(counts, "rep", "left").join(joined, "rep", "left")
    member = good.select("vec_id", "g", "h").join(named, ["g", "h"]).select("vec_id", F.coalesce("component", "rep").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"))
    out = rows.select("vec_id").join(member, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector: its links, its component, whether it is the one that is kept."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op10_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
r(vec_id, t) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.t),
c AS (SELECT vec_id, min(t) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
}
QUERIES = {"op10_near_vectors": op10_near_vectors}
