"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Texts that are equal form one class; its smallest doc_id stands for it, the others are copies of it. The seeds of a text are the
minimizers (one in any W consecutive) of its runs of five words. A text is looked up by keys: each seed, each seed with the next
but one, and the runs of 15 and of 40 words that begin with a seed. All texts that hold a key are matched with the first one, by
doc_id, that holds it, so a key of m texts gives m - 1 matches, whatever batches and partitions the texts came in. Frequent seeds
lead to other texts than a long shared passage does; the longer keys lead to a text that holds the long run. Any 40 words of
an unchanged passage of 50 begin with a seed within its first 10 words, so no such passage goes without a text that holds
40 words of it.

That star alone leaves links out: the keys of an edited passage may all have been met before in other texts. So a second round asks,
for words that the first one left outside of passages: every two shared seeds of a text within REACH words are an edge, and the
texts that hold an edge fall into classes by the exact words from the one seed to the other. A text that asks is compared with the first
text of every other class and of its own, however frequent the edge, over all runs of five words around it, not minimizers only. So if
f and a later text share seeds up to REACH words apart, the first text that holds these very words of f is compared with it.

The matches of two texts are chained: a chain is ordered in both, gains K for a seed and pays GAP for each word between neighbours
on either side (a Fenwick tree of prefix maxima finds the best predecessor). Chains are aligned word by word: equal runs count,
gaps between anchors get an edit alignment, the ends are extended. A chain with too few equal words is split at its most unequal
gap, until each part has enough or no unequal gap is left. Aligned spans of a text that touch make a passage; passages of
LEAST words or more are the result.

Keys are packed by bucket. A key that more than CROWD texts of a batch hold is reported once; its texts meet the answer in a join
by key, which the adaptive skew join splits. Chains meet only the words of the earlier text that they need.

Edge cases: null and empty texts and texts under LEAST words have no passage; matches inside one text do not count; rows with a
null doc_id are left out; rows that repeat a doc_id are one document, the one whose text is largest. A very long text is read whole.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import cut, drop, keyed, lean, partitions, small, table

K, W, GAP, LEAST, SPAN, IDENTITY = wh.SHINGLE, 10, 0.1, 50, 15, 0.8
#: Words of the long keys; texts of a batch that hold a key and are reported one by one.
RUNS, CROWD = (SPAN, 40), 8
#: Bytes of text whose keys are packed together.
PACK = 1 << 20
#: Words between two spans that still touch.
TOUCH = 2
#: Words beyond a chain's ends that may still belong to it: an equal run of K + W - 1 words holds a seed.
MARGIN = K + W
#: Words from the first to the last seed of an edge; passages of LEAST words reach no farther.
REACH = 64
#: Pairs of edges made at once.
PAIRS = 1 << 20
#: Least bits for a place in a batch; longer batches take more.
LOW = 26
#: Bytes of a word's place in its text, and of a text's place in its pack.
PLACE, NAME = 4, 3


def keys(h: np.ndarray, bounds: np.ndarray):
    """(row, word in the row, hash) of all keys of the rows. The two lowest bits of the hash tell the kind: a seed, a pair, RUNS."""
    row, pos, g = seeds(h, bounds)
    pair = np.flatnonzero(row[2:] == row[:-2])
    out = [(row, pos, g), (row[pair], pos[pair], wh.mix(g[pair] * wh.MIX[0] + g[pair + 2] * wh.MIX[1]))]
    up, down = wh.powers(len(h) + 1)
    total = np.append(np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)]))
    for n in RUNS:
        fits = pos + n <= np.diff(bounds)[row]
        at = bounds[row[fits]] + pos[fits]
        out.append((row[fits], pos[fits], wh.mix((total[at + n] - total[at]) * down[at])))
    return tuple(np.concatenate(x) for x in zip(*((r, p, x & ~np.uint64(3) | np.uint64(k)) for k, (r, p, x) in enumerate(out)), strict=True))


def seeds(h: np.ndarray, bounds: np.ndarray):
    """(row, word in the row, hash) of the minimizers of every row's shingles."""
    g, at = wh.shingles(h, bounds, K, short=False)
    n = np.diff(at)
    if not len(g):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    # Of equal shingles in a window, as in a text of one word, those at multiples of W in the row come first: one place of W, not
    # every one.
    owner = np.repeat(np.arange(len(n)), n)
    bits = max(LOW, len(g).bit_length())
    low, place = np.uint64((1 << bits + 4) - 1), np.arange(len(g))
    least = (g & ~low) | ((place - at[:-1][owner]) % W << bits | place).astype(np.uint64)
    # Windows stay inside a row: those that would cross its end are moved back, and short rows have one window.
    pad = np.full(W, np.iinfo(np.uint64).max, np.uint64)
    full = np.concatenate([least, pad])
    best = full[: len(least)].copy()
    room = at[1:][owner] - np.arange(len(least))
    for d in range(1, W):
        nxt = full[d : d + len(least)]
        best = np.where(room > d, np.minimum(best, nxt), best)
    whole = (room >= W) | (np.arange(len(least)) == at[:-1][owner])
    pick = np.unique((best[whole] & np.uint64((1 << bits) - 1)).astype(np.int64))
    who = owner[pick]
    return who, pick - at[:-1][who], g[pick]


def points_of(m: np.ndarray) -> np.ndarray:
    """The points of matches (word, word there, kind): those of seeds and pairs, and along runs; one for K words of a diagonal."""
    out = [m[m[:, 2] < 2, :2]]
    for kind, n in enumerate(RUNS, 2):
        run = m[m[:, 2] == kind, :2]
        out += [run + d for d in range(0, n - K + 1, K)]
    points = np.concatenate(out)
    points = points[np.argsort(points[:, 0], kind="stable")]
    cell = (points[:, 0] // K << 32) + points[:, 0] - points[:, 1]
    return points[np.sort(np.unique(cell, return_index=True)[1])]


def _packed(ranges: int, doc, pos, ref, at, kind):
    """Rows (range of documents, matches): matches sorted by document, with small differences."""
    if not len(doc):
        return []
    where = (wh.mix(doc.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
    order = np.lexsort((pos, ref, doc, where))
    doc, pos, ref, at, kind = doc[order], pos[order], ref[order], at[order], kind[order]
    cuts = np.searchsorted(where[order], np.arange(ranges + 1))
    codec, out = pa.Codec("zstd", 1), []
    for k in np.flatnonzero(np.diff(cuts)):
        x = slice(cuts[k], cuts[k + 1])
        blob = b"".join(y.astype(t).tobytes() for y, t in ((np.diff(doc[x], prepend=0), "<i8"), (np.diff(ref[x], prepend=0), "<i8"), (pos[x], "<i4"), (at[x], "<i4"), (kind[x], "<i1")))
        out.append((int(k), codec.compress(blob, asbytes=True), int(cuts[k + 1] - cuts[k])))
    return out


def _unpacked(blob: bytes, n: int):
    """(doc, ref, matches of word, word there, kind) of a row of _packed."""
    raw = pa.Codec("zstd").decompress(blob, 25 * n, asbytes=True)
    doc, ref = (np.cumsum(np.frombuffer(raw, "<i8", n, 8 * n * k)) for k in range(2))
    pos, at = (np.frombuffer(raw, "<i4", n, 16 * n + 4 * n * k) for k in range(2))
    return doc, ref, np.stack([pos, at, np.frombuffer(raw, "<i1", n, 24 * n).astype(np.int32)], axis=1)


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], list(names))


def _bytes(x: np.ndarray, n: int, skip: int = 0) -> bytes:
    """n bytes of each unsigned number, from byte skip on."""
    width = x.dtype.itemsize
    return x.view(np.uint8).reshape(-1, width)[:, skip : skip + n].tobytes()


def _numbers(raw: bytes, n: int, dtype, skip: int = 0) -> np.ndarray:
    got = np.frombuffer(raw, np.uint8).reshape(-1, n)
    out = np.zeros((len(got), np.dtype(dtype).itemsize), np.uint8)
    out[:, skip : skip + n] = got
    return out.view(dtype).ravel()


#: Rows of three sorts: reports (bucket, m, g, names), waiting crowds (key, m, names) and their answers (key, doc_id, at), and
#: matches (bucket: a range of documents, m, at: how many).
REPORT = ("bucket", "m", "g", "names", "key", "doc_id", "at")
REPORT_KINDS = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
REPORT_SQL = "bucket int, m binary, g binary, names binary, key long, doc_id long, at long"


def _report(buckets: int):
    """Keys with their texts and places, packed by bucket. Of a key with more than CROWD texts here only the first place is told,
    marked; the others go as a row of their own, with the key, to wait for the answer."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, _, data, offsets in wh.chunks(b.column(1), limit=PACK):
                h, bounds, _, _ = wh.words(data, offsets)
                row, pos, g = keys(h, bounds)
                if not len(row):
                    continue
                doc = ids[i + row]
                order = np.lexsort((pos, doc, g))
                doc, row, pos, g = doc[order], row[order], pos[order], g[order]
                new = np.append(True, g[1:] != g[:-1])
                start = np.flatnonzero(new)
                size = np.diff(np.append(start, len(g)))
                crowd = np.repeat(size > CROWD, size)
                out = []
                for a, z in zip(start[size > CROWD], (start + size)[size > CROWD], strict=True):
                    names, at = np.unique(doc[a:z], return_inverse=True)
                    out.append((int(g[a] >> np.uint64(2)) % buckets, np.stack([at, pos[a:z]], axis=1).astype(np.int32).tobytes(), None, names.tobytes(), int(g[a].view(np.int64)), None, None))
                send = np.flatnonzero(~crowd | new)
                where = ((g[send] >> np.uint64(2)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[by], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    x = send[by[cuts[k] : cuts[k + 1]]]
                    names, at = np.unique(doc[x], return_inverse=True)
                    m = _bytes((at.astype("<u4") << np.uint32(1)) | crowd[x], NAME) + _bytes(pos[x].astype("<u4"), PLACE)
                    out.append((int(k), m, g[x].tobytes(), names.tobytes(), None, None, None))
                yield _batch(out, REPORT, REPORT_KINDS)

    return run


def _meet(ranges: int):
    """Buckets of reports, sorted by bucket: matches with the first text of each key, the answers that crowds wait for, and crowds."""

    def solve(held):
        doc, pos, g, crowd = [], [], [], []
        for r in held:
            n = len(r["g"]) // 8
            at = _numbers(r["m"][: NAME * n], NAME, "<u4")
            doc.append(np.frombuffer(r["names"], np.int64)[(at >> 1).astype(np.int64)])
            pos.append(_numbers(r["m"][NAME * n :], PLACE, "<u4").astype(np.int64))
            crowd.append((at & 1).astype(bool))
            g.append(np.frombuffer(r["g"], np.uint64))
        doc, pos, g, crowd = np.concatenate(doc), np.concatenate(pos), np.concatenate(g), np.concatenate(crowd)
        order = np.lexsort((pos, doc, g))
        doc, pos, g, crowd = doc[order], pos[order], g[order], crowd[order]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        lead = np.repeat(start, np.diff(np.append(start, len(g))))
        # A seed's places in its first text go to that text, if another text holds it: the second round needs all who share a seed.
        alone = np.minimum.reduceat(doc, start) == np.maximum.reduceat(doc, start)
        alone = np.repeat(alone & ~np.logical_or.reduceat(crowd, start), np.diff(np.append(start, len(g))))
        other = ((doc != doc[lead]) | ((g & np.uint64(3)) == 0) & ~alone) & ~crowd
        lead = lead[other]
        out = [(k, m, None, None, None, None, n) for k, m, n in _packed(ranges, doc[other], pos[other], doc[lead], pos[lead], (g[other] & np.uint64(3)).astype(np.int64))]
        asked = start[np.logical_or.reduceat(crowd, start)]
        out += [(None, None, None, None, k, d, p) for k, d, p in zip(g[asked].view(np.int64).tolist(), doc[asked].tolist(), pos[asked].tolist(), strict=True)]
        for lo in range(0, len(out), 20000):
            yield _batch(out[lo : lo + 20000], REPORT, REPORT_KINDS)

    def run(batches):
        held, now = [], None
        for b in batches:
            waiting = pc.is_valid(b.column("key"))
            if pc.any(waiting).as_py():
                yield b.filter(waiting)
                b = b.filter(pc.invert(waiting))
            for r in b.to_pylist():
                if r["bucket"] != now and held:
                    yield from solve(held)
                    held = []
                now = r["bucket"]
                held.append(r)
        if held:
            yield from solve(held)

    return run


MATCHES = ("bucket", "m", "at")
MATCHES_SQL = "bucket int, m binary, at long"


def _answered(ranges: int):
    """Crowds (key, names, m) beside their answer (doc_id and at: the first text and the place there): matches."""

    def run(batches):
        for b in batches:
            doc, pos, ref, at, kind = ([np.zeros(0, np.int64)] for _ in range(5))
            for r in b.to_pylist():
                m = np.frombuffer(r["m"], np.int32).reshape(-1, 2)
                d = np.frombuffer(r["names"], np.int64)[m[:, 0]]
                other = np.full(len(d), not r["key"] & 3) | (d != r["doc_id"])
                same = np.ones(int(other.sum()), np.int64)
                for held, x in ((doc, d[other]), (pos, m[other, 1].astype(np.int64)), (ref, same * r["doc_id"]), (at, same * r["at"]), (kind, same * (r["key"] & 3))):
                    held.append(x)
            yield _batch(_packed(ranges, *map(np.concatenate, (doc, pos, ref, at, kind))), MATCHES, (pa.int32(), pa.binary(), pa.int64()))

    return run


def _gather(batches):
    """Ranges of documents, sorted: of each document with two matches or more all of them, by the earlier document. Its own places
    of seeds that it is the first to hold are among them, as matches with itself."""

    def solve(held):
        doc, ref, m = (np.concatenate(x) for x in zip(*(_unpacked(*r) for r in held), strict=True))
        order = np.lexsort((m[:, 1], m[:, 0], m[:, 2], ref, doc))
        doc, ref, m = doc[order], ref[order], m[order]
        cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        rows = [(int(doc[a]), ref[a:z].tobytes(), m[a:z].tobytes()) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z - a > 1]
        for lo in range(0, len(rows), 5000):
            yield _batch(rows[lo : lo + 5000], ("doc_id", "refs", "m"), (pa.int64(), pa.binary(), pa.binary()))

    held, now = [], None
    for b in batches:
        for bucket, m, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if bucket != now and held:
                yield from solve(held)
                held = []
            now = bucket
            held.append((m, n))
    if held:
        yield from solve(held)


def chains(points: np.ndarray, gap: float = GAP, weight: float = K, least: float = 2 * K) -> list[np.ndarray]:
    """Local collinear chains of (x, y) points, best first: rows of points, ascending in both; each point in one chain at most.

    A chain's score is weight for each point less gap for each unit of L1 distance between neighbours; links that
    do not pay are not made.
    """
    points = points[np.lexsort((points[:, 1], points[:, 0]))]
    points = points[np.append(True, (points[1:] != points[:-1]).any(axis=1))[: len(points)]]
    return [points[c] for c in _chains(points[:, 0].tolist(), points[:, 1].tolist(), gap, weight, least)]


def _chains(xs: list[int], ys: list[int], gap: float, weight: float, least: float) -> list[list[int]]:
    """The chains of distinct points, sorted by x and y, as their numbers. A Fenwick tree holds prefix maxima of (value, point)."""
    n = len(xs)
    place = {y: k for k, y in enumerate(sorted(set(ys)))}
    rank = [place[y] for y in ys]
    size = len(place)
    value_at, point_at = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, back, first = [float(weight)] * n, [-1] * n, 0
    for i in range(n):
        x, k = xs[i], rank[i]
        if xs[first] != x:  # points of one x may not follow each other
            for j in range(first, i):
                value, r = score[j] + gap * (xs[j] + ys[j]), rank[j] + 1
                while r <= size:
                    if value > value_at[r]:
                        value_at[r], point_at[r] = value, j
                    r += r & -r
            first = i
        value, j = float("-inf"), -1
        while k > 0:
            if value_at[k] > value:
                value, j = value_at[k], point_at[k]
            k -= k & -k
        if j >= 0:
            value -= gap * (x + ys[i])
            if value > 0:
                score[i], back[i] = weight + value, j
    used, out = [False] * n, []
    for i in sorted((i for i in range(n) if score[i] >= least), key=lambda i: -score[i]):
        if used[i]:
            continue
        chain, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = back[j]
        total = score[i] - (score[j] if j >= 0 else 0)
        if total >= least:
            out.append(chain[::-1])
    return out


def useful_chains(refs: np.ndarray, m: np.ndarray, n_words: int) -> list[tuple[int, np.ndarray]]:
    """(earlier document, chain), most points first. A chain goes if runs that better chains hold cover it word for word."""
    found = []
    for rows in np.split(np.arange(len(refs)), np.flatnonzero(refs[1:] != refs[:-1]) + 1):
        points = points_of(m[rows])
        if len(points) > 1:
            found += [(int(refs[rows[0]]), c, m[rows][m[rows, 2] > 1]) for c in chains(points)]
    found.sort(key=lambda x: (-len(x[1]), x[0], x[1][0, 0]))
    covered, out = np.zeros(n_words + 1, bool), []
    for ref, c, runs in found:
        lo, hi = int(c[0, 0]), int(c[-1, 0]) + K
        if covered[lo:hi].all():
            continue
        out.append((ref, c))
        if len(runs):
            mine = runs[(runs[:, 0] >= lo) & (runs[:, 0] < hi)]
            diagonals = set((c[:, 0] - c[:, 1]).tolist())
            for x, y, kind in mine.tolist():
                if x - y in diagonals and x + RUNS[kind - 2] <= hi:
                    covered[x : x + RUNS[kind - 2]] = True
    return out


def _chain(batches):
    """Each text with its matches: chains, and the words around them."""
    for b in batches:
        ids, out = b.column(0).to_numpy(), []
        for i, j, data, offsets in wh.chunks(b.column(1)):
            h, bounds, _, _ = wh.words(data, offsets)
            h = h.astype(np.uint32)
            for r in range(i, j):
                w = h[bounds[r - i] : bounds[r - i + 1]]
                refs = np.frombuffer(b.column(2)[r].as_py(), np.int64)
                m = np.frombuffer(b.column(3)[r].as_py(), np.int32).reshape(-1, 3).astype(np.int64)
                others = refs != ids[r]
                if not others.any():
                    continue
                for ref, c in useful_chains(refs[others], m[others], len(w)):
                    lo, hi = max(0, int(c[0, 0]) - MARGIN), min(len(w), int(c[-1, 0]) + K + MARGIN)
                    low = max(0, int(c[0, 1]) - MARGIN)
                    out.append((int(ids[r]), ref, c.astype(np.int32).tobytes(), lo, w[lo:hi].tobytes(), low, int(c[-1, 1]) + K + MARGIN - low))
        yield _batch(out, ("doc_id", "ref", "chain", "lo", "words", "ref_lo", "ref_n"), (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32()))


def edges(pos: np.ndarray, seed: np.ndarray, h: np.ndarray):
    """(place of the first seed, place of the second, hash of the two, hash of the words from the one to the other) of the edges
    of a text; its seeds in order. Repeats of one word are no edge: they are an unchanged run, which the first round matches."""
    up, down = wh.powers(len(h) + 1)
    total = np.append(np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)]))
    change = np.append(0, np.cumsum(h[1:] != h[:-1]))
    out = []
    for k in range(1, REACH):
        near = np.flatnonzero(pos[k:] - pos[:-k] <= REACH)
        if not len(near):
            break
        near = near[change[pos[near]] < change[pos[near + k] + K - 1]]
        a, z = pos[near], pos[near + k]
        out.append((a, z, wh.mix(seed[near] * wh.MIX[0] + seed[near + k] * wh.MIX[1]), wh.mix((total[z + K] - total[a]) * down[a])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else None


EDGES_SQL = "bucket int, m binary, at long"


def _edges(buckets: int):
    """Texts (doc_id, text, refs, m, covered: their passages): edges, packed by bucket. An edge asks unless a passage covers it;
    of edges that do not ask and have equal words only the first text's is sent."""

    def sent(rows):
        doc, a, z, key, words, asks = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((a, doc, words, key))
        doc, a, z, key, words, asks = doc[order], a[order], z[order], key[order], words[order], asks[order]
        keep = asks | np.append(True, (key[1:] != key[:-1]) | (words[1:] != words[:-1]))
        where = (key[keep] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(where, kind="stable")
        doc, a, z, key, words, asks = (x[keep][by] for x in (doc, a, z, key, words, asks))
        cuts = np.searchsorted(where[by], np.arange(buckets + 1))
        codec, out = pa.Codec("zstd", 1), []
        for k in np.flatnonzero(np.diff(cuts)):
            x = slice(cuts[k], cuts[k + 1])
            step = ((z[x] - a[x]) << 1 | asks[x]).astype("<u1")
            blob = b"".join((np.diff(key[x], prepend=np.uint64(0)).tobytes(), words[x].tobytes(), doc[x].tobytes(), a[x].astype("<i4").tobytes(), step.tobytes()))
            out.append((int(k), codec.compress(blob, asbytes=True), int(cuts[k + 1] - cuts[k])))
        return _batch(out, MATCHES, (pa.int32(), pa.binary(), pa.int64()))

    def run(batches):
        rows, held = [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, data, offsets in wh.chunks(b.column(1)):
                h, bounds, _, _ = wh.words(data, offsets)
                for r in range(i, j):
                    m = np.frombuffer(b.column(3)[r].as_py(), np.int32).reshape(-1, 3).astype(np.int64)
                    seed = np.flatnonzero(m[:, 2] == 0)
                    seed = seed[np.argsort(m[seed, 0], kind="stable")]
                    refs, pos = np.frombuffer(b.column(2)[r].as_py(), np.uint64)[seed], m[seed, 0]
                    got = edges(pos, wh.mix(refs * wh.MIX[0] + m[seed, 1].astype(np.uint64)), h[bounds[r - i] : bounds[r - i + 1]])
                    if got is None:
                        continue
                    a, z, key, words = got
                    inside = np.zeros(len(a), bool)
                    for s in b.column(4)[r].as_py() or ():
                        inside |= (a >= s["lo"]) & (z + K <= s["hi"])
                    rows.append((np.full(len(a), ids[r]), a, z, key, words, ~inside))
                    held += len(a)
                if held > PAIRS:
                    yield sent(rows)
                    rows, held = [], 0
        if rows:
            yield sent(rows)

    return run


def _pairs(ranges: int):
    """Buckets of edges, sorted by bucket: the matches of every edge that asks with the first text of each class of its words."""

    def solve(held):
        got = []
        for blob, n in held:
            raw = pa.Codec("zstd").decompress(blob, 29 * n, asbytes=True)
            key = np.cumsum(np.frombuffer(raw, np.uint64, n))
            step = np.frombuffer(raw, "<u1", n, 28 * n)
            got.append((key, np.frombuffer(raw, np.uint64, n, 8 * n), np.frombuffer(raw, np.int64, n, 16 * n), np.frombuffer(raw, "<i4", n, 24 * n).astype(np.int64), (step >> 1).astype(np.int64), step & 1 > 0))
        key, words, doc, pos, step, asks = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((pos, doc, words, key))
        key, words, doc, pos, step, asks = key[order], words[order], doc[order], pos[order], step[order], asks[order]
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new | np.append(True, words[1:] != words[:-1]))
        group = np.cumsum(new) - 1
        cuts = np.append(np.flatnonzero(new[first]), len(first))
        asking = np.flatnonzero(asks)
        many = np.diff(cuts)[group[asking]]
        ends = np.cumsum(many)
        lo = 0
        while lo < len(asking):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            n = many[lo:hi]
            f = np.repeat(asking[lo:hi], n)
            e = first[np.repeat(cuts[group[asking[lo:hi]]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
            earlier = doc[e] < doc[f]
            f, e = f[earlier], e[earlier]
            twice = lambda x: np.concatenate([x, x])
            yield _batch(_packed(ranges, twice(doc[f]), np.concatenate([pos[f], pos[f] + step[f]]), twice(doc[e]), np.concatenate([pos[e], pos[e] + step[e]]), np.zeros(2 * len(f), np.int64)), MATCHES, (pa.int32(), pa.binary(), pa.int64()))
            lo = hi

    def run(batches):
        held, now = [], None
        for b in batches:
            for bucket, m, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now and held:
                    yield from solve(held)
                    held = []
                now = bucket
                held.append((m, n))
        if held:
            yield from solve(held)

    return run


def reaching(parts: list[tuple[int, int]]) -> list[bool]:
    """Of spans (first word, end), whether each touches others, directly or not, with which it reaches over LEAST words."""
    out, group, lo, end = [False] * len(parts), [], 0, 0
    for k in [*sorted(range(len(parts)), key=lambda k: parts[k]), None]:
        if k is None or group and parts[k][0] > end + TOUCH:
            for g in group:
                out[g] = end - lo >= LEAST
            group = []
        if k is not None:
            lo, end = (lo, max(end, parts[k][1])) if group else parts[k]
            group.append(k)
    return out


def _windows(batches):
    """Each text with its matches of edges and its spans of the first round: the words of both texts to compare, where edges lie
    along a diagonal. Spans lie inside windows, so windows that with others and with those spans do not reach over LEAST words go."""
    for b in batches:
        ids, out = b.column(0).to_numpy(), []
        for i, j, data, offsets in wh.chunks(b.column(1)):
            h, bounds, _, _ = wh.words(data, offsets)
            h = h.astype(np.uint32)
            for r in range(i, j):
                w = h[bounds[r - i] : bounds[r - i + 1]]
                refs = np.frombuffer(b.column(2)[r].as_py(), np.int64)
                m = np.frombuffer(b.column(3)[r].as_py(), np.int32).reshape(-1, 3)[:, :2].astype(np.int64)
                mine = []
                for rows in np.split(np.arange(len(refs)), np.flatnonzero(refs[1:] != refs[:-1]) + 1):
                    # Two seeds REACH apart on both sides still make a chain at this cost of a gap.
                    for c in chains(m[rows], K / (4 * REACH), K, K):
                        lo, hi = max(0, int(c[0, 0]) - MARGIN), min(len(w), int(c[-1, 0]) + K + MARGIN)
                        low = max(0, int(c[0, 1]) - MARGIN)
                        mine.append((lo, hi, int(refs[rows[0]]), low, int(c[-1, 1]) + K + MARGIN - low))
                held = [(s["start"], s["start"] + s["n"]) for s in b.column(4)[r].as_py() or ()]
                wanted = reaching([x[:2] for x in mine] + held)
                out += [(int(ids[r]), ref, lo, w[lo:hi].tobytes(), *there) for (lo, hi, ref, *there), x in zip(mine, wanted, strict=False) if x]
        yield _batch(out, ("doc_id", "ref", "lo", "words", "ref_lo", "ref_n"), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()))


#: Words of windows whose common runs are found at once.
AT_ONCE = 1 << 15


def common_runs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[list[int], list[int]]]:
    """Of pairs of lists of words, the points (x, y) of all runs of K words that both share, one for K words of a diagonal, by x and y."""
    sides = []
    for side in zip(*pairs, strict=True):
        w, bounds = np.concatenate(side).astype(np.uint64), np.append(0, np.cumsum([len(x) for x in side]))
        n = max(0, len(w) - K + 1)
        runs = sum((w[d : d + n] * wh.MIX[d] for d in range(K)), np.zeros(n, np.uint64))
        owner = np.repeat(np.arange(len(side)), np.diff(bounds))[:n]
        fits = np.arange(n) + K <= bounds[1:][owner]
        owner, place = owner[fits], (np.arange(n) - bounds[:-1][owner])[fits]
        sides.append((runs[fits], owner, place))
    (x, x_owner, x_place), (y, y_owner, y_place) = sides
    # Runs are numbered by value, so that a run and its pair fit one number.
    code = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
    x, y = code[: len(x)] * len(pairs) + x_owner, code[len(x) :] * len(pairs) + y_owner
    order = np.argsort(y, kind="stable")
    lo, hi = (np.searchsorted(y[order], x, side) for side in ("left", "right"))
    n = hi - lo
    at = order[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] if len(x) else np.zeros(0, np.int64)
    owner, px, py = np.repeat(x_owner, n), np.repeat(x_place, n), y_place[at]
    # The first point of each diagonal in K words of a text.
    order = np.lexsort((px, px - py, px // K, owner))
    owner, px, py = owner[order], px[order], py[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (px[1:] // K != px[:-1] // K) | (px[1:] - py[1:] != px[:-1] - py[:-1]))[: len(px)]
    owner, px, py = owner[new], px[new], py[new]
    order = np.lexsort((py, px, owner))
    cuts = np.searchsorted(owner[order], np.arange(len(pairs) + 1)).tolist()
    px, py = px[order].tolist(), py[order].tolist()
    return [(px[i:j], py[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _compare(batches):
    """Words of two texts: chains of all runs that they share, aligned; not those within a span of a better chain, as in repeated lines."""

    def spans(r, words, other, xs, ys):
        held, a, b = bytearray(len(words) + K), words.tolist(), other.tolist()
        for c in _chains(xs, ys, GAP, K, 2 * K):
            x, y = [xs[k] for k in c], [ys[k] for k in c]
            if 0 not in held[x[0] : x[-1] + K]:
                continue
            for start, n, there, *rest in _good_spans(x, y, a, r["lo"], b):
                held[start - r["lo"] : start - r["lo"] + n] = b"\1" * n
                yield r["doc_id"], r["ref"], start, n, there + r["ref_lo"], *rest

    for b in batches:
        rows, out = b.to_pylist(), []
        pairs = [tuple(np.frombuffer(r[k], np.uint32) for k in ("words", "ref_words")) for r in rows]
        ends = np.cumsum([len(x) + len(y) for x, y in pairs])
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
            for r, pair, (xs, ys) in zip(rows[lo:hi], pairs[lo:hi], common_runs(pairs[lo:hi]), strict=True):
                if len(xs) > 1:
                    out += spans(r, *pair, xs, ys)
            lo = hi
        yield _batch(out, ("doc_id", "ref", "start", "n", "ref_start", "ref_n", "same"), (pa.int64(),) * 7)


def _words(batches):
    for b in batches:
        out = []
        for i, j, data, offsets in wh.chunks(b.column(1)):
            h, bounds, _, _ = wh.words(data, offsets)
            h = h.astype(np.uint32)
            out += [h[bounds[r] : bounds[r + 1]].tobytes() for r in range(j - i)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["ref", "ref_words"])


def equal_words(a: list[int], b: list[int]) -> int:
    """Words in common of an edit alignment of two gaps (longest common subsequence, a bit a word of a)."""
    if not a or not b:
        return 0
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if hit := row & at.get(y, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _extend(a, b, step_a, step_b) -> tuple[int, int]:
    """How far two word lists go together from their starts: (words, equal words) at the best net gain, one by one."""
    best = gain = same = kept = at = 0
    left = min(len(a), len(b))
    for k, (x, y) in enumerate(zip(a[::step_a], b[::step_b], strict=False), 1):
        if x == y:
            gain += 1
            same += 1
            if gain > best:
                best, kept, at = gain, same, k
        else:
            gain -= 2
            if gain + left - k <= best:  # no later gain can be the best one
                break
    return at, kept


def _gained(x: list[int], y: list[int], a: list[int], b: list[int]) -> list[int]:
    """Equal words that each point of a chain but the first adds to those before it: those of the gap, and its own beyond the run before."""
    out = []
    for p, q, u, v in zip(x, y, x[1:], y[1:], strict=False):
        near = min(u - p, v - q)
        out.append(max(0, near) if near < K else K + equal_words(a[p + K : u], b[q + K : v]))
    return out


def _reach(x: list[int], y: list[int], a: list[int], b: list[int]) -> tuple[int, int, int]:
    """(Words before a chain, words after it, equal words among them) by which its ends are extended."""
    end, there = x[-1] + K, y[-1] + K
    back, got = _extend(a[: x[0]], b[: y[0]], -1, -1)
    ahead, more = _extend(a[end:], b[there : there + MARGIN], 1, 1)
    return back, ahead, got + more


def align(chain: np.ndarray, words: np.ndarray, lo: int, other: np.ndarray) -> tuple[int, int, int, int, int]:
    """(first word, words, first word there, words there, equal words) of a chain; words begin at word lo of the text."""
    x, y, a, b = (chain[:, 0] - lo).tolist(), chain[:, 1].tolist(), words.tolist(), other.tolist()
    back, ahead, same = _reach(x, y, a, b)
    return lo + x[0] - back, x[-1] + K - x[0] + back + ahead, y[0] - back, y[-1] + K - y[0] + back + ahead, K + sum(_gained(x, y, a, b)) + same


def _worst(lost: list[int]) -> tuple[list[int], list[int], int]:
    """(left, right, root): the worst gap of all, then of those before and after it, and so on; of equal ones the first. -1: none."""
    left, right, path = [-1] * len(lost), [-1] * len(lost), []
    for k, x in enumerate(lost):
        below = -1
        while path and lost[path[-1]] < x:
            below = path.pop()
        left[k] = below
        if path:
            right[path[-1]] = k
        path.append(k)
    return left, right, path[0] if path else -1


def good_spans(chain: np.ndarray, words: np.ndarray, lo: int, other: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The spans of a chain, as align gives them, of SPAN words and IDENTITY or more; a part with less is split at its worst gap."""
    return _good_spans((chain[:, 0] - lo).tolist(), chain[:, 1].tolist(), words.tolist(), lo, other.tolist())


def _good_spans(x: list[int], y: list[int], a: list[int], lo: int, b: list[int]) -> list[tuple[int, int, int, int, int]]:
    """good_spans of a chain's places in the lists a, which begins at word lo of its text, and b."""
    good = lambda span: min(span[1], span[3]) >= SPAN and span[4] >= IDENTITY * max(span[1], span[3])
    before, after, same = _reach(x, y, a, b)
    if min(x[-1] - x[0], y[-1] - y[0]) + K + before + after < SPAN:
        return []
    got, n = _gained(x, y, a, b), len(x)
    sums = list(accumulate(got, initial=K))
    whole = lo + x[0] - before, x[-1] + K - x[0] + before + after, y[0] - before, y[-1] + K - y[0] + before + after, sums[-1] + same
    if good(whole) or n == 1:
        return [whole] if good(whole) else []
    lost = [max(x[k + 1] - x[k], y[k + 1] - y[k]) - g for k, g in enumerate(got)]
    left, right, root = _worst(lost)
    ends: list[tuple[tuple[int, int] | None, tuple[int, int] | None]] = [(None, None)] * n
    todo, out = [(0, n, root)], []
    while todo:
        i, j, k = todo.pop()
        low, low_there = (x[i - 1] + K, y[i - 1] + K) if i else (0, 0)
        top, top_there = (x[j], y[j]) if j < n else (len(a), len(b))
        end, there = x[j - 1] + K, y[j - 1] + K
        wide, wide_there, equal = end - x[i], there - y[i], sums[j - 1] - sums[i] + K
        most = max(0, min(MARGIN, x[i] - low, y[i] - low_there)) + max(0, min(MARGIN, top - end, top_there - there))
        # Words beyond the ends add as many to both sides and to the equal words at most: what then still falls short is not good.
        if min(wide, wide_there) + most >= SPAN and equal + most >= IDENTITY * (max(wide, wide_there) + most) - 1e-6:
            if ends[i][0] is None:
                ends[i] = _extend(a[max(low, x[i] - MARGIN) : x[i]], b[max(low_there, y[i] - MARGIN) : y[i]], -1, -1), ends[i][1]
            if ends[j - 1][1] is None:
                ends[j - 1] = ends[j - 1][0], _extend(a[end : min(top, end + MARGIN)], b[there : min(top_there, there + MARGIN)], 1, 1)
            (back, same), (ahead, more) = ends[i][0], ends[j - 1][1]
            span = lo + x[i] - back, wide + back + ahead, y[i] - back, wide_there + back + ahead, equal + same + more
            if good(span):
                out.append(span)
                continue
        if k >= 0 and lost[k] > 0:
            todo += [(i, k + 1, left[k]), (k + 1, j, right[k])]
    return out


def _align(batches):
    for b in batches:
        out = []
        for r in b.to_pylist():
            chain = np.frombuffer(r["chain"], np.int32).reshape(-1, 2) - np.array([0, r["ref_lo"]])
            found = good_spans(chain, np.frombuffer(r["words"], np.uint32), r["lo"], np.frombuffer(r["ref_words"], np.uint32))
            out += [(r["doc_id"], r["ref"], start, n, there + r["ref_lo"], *rest) for start, n, there, *rest in found]
        yield _batch(out, ("doc_id", "ref", "start", "n", "ref_start", "ref_n", "same"), (pa.int64(),) * 7)


def _passages(batches):
    """Each text's aligned spans: passages of spans that touch."""
    for b in batches:
        out = []
        for doc, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            spans = sorted((s["start"], s["start"] + s["n"], s["ref"], s["same"], s["n"], s["ref_start"]) for s in spans)
            group, reach = [], -1
            for s in [*spans, None]:
                if s is None or group and s[0] > reach + TOUCH:
                    lo = group[0][0]
                    if reach - lo >= LEAST:
                        best = max(group, key=lambda g: (g[4], -g[2]))
                        out.append((doc, lo, reach - lo, sorted({g[2] for g in group}), best[2], best[5], best[4], round(best[3] / best[4], 6), False))
                    group, reach = [], -1
                if s is not None:
                    group.append(s)
                    reach = max(reach, s[1])
        yield _batch(out, ("doc_id", "start_word", "n_words", "refs", "best_ref", "best_start", "best_words", "identity", "copy"), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))


RESULT = "doc_id long, start_word long, n_words long, refs array<long>, best_ref long, best_start long, best_words long, identity double, copy boolean"


def _counted(batches):
    for b in batches:
        n = []
        for _, _, data, offsets in wh.chunks(b.column(1)):
            n += np.diff(wh.words(data, offsets)[1]).tolist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "rep", "n"])


def _aligned(own: DataFrame, joined: DataFrame, find, kinds: str, align) -> DataFrame:
    """Spans, as align gives them, of what find finds in the texts, beside the words of the earlier texts."""
    found = cut(joined.mapInArrow(lean(find), kinds))
    named = small(cut(found.select(F.col("ref").alias("doc_id")).distinct()), 8)
    words = cut(own.join(named, "doc_id", "left_semi").mapInArrow(lean(_words), "ref long, ref_words binary"))
    # Of the earlier text only the words at the chain leave the join.
    near = found.join(words, "ref").withColumn("ref_words", F.expr("substring(ref_words, 4 * ref_lo + 1, 4 * ref_n)")).drop("ref_n")
    return near.mapInArrow(lean(align), "doc_id long, ref long, start long, n long, ref_start long, ref_n long, same long")


def _collected(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "ref", "same", "ref_start")).alias("spans")).mapInArrow(_passages, RESULT)


def fuzzy_passages(docs: DataFrame) -> DataFrame:
    """One row for each passage of a document that an earlier one holds, exactly or nearly.

    doc_id, start_word and n_words of the passage; refs, the earlier documents that it was found in; best_ref, best_start,
    best_words and identity of the longest alignment. A copy of a whole earlier text has copy set and that one passage.
    """
    spark = docs.sparkSession
    docs = keyed(docs, "doc_id", "text").where("text is not null")
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    twice = docs.join(small(again, 8), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    docs = docs.join(small(again, 8), "doc_id", "left_anti").unionByName(twice)
    sizes = docs.select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("size"))
    first = cut(sizes.groupBy("h").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.sum("size").alias("size")))
    total = first.agg(F.sum("size")).first()[0] or 0
    n = partitions(spark, total, 24 << 20)
    copies = cut(sizes.select("doc_id", "h").join(first.where("rep < last").select("h", "rep"), "h").where("doc_id <> rep").select("doc_id", "rep").distinct())
    own = docs.join(small(copies.select("doc_id"), 8), "doc_id", "left_anti")
    reports = own.mapInArrow(lean(_report(4 * n)), REPORT_SQL).repartition(n, "bucket").sortWithinPartitions("bucket")
    met = cut(reports.mapInArrow(lean(_meet(n)), REPORT_SQL), "lz4")
    crowds, answers = met.where("key is not null and names is not null").select("key", "names", "m"), met.where("key is not null and names is null").select("key", "doc_id", "at")
    matches = met.where("key is null").select(*MATCHES).unionByName(crowds.join(answers, "key").mapInArrow(lean(_answered(n)), MATCHES_SQL))
    matches = cut(matches.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_gather), "doc_id long, refs binary, m binary"), "lz4")
    drop(met)
    joined = own.join(matches.hint("merge"), "doc_id").select("doc_id", "text", "refs", "m")
    spans = cut(_aligned(own, joined, _chain, "doc_id long, ref long, chain binary, lo int, words binary, ref_lo int, ref_n int", _align))
    covered = _collected(spans).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_word").alias("lo"), F.expr("start_word + n_words").alias("hi"))).alias("covered"))
    asked = joined.join(covered, "doc_id", "left").select("doc_id", "text", "refs", "m", "covered")
    sides = asked.mapInArrow(lean(_edges(n)), EDGES_SQL).repartition(n, "bucket").sortWithinPartitions("bucket")
    pairs = cut(sides.mapInArrow(lean(_pairs(n)), MATCHES_SQL), "lz4")
    drop(matches)
    pairs = cut(pairs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_gather), "doc_id long, refs binary, m binary"), "lz4")
    met = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("met"))
    joined = own.join(pairs.join(met, "doc_id", "left").hint("merge"), "doc_id").select("doc_id", "text", "refs", "m", "met")
    more = _aligned(own, joined, _windows, "doc_id long, ref long, lo int, words binary, ref_lo int, ref_n int", _compare)
    passages = _collected(spans.unionByName(more))
    whole = docs.join(small(copies, 16), "doc_id").select("doc_id", "text", "rep").mapInArrow(_counted, "doc_id long, rep long, n long").where(F.col("n") >= LEAST)
    zero, one = F.lit(0).cast("long"), F.lit(1.0)
    whole = whole.select("doc_id", zero.alias("start_word"), F.col("n").alias("n_words"), F.array("rep").alias("refs"), F.col("rep").alias("best_ref"), zero.alias("best_start"), F.col("n").alias("best_words"), one.alias("identity"), F.lit(True).alias("copy"))
    return passages.unionByName(whole)


def op1_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a repeated passage of a document."""
    return fuzzy_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE: dict[str, str] = {}
QUERIES = {"op1_fuzzy_passages": op1_fuzzy_passages}
