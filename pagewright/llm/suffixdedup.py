"""Suffix-array dedup: remove every byte that a 50-byte string covers which also starts in a document with a smaller id.

Each window of 50 bytes has a minimizer, the smallest hash among its 20-byte strings. Consecutive windows with one minimizer
form a piece. Equal windows have equal minimizers, so pieces can be dealt out by minimizer and every shard decides its windows
by itself, exactly:

1. Every batch of texts reports its distinct minimizers; those of two documents or more are shared. A document gets back
   16-bit tags of its shared minimizers: a tag that fits by chance adds a piece to the next step and changes no result.
2. Pieces with a shared minimizer go to the shard of that minimizer, equal pieces of a batch as one.
3. A shard keeps one copy of equal pieces, with their smallest document; a copy in another document goes whole. A window of a piece
   can only equal windows of pieces with the same minimizer, so pieces that are alone with theirs are settled. The suffixes of
   all others are sorted by external induced sorting (induce.py), and windows whose common prefix is 50 bytes or more form a
   group. A window goes if its group holds a smaller document.
4. Spans return to their documents, packed for each shard and range of documents, are merged, and cut out.

Hot lines and groups of copies cost one report and one piece a batch before they move. Documents join what comes back by id.

Edge cases: a null text counts as empty; texts under 50 bytes lose nothing; matches never cross documents; rows with a null
doc_id are left out; rows that repeat a doc_id hold one document's text and lose the same bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induce
from . import wordhash as wh
from .common import cut, drop, keyed, lean, partitions, table

WINDOW, SEED = 50, 20
#: Bytes of text for a shard, and longest stretch of a text that is hashed at once (stretches overlap by a window).
SHARD_TEXT, STRETCH = 16 << 20, 1 << 18
#: Bytes of text whose pieces are packed together.
PACK = 8 << 20
LOW = 22


def pieces(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, seed: int = SEED):
    """(row, first byte in the row, length, minimizer hash) of all pieces of the rows' bytes."""
    out = []
    starts, ends, rows, shift = [], [], [], []
    for r in range(len(offsets) - 1):
        lo, hi = int(offsets[r]), int(offsets[r + 1])
        if hi - lo <= STRETCH:
            starts.append(lo), ends.append(hi), rows.append(r), shift.append(lo)
            continue
        for s in range(lo, hi - window + 1, STRETCH - window + 1):
            starts.append(s), ends.append(min(hi, s + STRETCH)), rows.append(r), shift.append(lo)
    starts, ends, rows, shift = (np.array(x, np.int64) for x in (starts, ends, rows, shift))
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(np.cumsum(ends[i:] - starts[i:]), STRETCH, "right")) + i
        j = max(j, i + 1)
        lo, hi = int(starts[i]), int(ends[j - 1])
        out.append(_pieces(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo, rows[i:j], shift[i:j] - lo, window, seed))
        i = j
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pieces(data, starts, ends, rows, shift, window, seed):
    n, width = len(data), window - seed + 1
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    up, down = wh.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(wh.BYTE[data] * up[:n], out=total[1:])
    full = wh.mix((total[seed:] - total[:-seed]) * down[: n + 1 - seed])
    low = np.uint64((1 << LOW) - 1)
    least = (full & ~low) | np.arange(len(full), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    count = np.maximum(ends - starts - window + 1, 0)
    inside = np.repeat(starts - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
    owner = np.repeat(np.arange(len(starts)), count)
    at = (least[inside] & low).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    who = owner[first]
    return rows[who], inside[first] - shift[who], inside[last] - inside[first] + window, full[at[first]]


def tags(h: np.ndarray) -> np.ndarray:
    """16-bit tags of minimizers, from bits that neither buckets nor shards use."""
    return (h >> np.uint64(48)).astype(np.uint16)


def _report(buckets: int):
    """Distinct minimizers of each batch for their buckets; the tags of those that two documents of the batch share."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, _, data, offsets in wh.chunks(b.column(1), lower=False, limit=PACK):
                row, _, _, h = pieces(data, offsets)
                if not len(row):
                    continue
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[fresh], row[fresh]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                times = np.diff(np.append(np.flatnonzero(new), len(h)))
                shared = np.repeat(times > 1, times)
                out = [(*r, None, None, None, None) for r in _rows(ids[i + row[shared]], h[shared], buckets)]
                send = np.flatnonzero(new)
                flag, sh, sr = times > 1, h[send], row[send]
                where = (sh % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    x = order[cuts[k] : cuts[k + 1]]
                    names, at = np.unique(sr[x], return_inverse=True)
                    out.append((int(k), None, None, _narrow(sh[x]), (at.astype(np.uint32) * np.uint32(2) + flag[x]).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), ids[i + names].tobytes(), len(x)))
                yield _batch(out, ("bucket", "doc_id", "tags", "hs", "at", "names", "n"), (pa.int32(), pa.int64(), *(pa.binary(),) * 4, pa.int32()))

    return run


def _narrow(h: np.ndarray) -> bytes:
    """The 24 + 16 highest bits of each hash: within a bucket, five bytes tell minimizers apart."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _rows(doc, h, buckets: int):
    """A row for each document with the tags of its hashes; its bucket only spreads the rows."""
    if not len(doc):
        return []
    order = np.argsort(doc, kind="stable")
    doc, t = doc[order], tags(h)[order]
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    return [(int(doc[a]) % buckets, int(doc[a]), t[a:z].tobytes()) for a, z in zip(cuts, [*cuts[1:], len(doc)], strict=True)]


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], list(names))


def _grouped(batches, key: str):
    """Lists of a key's rows; rows come sorted by the key."""
    held, now = [], None
    for b in batches:
        for k in range(b.num_rows):
            r = {n: c[k].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
            if r[key] != now and held:
                yield now, held
                held = []
            now = r[key]
            held.append(r)
    if held:
        yield now, held


def _answer(batches):
    """Which reported minimizers are shared: tags to the documents that reported them alone in their batch, and known tags."""
    for _, rows in _grouped(batches, "bucket"):
        out = [(r["doc_id"], r["tags"]) for r in rows if r["tags"] is not None]
        rows = [r for r in rows if r["tags"] is None]
        if rows:
            n = sum(r["n"] for r in rows)
            h = np.zeros((n, 8), np.uint8)
            h[:, 3:] = np.frombuffer(b"".join(r["hs"] for r in rows), np.uint8).reshape(-1, 5)
            h = h.view("<u8").ravel()
            at = np.zeros((n, 4), np.uint8)
            at[:, :3] = np.frombuffer(b"".join(r["at"] for r in rows), np.uint8).reshape(-1, 3)
            at = at.view("<u4").ravel()
            flag = (at & 1).astype(bool)
            ends = np.cumsum([r["n"] for r in rows])
            doc = np.concatenate([np.frombuffer(r["names"], np.int64)[(at[z - r["n"] : z] >> 1).astype(np.int64)] for r, z in zip(rows, ends, strict=True)])
            order = np.argsort(h, kind="stable")
            h, doc, flag = h[order], doc[order], flag[order]
            new = np.append(True, h[1:] != h[:-1])
            start = np.flatnonzero(new)
            shared = np.logical_or.reduceat(flag, start) | (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start))
            tell = np.repeat(shared, np.diff(np.append(start, n))) & ~flag
            out += [r[1:] for r in _rows(doc[tell], h[tell], 1)]
        for lo in range(0, len(out), 20000):
            yield _batch(out[lo : lo + 20000], ("doc_id", "tags"), (pa.int64(), pa.binary()))


def _gather(batches):
    """One row a document with all its tags; rows come sorted by doc_id."""
    out = []
    for doc, rows in _grouped(batches, "doc_id"):
        out.append((doc, np.unique(np.frombuffer(b"".join(r["tags"] for r in rows), np.uint16)).tobytes()))
        if len(out) == 20000:
            yield _batch(out, ("doc_id", "known"), (pa.int64(), pa.binary()))
            out = []
    if out:
        yield _batch(out, ("doc_id", "known"), (pa.int64(), pa.binary()))


def _deal(shards: int):
    """Pieces with a shared minimizer, to the minimizers' shards; equal pieces of a batch once, with all their places."""

    def run(batches):
        codec = pa.Codec("zstd", 3)
        for b in batches:
            ids, known = b.column(0).to_numpy(), b.column(2)
            for i, j, data, offsets in wh.chunks(b.column(1), lower=False, limit=PACK):
                row, at, size, h = pieces(data, offsets)
                cuts, tag = np.searchsorted(row, np.arange(j - i + 1)), tags(h)
                keep, wanted = np.zeros(len(row), bool), np.zeros(1 << 16, bool)
                for r in range(j - i):
                    mine = np.frombuffer(known[i + r].as_py() or b"", np.uint16)
                    wanted[mine] = True
                    keep[cuts[r] : cuts[r + 1]] = wanted[tag[cuts[r] : cuts[r + 1]]]
                    wanted[mine] = False
                row, at, size, h = row[keep], at[keep], size[keep], h[keep]
                if not len(row):
                    continue
                raw, lo = data.tobytes(), offsets[row] + at
                names: dict[bytes, int] = {}
                which = np.fromiter((names.setdefault(raw[s : s + z], len(names)) for s, z in zip(lo.tolist(), size.tolist(), strict=True)), np.int64, len(row))
                text = list(names)
                shard = np.zeros(len(text), np.int64)
                shard[which] = (wh.mix(h) % np.uint64(shards)).astype(np.int64)
                out, by = [], np.argsort(shard, kind="stable")
                ends = np.searchsorted(shard[by], np.arange(shards + 1))
                place = np.argsort(shard[which], kind="stable")
                places = np.searchsorted(shard[which][place], np.arange(shards + 1))
                local = np.empty(len(text), np.int64)
                local[by] = np.arange(len(by)) - np.repeat(ends[:-1], np.diff(ends))
                for k in np.flatnonzero(np.diff(ends)):
                    x = place[places[k] : places[k + 1]]
                    parts = [text[m] for m in by[ends[k] : ends[k + 1]]]
                    # Places in the order of their documents, so that numbers in a row are small and alike.
                    docs, doc = np.unique(row[x], return_inverse=True)
                    sizes = np.array([len(p) for p in parts], np.uint16)
                    numbers = np.concatenate([local[which[x]].astype("<u4").view(np.uint8), np.diff(doc, prepend=0).astype("<i4").view(np.uint8), at[x].astype("<u4").view(np.uint8)])
                    blob = b"".join(parts) + numbers.tobytes()
                    out.append((int(k), codec.compress(blob, asbytes=True), len(blob), codec.compress(sizes.tobytes(), asbytes=True), len(parts), len(x), ids[i + docs].tobytes()))
                yield _batch(out, ("shard", "blob", "size", "sizes", "parts", "places", "docs"), (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))

    return run


def _unpacked(r: dict):
    """(pieces, piece of each place, document of each place, first byte of each place) of a dealt row."""
    codec = pa.Codec("zstd")
    blob = codec.decompress(r["blob"], r["size"], asbytes=True)
    sizes = np.frombuffer(codec.decompress(r["sizes"], 2 * r["parts"], asbytes=True), np.uint16).astype(np.int64)
    ends, n = np.cumsum(sizes), r["places"]
    end = int(ends[-1])
    which, doc, at = (np.frombuffer(blob, kind, n, end + 4 * n * k).astype(np.int64) for k, kind in enumerate(("<u4", "<i4", "<u4")))
    parts = [blob[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return parts, which, np.frombuffer(r["docs"], np.int64)[np.cumsum(doc)], at


def repeated(parts: list[bytes], doc: np.ndarray, window: int = WINDOW, budget: int = induce.BUDGET, base: int = induce.BASE) -> np.ndarray:
    """For each byte of the joined parts (distinct strings, doc their documents): whether its window also starts in a smaller document's part."""
    sizes = np.array([len(p) for p in parts], np.int64)
    n = int(sizes.sum() + len(parts) + 1)
    t = induce.scratch(n, np.uint16, budget)
    ends = np.cumsum(sizes + 1)
    t[:-1] = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    t[:-1] += 2
    t[ends - 1] = 1
    t[-1] = 0
    flagged = np.zeros(n, bool)
    for pos, lcp in induce.sorted_suffixes(t, window, budget, base):
        new = lcp < window
        new[0] = True
        ok = np.flatnonzero(pos < n - 1)
        owner = np.searchsorted(ends, pos[ok], "right")
        whole = ends[owner] - 1 - pos[ok] >= window
        ok, owner = ok[whole], owner[whole]
        if not len(ok):
            continue
        group = np.cumsum(new)[ok]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        d = doc[owner]
        flagged[pos[ok]] = d > np.repeat(np.minimum.reduceat(d, start), np.diff(np.append(start, len(d))))
    inner = np.ones(n, bool)
    inner[ends - 1] = False
    inner[-1] = False
    return flagged[inner]


def rivals(parts: list[bytes], window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    """The parts (numbers, ascending) whose minimizer another part has as well; a part's windows share one minimizer."""
    h = np.zeros(len(parts), np.uint64)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(parts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + STRETCH, "right")))
        row, _, _, got = pieces(np.frombuffer(b"".join(parts[i:j]), np.uint8), np.append(0, np.cumsum(sizes[i:j])), window, seed)
        h[i + row] = got
        i = j
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    return np.sort(order[np.append(False, same) | np.append(same, False)])


def _decide(ranges: int):
    """A shard: pieces, their documents and places in; spans of bytes to remove out, a row for each range of documents."""

    def run(batches):
        for _, rows in _grouped(batches, "shard"):
            names: dict[bytes, int] = {}
            string, docs, at = [], [], []
            for r in rows:
                parts, which, d, a = _unpacked(r)
                ids = np.fromiter((names.setdefault(p, len(names)) for p in parts), np.int64, len(parts))
                string.append(ids[which].astype(np.int32))
                docs.append(d)
                at.append(a)
            string, docs, at = np.concatenate(string), np.concatenate(docs), np.concatenate(at)
            least = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(least, string, docs)
            parts = list(names)
            del names, rows
            sizes = np.array([len(p) for p in parts], np.int64)
            mixed = rivals(parts)
            flagged = repeated([parts[k] for k in mixed], least[mixed]) if len(mixed) else np.zeros(0, bool)
            begin = np.cumsum(sizes[mixed]) - sizes[mixed]
            f = np.flatnonzero(flagged)
            owner = np.searchsorted(begin, f, "right") - 1
            start = f - begin[owner]
            # runs of flagged windows of one piece become one span
            new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)) if len(f) else np.zeros(0, bool)
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(f))[: len(a)] - 1
            span_owner, span_lo, span_hi = mixed[owner[a]], start[a], start[z] + WINDOW
            bounds = np.searchsorted(span_owner, np.arange(len(parts) + 1))
            later = docs > least[string]
            d, lo, hi = [docs[later]], [at[later]], [at[later] + sizes[string[later]]]
            own = np.flatnonzero(~later)
            many = bounds[string[own] + 1] - bounds[string[own]]
            own, many = own[many > 0], many[many > 0]
            pick = np.repeat(bounds[string[own]] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
            d.append(np.repeat(docs[own], many))
            lo.append(np.repeat(at[own], many) + span_lo[pick])
            hi.append(np.repeat(at[own], many) + span_hi[pick])
            d, lo, hi = merged_spans(np.concatenate(d), np.concatenate(lo), np.concatenate(hi))
            where = (wh.mix(d.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
            by = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[by], np.arange(ranges + 1))
            codec, out = pa.Codec("zstd", 1), []
            for k in np.flatnonzero(np.diff(cuts)):
                x = by[cuts[k] : cuts[k + 1]]
                blob = b"".join(y.astype(kind).tobytes() for y, kind in ((np.diff(d[x], prepend=0), "<i8"), (lo[x], "<u4"), (hi[x] - lo[x], "<u4")))
                out.append((int(k), codec.compress(blob, asbytes=True), len(x)))
            if out:
                yield _batch(out, ("range", "blob", "n"), (pa.int32(), pa.binary(), pa.int32()))

    return run


def merged_spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """(document, first byte, byte after the last) of the maximal runs of the documents' spans, by document and byte."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    other = np.append(True, doc[1:] != doc[:-1])
    rank = np.cumsum(other) << 40  # keeps documents apart: no text has 2^40 bytes
    reach = np.maximum.accumulate(hi + rank)
    first = np.flatnonzero(np.append(True, (lo + rank)[1:] > reach[:-1]))
    return doc[first], lo[first], reach[np.append(first[1:], len(doc)) - 1] - rank[first]


def _collect(batches):
    """A range of documents: the spans of each, merged, as packed pairs."""
    codec = pa.Codec("zstd")
    for _, rows in _grouped(batches, "range"):
        doc, lo, hi = [], [], []
        for r in rows:
            n = r["n"]
            blob = codec.decompress(r["blob"], 16 * n, asbytes=True)
            doc.append(np.cumsum(np.frombuffer(blob, "<i8", n)))
            lo.append(np.frombuffer(blob, "<u4", n, 8 * n).astype(np.int64))
            hi.append(np.frombuffer(blob, "<u4", n, 12 * n).astype(np.int64) + lo[-1])
        doc, lo, hi = merged_spans(np.concatenate(doc), np.concatenate(lo), np.concatenate(hi))
        spans = np.stack([lo, hi], axis=1)
        cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        for k in range(0, len(cuts) - 1, 20000):
            part = cuts[k : k + 20001]
            yield _batch([(int(doc[x]), spans[x:y].tobytes()) for x, y in zip(part[:-1], part[1:], strict=True)], ("doc_id", "spans"), (pa.int64(), pa.binary()))


def without(raw: bytes, gone: np.ndarray) -> bytes:
    """The bytes outside the spans."""
    edges = [0, *gone.ravel().tolist(), len(raw)]
    return b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))


def _cutter(batches):
    for b in batches:
        sizes, removed, runs, digests = [], [], [], []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            gone = np.frombuffer(spans or b"", np.int64).reshape(-1, 2)
            rest = without(raw, gone)
            sizes.append(len(raw))
            removed.append(len(raw) - len(rest))
            runs.append(len(gone))
            digests.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _found(docs: DataFrame, side: DataFrame) -> DataFrame:
    """docs left-joined with side (a cut) by doc_id, always by shuffle, so that every size behaves alike."""
    return docs.join(side.hint("merge"), "doc_id", "left")


def _spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the byte spans to remove, as packed pairs, of every document that loses any."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark, total, 2 * SHARD_TEXT)
    reports = docs.mapInArrow(lean(_report(4 * n)), "bucket int, doc_id long, tags binary, hs binary, at binary, names binary, n int")
    told = reports.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_answer), "doc_id long, tags binary")
    shared = cut(told.repartition(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(lean(_gather), "doc_id long, known binary"))
    mine = _found(docs, shared).where("known is not null").select("doc_id", "text", "known")
    dealt = mine.mapInArrow(lean(_deal(2 * n)), "shard int, blob binary, size long, sizes binary, parts long, places long, docs binary")
    spans = dealt.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(lean(_decide(n)), "range int, blob binary, n int")
    spans = cut(spans.repartition(n, "range").sortWithinPartitions("range").mapInArrow(lean(_collect), "doc_id long, spans binary"))
    drop(shared)
    return spans


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): every document, and what is left of its bytes."""
    docs = keyed(docs, "doc_id", "text")
    out = _found(docs, _spans(docs)).select("doc_id", "text", "spans")
    return out.mapInArrow(lean(_cutter), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_substrings(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut out of text; of a character that a cut splits, the bytes that are left go too."""
    spans = _spans(keyed(docs, "doc_id", "text")).select("doc_id", F.col("spans").alias("__spans"))
    work = docs.withColumn("__key", F.col("doc_id").cast("long")).join(spans.withColumnRenamed("doc_id", "__doc").hint("merge"), F.col("__key") == F.col("__doc"), "left")
    work = work.select(*(docs[c] for c in docs.columns), "__spans")
    place = docs.columns.index("text")

    def rewrite(batches):
        for b in batches:
            out = []
            for text, spans in zip(b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if text is not None and spans:
                    text = without(text.encode("utf-8", "surrogatepass"), np.frombuffer(spans, np.int64).reshape(-1, 2)).decode("utf-8", "ignore")
                out.append(text)
            columns = b.columns[:-1]
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return work.mapInArrow(lean(rewrite), docs.schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its bytes, those removed and in how many runs, the digest of the rest."""
    return dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE: dict[str, str] = {}
QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
