"""External induced sorting of suffixes with common-prefix values.

The string's last symbol is its only smallest one. Suffixes are S (smaller than the next) or L (larger); a leftmost S after an L
is LMS. LMS substrings get names in their order, the string of names is sorted by recursion, and what comes back induces all
L suffixes, these all S suffixes. An induction is a walk over the symbols in order: a queue with a range of symbols as its
key hands out the tuples (suffix, common prefix with the tuple before) of the current range, in the order in which they
were pushed; each suffix whose predecessor is of the induced kind pushes that predecessor to the predecessor's own range. The
common prefix of two pushed neighbours is one more than the least common prefix between their sources.

Tuples are handled in blocks by vector operations. The queues keep blocks in memory up to a budget and spill the rest to a
scratch file; sorted L suffixes, which the second induction reads backward, lie in such a queue as well. A string beyond the
budget is kept in scratch files too, mapped into memory. Scratch files belong to one attempt of one task and are gone when
it ends, however it ends.

Suffixes that agree in cap symbols or more may come in any order among themselves; common prefixes are cut at cap.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of tuples that a queue keeps in memory, and symbols below which a string of names is sorted in memory.
BUDGET, BASE = 16 << 20, 1 << 16
#: Most ranges of symbols at a time, where the alphabet is large.
RANGES = 64
PAIR = np.dtype([("pos", np.int64), ("lcp", np.int32)])


class DiskQueue:
    """A priority queue of blocks: keys are small integers, a key's blocks come out in the order in which they went in."""

    def __init__(self, budget: int = BUDGET):
        self.budget, self.held, self.size, self.file, self.spilled = budget, {}, 0, None, 0

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        block = np.empty(len(pos), PAIR)
        block["pos"], block["lcp"] = pos, lcp
        self.held.setdefault(key, []).append(block)
        self.size += block.nbytes
        if self.size > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="induce-")  # noqa: SIM115
        self.file.seek(0, 2)
        for key, blocks in self.held.items():
            for k, b in enumerate(blocks):
                if isinstance(b, np.ndarray) and len(b):
                    at = self.file.tell()
                    self.file.write(b.tobytes())
                    blocks[k] = (at, len(b))
                    self.spilled += b.nbytes
            self.held[key] = blocks
        self.size = 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a key; they leave the queue."""
        out = []
        for b in self.held.pop(key, []):
            if isinstance(b, tuple):
                self.file.seek(b[0])
                b = np.frombuffer(self.file.read(b[1] * PAIR.itemsize), PAIR)
            else:
                self.size -= b.nbytes
            out.append(b)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        block = np.concatenate(out) if len(out) > 1 else out[0]
        return block["pos"].copy(), block["lcp"].copy()

    def close(self) -> None:
        self.held = {}
        if self.file is not None:
            self.file.close()


def scratch(n: int, dtype, budget: int) -> np.ndarray:
    """An array of n values: in memory, or beyond the budget in an unlinked scratch file."""
    if n * np.dtype(dtype).itemsize <= budget:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile(prefix="induce-") as f:
        return np.memmap(f, dtype, "w+", shape=(n,))


def least_between(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """min of values[after + 1 .. upto] of each query (after < upto)."""
    out, span = np.empty(len(after), values.dtype), upto - after
    level, row = 0, values
    while True:
        mine = np.flatnonzero((span >= 1 << level) & (span < 2 << level))
        if len(mine):
            out[mine] = np.minimum(row[after[mine] + 1], row[upto[mine] - (1 << level) + 1])
        if not (span >= 2 << level).any():
            return out
        row = np.minimum(row[: -(1 << level)], row[1 << level :])
        level += 1


def classify(t: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(is S, run of equal symbols from here on, cut at 2^15 - 1), from right to left in chunks."""
    n = len(t)
    is_s, run = scratch(n, bool, budget), scratch(n, np.int16, budget)
    is_s[n - 1], run[n - 1] = True, 1
    hi, step = n - 1, 4 << 20
    while hi > 0:
        lo = max(0, hi - step)
        a, b = t[lo:hi], t[lo + 1 : hi + 1]
        differs = np.flatnonzero(a != b)
        nxt = np.searchsorted(differs, np.arange(hi - lo))
        inside = nxt < len(differs)
        end = np.where(inside, differs[np.minimum(nxt, len(differs) - 1)] if len(differs) else 0, 0)
        rising = np.zeros(hi - lo, bool)
        rising[differs] = a[differs] < b[differs]
        is_s[lo:hi] = np.where(inside, rising[end], is_s[hi])
        run[lo:hi] = np.minimum(np.where(inside, end - np.arange(hi - lo) + 1, hi - lo - np.arange(hi - lo) + int(run[hi])), 32767)
        hi = lo
    return is_s, run


def name_substrings(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in the order of (symbol, kind) strings, and how many there are."""
    size = np.append(np.diff(lms) + 1, 1)
    top = 2 * (int(t.max()) + 1)
    names, depth = np.zeros(len(lms), np.int64), 0
    live, count = np.arange(len(lms)), 1
    each = 1
    while (top + 1) ** (each + 1) * 2 < 1 << 40 and each < 6:
        each += 1
    while len(live):
        key = np.zeros(len(live), np.int64)
        for d in range(depth, depth + each):
            at = np.minimum(lms[live] + d, len(t) - 1)
            symbol = np.where(d < size[live], 2 * t[at].astype(np.int64) + is_s[at] + 1, 0)
            key = key * (top + 1) + symbol
        # Refine: equal names are split by the next symbols, and names keep their order.
        order = np.lexsort((key, names[live]))
        n, k = names[live][order], key[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (n[1:] != n[:-1]) | (k[1:] != k[:-1])
        first = np.ones(len(order), bool)
        first[1:] = n[1:] != n[:-1]
        # A group's names start at its old name, whose members all are live; so gaps of old names suffice.
        start = np.flatnonzero(first)
        place = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        inner = place - np.repeat(start, np.diff(np.append(start, len(order))))[place]
        names[live[order]] = n + inner[group]
        sizes = np.diff(np.append(place, len(order)))
        more = (sizes > 1)[group]
        depth += each
        live = live[order][more]
        live = live[size[live] > depth]
        count = 0
    distinct, names = np.unique(names, return_inverse=True)
    del count
    return names.astype(np.int64), len(distinct)


def sort_in_memory(r: np.ndarray, cap: int) -> np.ndarray:
    """Positions in the order of their suffixes by at least cap symbols: ranks of prefixes of doubled length.

    A rank is the place of its group's first member in the order, so groups of one are settled and stay as they are.
    """
    n, k = len(r), 1
    order = np.argsort(r, kind="stable")
    new = np.append(True, r[order][1:] != r[order][:-1])
    rank = np.empty(n, np.int64)
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    open_ = place[~(new & np.append(new[1:], True))]
    while len(open_) and k < cap:
        mine = order[open_]
        after = np.where(mine + k < n, rank[np.minimum(mine + k, n - 1)] + 1, 0)
        by = np.argsort(rank[mine] * (n + 1) + after)
        mine, after = mine[by], after[by]
        old = rank[mine]
        order[open_] = mine
        new = np.append(True, (old[1:] != old[:-1]) | (after[1:] != after[:-1]))
        rank[mine] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        k *= 2
    return order


def common_prefixes(t: np.ndarray, order: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix of order with the one before, cut at cap; known symbols are not compared again.

    Symbols of 16 bits are compared four at a time; the unique last symbol ends every comparison in time.
    """
    out = np.minimum(known, cap).astype(np.int32)
    out[0] = 0
    live, n = np.arange(1, len(order)), len(t)
    if t.dtype == np.uint16:
        padded = np.concatenate([t, np.zeros(3, np.uint16)])
        four = padded[:n].astype(np.uint64)
        for k in (1, 2, 3):
            four |= padded[k : n + k].astype(np.uint64) << np.uint64(16 * k)
        while len(live):
            live = live[out[live] < cap]
            x = four[order[live] + out[live]] ^ four[order[live - 1] + out[live]]
            same = (x & np.uint64(0xFFFF) == 0).astype(np.int32) + (x & np.uint64(0xFFFFFFFF) == 0) + (x & np.uint64(0xFFFFFFFFFFFF) == 0) + (x == 0)
            out[live] += same
            live = live[same == 4]
        return np.minimum(out, cap)
    while len(live):
        live = live[out[live] < cap]
        a, b = order[live] + out[live], order[live - 1] + out[live]
        same = (a < n) & (b < n)
        same[same] = t[a[same]] == t[b[same]]
        live = live[same]
        out[live] += 1
    return out


def _induce(t, is_s, run, kind: bool, flip: bool, seeds, bounds, cap: int, budget: int):
    """Walk symbol ranges upward (flip: over the reversed alphabet) and induce the suffixes with is_s == kind.

    seeds(range) gives (pos, lcp) of the other kind in walking order. Yields for each range (pos, lcp, induced) in walking
    order; lcp is that with the suffix before, 0 where the symbol changes.
    """
    top = int(bounds[-1]) - 1
    symbols = (lambda p: top - t[p].astype(np.int64)) if flip else (lambda p: t[p].astype(np.int64))
    queue = DiskQueue(budget)
    try:
        for r in range(len(bounds) - 1):
            pos, lcp = queue.pop(r)
            seed_pos, seed_lcp = seeds(r)
            single = bounds[r + 1] - bounds[r] == 1
            if single:
                pos, lcp = _waves(t, run, pos, lcp)
            if single or not len(pos):
                every, value = np.concatenate([pos, seed_pos]), np.concatenate([lcp, seed_lcp])
                induced = np.zeros(len(every), bool)
                induced[: len(pos)] = True
                if len(pos) and len(seed_pos):
                    value[len(pos)] = min(run[pos[-1]], run[seed_pos[0]], cap)
                pred, src = every - 1, np.arange(len(every))
                inside = np.zeros(len(every), bool)
                ok = pred >= 0
                if single:
                    ok[ok] = (is_s[pred[ok]] == kind) & (t[pred[ok]] != t[every[ok]])
                else:
                    ok[ok] = is_s[pred[ok]] == kind
                    inside[ok] = symbols(pred[ok]) < bounds[r + 1]
            if not single and (len(pos) or inside.any()):
                every, value, induced = _range(t, is_s, run, kind, symbols, bounds[r + 1], pos, lcp, seed_pos, seed_lcp, cap)
                pred, src = every - 1, np.arange(len(every))
                ok = pred >= 0
                ok[ok] = (is_s[pred[ok]] == kind) & (symbols(pred[ok]) >= bounds[r + 1])
            if len(value):
                value[0] = 0
            yield every, np.minimum(value, cap), induced
            pred, src = pred[ok], src[ok]
            if not len(pred):
                continue
            target = symbols(pred)
            order = np.argsort(target, kind="stable")
            pred, src, target = pred[order], src[order], target[order]
            first = np.ones(len(order), bool)
            first[1:] = target[1:] != target[:-1]
            share = np.ones(len(order), np.int32)
            rest = np.flatnonzero(~first)
            share[rest] = np.minimum(1 + least_between(value, src[rest - 1], src[rest]), cap)
            goes = np.searchsorted(bounds, target, "right") - 1
            cuts = np.flatnonzero(np.diff(goes)) + 1
            if single and bounds[-1] - bounds[0] == len(bounds) - 1:
                pass
            else:  # ranges of several symbols keep the order of pushing
                for g in np.unique(goes):
                    mine = np.flatnonzero(goes == g)
                    mine = mine[np.argsort(src[mine], kind="stable")]
                    queue.push(int(g), pred[mine], share[mine])
                continue
            for lo, hi in zip([0, *cuts], [*cuts, len(order)], strict=True):
                queue.push(int(goes[lo]), pred[lo:hi], share[lo:hi])
    finally:
        queue.close()


def _waves(t, run, pos, lcp):
    """A symbol's induced suffixes: those from other symbols, then their predecessors of the same symbol, and so on."""
    all_pos, all_lcp, wave, shared = [pos], [lcp], pos, lcp
    while len(wave):
        at = np.flatnonzero(wave > 0)
        at = at[t[wave[at] - 1] == t[wave[at]]]
        if not len(at):
            break
        nxt = np.ones(len(at), np.int32)
        if len(at) > 1:
            nxt[1:] = 1 + least_between(shared, at[:-1], at[1:])
        new = wave[at] - 1
        nxt[0] = min(run[all_pos[-1][-1]], run[new[0]])
        all_pos.append(new)
        all_lcp.append(nxt)
        wave, shared = new, nxt
    return np.concatenate(all_pos), np.concatenate(all_lcp)


def _range(t, is_s, run, kind, symbols, end, pos, lcp, seed_pos, seed_lcp, cap):
    """A range of several symbols: suffixes may be induced by others of the same range, so ranks settle in rounds."""
    p, src = [pos, seed_pos], [np.full(len(pos) + len(seed_pos), -1, np.int64)]
    wave, base, total = np.concatenate([pos, seed_pos]), 0, len(pos) + len(seed_pos)
    while len(wave):
        at = np.flatnonzero(wave > 0)
        q = wave[at] - 1
        ok = is_s[q] == kind
        ok[ok] = symbols(q[ok]) < end
        new = q[ok]
        p.append(new)
        src.append(base + at[ok])
        base, total, wave = total, total + len(new), new
    p, src = np.concatenate(p), np.concatenate(src)
    n, m = len(p), len(pos)
    outer = np.arange(n)
    seed = (outer >= m) & (outer < m + len(seed_pos))
    sym, rank = symbols(p), np.zeros(n, np.int64)
    while True:
        key = np.where(src >= 0, n + rank[np.maximum(src, 0)], outer)
        order = np.lexsort((key, seed, sym))
        new = np.empty(n, np.int64)
        new[order] = np.arange(n)
        if (new == rank).all():
            break
        rank = new
    q, s, k = p[order], src[order], sym[order]
    value = np.zeros(n, np.int32)
    given = np.concatenate([lcp, seed_lcp, np.zeros(n - m - len(seed_pos), np.int32)])[order]
    same = np.zeros(n, bool)
    same[1:] = k[1:] == k[:-1]
    sd = seed[order]
    before = np.roll(sd, 1)
    value[same & (s < 0)] = given[same & (s < 0)]
    edge = np.flatnonzero(same & sd & ~before)
    value[edge] = np.minimum(run[q[edge]], run[q[edge - 1]])
    mine = np.flatnonzero(same & (s >= 0))
    alone = s[mine - 1] < 0
    value[mine[alone]] = 1
    mine = mine[~alone]
    while len(mine):
        got = np.minimum(1 + least_between(value, rank[s[mine - 1]], rank[s[mine]]), cap)
        if (got == value[mine]).all():
            break
        value[mine] = got
    return q, value, ~sd


def _bounds(t: np.ndarray, flip: bool) -> np.ndarray:
    """Borders of the ranges of symbols: each symbol its own where there are few, else RANGES of about equal weight."""
    top = int(t.max()) + 1
    if top <= 4096:
        return np.arange(top + 1)
    weight = np.cumsum(np.bincount(t, minlength=top)[:: -1 if flip else 1])
    cuts = np.searchsorted(weight, np.linspace(0, weight[-1], RANGES + 1)[1:-1])
    return np.unique(np.concatenate([[0], cuts, [top]]))


def sorted_suffixes(t: np.ndarray, cap: int, budget: int = BUDGET, base: int = BASE):
    """Blocks (pos, lcp) of all suffixes but the last symbol's, in descending order; lcp is that with the suffix before."""
    n = len(t)
    if n < 2:
        return
    is_s, run = classify(t, budget)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    names, count = name_substrings(t, is_s, lms)
    known = np.zeros(len(lms), np.int64)
    if count == len(lms):
        order = np.argsort(names)
    elif len(lms) <= base:
        order = sort_in_memory(names, cap // 2 + 1)  # a name stands for two symbols or more
    else:
        order, shared = scratch(len(lms), np.int64, budget), scratch(len(lms), np.int32, budget)
        at = len(lms)
        for pos, lcp in sorted_suffixes(names, cap // 2 + 1, budget, base):
            order[at - len(pos) : at] = pos[::-1]
            # lcp with the one before in descending order is that of the next one in ascending order
            hi = at - len(pos)
            shared[hi + 1 : at] = lcp[1:][::-1]
            if at < len(lms):
                shared[at] = lcp[0]
            at = hi
        order[0] = len(lms) - 1
        after = np.minimum(order[1:] + shared[1:], len(lms) - 1)
        known[1:] = lms[after] - lms[order[1:]]
    lms_pos = lms[order]
    lms_lcp = common_prefixes(t, lms_pos, known, cap)
    up, down = _bounds(t, False), _bounds(t, True)
    first = t[lms_pos].astype(np.int64)
    borders = np.searchsorted(first, up)
    found = DiskQueue(budget)
    top = int(up[-1])
    try:
        # The first walk may use other ranges than the second, so sorted L suffixes are filed by the second's ranges.
        for pos, lcp, induced in _induce(t, is_s, run, False, False, lambda r: (lms_pos[borders[r] : borders[r + 1]], lms_lcp[borders[r] : borders[r + 1]].copy()), up, cap, budget):
            pos, lcp = pos[induced], lcp[induced]
            if len(pos):
                mirrored = top - 1 - t[pos].astype(np.int64)
                goes = np.searchsorted(down, mirrored, "right") - 1
                cuts = np.flatnonzero(np.diff(goes)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(pos)], strict=True):
                    found.push(int(goes[lo]), pos[lo:hi], lcp[lo:hi])

        def larger(r):
            pos, lcp = found.pop(r)
            back = np.zeros(len(lcp), np.int32)
            if len(lcp) > 1:
                # common prefixes turn with the order; where the symbol changes they are 0
                back[1:] = lcp[1:][::-1]
                back[1:][t[pos[1:]][::-1] != t[pos[:-1]][::-1]] = 0
            return pos[::-1].copy(), back

        for pos, lcp, _ in _induce(t, is_s, run, True, True, larger, down, cap, budget):
            if len(pos):
                yield pos, lcp
    finally:
        found.close()
