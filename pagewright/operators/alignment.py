"""Alignment and edit distance of long texts.

Words of two texts are aligned over anchors: words that occur once in either text. The longest chain of anchors that rises in both
texts, less those that cost more words than they bring, cuts a book into gaps, which are aligned each by itself: by anchors again
inside the gap, then along a way of fewest edits. The two texts of a row are aligned in its task, and no word is shuffled.

The edit distance is bit-parallel: one machine word, here one integer of any width, holds a band of a column of the dynamic
programme. The band doubles until the distance fits, so nearly equal texts cost time in proportion to their length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by code points, in steps of a band around the diagonal."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1024 if a[start : start + 1024] == b[start : start + 1024] else 1
    start = min(start, len(a), len(b))
    a, b = a[start:], b[start:]
    end = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    band = max(32, len(a) - len(b))
    while True:
        found = _within(a, b, band)
        if found <= band or band >= len(a):
            return found
        band *= 2


def _within(a: str, b: str, band: int) -> int:
    """The distance of a and b if it is at most band, else some number above band. Bit k of a column stands for row i - band + k
    of a while column i of b is worked on; the vectors hold the rising and falling steps down the column."""
    width = 2 * band + 1
    full = (1 << width) - 1
    last, columns = len(a), len(b)
    held: dict[str, tuple[int, int]] = {}  # character -> (column of its mask, its places among the rows of the band)
    for row in range(min(band, last)):
        at, mask = held.get(a[row], (0, 0))
        held[a[row]] = (0, mask | 1 << (row + band))
    # column 0: going down one row costs one, rows above the text do not count
    rising, falling = full & ~((1 << band) - 1), 0
    score = 0  # the value of the diagonal's row
    for i in range(columns):
        row = i + band
        if row < last:
            at, mask = held.get(a[row], (i, 0))
            held[a[row]] = (i, (mask >> (i - at)) | 1 << (2 * band))
        at, mask = held.get(b[i], (i, 0))
        equal = mask >> (i - at) & full
        free = (((equal & rising) + rising) ^ rising) | equal | falling  # steps along the diagonal that cost nothing
        up, down = (falling | ~(free | rising)) & full, free & rising & full
        # the next column's band lies one row lower
        slid = free >> 1
        rising, falling = (down | ~(slid | up)) & full, slid & up
        score += 0 if free >> band & 1 else 1
    # from the diagonal at the last column down to the last row
    for bit in range(band, band + last - columns):
        score += (rising >> bit & 1) - (falling >> bit & 1)
    return score


#: Texts whose lengths multiply to more than this are compared in bands; both ways give the same distance.
LONG = 1 << 22


def distance(a: Column, b: Column) -> Column:
    """The edit distance of two texts; null if one is null."""

    @F.pandas_udf("long")
    def banded(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else edit_distance(s, t) for s, t in zip(x, y, strict=True)], dtype="Int64")

    long = F.length(a).cast("long") * F.length(b) > LONG
    return F.coalesce(F.when(~long, F.levenshtein(a, b).cast("long")), banded(F.when(long, a), F.when(long, b)))


def rising_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (by their first number) whose second numbers rise."""
    ends: list[int] = []  # the least second number that ends a chain of each length
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before.append(at[n - 1] if n else -1)
        if n == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[n], at[n] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def worth(chain: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The anchors of a rising chain that pay: each saves an edit, and to leave a diagonal (second less first number) costs half an
    edit a step, from the diagonal start to the diagonal end, as the edits between two anchors are the words of the longer side.
    A word that only seems to have moved costs more than it brings; of equal costs most anchors stay."""
    unit = len(chain) + 1
    places = sorted({j - i for i, j in chain})
    if start == end and places == [start]:  # none leaves the way
        return chain
    rank = {d: k for k, d in enumerate(places)}
    # Fenwick trees of prefix maxima: of chains that end on a lower diagonal, and on a higher one
    low, high = ([(float("-inf"), -1)] * (len(places) + 1) for _ in range(2))
    gain, before = [], []
    for n, (i, j) in enumerate(chain):
        d = j - i
        best, of = -unit * abs(d - start), -1
        for tree, at, own in ((low, rank[d] + 1, -unit * d), (high, len(places) - rank[d], unit * d)):
            while at:
                if tree[at][0] + own > best:
                    best, of = tree[at][0] + own, tree[at][1]
                at -= at & -at
        best += 2 * unit + 1
        gain.append(best)
        before.append(of)
        for tree, at, own in ((low, rank[d] + 1, unit * d), (high, len(places) - rank[d], -unit * d)):
            while at < len(tree):
                tree[at] = max(tree[at], (best + own, n))
                at += at & -at
    best, k = -unit * abs(end - start), -1
    for n, (i, j) in enumerate(chain):
        if gain[n] - unit * abs(end - (j - i)) > best:
            best, k = gain[n] - unit * abs(end - (j - i)), n
    out = []
    while k >= 0:
        out.append(chain[k])
        k = before[k]
    return out[::-1]


#: Cells of a table that is kept whole to find the way through it; a larger one is halved.
CELLS = 1 << 26


class _Columns:
    """The edit distances of ref against every beginning of hyp, a column of steps at a time, each one integer of len(ref) bits."""

    def __init__(self, ref: list[str], hyp: list[str], keep: bool):
        places: dict[str, int] = {}
        for k, w in enumerate(ref):
            places[w] = places.get(w, 0) | 1 << k
        full, top = (1 << len(ref)) - 1, len(ref) - 1
        rising, falling, score = full, 0, len(ref)
        self.last, self.down, self.along = [score], [(rising, falling)], [(0, 0)]
        for w in hyp:
            equal = places.get(w, 0)
            free = (((equal & rising) + rising) ^ rising) | equal | falling
            up, down = (falling | ~(free | rising)) & full, free & rising & full
            score += (up >> top & 1) - (down >> top & 1)
            self.last.append(score)
            if keep:
                self.along.append((up, down))
            up, down = (up << 1 | 1) & full, down << 1 & full
            rising, falling = (down | ~(free | up)) & full, up & free
            if keep:
                self.down.append((rising, falling))

    @staticmethod
    def step(pair: tuple[int, int], row: int) -> int:
        return (pair[0] >> row & 1) - (pair[1] >> row & 1)


def equal_words(ref: list[str], hyp: list[str]) -> list[tuple[int, int]]:
    """Positions of the equal words on a way of fewest edits, on which a changed word counts once."""
    out, todo = [], [(0, len(ref), 0, len(hyp))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > CELLS and b - a > 1:
            half = (a + b) // 2
            head, tail = _Columns(ref[a:half], hyp[c:d], False).last, _Columns(ref[half:b][::-1], hyp[c:d][::-1], False).last
            j = c + min(range(d - c + 1), key=lambda k: head[k] + tail[d - c - k])
            todo += [(a, half, c, j), (half, b, j, d)]
            continue
        steps, i, j = _Columns(ref[a:b], hyp[c:d], True), b - a, d - c
        while i and j:
            if ref[a + i - 1] == hyp[c + j - 1]:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
                continue
            along = steps.step(steps.along[j], i - 1)
            if along + steps.step(steps.down[j - 1], i - 1) == 1:
                i, j = i - 1, j - 1
            elif along == 1:
                j -= 1
            else:
                i -= 1
    return sorted(out)


def facing(ref: list[str], hyp: list[str]) -> list[tuple[int, int]]:
    """Positions that stand for each other: equal words, and runs of one length between two of them. Words that occur once in
    both are anchors where that pays, again between two anchors, until there are none; the rest takes a way of fewest edits."""
    out, todo = [], [(0, len(ref), 0, len(hyp))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and ref[a] == hyp[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and ref[b - 1] == hyp[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        there = _once(hyp[c:d])
        chain = worth(rising_chain([(a + k, c + there[w]) for w, k in _once(ref[a:b]).items() if w in there]), c - a, d - b)
        if chain:
            out += chain
            edges = [(a - 1, c - 1), *chain, (b, d)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
        else:
            out += [(a + i, c + j) for i, j in equal_words(ref[a:b], hyp[c:d])]
    edges = [(-1, -1), *sorted(out), (len(ref), len(hyp))]
    out += [(i + n, j + n) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if k - i == m - j for n in range(1, k - i)]
    return sorted(out)


def _once(words: list[str]) -> dict[str, int]:
    n = Counter(words)
    return {w: k for k, w in enumerate(words) if n[w] == 1}


def aligned(ref: list[int], hyp: list[int]) -> list[tuple[int, int]]:
    """Positions that stand for each other in two texts: the anchors of the whole texts that pay, and what faces each other in
    the gaps between them."""
    there = _once(hyp)
    chain = worth(rising_chain([(k, there[w]) for w, k in _once(ref).items() if w in there]), 0, len(hyp) - len(ref))
    out, edges = list(chain), [(-1, -1), *chain, (len(ref), len(hyp))]
    for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
        if k - i > 1 and m - j > 1:
            out += [(i + 1 + p, j + 1 + q) for p, q in facing(ref[i + 1 : k], hyp[j + 1 : m])]
    return out


#: Rows that are sent on at once.
SENT = 1 << 16
_OWN = ("ref", "hyp", "ref_low", "hyp_low")


def _aligned(keys: list[str], schema: pa.Schema):
    """Texts (keys, ref, hyp, and both in small letters): a row for each pair that align gives."""

    def rows(b, owner, found):
        at = pa.array(owner, pa.int32())
        ix = [pa.array([p[side] for p in found], pa.int32()) for side in (0, 1)]
        words = []
        for side in (0, 1):
            column = b.column(_OWN[side])  # its values and offsets are those of the whole array, sliced or not
            starts = column.offsets.take(at)
            words.append(column.values.take(pc.add(starts, ix[side])))
        return pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), *ix, *words], schema=schema)

    def run(batches):
        for b in batches:
            owner, found = [], []
            low = [b.column(c) for c in _OWN[2:]]
            # Words as numbers, equal ones alike; null is a word of its own.
            numbers = pa.concat_arrays([c.flatten() for c in low]).dictionary_encode("encode").indices.to_numpy().tolist()
            sizes = [pc.fill_null(pc.list_value_length(c), 0).to_pylist() for c in low]
            i, j = 0, sum(sizes[0])
            for k, (n, m) in enumerate(zip(*sizes, strict=True)):
                pairs = aligned(numbers[i : i + n], numbers[j : j + m])
                i, j = i + n, j + m
                owner += [k] * len(pairs)
                found += pairs
                if len(found) >= SENT:
                    yield rows(b, owner, found)
                    owner, found = [], []
            if found:
                yield rows(b, owner, found)

    return run


def align(texts: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(keys, ref_ix, hyp_ix, ref_word, hyp_word): which word of hyp stands for which word of ref, where equal words or runs of
    one length face each other; case does not count. keys are unique and not named ref, hyp, ref_low or hyp_low; ref and hyp
    are arrays of words, null ones are empty.

    Two texts are one row, and are aligned where they lie: words do not move, so tables whose texts are dealt over the tasks are
    to be given. Work grows with the number of words; a gap without anchors costs its area by the width of a machine word, in
    bounded memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    low = lambda c: F.transform(c, lambda w: F.lower(w))
    word = texts.select(ref, hyp).schema
    kind = T.StructType([*(texts.schema[k] for k in keys), *(T.StructField(f"{c}_ix", T.IntegerType()) for c in _OWN[:2]), *(T.StructField(f"{c}_word", word[n].dataType.elementType) for c, n in zip(_OWN, (ref, hyp), strict=False))])
    own = texts.select(*keys, F.col(ref).alias("ref"), F.col(hyp).alias("hyp"), low(ref).alias("ref_low"), low(hyp).alias("hyp_low"))
    return own.mapInArrow(_aligned(keys, to_arrow_schema(kind)), kind)
