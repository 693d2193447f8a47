"""Words and shingles of whole texts as 64-bit hashes, by vector operations over UTF-8 bytes.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased text. A shingle is
a run of five consecutive words; a text of one to four words has one shingle, all its words. Equal shingles have equal
hashes; different ones collide with probability 2^-64 a pair, and that is what "exact" means where sets of these hashes
are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
P = U(0x9E3779B97F4A7C15)
P_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
MIX = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
IS_WORD = np.zeros(256, bool)
IS_WORD[128:] = True
IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz_"]] = True
SHINGLE = 5
#: Bytes handled at once (the arrays of one step take about 60 times as much); a longer text is handled alone, whole.
CHUNK = 1 << 18
#: Longest tables of powers that are kept.
KEPT_POWERS = (1 << 20) + 2

_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of P and of its inverse; tables over the usual size are not kept."""
    if len(_powers[0]) < n:
        made = [np.full(max(n, CHUNK + 1), p, np.uint64) for p in (P, P_INVERSE)]
        for m in made:
            m[0] = 1
            np.cumprod(m, out=m)
        if n > KEPT_POWERS:
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def chunks(column: pa.Array, lower: bool = True, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) over rows whose bytes sum to about limit; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the count, first byte, byte after the last)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    inside = IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:n], out=total[1:])
    return mix((total[e] - total[s]) * down[s]), np.searchsorted(s, offsets), s, e


def shingles(h: np.ndarray, bounds: np.ndarray, k: int = SHINGLE, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, first shingle of each row and the count); short: rows under k words have one, if any word."""
    counts = np.diff(bounds)
    n = np.maximum(counts - k + 1, np.minimum(counts, 1) if short else 0)
    at = np.zeros(len(bounds), np.int64)
    np.cumsum(n, out=at[1:])
    start = np.repeat(bounds[:-1] - at[:-1], n) + np.arange(at[-1])
    if not len(start):
        return np.zeros(0, np.uint64), at
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    if short and (few := counts < k).any():
        size = np.repeat(np.minimum(counts, k), n)
        out = np.zeros(len(start), np.uint64)
        for d in range(k):
            out += np.where(d < size, padded[start + d] * MIX[d % 5] + U(d + 1), U(0))
        del few
    else:
        out = np.zeros(len(start), np.uint64)
        for d in range(k):
            out += padded[start + d] * MIX[d % 5] + U(d + 1)
    return mix(out), at


def sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row with a word."""
    for i, _, data, offsets in chunks(column):
        h, bounds, _, _ = words(data, offsets)
        g, at = shingles(h, bounds)
        for r in np.flatnonzero(np.diff(at)):
            yield i + int(r), np.unique(g[at[r] : at[r + 1]])


#: The same words in DuckDB, for oracles.
SQL_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+')"
