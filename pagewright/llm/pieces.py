"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

The pieces come from a SentencePiece model file; none is trained. The lattice of a text has an edge for every piece and, for a
character that is no piece, one for its UTF-8 bytes. A piece costs the negative logarithm of its Zipf probability by rank in
the file (rank 1 first), in integers of a millionth, so sums are exact and any order of addition gives the same ties; a byte
costs more than any piece. Every text gets the space in front that SentencePiece adds.

No piece crosses from a non-space to a space, so the lattice of a text is a chain of the lattices of its words (spaces, then
non-spaces). Forward and backward Viterbi scores of a batch's distinct words come from vector operations over all words of a
length. An edge off the best path gives, by forward + cost + backward, the best path through it, so their minimum is exactly
what a word's second-best segmentation costs more. Only the n - 1 words of a text with the smallest such excess can take
part in its n best; for these, A* runs backward from the word's end, with the forward Viterbi scores as exact heuristic, and
a heap combines the words' lists. Equal costs count as different segmentations; the search takes the one nearest to the word's
start first, and the best is the one that Viterbi takes, whose last pieces are shortest.

Edge cases: a null text counts as empty; an empty text has no ids, cost 0 and decodes to itself; U+2581 in a text is encoded
by its bytes, so it survives; words over LONG characters, of any length, take plain loops of the same recursion, linear in their
length. Rows with a null doc_id are left out, repeated rows all stay.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, lean, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Best segmentations of a text that the query asks for.
N_BEST = 4
#: Characters handled at once; words longer than LONG take the plain loop.
CHARS, LONG = 1 << 20, 40
#: Words in the memo of a Python worker, and their characters.
KEEP, KEEP_CHARS = 200_000, 8 << 20
INF = np.int64(1) << 50
WORD = re.compile(r" *[^ ]+| +")
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Numbered(dict):
    """Numbers words in the order in which they are first asked for; words lists them."""

    def __init__(self):
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


class Known:
    """Words met so far, with the results of their lattices: a memo that changes no result and is dropped beyond KEEP words."""

    def __init__(self):
        self.names = Numbered()
        self.words = self.names.words
        self.chars = 0
        self.packed: list[bytes] = []  # ids of the best segmentation, four bytes each
        self.plain: list[bytes] = []  # what the ids decode to
        self.cost, self.excess, self.lists = np.zeros(0, np.int64), np.zeros(0, np.int64), {}

    def best(self, word: int) -> tuple[int, ...]:
        raw = self.packed[word]
        return struct.unpack(f"<{len(raw) // 4}i", raw)


class Pieces:
    """The pieces of a model: their bytes, costs, and a hash table over them."""

    def __init__(self, names: list[str], kinds: list[str]):
        """kinds: 'piece', 'byte' or 'other' for each id; names with U+2581 for the space."""
        self.known: Known | None = None
        self.raw = [bytes([int(n[3:5], 16)]) if k == "byte" else n.replace("▁", " ").encode() if k == "piece" else b"" for n, k in zip(names, kinds, strict=True)]
        usual = [i for i, k in enumerate(kinds) if k == "piece"]
        norm = float(np.sum(1 / np.arange(1, len(usual) + 1)))
        self.cost = np.full(len(names), INF)
        self.cost[usual] = np.rint(1e6 * np.log(np.arange(1, len(usual) + 1) * norm)).astype(np.int64)
        self.byte_cost = int(self.cost[usual].max(initial=0)) + 5_000_000
        self.bytes = np.zeros(256, np.int64)
        for i, k in enumerate(kinds):
            if k == "byte":
                self.bytes[self.raw[i][0]] = i
                self.cost[i] = self.byte_cost
        self.ids = {names[i].replace("▁", " "): i for i in usual}
        self.longest = max(map(len, self.ids), default=1)
        crossing = [p for p in self.ids if re.search("[^ ] ", p)]
        if crossing:
            raise ValueError(f"pieces cross from a non-space to a space: {crossing[:3]}")
        texts = list(self.ids)
        h = np.array([self._hash(t) for t in texts], np.uint64)
        order = np.argsort(h)
        self.hashes, self.owner = h[order], np.array([self.ids[t] for t in texts], np.int64)[order]
        if len(np.unique(self.hashes)) != len(texts):
            raise ValueError("pieces collide")
        # The piece of each slot of 20 bits: -1 for none, -2 for several.
        slot = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.slots = np.full(1 << 20, -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.slots[slot[1:][slot[1:] == slot[:-1]]] = -2

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = ["byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece" for i in range(m.get_piece_size())]
        return cls([m.id_to_piece(i) for i in range(m.get_piece_size())], kinds)

    @staticmethod
    def _hash(t: str) -> np.uint64:
        c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
        with np.errstate(over="ignore"):
            return _spread((c + np.uint64(1)) @ _powers(len(c))[0])

    def fallback(self, ch: str) -> list[int]:
        return [int(self.bytes[b]) for b in ch.encode("utf-8", "surrogatepass")]

    def edges(self, word: str, end: int):
        """(start, cost, ids) of the edges that end at end."""
        for start in range(max(0, end - self.longest), end):
            i = self.ids.get(word[start:end])
            if i is not None:
                yield start, int(self.cost[i]), (i,)
            elif end - start == 1:
                b = self.fallback(word[start])
                yield start, self.byte_cost * len(b), tuple(b)

    def forward(self, word: str) -> tuple[list[int], list[int]]:
        """For each end the cost of the best way there, and the length of its last edge (the shortest of equal ones)."""
        best, last = [0] * (len(word) + 1), [0] * (len(word) + 1)
        for e in range(1, len(word) + 1):
            best[e], last[e] = min((best[s] + c, e - s) for s, c, _ in self.edges(word, e))
        return best, last

    def long(self, word: str) -> tuple[tuple[int, ...], int, int]:
        """(ids of the best segmentation, its cost, what the second-best costs more), in time linear in the word's length."""
        best, last = self.forward(word)
        n, back = len(word), [int(INF)] * len(word) + [0]
        for e in range(n, 0, -1):
            for s, c, _ in self.edges(word, e):
                back[s] = min(back[s], c + back[e])
        on, e, ids = {}, n, []
        while e:
            on[e] = e - last[e]
            ids.append(next(i for s, _, i in self.edges(word, e) if s == on[e]))
            e = on[e]
        second = min((best[s] + c + back[e] for e in range(1, n + 1) for s, c, _ in self.edges(word, e) if on.get(e) != s), default=INF)
        return tuple(itertools.chain.from_iterable(reversed(ids))), best[n], INF if second >= INF else second - best[n]

    def nbest(self, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n cheapest segmentations: backward A* whose heuristic is the forward Viterbi cost.

        An agenda entry is an arrival by one edge; when it is taken, the next dearer edge from the same place enters, so entries
        grow with the edges taken. Of equal costs the arrival nearest to the word's start comes first. Segmentations are
        linked lists that share their tails. A place is left n times at most.
        """
        best, _ = self.forward(word)
        agenda, out, count, left = [(best[-1], len(word), 0, 0, None, None)], [], 0, {}
        while agenda and len(out) < n:
            _, at, _, behind, tail, rest = heapq.heappop(agenda)
            if rest is not None:
                ways, k, base, link = rest
                if k < len(ways):
                    count += 1
                    total, s, c, ids = ways[k]
                    heapq.heappush(agenda, (base + total, s, count, base + c, (ids, link), (ways, k + 1, base, link)))
            if at == 0:
                ids, link = [], tail
                while link:
                    ids += link[0]
                    link = link[1]
                out.append((behind, tuple(ids)))
                continue
            left[at] = left.get(at, 0) + 1
            if left[at] > n:
                continue
            ways = sorted((c + best[s], s, c, ids) for s, c, ids in self.edges(word, at))
            count += 1
            total, s, c, ids = ways[0]
            heapq.heappush(agenda, (behind + total, s, count, behind + c, (ids, tail), (ways, 1, behind, tail)))
        return out

    def viterbi(self, words: list[str]):
        """Of each word: ids of the best segmentation, its cost, and what the second-best costs more (INF: there is none)."""
        ids: list = [None] * len(words)
        cost, excess = np.zeros(len(words), np.int64), np.full(len(words), INF)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, members in by.items():
            if n > LONG:
                for k in members:
                    ids[k], cost[k], excess[k] = self.long(words[k])
                continue
            for lo in range(0, len(members), 8192):
                self._same_length(words, members[lo : lo + 8192], n, ids, cost, excess)
        return ids, cost, excess

    def _same_length(self, words, members, n, ids, cost, excess):
        m = len(members)
        c = np.frombuffer("".join(words[k] for k in members).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).astype(np.uint64)
        up, down = _powers(n + 1)
        total = np.zeros((n + 1, m), np.uint64)
        np.cumsum(((c + np.uint64(1)) * up[:n]).T, axis=0, out=total[1:])
        most = min(n, self.longest)
        edge, name = [None] * (most + 1), [None] * (most + 1)
        for size in range(1, most + 1):
            h = _spread((total[size:] - total[: n + 1 - size]) * down[: n + 1 - size, None]).ravel()
            spot = self.slots[(h >> np.uint64(44)).astype(np.int64)]
            several = np.flatnonzero(spot == -2)
            spot[several] = np.searchsorted(self.hashes, h[several]).clip(max=len(self.hashes) - 1)
            found = np.full(len(h), -1, np.int64)
            may = np.flatnonzero(spot >= 0)
            hit = self.hashes[spot[may]] == h[may]
            found[may[hit]] = self.owner[spot[may[hit]]]
            price = np.where(found >= 0, self.cost[found], INF)
            if size == 1 and (found < 0).any():
                code = c.T.ravel()
                width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
                price = np.where(found >= 0, price, width * self.byte_cost)
            edge[size], name[size] = price.reshape(n + 1 - size, m), found.reshape(n + 1 - size, m)
        f, b = np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.int64)
        back = np.zeros((n + 1, m), np.int8)
        for e in range(1, n + 1):
            ways = np.stack([f[e - s] + edge[s][e - s] for s in range(1, min(most, e) + 1)])
            back[e] = ways.argmin(0) + 1
            f[e] = ways.min(0)
        for s in range(n - 1, -1, -1):
            b[s] = np.min([edge[k][s] + b[s + k] for k in range(1, min(most, n - s) + 1)], axis=0)
        on = np.zeros((most + 1, n + 1, m), bool)
        at, col = np.full(m, n), np.arange(m)
        steps = []
        while True:
            live = at > 0
            if not live.any():
                break
            size = back[at, col].astype(np.int64)
            start = at - size
            which = np.full(m, -2, np.int64)
            for k in np.unique(size[live]):
                x = live & (size == k)
                which[x] = name[k][start[x], col[x]]
                on[k, start[x], col[x]] = True
            steps.append((which, start))
            at = np.where(live, start, 0)
        second = np.full(m, INF)
        for k in range(1, most + 1):
            through = f[: n + 1 - k] + edge[k] + b[k:]
            through[on[k, : n + 1 - k]] = INF
            np.minimum(second, through.min(0), out=second)
        second = np.where(second >= INF // 2, INF, second - f[n])
        table_ = np.array([w for w, _ in steps][::-1])
        plain = ~(table_ == -1).any(0)
        for j, k in enumerate(members):
            if plain[j]:
                x = table_[:, j]
                ids[k] = tuple(x[x >= 0].tolist())
            else:
                ids[k] = tuple(i for w, s in reversed(steps) if w[j] != -2 for i in ([int(w[j])] if w[j] >= 0 else self.fallback(words[k][s[j]])))
            cost[k], excess[k] = f[n, j], second[j]

    def decode(self, ids) -> str:
        """The text of ids: bytes joined, the space in front removed."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    def encode(self, texts: list[str], n: int = 1):
        """For each text (ids of the best segmentation, [(cost, {word: ids that replace the best ones}), ...], words)."""
        if self.known is None or len(self.known.words) > KEEP or self.known.chars > KEEP_CHARS:
            self.known = Known()
        known = self.known
        names, old = known.names, len(known.words)
        order = []
        for t in texts:
            ws = WORD.findall(" " + t) if t else []
            order.append(np.fromiter(map(names.__getitem__, ws), np.int64, len(ws)))
        known.chars += sum(map(len, known.words[old:]))
        ids, cost, excess = self.viterbi(known.words[old:])
        known.packed += [struct.pack(f"<{len(x)}i", *x) for x in ids]
        known.plain += [b"".join(map(self.raw.__getitem__, x)) for x in ids]
        known.cost, known.excess = np.concatenate([known.cost, cost]), np.concatenate([known.excess, excess])
        for ws in order:
            best = np.frombuffer(b"".join(map(known.packed.__getitem__, ws.tolist())), "<i4")
            yield best, self._combine(ws, int(known.cost[ws].sum()), known, n), ws

    def restored(self, ws: np.ndarray) -> bytes:
        """What the best ids of the words decode to, with the space in front; ws are those that encode gave last."""
        return b"".join(map(self.known.plain.__getitem__, ws.tolist()))

    def _combine(self, ws, total, known, n):
        out = [(total, {})]
        if n > 1 and len(ws):
            x = known.excess[ws]
            near = np.argpartition(x, n - 2)[: n - 1] if len(x) > n - 1 else np.arange(len(x))
            near = sorted(near[x[near] < INF].tolist(), key=lambda p: (int(x[p]), p))
            choice = []
            for p in near:
                w = (int(ws[p]), n)
                if w not in known.lists:
                    # Of equal costs the one that Viterbi takes is the best.
                    ways, top = self.nbest(known.words[w[0]], n), (int(known.cost[w[0]]), known.best(w[0]))
                    known.lists[w] = [top, *(x for x in ways if x != top)][:n]
                choice.append(known.lists[w])
            # k-best sums of independent lists: a state is a rank for each word.
            start = (0,) * len(near)
            heap, seen = [(0, start)], {start}
            while heap and len(out) <= n:
                more, ranks = heapq.heappop(heap)
                if any(ranks):
                    out.append((total + more, {near[k]: choice[k][r][1] for k, r in enumerate(ranks) if r}))
                for k, r in enumerate(ranks):
                    if r + 1 < len(choice[k]):
                        nxt = ranks[:k] + (r + 1,) + ranks[k + 1 :]
                        if nxt not in seen:
                            seen.add(nxt)
                            heapq.heappush(heap, (more + choice[k][r + 1][0] - choice[k][r][0], nxt))
        return out[:n]


def _spread(h):
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(n: int):
    up, down = np.full(n, _P, np.uint64), np.full(n, _Q, np.uint64)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _parts(column: pa.Array):
    """Texts in runs of about CHARS characters."""
    held, size = [], 0
    for t in column.to_pylist():
        held.append(t or "")
        size += len(held[-1])
        if size >= CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoder(shared, n: int, digest: bool):
    def run(batches):
        import hashlib

        pieces: Pieces = shared.value
        for b in batches:
            at = 0
            for texts in _parts(b.column(1)):
                keys = b.column(0).slice(at, len(texts))
                at += len(texts)
                rows, best_ids = [], []
                for text, (best, ways, ws) in zip(texts, pieces.encode(texts, n), strict=True):
                    costs, known = [c for c, _ in ways], pieces.known
                    ok = pieces.restored(ws) == (" " + text if text else "").encode("utf-8", "surrogatepass")
                    # Of the other segmentations, the words in which they differ.
                    ok = ok and all(b"".join(map(pieces.raw.__getitem__, ids)) == known.plain[ws[p]] for _, change in ways for p, ids in change.items())
                    changes = [sorted(change.items()) for _, change in ways]
                    if digest:
                        rows.append((len(best), costs, hashlib.sha256(best.tobytes()).hexdigest(), hashlib.sha256(repr(changes).encode()).hexdigest(), ok))
                    else:
                        best_ids.append(best)
                        rows.append((costs, [[{"word": p, "ids": list(i)} for p, i in w] for w in changes], ok))
                if digest:
                    first, kinds = [], (pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.bool_())
                else:
                    ends = pa.array(np.cumsum([0, *map(len, best_ids)]), pa.int32())
                    first = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(best_ids).astype(np.int32)))]
                    kinds = (pa.list_(pa.int64()), pa.list_(pa.list_(pa.struct([("word", pa.int64()), ("ids", pa.list_(pa.int32()))]))), pa.bool_())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([keys, *first, *columns], ["doc_id", *(DIGEST if digest else FULL)])

    return run


DIGEST = {"n_tokens": "long", "costs": "array<long>", "ids_sha256": "string", "changes_sha256": "string", "decoded": "boolean"}
FULL = {"ids": "array<int>", "costs": "array<long>", "changes": "array<array<struct<word:long,ids:array<int>>>>", "decoded": "boolean"}


def encode(docs: DataFrame, model: str = MODEL, n: int = 1, digest: bool = False) -> DataFrame:
    """doc_id with the n best segmentations of every text.

    ids are those of the best; costs and changes have one entry a segmentation, cheapest first, a change being the words (by
    number) whose ids differ from the best ones; decoded tells whether the ids decode to the text. digest: counts, SHA-256 of ids and changes, and whether every
    segmentation decodes to the text, in place of ids and changes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    schema = "doc_id long, " + ", ".join(f"{k} {v}" for k, v in (DIGEST if digest else FULL).items())
    return keyed(docs, "doc_id", "text").mapInArrow(lean(_encoder(shared, n, digest)), schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches):
        for b in batches:
            text = [None if x is None else shared.value.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: tokens of the best segmentation, costs of the N_BEST best, digests, the round trip."""
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), n=N_BEST, digest=True).select("doc_id", "n_tokens", F.col("costs").getItem(0).alias("cost"), F.col("costs").alias("n_best_costs"), "ids_sha256", "changes_sha256", "decoded")


ORACLE: dict[str, str] = {}
QUERIES = {"op4_pieces": op4_pieces}
