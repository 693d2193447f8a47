"""Packing, conversation repair and ranking with ties against brute force, edge cases of all operators of round three."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from datetime import datetime
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import bpeids, chaining, covertree, packing, ranking, repair

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def unpacked(data):
    return np.frombuffer(data, "<u4").tolist()


def test_ids_equal_the_library(whole):
    r = random.Random(1)
    signs = "aabcé ñÖ  \n\t\r\x1c\x85\xa0 .,'’s-0١9Ⅷ中文😀́ꟲ͸_<|>"
    texts = ["", " ", "  ", "\n\n x", "it's <|endoftext|> ok", "a\tb\t  c ", "x" * 5000]
    texts += ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(3000)]
    ids = bpeids.Ids(FILE)
    for text, data in zip(texts, ids.encode(texts), strict=True):
        assert unpacked(data) == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_memo_starts_anew(whole, monkeypatch):
    monkeypatch.setattr(bpeids, "MEMO", 3)
    texts = ["one two three four five", "six one", "one two"]
    assert [unpacked(x) for x in bpeids.Ids(FILE).encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def optimum(lengths, room):
    """Fewest bins, by trying every place for every piece."""
    best = len(lengths)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for i in range(len(free)):
            if free[i] >= lengths[k] and free[i] not in free[:i]:
                place(k + 1, [*free[:i], free[i] - lengths[k], *free[i + 1 :]])
        place(k + 1, [*free, room - lengths[k]])

    place(0, [])
    return best


def test_bounds_hold_and_certify():
    r, certified = random.Random(2), 0
    for _ in range(150):
        room = r.choice([10, 12, 17, 24])
        lengths = sorted((r.randrange(1, room + 1) for _ in range(r.randrange(1, 9))), reverse=True)
        bound = packing.lower_bound(np.bincount(lengths, minlength=room + 1))
        bins, offsets, free = packing.best_fit(lengths, room)
        best = optimum(lengths, room)
        assert isinstance(bound, Fraction) and -(-bound // 1) <= best <= len(free)
        certified += -(-bound // 1) == len(free)
        taken = defaultdict(list)
        for n, b, at in zip(lengths, bins, offsets, strict=True):
            taken[b].append((at, at + n))
        for b, spans in taken.items():
            spans.sort()
            assert [a for a, _ in spans] == [0, *(z for _, z in spans[:-1])] and spans[-1][1] == room - free[b]
    assert certified > 100
    # three pieces of a little over half, and pieces of a third: lengths alone allow two bins fewer
    assert packing.lower_bound(np.bincount([6, 6, 6], minlength=11)) == 3
    assert packing.lower_bound(np.bincount([4] * 6, minlength=11)) == 3


def sound(rows, room):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.offset + r.length))
    for spans in by.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *(z for _, z in spans[:-1])] and spans[-1][1] <= room
    return len(by)


def test_exchange_reaches_the_bound(spark):
    r = random.Random(3)
    lengths = [r.randrange(1, 40) for _ in range(4000)] + [64] * 50
    pieces = spark.createDataFrame([(i % 7, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    out = packing.pack(pieces, room=64, deal=100).collect()
    assert sorted(x.ids_crc32 for x in out) == list(range(len(lengths)))
    bound = -(-packing.lower_bound(np.bincount(lengths, minlength=65)) // 1)
    alone = sum(len(packing.best_fit(sorted(lengths[i::40], reverse=True), 64)[2]) for i in range(40))
    assert bound <= sound(out, 64) <= bound + 2 < alone


def test_pieces_of_documents(spark, whole):
    texts = [None, "", "word", "uno dos tres " * 1500, "a b c d e f g h i j " * 3000, "mañana 中文 " * 200]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)] + [(2, "word", "x")], "doc_id long, text string, sequence_id string")
    out = packing.pack(packing.token_pieces(docs)).collect()
    sound(out, packing.ROOM)
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert len(by[2]) == 2 and {x.ids_crc32 for x in by[2]} == {x.ids_crc32 for x in by[2][:1]}
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, packing.END]
        rows = sorted(by[i if i else None], key=lambda x: (x.piece, x.start))[: None if i != 2 else 1]
        assert sum(x.length for x in rows) == len(ids) and all(x.length == packing.ROOM for x in rows[1:])
        for k, x in enumerate(rows):
            assert x.piece == k and x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes())
    assert packing.pack(packing.token_pieces(docs.limit(0))).count() == 0


LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """(cost, audit) over all edits, by trying them: turns are (initial, fault)."""
    best = None
    for inserts in range(3 if len(turns) < 4 else 2):
        for marks in itertools.product("KRD", repeat=len(turns)):
            for places in itertools.combinations_with_replacement(range(len(turns) + 1), inserts):
                audit = "".join("I" * places.count(k) + m for k, m in enumerate([*marks, ""]))
                free = sum(m == "R" for m in marks) + inserts
                cost = 3 * free + 4 * marks.count("D") + sum(3 for m, (_, f) in zip(marks, turns, strict=True) if m != "D" and f == "truncated")
                if any(m != "D" and f in ("blank", "duplicate") for m, (_, f) in zip(marks, turns, strict=True)) or best and (cost, audit) >= best:
                    continue
                fixed, left = [], iter(turns)
                for a in audit:
                    initial = None if a == "I" else next(left)[0]
                    if a != "D":
                        fixed.append(initial if a == "K" else None)
                ok = any(LEGAL.fullmatch("".join(x or y for x, y in zip(fixed, want, strict=True))) and all(y in "ua" for x, y in zip(fixed, want, strict=True) if x is None) for want in (["u", "a"] * 9, ["s", *["u", "a"] * 9]) for want in [want[: len(fixed)]])
                if ok:
                    best = (cost, audit)
    return best


def test_repair_finds_the_cheapest_edits(spark, monkeypatch):
    r = random.Random(4)
    rows, want = [], {}
    for conv in range(120):
        turns, seen = [], set()
        for turn in range(r.randrange(6)):
            role, text = r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["Yes.", "So", " \t", "Why? ", f"n{turn}!"])
            rows.append((conv, turn, role, text, False))
            fault = "blank" if not text.strip() else "duplicate" if (role, text) in seen else "truncated" if text.strip()[-1] not in ".!?" else None
            seen.add((role, text))
            turns.append((role[:1] or "-", fault))
        rows.append((conv, 99, "user", "gone", True))
        want[conv] = cheapest(turns) or (None, None)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean")
    one = {x.conv_id: (x.cost, x.audit, x.repaired) for x in repair.repair(table).collect()}
    assert len(one) == 120
    for conv, (cost, audit) in want.items():
        if len([1 for x in rows if x[0] == conv]) <= 4:  # three turns: all cheapest edits need two insertions at most
            assert one[conv][:2] == (cost, audit)
        elif cost is not None:
            assert one[conv][0] <= cost
        assert LEGAL.fullmatch("".join(x.role[:1] for x in one[conv][2]))


def test_long_conversations_go_on_from_batch_to_batch():
    import pyarrow as pa

    r = random.Random(5)
    names = ("conv_id", "gone", "turn", "role", "text", "initial", "fault", "illegal", "fresh")
    rows = []
    for conv, n in ((1, 40), (2, 3), (3, 1), (4, 27), (5, 0)):
        for turn in range(n):
            role = r.choice(["user", "assistant", "system"])
            rows.append((conv, False, turn, role, "x.", role[0], r.choice([None, None, "truncated", "blank"]), False, True))
        rows.append((conv, True, None, "user", "", "u", None, False, False))
    table = pa.table({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    def results(batch):
        repair.BATCH, before = batch, repair.BATCH
        try:
            work, out = repair._Repairs(), []
            for b in table.to_batches(max_chunksize=7):
                out += [x for done in work.add(b) for x in done]
            return out + [x for done in work.settle(True) for x in done]
        finally:
            repair.BATCH = before

    assert results(2) == results(1000) == sorted(results(5))
    assert [x[0] for x in results(2)] == [1, 2, 3, 4, 5]


def test_damage_and_its_edges(spark):
    n = lambda conv, turn: zlib.crc32(f"{conv}:{turn}".encode()) % 20
    dropped = next(c for c in range(1000) if n(c, 0) == 0)
    doubled = next(c for c in range(1000) if n(c, 0) == 3)
    rows = [(dropped, 0, "user", "Hi.", 1), (doubled, 0, "user", "Hi.", 1), (None, None, None, None, 1), (7, None, "user", "A.", 1), (7, 3, "assistant", "B.", 1), (7, 3, "assistant", "B.", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit long")
    out = {x.conv_id: x for x in repair.repair(repair.damaged(table)).withColumn("said", F.array_join(F.transform("repaired", lambda x: x["text"]), "|")).collect()}
    assert set(out) == {dropped, doubled, None, 7}
    assert (out[dropped].cost, out[dropped].audit, out[dropped].gaps, out[dropped].repaired) == (0, "", 0, [])
    assert (out[doubled].duplicate, out[doubled].audit, out[doubled].cost) == (1, "KDI", 7)
    assert out[None].blank == (n(" ", " ") != 0) + (n(" ", " ") == 3) and out[None].gaps == 0
    assert repair.repair(repair.damaged(table.limit(0))).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def placed(lines, k):
    """All groups sorted whole: (vendor, part, month, pos, the line's numbers, tied)."""
    groups = defaultdict(list)
    for sale, line, item, vendor, quantity, amount, discount, shipped in lines:
        key = (vendor, -1 if item is None else item % 5, -1 if shipped is None else 100 * shipped.year + shipped.month)
        if sale is not None and zlib.crc32(str(sale).encode()) % 5 == 0:
            key = (-1, -1, -1)
        cents = None if amount is None else int(np.floor(100 * amount + 0.5))
        percent = None if discount is None else int(np.floor(100 * discount + 0.5))
        pair = (0, 0) if quantity is None else (1, -(quantity // 10)), (0, 0) if percent is None else (1, percent)
        groups[key].append((pair, [(x is None, x or 0) for x in (sale, line, quantity, cents)], (sale, line, quantity, percent, cents)))
    out = []
    for key, own in groups.items():
        own.sort(key=lambda x: x[:2])
        for pos, (pair, _, numbers) in enumerate(own[:k], 1):
            out.append((*key, pos, *numbers, sum(x[0] == pair for x in own)))
    return sorted(out, key=repr)


def lines_of(r, n):
    some = lambda *x: r.choice([None, *x])
    days = [datetime(2024, m, d) for m in (1, 2) for d in (1, 28)]
    return [(some(*range(9)), some(1, 2), some(*range(6)), some(0, 1), some(*range(-12, 40)), some(1.005, 2.5, 3.0), some(0.0, 0.014, 0.015, 0.1), some(*days)) for _ in range(n)]


KIND = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, shipped_at timestamp_ntz"


def ranked(spark, tmp_path, lines):
    folder = tmp_path / f"t{len(lines)}"
    spark.createDataFrame(lines, KIND).withColumn("code", F.lit("x")).write.parquet(f"{folder}/sale_lines.parquet")
    out = ranking.op13_ranking_ties(spark, str(folder)).collect()
    assert all(x.pos == x.place for x in out)
    return sorted(((x.vendor_id, x.part, x.month, x.pos, x.sale_id, x.line_no, x.quantity, x.percent, x.amount_cents, x.tied) for x in out), key=repr)


def test_ranking_equals_sorting_every_group(spark, tmp_path):
    r = random.Random(6)
    lines = lines_of(r, 1200)
    lines += [(5, 1, 7, 7, 49, 1.0, 0.0, datetime(2024, 1, 1))] * 600  # equal lines
    assert ranked(spark, tmp_path, lines) == placed(lines, ranking.PLACES)


def test_ranking_of_far_apart_pairs_and_of_nothing(spark, tmp_path):
    lines = [(None, 1, 1, 1, q, 1.0, d, None) for q in (None, -2147483648, 2147483647) for d in (None, -9e15, 0.0, 9e15)]
    assert ranked(spark, tmp_path, lines) == placed(lines, ranking.PLACES)
    assert ranked(spark, tmp_path, []) == []


@pytest.mark.parametrize("k", [1, 5, 40, 1000])
def test_places_for_any_k(spark, k):
    r = random.Random(7)
    rows = [(0 if r.random() < 0.5 else r.randrange(20), r.randrange(60), r.randrange(4)) for _ in range(1500)]
    got = ranking.top_places(spark.createDataFrame(rows, "g long, code long, t long"), ["g"], ["t"], k).collect()
    groups = defaultdict(list)
    for g, c, t in rows:
        groups[g].append((c, t))
    want = [(g, i, *x, sum(y[0] == x[0] for y in own)) for g, own in groups.items() for i, x in enumerate(sorted(own)[:k], 1)]
    assert sorted((x.g, x.pos, x.code, x.t, x.tied) for x in got) == sorted(want)


def test_fingerprints_select_mappings(spark, monkeypatch):
    from pagewright.llm import chat

    kind = "messages array<struct<role:string,content:string,name:string>>, prompt string, response string, instruction string, input string, output string, turns_n int"
    rows = [([("user", "a", "x")], None, None, None, None, None, 1), (None, "p", "r", None, None, None, 1), (None, None, None, "i", None, "o", 1), (None, None, None, "i", "in", "o", 1), (None, "p", None, None, None, None, 1), (None,) * 6 + (1,), ([], None, None, None, None, None, 1), (None, "p", "r", "i", None, "o", 1)]
    df = spark.createDataFrame(rows, kind)
    want = [[("user", "a")], [("user", "p"), ("assistant", "r")], [("user", "i"), ("assistant", "o")], [("user", "i\nin"), ("assistant", "o")], None, None, [], None]
    got = lambda: [None if r.turns is None else [tuple(x) for x in r.turns] for r in chat.canonical(df).collect()]
    assert got() == want
    fp = chat.fingerprint(("messages[].content", "messages[].role"))
    monkeypatch.delitem(chat.MAPPINGS, fp)
    assert got() == [None, *want[1:6], None, None]
    monkeypatch.setattr(chat, "MAPPINGS", {})
    assert got() == [None] * 8


def test_near_vectors_of_extreme_size(spark):
    """Squares of these components leave the range of double precision; directions alone decide."""
    base = [[3.0, 4.0, 0.0, 0.5], [0.0, 1.0, 2.0, -1.0]]
    sizes = (1.0, 1e-200, 1e200, 5e-310, 1e307)
    rows = [(k * len(sizes) + n, [x * s for x in v], "a") for k, v in enumerate(base) for n, s in enumerate(sizes)]
    rows.append((90, [1e-200, 0.0, 0.0, 1e200], "a"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df).collect()}
    assert got == {i: (4, i - i % 5, i % 5 == 0) for i in range(10)} | {90: (0, 90, True)}


def test_places_beyond_three_bytes(monkeypatch):
    far = np.array([0, 5, (1 << 24) + 5, (1 << 32) - 1], np.uint32)
    assert (chaining._numbers(chaining._bytes(far, chaining.PLACE), chaining.PLACE, "<u4") == far).all()
    h = np.random.default_rng(1).integers(1, 1 << 62, 3000).astype(np.uint64)
    bounds = np.array([0, 1200, 3000])
    want = chaining.seeds(h, bounds)
    monkeypatch.setattr(chaining, "LOW", 4)  # a batch longer than the bits that are set aside takes more of them
    assert all((a == b).all() for a, b in zip(want, chaining.seeds(h, bounds), strict=True))


def test_passages_whose_keys_all_lead_elsewhere(spark):
    passage = [f"w{j}" for j in range(84)]
    own = lambda i, n: [f"own{i}w{j}" for j in range(n)]
    # Every run of 14 words lies in a snippet of some earlier text; snippets are no passages, and more than CROWD texts hold each.
    rows = [(20 * k + c, own(20 * k + c, 30) + passage[4 * k : 4 * k + 14] + own(3000 + 20 * k + c, 30)) for k in range(18) for c in range(12)]
    edited = [f"edit{j}" if j % 13 == 12 else x for j, x in enumerate(passage)]
    rows += [(1000, own(1000, 40) + passage + own(1001, 40)), (1001, own(1002, 25) + edited + own(1003, 70))]
    again = [f"other{j}" if j % 13 == 6 else x for j, x in enumerate(passage)]
    rows += [(1002, own(1004, 7) + again + own(1005, 9))]
    for n in (1, 5):
        found = chaining.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(n)).collect()
        got = {r.doc_id: r for r in found}
        assert set(got) == {1001, 1002} and len(found) == 2
        assert 1000 in got[1001].refs and got[1001].best_ref == 1000 and got[1001].start_word <= 25 and got[1001].n_words >= 84
        assert 1000 in got[1002].refs and got[1002].n_words >= 78


def test_edges_meet_the_first_text_of_each_class(monkeypatch):
    import numpy as np
    import pyarrow as pa

    h = np.random.default_rng(1).integers(1, 1 << 63, 200, dtype=np.uint64)
    pos = np.array([3, 10, 40, 74, 139])
    a, z, key, words = chaining.edges(pos, h[:5], h)
    assert sorted(zip(a.tolist(), z.tolist(), strict=True)) == [(3, 10), (3, 40), (10, 40), (10, 74), (40, 74)]
    assert len(set(key.tolist())) == len(set(words.tolist())) == 5
    assert chaining.edges(pos[::4], h[:2], h) is None
    texts = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")]
    middle = {"a": "x y", "b": "x z", "c": "v w y"}
    ids, text = [i for i, _ in texts], [f"p q r s t {middle[m]} k l m n o" for _, m in texts]
    want = {(2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (5, 2), (5, 4)}
    for most in (1 << 20, 1):  # pairs made at once
        monkeypatch.setattr(chaining, "PAIRS", most)
        place = [7 + (i == 4) for i in ids]
        m = [np.array([[0, 0, 0], [p, 7, 0]], np.int32).tobytes() for p in place]
        refs = [np.array([1, 1]).tobytes() for _ in ids]
        covered = pa.array([None] * 5, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
        b = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(text), pa.array(refs, pa.binary()), pa.array(m, pa.binary()), covered], ["doc_id", "text", "refs", "m", "covered"])
        sides = [x for k in (slice(0, 3), slice(3, 2)) for x in chaining._edges(1)([b.slice(k.start, k.stop)])]
        got = set()
        for out in chaining._pairs(1)(iter(sides)):
            for blob, n in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True):
                doc, ref, _ = chaining._unpacked(blob, n)
                got |= set(zip(doc.tolist(), ref.tolist(), strict=True))
        assert got == want
