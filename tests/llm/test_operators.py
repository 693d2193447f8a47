"""Each operator and pipeline stage on small tables: brute force, nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import chaining, chat, common, covertree, decontaminate, jaccard, langid, licenses, pieces, styletree, suffixdedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of the operators' own results, given to the input as well.
CLASHES = ("class_id", "kept", "score", "spans", "known", "ms", "rep", "n", "label", "component", "lang_pred")

PROSE = [" ".join(f"{stem}{(7 * k + j) % 83}" for j in range(90)) for k, stem in enumerate(("alpha", "beta", "gamma", "delta"))]
ROWS = [
    (1, PROSE[0]), (2, PROSE[0]), (3, PROSE[0] + " tail"), (4, PROSE[1]), (5, None), (6, ""), (7, "..."), (8, "one two"), (9, "one two"),
    (10, PROSE[2] + "\n" + PROSE[1] + "\n" + PROSE[3]), (11, "é" * 60 + PROSE[3][:200]), (12, "long " * 30000), (13, PROSE[3][:57] + " unlike the rest of it"), (14, "\U0001f600 ▁ \ttabs"),
]


def frame(spark, rows=None, extra=True):
    rows = ROWS if rows is None else rows
    df = spark.createDataFrame([(i, t, "en" if i is None or i % 2 else "fr", "s", len(t or "")) for i, t in rows], DOCS)
    if extra:
        for c in CLASHES:
            df = df.withColumn(c, F.lit("x"))
    return df


def words(t):
    return re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower())


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def closure(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_jaccard_join_of_chains_of_copies(spark):
    import random

    rng = random.Random(3)
    base = [f"w{j}" for j in range(60)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(frame(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    label = closure(sets, links)
    assert got == {i: (label[i], sum(a == i for a, _ in links)) for i in sets}


def test_cut_tables_can_be_dropped(spark):
    import os

    df = common.cut(spark.range(5))
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder)
    common.drop(df)
    assert not os.path.exists(folder)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (200, 200), (None, 3), (50, 52), (52, 54)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 50: 50, 52: 50, 54: 50}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join(spark):
    got = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in jaccard.jaccard_join(frame(spark, [*ROWS, (None, "x"), (1, PROSE[0])])).collect()}
    sets = {i: shingles(t) for i, t in ROWS}
    links = [(a, b) for a in sets for b in sets if a != b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    label = closure(sets, links)
    assert got == {i: (label[i], sum(a == i for a, _ in links), label[i] == i) for i in sets}
    assert jaccard.jaccard_join(frame(spark, [])).count() == 0


def test_jaccard_join_cuts_a_large_class_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE_ROWS", 5)
    rows = [(k, " ".join(PROSE[0].split()[:85] + [f"own{k}"])) for k in range(23)]
    got = [(r.class_id, r.n_links) for r in jaccard.jaccard_join(frame(spark, rows)).collect()]
    assert got == [(0, 22)] * 23


def removed(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = [False] * len(b)
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                cover[p : p + 50] = [True] * 50
        rest = bytes(c for c, gone in zip(b, cover, strict=True) if not gone)
        runs = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        out[i] = (len(b), sum(cover), runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("size", [None, 60])
def test_suffix_dedup(spark, monkeypatch, size):
    if size:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(suffixdedup, "PACK", 2000)
    want = removed(ROWS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup_substrings(frame(spark, [*ROWS, (None, "x")])).collect()}
    assert got == {i: x[:4] for i, x in want.items()}
    out = suffixdedup.remove_substrings(frame(spark))
    assert out.columns == frame(spark).columns
    assert {r.doc_id: r.text for r in out.collect()} == {i: want[i][4] if t is not None else None for i, t in ROWS}
    assert suffixdedup.dedup_substrings(frame(spark, [])).count() == 0


def test_suffix_dedup_of_random_texts_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    lines = ["".join(rng.choice("abcé ") for _ in range(rng.randint(20, 140))) for _ in range(25)]
    rows = [(k, "".join(rng.choice(lines) for _ in range(rng.randint(0, 6)))) for k in rng.sample(range(-50, 500), 60)]
    rows += [(1000 + k, "ab" * k * 20) for k in range(5)] + [(2000, "".join(lines) * 3)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup_substrings(frame(spark, rows).repartition(5)).collect()}
    assert got == {i: x[:4] for i, x in removed(rows).items()}


def test_fuzzy_passages(spark):
    text = PROSE[1].split()
    edited = text[:20] + ["other"] + text[21:50] + text[51:]
    rows = [*ROWS, (20, "a b c " + " ".join(edited) + " d e f"), (None, "x")]
    got = {}
    for r in chaining.fuzzy_passages(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {2, 3, 9, 10, 20} - {9}
    assert got[2][0].copy and got[2][0].refs == [1] and got[3][0].n_words == 90 and got[3][0].refs == [1]
    assert got[20][0].start_word == 3 and got[20][0].n_words == 89 and 4 in got[20][0].refs and got[20][0].identity > 0.95
    assert [(r.start_word, r.n_words, r.best_ref) for r in got[10]] == [(90, 90, 4)]
    assert chaining.fuzzy_passages(frame(spark, [])).count() == 0


def test_fuzzy_passages_on_both_sides_of_different_words(spark):
    rows, gaps = [], (30, 65, 100, 200, 300)
    for k, gap in enumerate(gaps):
        shared = [[f"p{k}s{side}w{j}" for j in range(100)] for side in range(2)]
        rows += [(2 * k + d, " ".join(shared[0] + [f"p{k}d{d}w{j}" for j in range(gap)] + shared[1])) for d in range(2)]
    got = {}
    for r in chaining.fuzzy_passages(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.n_words, r.refs))
    want = {2 * k + 1: [(0, 100, [2 * k]), (100 + gap, 100, [2 * k])] for k, gap in enumerate(gaps)}
    want[1] = [(0, 230, [0])]
    assert {i: sorted(x) for i, x in got.items()} == want


def test_fuzzy_passages_of_lines_seen_singly_before(spark):
    passage = [f"w{j}" for j in range(60)]
    own = lambda i, n: [f"own{i}w{j}" for j in range(n)]
    rows = [(k + 1, own(k, 30) + passage[6 * k : 6 * k + 12] + own(100 + k, 30)) for k in range(9)]
    rows += [(10, own(10, 40) + passage + own(11, 40)), (20, own(20, 25) + passage + own(21, 70))]
    got = chaining.fuzzy_passages(frame(spark, [(i, " ".join(w)) for i, w in rows]).coalesce(1)).collect()
    assert [(r.doc_id, r.start_word, r.n_words, r.best_ref, r.identity) for r in got] == [(20, 25, 60, 10, 1.0)]


def passages_of_all_pairs(rows):
    """Words covered by passages when the seeds of every pair of texts are chained, for each document."""
    import numpy as np
    import pyarrow as pa

    from pagewright.llm import wordhash as wh

    held = {}
    for i, t in sorted(rows):
        (_, _, data, offsets), = wh.chunks(pa.array([t], pa.large_string()))
        h, bounds, _, _ = wh.words(data, offsets)
        _, pos, g = chaining.seeds(h, bounds)
        held[i] = h.astype(np.uint32), pos, g
    out = {}
    for i, (w, pos, g) in held.items():
        spans = []
        for j, (v, there, k) in held.items():
            points = np.argwhere(g[:, None] == k[None, :]) if j < i else np.zeros((0, 2), int)
            for c in chaining.chains(np.stack([pos[points[:, 0]], there[points[:, 1]]], axis=1)) if len(points) > 1 else ():
                spans += [(s, s + n) for s, n, *_ in chaining.good_spans(c, w, 0, v)]
        got, reach = set(), -9
        for a, z in [*sorted(spans), (1 << 30, 0)]:
            if a > reach + 2:
                if reach > 0 and reach - low >= chaining.LEAST:
                    got |= set(range(low, reach))
                low, reach = a, z
            reach = max(reach, z)
        out[i] = got
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fuzzy_passages_find_what_all_pairs_find(spark, seed):
    import random

    rng = random.Random(seed)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    lines = [[f"l{k}w{j}" for j in range(rng.randint(8, 14))] for k in range(12)]
    passages = [[x for _ in range(9) for x in rng.choice(lines)] if rng.random() < 0.5 else own(rng.randint(50, 120)) for _ in range(8)]
    rows = []
    for i in range(70):
        w = own(rng.randint(5, 40))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:  # a snippet, so that seeds are first met elsewhere
                a = rng.randrange(len(p) - 11)
                p = p[a : a + rng.randint(12, 30)]
            for _ in range(rng.randint(0, len(p) // 20)):
                p[rng.randrange(len(p))] = f"e{rng.randrange(10**9)}"
            w += p + own(rng.randint(5, 40))
        rows.append((i, " ".join(w)))
    rows += [(200, " ".join(own(9) + passages[0] + own(9))), (201, " ".join(own(3) + passages[0] + own(3)))]
    results = []
    for n in (1, 7):
        found = chaining.fuzzy_passages(frame(spark, rows).repartition(n)).collect()
        results.append(sorted((r.doc_id, r.start_word, r.n_words, tuple(r.refs), r.best_ref, r.best_start, r.identity) for r in found))
    assert results[0] == results[1]
    got = {}
    for i, a, n, *_ in results[0]:
        got.setdefault(i, set()).update(range(a, a + n))
    want = passages_of_all_pairs(rows)
    every = sum(map(len, want.values()))
    assert every > 500 and sum(len(w & got.get(i, set())) for i, w in want.items()) >= 0.95 * every
    assert sum(len(g - want[i]) for i, g in got.items()) <= 0.05 * every


def test_fuzzy_passages_behind_snippets(spark):
    import random

    rng = random.Random(8)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(90)
    rows = [(k, " ".join(own(20) + passage[7 * k : 7 * k + 12] + own(20))) for k in range(12)]
    rows += [(100, " ".join(own(15) + passage + own(30))), (101, " ".join(own(33) + passage + own(8)))]
    crowd = [(200 + k, " ".join(own(10) + passage[20:75] + own(10))) for k in range(40)]  # more than CROWD of a batch
    for n in (1, 4):
        got = [(r.doc_id, r.start_word, r.n_words, r.best_ref) for r in chaining.fuzzy_passages(frame(spark, [*rows, *crowd]).repartition(n)).collect()]
        assert sorted(got) == [(101, 33, 90, 100)] + [(i, 10, 55, 100) for i, _ in crowd]


def test_decontaminate(spark, monkeypatch):
    items = [(1, PROSE[1]), (2, " ".join(PROSE[2].split()[10:30])), (3, "one two"), (4, None), (5, ""), (6, "never seen at all here"), (None, "x"), (1, PROSE[1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = set()
    for i, t in ROWS:
        for n, x in items:
            k = min(5, len(words(x)))
            grams = lambda ws, k=k: {tuple(ws[p : p + k]) for p in range(len(ws) - k + 1)} if k else set()
            own = grams(words(x))
            both = grams(words(t)) & own
            if n and k and 5 * len(both) >= 4 * len(own):
                want.add((i, n, len(own), len(both)))
    for bits in (1 << 27, 1 << 10, 64):  # a filter that is full lets everything through to the joins
        monkeypatch.setattr(decontaminate, "BITS", bits)
        got = [tuple(r) for r in decontaminate.contaminated(frame(spark, [*ROWS, (None, "one two")]), bench).collect()]
        assert set(got) == want and len(got) == len(want)
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark), bench.limit(0)).count() == 0


def test_items_are_found_as_brute_force_does(spark):
    """Items of all sizes in random documents, one of them holds every item, many times over; one id with two texts."""
    import random

    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (1, 3, 5, 9, 20, 40, 70, 9000)]
    docs = []
    for k in range(40):
        d = text(rng.randint(0, 400))
        at = rng.randint(0, len(d))
        part = list(items[k % 8])
        if k % 3 == 0 and len(part) > 20:
            part[3] = "edit"
        docs.append((k, " ".join(d[:at] + part + d[at:])))
    docs += [(40, " ".join(" ".join(x) for x in items * 20)), (7, docs[6][1]), (7, docs[6][1])]
    most: dict = {}
    for r, d in docs:
        w = d.split()
        for n, x in enumerate(items):
            k = min(5, len(x))
            grams = lambda ws, k=k: {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
            both = len(grams(x) & grams(w))
            if both * 5 >= 4 * len(grams(x)):
                most[r, n] = max(both, most.get((r, n), 0))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(items)], "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id): r.n_common for r in got} == most and len(got) == len(most)


def test_language_id(spark):
    rows = [(k, ("the house of " if k % 2 else "la maison est ") * 5 + str(k)) for k in range(60)] + [(100, None), (101, ""), (102, "12 !"), (103, "the house"), (103, "the house")]
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 3, None).otherwise(F.when(F.col("doc_id") % 2 == 1, "en").otherwise("fr")))
    m = langid.fit(docs.where("doc_id < 60"))
    got = langid.predict(docs, m).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred, r.score) == ("und", 0) if 100 <= r.doc_id < 103 else r.lang_pred == ("en" if r.doc_id % 2 else "fr") and 0 <= r.score <= 1 for r in got)
    kept = langid.keep_languages(docs, m, 0.25)
    assert {r.lang for r in kept.where("doc_id = 3").collect()} == {"en"}
    assert kept.columns == docs.columns and kept.count() == 62
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"} and langid.predict(docs.limit(0), m).count() == 0


def test_language_id_equals_brute_force(spark):
    """Landmarks, Nystroem map, ridge and prediction by sets of n-grams and plain linear algebra; long texts and rare planes."""
    import random

    import numpy as np

    rng = random.Random(2)
    stems = {"aa": "the of and to in".split(), "bb": "der die und zu von".split(), "cc": "\U00010428\U00010429 \U0001042a \U00010428".split()}
    rows = [(k, " ".join(rng.choice(stems[lang]) + rng.choice("xyz ") for _ in range(rng.randint(1, 30))), lang) for k, lang in enumerate(sorted(stems) * 15)]
    tests = [*(t for _, t, _ in rows), "of 12 the !", "\U00010428 \U0001f600", "und und " * 50000]

    def grams(t):
        t = re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else " ", t.lower(), flags=re.S)
        t = re.sub(" +", " ", t)
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    sets, texts = [grams(t) for _, t, _ in rows], [grams(t) for t in tests]
    order = np.argsort([(i * 0x9E3779B1) % (1 << 32) for i in range(len(rows))])[: langid.LANDMARKS]
    vocabulary = set().union(*(sets[i] for i in order))
    assert len({int(x) for g in vocabulary for x in langid.grams(g)}) >= len(vocabulary)
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    mm, nm, tm = (np.array([[kernel(a, sets[j]) for j in order] for a in x]) for x in ([sets[j] for j in order], sets, texts))
    values, vectors = np.linalg.eigh(mm)
    good = values > 1e-6 * values.max()
    to = vectors[:, good] / np.sqrt(values[good])
    langs = sorted(stems)
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for *_, lang in rows])
    w = np.full(len(rows), 1 / len(rows))  # the languages have equally many rows
    x = nm @ to
    weights = np.linalg.solve((x * w[:, None]).T @ x + langid.RIDGE / len(rows) * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
    value = tm @ to @ weights
    want = [(langs[k], min(max((v[k] + 1) / 2, 0), 1)) for v, k in zip(value, value.argmax(1), strict=True)]
    m = langid.Model([t for _, t, _ in rows], [lang for *_, lang in rows])
    docs = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, m).collect()}
    assert all(got[k][0] == lang and abs(got[k][1] - s) < 0.01 for k, (lang, s) in enumerate(want))


def test_held_out_rule(spark):
    import zlib

    got = {r.doc_id: r.h for r in spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", langid.held_out("doc_id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_pieces_round_trip(spark):
    import os

    if not os.path.exists(pieces.MODEL):
        pytest.skip("no model file here")
    docs = frame(spark, [*ROWS, (None, "x"), (40, "y" * 50000)])
    full = pieces.encode(docs, n=3)
    assert {r.doc_id: r.text for r in pieces.decode(full).collect()} == {**{i: t or "" for i, t in ROWS}, 40: "y" * 50000}
    digest = {r.doc_id: r for r in pieces.encode(docs, n=3, digest=True).collect()}
    for r in full.collect():
        d = digest[r.doc_id]
        assert d.decoded and d.n_tokens == len(r.ids) and list(d.costs) == list(r.costs) == sorted(r.costs)
    assert pieces.encode(docs.limit(0)).count() == 0


def test_near_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [nan, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-0.0, 1.0], 1), (14, [0.0, 1.0], 1), (15, [1.0, 0.3], 1), (16, [inf, 1.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("component", F.lit(0)).withColumn("mult", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df).collect()}
    good = {i: (v, k) for i, v, k in rows if i and i not in (5, 6, 7, 8, 9, 10, 16)}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    links = [(a, b) for a in good for b in good if a != b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and cos(good[a][0], good[b][0]) >= 0.98]
    label = closure([i for i, *_ in rows if i], links)
    assert got == {i: (sum(a == i for a, _ in links), label[i], label[i] == i) for i in label}
    assert covertree.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 7)
    df = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") / 1000).alias("embedding"), F.lit(1).alias("label"))
    assert {(r.n_links, r.component_id) for r in covertree.near_vectors(df).collect()} == {(39, 0)}


PAGES = "page_id long, url string, html string"


def test_main_text_with_style_trees(spark):
    page = lambda k: f"<body><div class='c1'>Home News Contact</div><div class='c2'><p>text {k} of its own {k * k}</p><p>more {k}</p></div><div class='c3'>All rights reserved</div>"
    rows = [(k, "http://h.example/" + str(k), page(k)) for k in range(20)] + [(50, None, "<p>a</p>"), (51, "http://x/", None), (52, "bad", ""), (53, "http://one.example/", page(3)), (53, "http://one.example/", page(3)), (None, "u", "x"), (54, "http://long.example/", "<p>" + "word " * 200000 + "</p>")]
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("x")).withColumn("judged", F.lit("x")).withColumn("text", F.lit("x"))
    got = styletree.main_text(df).collect()
    assert len(got) == 26
    by = {r.page_id: r for r in got}
    assert by[4].text == "text 4 of its own 16\nmore 4" and by[4].n_chars == len(by[4].text)
    assert by[51].text == by[52].text == "" and by[50].text == "a" and "rights" in by[53].text and by[54].n_chars == 999999
    assert styletree.main_text(df.limit(0)).count() == 0


def test_style_trees_work_inside_articles(spark):
    """The entropies alone tell a repeated block of no telling name from the article, and taking the tree away brings it back."""
    import random

    rng = random.Random(5)
    prose = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(30))
    own = {k: (prose(), prose()) for k in range(30)}
    page = lambda k: f"<article><h1>{own[k][0]}</h1><div class='k7'>Read us daily</div><p>{own[k][1]}</p></article>"
    df = spark.createDataFrame([(k, "http://a.example/", page(k)) for k in own], PAGES)
    assert {r.page_id: r.text for r in styletree.main_text(df).collect()} == {k: "\n".join(x) for k, x in own.items()}
    assert all("Read us daily" in styletree.Page(page(k)).text() for k in own)


def test_style_trees_spare_copies_and_many_constant_blocks(spark):
    import random

    rng = random.Random(6)
    prose = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(60))
    blocks = "".join(f"<div class='b{j}'>constant {j}</div>" for j in range(12))
    wide = {k: prose() for k in range(40)}
    one = prose()
    copied = {100 + k: one if k < 95 else prose() for k in range(100)}
    near = {300 + k: f"{one} end {k}" if k < 95 else prose() for k in range(100)}
    rows = [(k, "http://wide/", f"<body>{blocks}<div class='t'>{t}</div></body>") for k, t in wide.items()]
    rows += [(k, f"http://copied{k // 300}/", f"<article><h1>{t[:20]}</h1><p>{t}</p></article>") for k, t in [*copied.items(), *near.items()]]
    got = {r.page_id: r.text for r in styletree.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {**wide, **{k: f"{t[:20].strip()}\n{t}" for k, t in [*copied.items(), *near.items()]}}


def test_style_tree_importance_equals_brute_force(spark):
    import math
    import random

    rng = random.Random(7)
    rows = [(k, f"http://h{k % 3}/", "".join(f"<div class='c{j}'>{rng.choice('ab')}<p>{rng.randrange(1, 4) * 'x '}</p>{'<p>y</p>' * rng.randrange(2)}</div>" for j in range(rng.randint(1, 3)))) for k in range(40)]
    seen: dict = {}
    for _, url, page in rows:
        p = styletree.Page(page)
        for path, shape, content, kids in p.units():
            seen.setdefault((styletree.host(url), path), {})[(p.key(p.priors()), shape, content, kids)] = 1
    want = {}
    for at, values in seen.items():
        entropy = []
        for kind in (1, 2):
            keys: dict = {}
            for v in values:
                keys.setdefault(v[kind], set()).add(v[0])
            n = [len(x) for x in keys.values()]
            all_ = [*n, *[1] * styletree.PRIOR_PAGES]
            h = -sum(c / sum(all_) * math.log(c / sum(all_)) for c in all_) / math.log(sum(all_))
            entropy.append(h)
        want[at] = entropy
    got = {(r.host, r.path): r for r in styletree.style_tree(spark.createDataFrame(rows, PAGES)).collect()}
    assert set(got) == set(want)
    for at, (hp, hc) in want.items():
        g = styletree.GAMMA ** got[at].l
        assert abs(got[at].importance - ((1 - g) * hp + g * hc)) < 1e-9


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.txt", "prose\n" + gpl + "\nprose prose prose prose prose prose prose prose prose prose prose prose"), (3, "a/b/y.txt", "nothing here"), (4, "z/w.txt", "nothing"), (5, None, mit), (6, "a/b/null.txt", None), (7, "top", ""), (8, "a/b/c/COPYING", gpl), (9, "a/b/c/d.txt", "x"), (9, "a/b/c/d.txt", "x"), (10, "k/l.txt", "a licensed copyright of something that is not a template at all")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("x")).withColumn("dir", F.lit("x"))
    got = {r.doc_id: r for r in licenses.license_scan(df, "doc_id").collect()}
    assert (got[1].license, got[1].license_file) == ("MIT", True) and (got[2].license, got[2].license_file, got[2].inherited) == ("GPL-3.0", False, "GPL-3.0")
    assert got[3].license is None and got[3].inherited == got[3].effective == "MIT" and got[4].effective is None
    assert got[5].license == "MIT" and got[5].inherited is None and got[6].effective == "MIT" and got[7].effective is None
    assert got[9].effective == "GPL-3.0" and got[10].license is None
    assert licenses.license_scan(df, "doc_id").count() == len(rows)
    assert licenses.license_scan(df.limit(0), "doc_id").count() == 0


def test_licence_texts_headers_and_levels(spark):
    mit = next(t for name, t in licenses.TEXTS if name == "MIT")
    bsd = next(t for name, t in licenses.TEXTS if name == "BSD-2-Clause")
    apache = next(t for name, t in licenses.TEXTS if name == "Apache-2.0")
    wrapped = lambda t, mark="": "\n".join(mark + " ".join(t.split()[k : k + 9]) for k in range(0, len(t.split()), 9))
    prose = "\n".join(" ".join(f"word{(k * 37 + j * 101) % 400}" for j in range(8)) for k in range(60))
    rows = [
        (1, "r/LICENSE", "Copyright 2020 Someone\n\n" + wrapped(mit)), (2, "r/a/b/c/f.txt", prose), (3, "r/a/b/COPYING", wrapped(bsd)), (4, "r/a/b/c/d/g.txt", prose),
        (5, "r/src/h.c", wrapped(apache, " * ") + "\n" + prose), (6, "r/i.txt", prose + "\nReleased under the\nMIT License\n" + prose), (7, "s/j.txt", "under the license of the house, version of the work " * 9), (8, "s/long.txt", "MIT " * 200000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df, "doc_id").collect()}
    assert (got[1].license, got[1].license_file) == ("MIT", True) and (got[3].license, got[3].license_file) == ("BSD-2-Clause", True)
    assert (got[2].license, got[2].effective, got[4].effective) == (None, "BSD-2-Clause", "BSD-2-Clause")
    assert (got[5].license, got[5].license_file, got[5].inherited) == ("Apache-2.0", False, "MIT")
    assert got[6].license == "MIT" and not got[6].license_file and got[7].license is None and got[7].effective is None
    # Many times the same files score alike.
    many = df.unionByName(df.selectExpr("doc_id + 100", "'x/' || path", "text").toDF("doc_id", "path", "text")).unionByName(df.selectExpr("doc_id + 200", "'y/' || path", "text").toDF("doc_id", "path", "text"))
    more = {r.doc_id: r for r in licenses.license_scan(many, "doc_id").collect()}
    for i, r in got.items():
        assert {(more[k].license, more[k].effective) for k in (i, i + 100, i + 200)} == {(r.license, r.effective)}
        assert r.score is None or abs(r.score - more[i].score) < 0.05


def test_licence_scores_equal_brute_force(spark):
    import math
    import random

    rng = random.Random(3)
    vocabulary = [*licenses.VOCABULARY[::3], *(f"w{k}" for k in range(60))]
    rows = []
    for i in range(40):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 30))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice([t for _, t in licenses.WORDINGS]).split()
            lines.insert(rng.randrange(len(lines)), " ".join(x for x in w if rng.random() < 0.9))
        if rng.random() < 0.2:
            lines = [" ".join(x for x in line.split() if rng.random() < 0.95) for line in rng.choice(licenses.TEXTS)[1].split(". ")]
        rows.append((i, f"p/{i}", "\n".join(lines)))
    terms = lambda t: re.findall("[a-z0-9]+", t.lower())
    df: dict = {}
    for *_, t in rows:
        for x in set(terms(t)):
            df[x] = df.get(x, 0) + 1

    def vector(words):
        return {t: (1 + math.log(words.count(t))) * (math.log((len(rows) + 1) / (df.get(t, 0) + 1)) + 1) for t in set(words)}

    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for i, _, t in rows:
        lines, best = t.split("\n"), []
        half = licenses.BLOCK // 2
        passages = [(False, p) for p in [*lines, *map(" ".join, zip(lines, lines[1:], strict=False))]] + [(True, t)]
        passages += [(True, " ".join(lines[k : k + licenses.BLOCK])) for k in range(0, len(lines), half) if not k or k + 1 + half <= len(lines)]
        for full, p in passages:
            v = vector(terms(p))
            for _, name, whole, words in licenses.TEMPLATES:
                if whole == full and v:
                    w = vector(words)
                    score = round(sum(x * w.get(k, 0) for k, x in v.items()) / norm(v) / norm(w), 6)
                    if score >= licenses.LEAST:
                        best.append((-score, name))
        want[i] = (min(best)[1], -min(best)[0]) if best else (None, None)
    got = {r.doc_id: (r.license, r.score) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id").collect()}
    assert sum(x[0] is not None for x in want.values()) > 10
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(x[1] is None or abs(x[1] - want[i][1]) < 2e-6 for i, x in got.items())


def test_chat_layouts(spark):
    kind = "prompt string, response string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, turns string"
    tricky = "\\e#h<l</turn>\n### a: b\\"
    rows = [("p", "r", None, None, None, None, "x"), (None, None, "i", "in", tricky, None, "x"), (None, None, "i", None, "o", None, None), (None, None, None, None, None, [("user", None), (None, tricky), ("a:b", "c")], None), (None,) * 7]
    out = chat.format_chats(spark.createDataFrame(rows, kind).withColumnRenamed("turns", "extra"))
    got = out.select("turns", chat.parsed(F.col("formatted")).alias("back"), "schema_fp", "formatted", "loss_spans", chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    plain = lambda turns: [(t.role or "", t.text or "") for t in turns]
    assert plain(got[0].turns) == [("user", "p"), ("assistant", "r")]
    assert plain(got[1].turns) == [("user", "i\nin"), ("assistant", tricky)] and got[1].loss == tricky
    assert plain(got[2].turns) == [("user", "i"), ("assistant", "o")]
    assert plain(got[3].turns) == [("user", ""), ("", tricky), ("a:b", "c")] and got[4].turns is None
    assert all(plain(r.back) == plain(r.turns) for r in got if r.turns is not None)
    for r in got[:4]:
        said = [t for role, t in plain(r.turns) if role == "assistant"]
        cuts = [r.formatted[s.start : s.start + s.n] for s in r.loss_spans]
        undo = lambda x: x.replace("\\l", "<").replace("\\h", "#").replace("\\e", "\\")
        assert [undo(c) for c in cuts] == said and r.loss == "".join(said)
        assert all(r.formatted[: s.start].endswith("### assistant: ") and r.formatted[s.start + s.n :].startswith("</turn>\n") for s in r.loss_spans)
    assert got[4].formatted is None and got[4].loss is None
    assert len({r.schema_fp for r in got}) == 5


def test_chat_query_edge_cases(spark, tmp_path):
    long = "### <\\é" * 200000
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, None, None, chat.PROBE), (4, 0, "user", "x"), (4, 1, "assistant", long)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op5_chat_format(spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, -7}
    assert (got[4].loss_chars, got[4].loss_sha256) == (len(long), digest(long)) and got[4].schema_fp != got[-7].schema_fp
    assert got[1].turns_sha256 == digest("user\nhi\nassistant\n\n") and got[1].loss_chars == 0
    assert (got[2].n_turns, got[2].loss_sha256) == (2, digest("aa"))
    assert got[3].turns_sha256 == digest("\n" + chat.PROBE + "\n")
    assert got[-7].loss_sha256 == digest(chat.PROBE) and got[-7].loss_chars == len(chat.PROBE)
    assert got[-7].turns_sha256 == digest(f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n")
    (tmp_path / "empty").mkdir()
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "empty" / "conversations.parquet"))
    assert [r.conv_id for r in chat.op5_chat_format(spark, str(tmp_path / "empty")).collect()] == [-7]


def test_pipeline(spark, tmp_path):
    """Every stage against brute force, or what it must do by its rules."""
    import os
    import random

    if not os.path.exists(pieces.MODEL):
        pytest.skip("no model file here")
    rng = random.Random(1)
    tongues = {
        "en": "the of and house that with from which were their".split(), "fr": "la le de maison que avec dans qui étaient leurs".split(),
        "de": "der die und haus dass mit von welche waren ihre".split(), "es": "el los de casa que con desde cual eran sus".split(),
    }
    names = sorted(tongues)
    word = lambda k: rng.choice(tongues[names[k % 4]])
    text = lambda k: " ".join(f"{word(k)} {word(k)}{k * 31 + j}" for j in range(60))
    rows = [(k, " ".join(f"{word(k)} {word(k)}{x}" for x in PROSE[k % 4].split()[:45]) + " " + text(k)) for k in range(24)]
    rows = [(k, f"{t} {rows[k - 4][1][:150]}" if k > 19 else t) for k, t in rows]
    alien = [(31, None), (32, "..."), (None, "the house"), (34, "Το ελληνικό κείμενο δεν είναι γνωστό σε κανέναν εδώ και τώρα"), (35, "это русский текст о погоде и людях")]
    item = " ".join(f"item{j}" for j in range(30))
    rows += [(40, rows[3][1] + " the end"), (41, text(1) + " " + item), (43, "the house " + rows[5][1][100:400])]
    docs = frame(spark, [*rows, *alien]).withColumn("lang", F.when((F.col("doc_id") != 7) & (F.col("doc_id") < 31), F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 4 + 1).cast("int"))))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.cut(stage(spark, docs, str(tmp_path)))
        kept.append(docs.collect())
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    texts = [{r.doc_id: r.text for r in stage} for stage in kept[:-1]]
    assert texts[0] == dict(rows) and {r.doc_id: r.lang for r in kept[0]}[7] == names[3]
    sets = {i: shingles(t) for i, t in texts[0].items()}
    label = closure(sets, [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    assert texts[1] == {i: t for i, t in texts[0].items() if label[i] == i} and 40 not in texts[1]
    cutout = removed(list(texts[1].items()))
    assert texts[2] == {i: x[4] for i, x in cutout.items() if x[4].strip()} and any(x[1] for x in cutout.values())
    assert all(r.n_chars == len(r.text) for r in kept[2])
    own = shingles(item)
    assert texts[3] == {i: t for i, t in texts[2].items() if 5 * len(shingles(t) & own) < 4 * len(own)} and 41 not in texts[3]
    assert {r.doc_id for r in kept[4]} == set(texts[3]) and all(r.decoded and r.n_tokens == len(r.ids) for r in kept[4])
    assert {r.doc_id: r.text for r in pieces.decode(docs).collect()} == texts[3]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.ids) for r in again.collect()) == sorted((r.doc_id, r.ids) for r in kept[4])


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import os

    if not os.path.exists(pieces.MODEL):
        pytest.skip("no model file here")
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
