"""Alignment of words and edit distances against plain forms, and long texts."""

import difflib
import random
import time

from pyspark.sql import functions as F

from pagewright.operators import alignment, metrics


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_equals_the_whole_table():
    r = random.Random(1)
    for _ in range(1500):
        letters = r.choice(["ab", "aбé", "жшщ😀x"])
        a, b = ("".join(r.choice(letters) for _ in range(r.randrange(90))) for _ in range(2))
        if r.random() < 0.5:  # nearly equal
            b = "".join(c for c in a if r.random() > 0.05)
        assert alignment.edit_distance(a, b) == alignment.edit_distance(b, a) == table_distance(a, b)
        for band in (max(1, abs(len(a) - len(b))), 70):
            long, short = (a, b) if len(a) >= len(b) else (b, a)
            if short:
                found, want = alignment._within(long, short, band), table_distance(a, b)
                assert found == want if want <= band else found > band


def test_long_nearly_equal_texts_take_linear_time():
    r = random.Random(2)
    a = "".join(r.choice("абвгд ежз") for _ in range(1_000_000))
    b = list(a)
    for _ in range(20):
        b[r.randrange(len(b))] = "Ω"
    began = time.time()
    assert alignment.edit_distance(a, "x" + "".join(b)) <= 21
    assert time.time() - began < 60


def test_distance_column(spark):
    long = "дълъг текст " * 400
    rows = [("абв", "абг", 1), (None, "x", None), ("", "xyz", 3), (long, long.replace("ъ", "ь", 3) + "!", 4), (long, "", len(long)), (long, "у" * 3000, None)]
    df = spark.createDataFrame(rows, "a string, b string, n long")
    got = [r[0] for r in df.select(alignment.distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[:5] == [r[2] for r in rows[:5]] and got[5] == table_distance(long, "у" * 3000)


def opcode_pairs(ref, hyp):
    steps = difflib.SequenceMatcher(None, ref, hyp, autojunk=False).get_opcodes()
    return [(a + k, c + k) for kind, a, b, c, d in steps if kind in ("equal", "replace") and b - a == d - c for k in range(b - a)]


def edited(r, words):
    out = []
    for w in words:
        x = r.random()
        out += [] if x < 0.03 else ["#" + w] if x < 0.1 else [w, "+" + w] if x < 0.13 else [w]
    return out


def test_alignment_equals_longest_blocks_where_words_are_unique(spark):
    r = random.Random(3)
    rows = []
    for key in range(40):
        ref = [f"W{key}x{n}" for n in range(r.randrange(60))]
        rows.append((key, ref, edited(r, ref), "x"))
    rows += [(90, [], ["a"], "x"), (91, None, None, "x"), (92, ["a", "B", "c"], ["A", "b", "C"], "x"), (93, ["a", "a", "a"], ["a", "a"], "x")]
    df = spark.createDataFrame(rows, "key long, ref array<string>, hyp array<string>, gap string")
    got = {}
    for x in alignment.align(df, ["key"]).collect():
        got.setdefault(x.key, []).append((x.ref_ix, x.hyp_ix))
        ref, hyp = next((a, b) for k, a, b, _ in rows if k == x.key)
        assert (x.ref_word, x.hyp_word) == (ref[x.ref_ix], hyp[x.hyp_ix])
    for key, ref, hyp, _ in rows:
        assert sorted(got.get(key, [])) == opcode_pairs([w.lower() for w in ref or []], [w.lower() for w in hyp or []]), key


def test_a_word_that_seems_to_have_moved_is_no_anchor(spark):
    """a misread word may spell another word of the text; alone off the way it is no anchor."""
    ref = "la casa que la casa la la casa ue la casa".split()
    hyp = [{2: "qque", 8: "que"}.get(k, w) for k, w in enumerate(ref)]
    same = [(k, k) for k in range(len(ref))]
    assert alignment.facing(ref, hyp) == same
    assert alignment.worth([(0, 0), (2, 8), (9, 9)], 0, 0) == [(0, 0), (9, 9)]
    assert alignment.worth([(0, 3), (1, 4), (2, 5), (3, 6)], 0, 3) == [(0, 3), (1, 4), (2, 5), (3, 6)]
    df = spark.createDataFrame([(1, ref, hyp)], "id long, ref array<string>, hyp array<string>")
    assert sorted((r.ref_ix, r.hyp_ix) for r in alignment.align(df, ["id"]).collect()) == same


def test_gaps_and_the_whole_agree():
    """Anchors of the whole text first, or the plain function over all of it: the same pairs where words repeat, too."""
    r = random.Random(4)
    for _ in range(200):
        ref = [r.choice("abcdefghijklmnop") + str(r.randrange(6)) for _ in range(r.randrange(50))]
        hyp = edited(r, ref)
        pairs = alignment.facing(ref, hyp)
        assert [i for i, _ in pairs] == sorted({i for i, _ in pairs}) and [j for _, j in pairs] == sorted({j for _, j in pairs})
        equal = sum(ref[i] == hyp[j] for i, j in pairs)
        assert equal >= 0.9 * sum(ref[i] == hyp[j] for i, j in opcode_pairs(ref, hyp))


def test_ways_of_fewest_edits(monkeypatch):
    r = random.Random(5)
    for _ in range(400):
        ref, hyp = ([r.choice("abc") for _ in range(r.randrange(12))] for _ in range(2))
        ways = []
        for cells in (1 << 26, 6):
            monkeypatch.setattr(alignment, "CELLS", cells)
            ways.append(alignment.equal_words(ref, hyp))
            edges = [(-1, -1), *ways[-1], (len(ref), len(hyp))]
            assert all(ref[i] == hyp[j] for i, j in ways[-1]) and all(i < k and j < m for (i, j), (k, m) in zip(edges, edges[1:], strict=False))
            assert sum(max(k - i, m - j) - 1 for (i, j), (k, m) in zip(edges, edges[1:], strict=False)) == table_distance(ref, hyp)
    monkeypatch.setattr(alignment, "CELLS", 1 << 26)
    same, began = ["long"] * 6000, time.time()
    other = ["q" if k % 11 == 5 else w for k, w in enumerate(same)]
    assert alignment.facing(same, other) == [(k, k) for k in range(6000)] and time.time() - began < 20


def test_a_book_is_aligned_in_pieces(spark):
    n = 300_000
    book = spark.range(1).select(F.lit(1).alias("key"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.when(k % 5 == 0, "the").otherwise(F.concat(F.lit("w"), k.cast("string")))).alias("ref"))
    book = book.withColumn("hyp", F.transform("ref", lambda w, k: F.when(k % 97 == 3, F.concat(w, F.lit("?"))).otherwise(w)))
    found = alignment.align(book, ["key"]).agg(F.count("*"), F.count_if(F.col("ref_ix") == F.col("hyp_ix")), F.count_if(F.col("ref_word") != F.col("hyp_word"))).first()
    assert tuple(found) == (n, n, sum(k % 97 == 3 for k in range(n)))


def test_fixes(spark):
    words = "Река тече към голямо море и река тече пак".split()
    first = "Pека тече кьм голямо mope и pека тече пак".split()
    df = spark.createDataFrame([(1, words, first, words[:3], words), (2, words, words, words, words), (3, [], [], [], [])], "id long, ref array<string>, first array<string>, other array<string>, ours array<string>")
    got = [(r.ix, r.word, r.first_read, r.other_read, r.our_read) for r in metrics.fix_list(df, "id").orderBy("id", "ix").collect()]
    assert got == [(0, "Река", "Pека", "Река", "Река"), (1, "море", "mope", None, "море"), (2, "към", "кьм", "към", "към")]
    assert metrics.fix_list(df, "id", limit=1).count() == 1


def test_words_of_texts_are_not_shuffled(spark):
    """the words of two texts are aligned in their row; null words and texts in slices of a batch are kept apart."""
    rows = [(k, f"k{k}", [f"w{k}", None, "x", "Y", "x"][: k % 6], [f"W{k}", None, "x", "z", "x"][k % 2 : k % 6]) for k in range(40)] + [(90, "n", None, ["a"]), (91, None, ["a"], ["A", "b"])]
    df = spark.createDataFrame(rows, "key long, other string, ref array<string>, hyp array<string>")
    found = alignment.align(df, ["key", "other"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.key, []).append((r.ref_ix, r.hyp_ix))
        ref, hyp = next((a, b) for k, o, a, b in rows if (k, o) == (r.key, r.other))
        assert (r.ref_word, r.hyp_word) == (ref[r.ref_ix], hyp[r.hyp_ix])
    lower = lambda w: [x and x.lower() for x in w or []]
    assert got == {k: pairs for k, _, ref, hyp in rows if (pairs := sorted(alignment.aligned(lower(ref), lower(hyp))))}
    assert got[5] == [(1, 0), (2, 1), (3, 2), (4, 3)] and got[4] == [(0, 0), (1, 1), (2, 2), (3, 3)]
