"""Plain parts of the operators against brute force, with random inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import chaining, chat, covertree, decontaminate, induce, jaccard, langid, pieces, styletree, suffixdedup
from pagewright.llm import wordhash as wh


def suffix_order(t, cap, budget, base):
    pos, lcp = [], []
    for p, q in induce.sorted_suffixes(np.array(t), cap, budget, base):
        pos += p.tolist()
        lcp += q.tolist()
    return pos, lcp


def check_suffixes(t, cap, budget, base):
    pos, lcp = suffix_order(t, cap, budget, base)
    want = sorted(range(len(t) - 1), key=lambda i: t[i:], reverse=True)
    assert [t[i : i + cap] for i in pos] == [t[i : i + cap] for i in want] and sorted(pos) == sorted(want)
    for k in range(1, len(pos)):
        a, b, c = t[pos[k - 1] :], t[pos[k] :], 0
        while c < min(cap, len(a), len(b)) and a[c] == b[c]:
            c += 1
        assert lcp[k] == c


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.sampled_from([3, 50]), st.sampled_from([0, 1 << 20]), st.sampled_from([0, 2, 1000]))
def test_induced_sorting(t, cap, budget, base):
    check_suffixes([*t, *t, 0], cap, budget, base)


def test_induced_sorting_with_ranges_of_symbols(monkeypatch):
    """A large alphabet is walked in ranges of symbols: here, ranges of a small one."""

    def bounds(t, flip):
        top = int(t.max()) + 1
        weight = np.cumsum(np.bincount(t, minlength=top)[:: -1 if flip else 1])
        return np.unique(np.concatenate([[0], np.searchsorted(weight, np.linspace(0, weight[-1], 4)[1:-1]), [top]]))

    monkeypatch.setattr(induce, "_bounds", bounds)
    rng = random.Random(2)
    for _ in range(150):
        t = [rng.randint(1, 9) for _ in range(rng.randint(1, 40))]
        check_suffixes([*t, *t[::2], 0], 1000, rng.choice([0, 1 << 20]), rng.choice([0, 1000]))


def test_queue_spills_and_keeps_the_order():
    q = induce.DiskQueue(budget=64)
    for k in range(20):
        q.push(k % 3, np.arange(k, k + 5), np.full(5, k, np.int32))
    assert q.spilled > 0
    pos, lcp = q.pop(1)
    assert lcp.tolist() == [k for k in range(20) if k % 3 == 1 for _ in range(5)]
    assert q.pop(1)[0].size == 0
    q.close()


def test_repeated_windows():
    rng = random.Random(5)
    for _ in range(30):
        parts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 20))) for _ in range(6)})
        doc = np.array([rng.randint(0, 3) for _ in parts])
        flagged = suffixdedup.repeated(parts, doc, window=4, budget=rng.choice([0, 1 << 20]), base=rng.choice([0, 1000]))
        want = []
        for p, d in zip(parts, doc, strict=True):
            for i in range(len(p)):
                w = p[i : i + 4]
                want.append(len(w) == 4 and any(w in q for q, e in zip(parts, doc, strict=True) if e < d))
        assert flagged.tolist() == want


def test_pieces_of_equal_windows_meet():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 101, 500).astype(np.uint8).tobytes()
    rows = [text, b"x" * 37 + text[100:300] + b"y" * 20, b"short", b""]
    data = np.frombuffer(b"".join(rows), np.uint8)
    offsets = np.cumsum([0, *map(len, rows)])
    row, at, size, h = suffixdedup.pieces(data, offsets)
    seen: dict[bytes, set] = {}
    windows = 0
    for r, a, n, x in zip(row, at, size, h, strict=True):
        for p in range(n - 49):
            seen.setdefault(rows[r][a + p : a + p + 50], set()).add(int(x))
            windows += 1
    assert windows == sum(max(0, len(x) - 49) for x in rows) and all(len(s) == 1 for s in seen.values())


def test_long_texts_are_cut_into_stretches(monkeypatch):
    text = np.random.default_rng(3).integers(97, 105, 3000).astype(np.uint8)
    whole = suffixdedup.pieces(text, np.array([0, 3000]))
    monkeypatch.setattr(suffixdedup, "STRETCH", 400)
    row, at, size, h = suffixdedup.pieces(text, np.array([0, 3000]))
    windows = lambda at, size, h: {(int(a) + p, int(x)) for a, n, x in zip(at, size, h, strict=True) for p in range(n - 49)}
    assert windows(at, size, h) == windows(*whole[1:])


def test_merged_spans():
    doc, lo, hi = np.array([7, 7, 7, 7, 7, -2]), np.array([5, 0, 3, 8, 20, 8]), np.array([9, 3, 4, 12, 21, 11])
    assert [x.tolist() for x in suffixdedup.merged_spans(doc, lo, hi)] == [[-2, 7, 7, 7], [8, 0, 5, 20], [11, 4, 12, 21]]
    none = np.zeros(0, int)
    assert [len(x) for x in suffixdedup.merged_spans(none, none, none)] == [0, 0, 0]


def test_seeds_do_not_depend_on_the_rows_before():
    rng = random.Random(6)
    rows = ["a a a a b " * 40, "same " * 100, " ".join(rng.choice("abc") for _ in range(300)), "x"]
    import pyarrow as pa

    def seeds(texts):
        ((_, _, data, offsets),) = wh.chunks(pa.array(texts, pa.large_string()))
        h, bounds, _, _ = wh.words(data, offsets)
        row, pos, g = chaining.seeds(h, bounds)
        return [(pos[row == len(texts) - 1].tolist(), g[row == len(texts) - 1].tolist())]

    for t in rows:
        assert all(seeds([*before, t]) == seeds([t]) for before in (["one two three four five six"], rows, ["same " * 7, "q"]))


def test_runs_of_equal_rows():
    import pyarrow as pa

    from pagewright.llm import common

    rng = random.Random(2)
    rows = sorted((rng.choice("ab"), rng.randrange(3), rng.randrange(9)) for _ in range(50))
    want = [[r for r in rows if r[:2] == k] for k in sorted({r[:2] for r in rows})]
    for size in (1, 7, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + size], strict=True)], ["g", "k", "v"]) for k in range(0, 50, size)]
        assert [[tuple(r.values()) for r in t.to_pylist()] for t in common.runs([batches[0].slice(0, 0), *batches], "g", "k")] == want
    assert list(common.runs([], "g")) == []


def test_rivals_are_the_parts_that_share_a_minimizer(monkeypatch):
    rng = np.random.default_rng(11)
    core = rng.integers(97, 123, (40, 50)).astype(np.uint8)
    rows = [core[k].tobytes() + bytes(rng.integers(97, 123, 5).astype(np.uint8)) for k in [*range(40), *range(0, 40, 4)]]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.arange(len(rows) + 1) * 55
    row, at, size, h = suffixdedup.pieces(data, offsets)
    parts = list(dict.fromkeys(rows[r][a : a + n] for r, a, n in zip(row, at, size, strict=True)))
    of = {rows[r][a : a + n]: int(x) for r, a, n, x in zip(row, at, size, h, strict=True)}
    times: dict[int, int] = {}
    for x in of.values():
        times[x] = times.get(x, 0) + 1
    for stretch in (1 << 20, 200):
        monkeypatch.setattr(suffixdedup, "STRETCH", stretch)
        assert suffixdedup.rivals(parts).tolist() == [k for k, p in enumerate(parts) if times[of[p]] > 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é,.\n_X9", max_size=30) | st.none(), min_size=1, max_size=6))
def test_word_hashes(texts):
    import re

    col = pa.array(texts, pa.string())
    for i, j, data, offsets in wh.chunks(col):
        h, bounds, _, _ = wh.words(data, offsets)
        names: dict[str, int] = {}
        for r in range(i, j):
            want = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (texts[r] or "").lower())
            got = h[bounds[r - i] : bounds[r - i + 1]].tolist()
            assert len(got) == len(want)
            for w, x in zip(want, got, strict=True):
                assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)


def shingle_set(text):
    import re

    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingle_sets_sizes():
    texts = ["a b c d e f", "a b", None, "", "a b c d e a b c d e a b c d e", "..."]
    got = {r: len(s) for r, s in wh.sets(pa.array(texts))}
    assert got == {r: len(shingle_set(t)) for r, t in enumerate(texts) if shingle_set(t)}


def test_bayesian_limits_keep_true_pairs():
    least = jaccard.least_matches(0.8)
    assert (np.diff(least[1:]) >= 0).all() and least[128] < 0.8 * 128 and least[16] >= 1


@pytest.mark.parametrize("many", [False, True])
def test_jaccard_links(many):
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(12 if many else 40):
        base = rng.integers(0, 1 << 62, 60 if many else 30, dtype=np.uint64)
        for _ in range(6 if many else 2):
            s = base.copy()
            s[: rng.integers(0, 9)] = rng.integers(0, 1 << 62)
            sets.append(np.unique(s))
    sig = np.array([jaccard.minhash(s) for s in sets])
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 4 * (len(sets[a]) + len(sets[b]) - n)}
    i, j = jaccard.linked(sig, sets, 4, 5)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    half = len(sets) // 2
    i, j = jaccard.linked(sig, sets, 4, 5, split=half)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in want if a < half <= b}
    order = rng.permutation(len(sets))
    root = jaccard.roots(len(sets), *map(np.array, zip(*want, strict=True)), order)
    for a, b in want:
        assert root[a] == root[b] and order[root[a]] <= order[a]


@pytest.mark.parametrize("n, dims", [(1, 4), (30, 3), (400, 3), (300, 40)])
def test_cover_tree_finds_all_pairs(n, dims):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, dims))
    v[n // 2 :] = v[: n - n // 2] * rng.uniform(0.5, 2, (n - n // 2, 1)) + rng.normal(scale=0.05, size=(n - n // 2, dims))
    cos = (v @ v.T) / np.sqrt(np.outer((v * v).sum(1), (v * v).sum(1)))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cos >= 0.98, 1)), strict=True)}
    i, j = covertree.close_pairs(v, None, 0.98)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    if n > 1:
        h = n // 2
        i, j = covertree.close_pairs(v[:h], v[h:], 0.98)
        assert set(zip(i.tolist(), (j + h).tolist(), strict=True)) == {(a, b) for a, b in want if a < h <= b}


def test_cover_tree_invariants():
    x = np.random.default_rng(0).normal(size=(500, 3))
    x /= np.sqrt((x * x).sum(1))[:, None]

    def walk(node):
        rows = np.concatenate(covertree.below(node))
        assert np.sqrt(((x[rows] - x[node.center]) ** 2).sum(1)).max() <= node.radius + 1e-6
        if node.kids is not None:
            assert node.kids[0].center == node.center and all(k.radius <= node.radius + 1e-9 for k in node.kids)
            for k in node.kids:
                walk(k)
        return rows

    assert sorted(walk(covertree.build(x)).tolist()) == list(range(500))


def best_chain(points, gap, weight):
    points = sorted(set(map(tuple, points)))
    score = []
    for i, (x, y) in enumerate(points):
        score.append(weight + max([0.0, *(score[j] - gap * (x - u + y - v) for j, (u, v) in enumerate(points[:i]) if u < x and v < y)]))
    return max(score)


def test_chains_score_like_the_quadratic_recursion():
    rng = random.Random(6)
    for _ in range(200):
        points = np.array([(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(rng.randint(1, 25))])
        got = chaining.chains(points, least=0)
        for c in got:
            assert (np.diff(c[:, 0]) > 0).all() and (np.diff(c[:, 1]) > 0).all()
        top = got[0]
        score = chaining.K * len(top) - chaining.GAP * (np.diff(top[:, 0]).sum() + np.diff(top[:, 1]).sum())
        assert abs(score - best_chain(points.tolist(), chaining.GAP, chaining.K)) < 1e-9
        assert sum(map(len, got)) <= len({tuple(p) for p in points.tolist()})


def test_alignment_counts_equal_words():
    words = np.arange(100, 160, dtype=np.uint32)
    other = words.copy()
    other[20] = 7
    other = np.concatenate([np.array([1, 2, 3], np.uint32), other])
    chain = np.array([[10, 13], [30, 33], [50, 53]])
    assert chaining.align(chain, words, 0, other) == (0, 60, 3, 60, 59)


def test_equal_words_of_wide_gaps():
    rng = random.Random(12)
    for _ in range(60):
        a, b = ([rng.randint(0, 30) for _ in range(rng.randint(0, 150))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            up, row = row, [0]
            for k, y in enumerate(b):
                row.append(up[k] + 1 if x == y else max(up[k + 1], row[k]))
        assert chaining.equal_words(a, b) == row[-1]


def test_seeds_reach_every_row():
    texts = ["a b c d e", "a b c d", "", " ".join(map(str, range(40)))]
    for _, _, data, offsets in wh.chunks(pa.array(texts)):
        h, bounds, _, _ = wh.words(data, offsets)
        row, pos, _ = chaining.seeds(h, bounds)
        assert set(row.tolist()) == {0, 3}
        assert (np.diff(pos[row == 3]) <= chaining.W).all()


def brute_segmentations(p, text):
    out = []

    def back(end, cost, ids):
        if not end:
            out.append((cost, ids))
        for start, c, more in p.edges(" " + text, end) if end else ():
            back(start, cost + c, more + ids)

    if text:
        back(len(text) + 1, 0, ())
    return sorted(out)


@pytest.fixture(scope="module")
def model():
    import os

    if not os.path.exists(pieces.MODEL):
        pytest.skip("no model file here")
    return pieces.Pieces.load(pieces.MODEL)


def test_n_best_segmentations(model):
    rng = random.Random(1)
    texts = ["the", "a b", "né ▁z", "  hi\n", "日本 x", "aaaa", "\U0001f600"] + ["".join(rng.choice("abeth ñ\n") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    for t in texts:
        want = brute_segmentations(model, t)
        for n in (1, 2, 5):
            best, ways, ws = next(model.encode([t], n))
            assert [c for c, _ in ways] == [c for c, _ in want[:n]] and model.decode(best) == t
            own = [model.known.best(model.known.names[w]) for w in pieces.WORD.findall(" " + t)]
            assert best.tolist() == [i for x in own for i in x] and model.restored(ws).decode() == (" " + t if t else "")
            whole = [tuple(i for k, x in enumerate(own) for i in change.get(k, x)) for _, change in ways]
            assert len(set(whole)) == len(ways) and all(model.decode(x) == t for x in whole)
            assert all(sum(int(model.cost[i]) for i in x) == c for x, (c, _) in zip(whole, ways, strict=True))


def test_long_words_have_the_best_costs(model):
    rng = random.Random(4)
    for _ in range(20):
        word = "".join(rng.choice("abetñ日\u2581") for _ in range(rng.randint(41, 90)))
        costs = [[0]]  # the five cheapest ways to each end, counted as different
        for e in range(1, len(word) + 1):
            costs.append(sorted(c + x for s, c, _ in model.edges(word, e) for x in costs[s])[:5])
        found = model.nbest(word, 5)
        assert [c for c, _ in found] == costs[-1] and len(set(found)) == len(found)
        ids, cost, excess = model.long(word)
        assert (cost, cost + excess) == tuple(costs[-1][:2]) and sum(int(model.cost[i]) for i in ids) == cost
        assert b"".join(model.raw[i] for i in ids).decode() == word


def test_a_million_characters_without_a_space(model):
    import time

    rng = random.Random(9)
    took = []
    for n in (125_000, 1_000_000):
        t = "".join(rng.choices("etaoinshrdlu", k=n))
        began = time.process_time()
        best, ways, _ = next(model.encode([t], 2))
        took.append(time.process_time() - began)
        assert model.decode(best) == t and len(ways) == 2 and ways[0][0] <= ways[1][0]
    assert took[1] < 25 * took[0]


def test_long_words_and_empty_texts(model):
    t = "x" * 300 + " " + " " * 50
    best, ways, _ = next(model.encode([t], 2))
    assert model.decode(best) == t and len(ways) == 2
    best, ways, _ = next(model.encode([""], 3))
    assert (best.tolist(), ways) == ([], [(0, {})]) and model.decode([]) == ""


def test_language_model_separates_alphabets():
    rng = random.Random(3)
    word = lambda s: "".join(rng.choice(s) for _ in range(5))
    text = lambda s: " ".join(word(s) for _ in range(30))
    texts = [text("abcd") for _ in range(20)] + [text("cdef") for _ in range(20)]
    m = langid.Model(texts, ["x"] * 20 + ["y"] * 20)
    lang, score = m.predict([text("abcd"), text("cdef"), "a"])
    assert lang[:2].tolist() == ["x", "y"] and ((0 <= score) & (score <= 1)).all()


def test_kernel_is_the_presence_kernel():
    m = langid.Model(["abc abd", "xyz"], ["a", "b"])
    sets = [langid.grams(t) for t in ("abd", "zzz", "")]
    marks = [langid.grams("abc abd"), langid.grams("xyz")]
    want = [[len(np.intersect1d(s, k)) / np.sqrt(max(len(s), 1) * len(k)) for k in marks] for s in sets]
    got = m.kernel(sets)
    assert min(np.abs(got - np.array(want)).max(), np.abs(got[:, ::-1] - np.array(want)).max()) < 1e-6


def test_minima_are_taken_in_steps(monkeypatch):
    s = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 63, 1000, dtype=np.uint64)
    whole = decontaminate._minima(s)
    monkeypatch.setattr(decontaminate, "STEP", 7)
    assert all((a == b).all() for a, b in zip(whole, decontaminate._minima(s), strict=True))
    h = s[:, None] * decontaminate.MULTIPLY + decontaminate.ADD
    assert (whole[0] == h.min(0)).all() and (whole[1] == s[h.argmin(0)]).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="ad banner">Buy</div><!-- <p>no</p> --><div id="sidebar">side</div><article class="post"><h1>Head &amp; line</h1><p>One <b>bold</b>
 text.<br>More<p>Two &lt;3<script>var a = "</p>";</script><div class="comments"><p>first!</p></div><form><input value=">">f</form></article><footer>&copy;</footer>"""


def test_main_text():
    assert styletree.Page(PAGE).text() == "Head & line\nOne bold text. More\nTwo <3"
    assert styletree.Page("").text() == "" and styletree.Page("plain   &eacute;").text() == "plain é"
    assert styletree.Page("<p>a<p>b<div>c</div>d").text() == "a\nb\nc\nd"
    assert styletree.Page("<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table>").text().replace("\n", "|") == "a|b|x y|z"
    assert styletree.Page("x<p " + "a" * 100000).text() == "x"
    assert styletree.Page("<main>in</main>out").text() == "in"


def test_main_text_of_forms_and_declared_classes():
    assert styletree.Page("<body><form id=f><div><p>Real article text of the page</p><input value=x><button>Go</button></div></form>").text() == "Real article text of the page"
    body = "<p>" + "many words of the article " * 9 + "</p>"
    text = ("many words of the article " * 9).strip()
    for noise in ("<div class='ad-box'>Buy</div>", "<ul class=menu><li>Home</ul>", "<div id=comments><p>" + "me too " * 99 + "</div>", "<aside>x</aside>", "<div hidden>x</div>", "<select><option>x</select>"):
        assert styletree.Page(f"<article>{body}{noise}</article><div>outside</div>").text() == text
    assert styletree.Page(f"<article>{body}<div class='related-work'>Others found this</div></article>").text() == text + "\nOthers found this"
    assert styletree.Page(f"<div class='ad-wrapper'>{body}</div>").text() == text


def test_deep_and_long_pages_take_linear_time():
    import time

    for page in ("<div>" * 20000 + "deep" + "</div>" * 20000, "<p><b>" * 20000 + "deep", "<ul><li>x" * 5000, "<p>deep " * 100000, "deep</i>" * 50000):
        began = time.time()
        p = styletree.Page(page)
        assert p.text() and list(p.units()) and time.time() - began < 5


def test_hosts():
    assert [styletree.host(u) for u in ("http://u@A.b:80/x", "//c.d?x", None, "x/y", "https://e.f#t")] == ["a.b:80", "c.d", "", "", "e.f"]


def test_fingerprints_are_stable_and_distinct():
    assert len(chat.MAPPINGS) == len(chat.LAYOUTS)
    assert chat.fingerprint(["a", "b"]) == chat.fingerprint(["b", "a"]) != chat.fingerprint(["ab"])


PARAGRAPH = "<p>" + "A sentence of the article that goes on for a while. " * 5 + "</p>"
REMARKS = '<section class="comments"><h3>Comments</h3><div class="comment">' + "I liked it a lot. " * 40 + "</div></section>"


@pytest.mark.parametrize(
    "body",
    [
        '<article class="post comment-status-open">{p}{p}</article>',
        '<div class="post has-comments">{p}{p}</div>',
        '<div id="page-comments-on"><article>{p}{p}</article></div>',
        '<div class="message reply">{p}{p}</div>',
        '<div class="content">{p}{p}</div><article class="teaser"><p>Read also this.</p></article>',
        '<div class="post has-comments">{p}{p}{c}</div>',
        "<article>{p}{p}</article>{c}",
        '<article class="has-comments">{p}{p}</article>{c}',
    ],
)
def test_class_words_do_not_empty_articles(body):
    html = "<html><body><nav><a>Home</a></nav>" + body.format(p=PARAGRAPH, c=REMARKS) + "<footer>Imprint</footer></body></html>"
    text = styletree.Page(html).text()
    assert text.count("A sentence of the article") == 10 and "liked" not in text and "Home" not in text and "Imprint" not in text
