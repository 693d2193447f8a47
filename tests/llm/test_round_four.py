"""Findings of round 4 on the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pagewright.llm import chaining


def _spelled(words) -> str:
    return " ".join(words)


def _met(spans):
    return pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))


def test_windows_too_short_for_a_passage_are_not_compared():
    """A shared line of 14 words alone is in no passage; beside a span that was found before it may be."""
    text = _spelled(f"w{k}" for k in range(200))
    refs = pa.array([np.array([1, 1]).tobytes()], pa.binary())
    m = pa.array([np.array([[60, 60, 0], [69, 69, 0]], np.int32).tobytes()], pa.binary())
    found = {}
    for name, spans in (("alone", []), ("far", [{"start": 100, "n": 40}]), ("near", [{"start": 80, "n": 40}])):
        b = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text]), refs, m, _met(spans)], ["doc_id", "text", "refs", "m", "met"])
        found[name] = sum(x.num_rows for x in chaining._windows([b]))
    assert found == {"alone": 0, "far": 0, "near": 1}
    # A gap of TOUCH words still touches, one more does not.
    assert chaining.reaching([(0, 30), (32, 60), (63, 90), (200, 250)]) == [True, True, False, True]
    assert chaining.reaching([]) == []


def test_ends_of_parts_are_tried_once(monkeypatch):
    """A chain of many points far apart falls into parts; the words beyond each point are compared once a side at most."""
    rng = np.random.default_rng(1)
    n = 40
    a, b = (rng.integers(1 << 20, 1 << 31, 30 * n).astype(np.uint32) for _ in range(2))
    for k in range(n):  # runs of 6 words, the next ones differ
        b[30 * k + 12 : 30 * k + 18] = a[30 * k + 12 : 30 * k + 18]
    b[90:130] = a[90:130]
    chain = np.stack([30 * np.arange(n) + 12] * 2, axis=1)
    calls, own = [], chaining._extend
    monkeypatch.setattr(chaining, "_extend", lambda *x: calls.append(1) or own(*x))
    spans = chaining.good_spans(chain, a, 0, b)
    assert spans == [(90, 48, 90, 48, 46)]  # words 90 to 129, and the run at 132
    assert len(calls) <= 2 + 2 * n


def test_common_runs_of_many_windows_at_once():
    """Runs meet in their own pair alone; as point by point comparison tells."""
    rng = np.random.default_rng(2)
    sides = [(rng.integers(1, 4, n).astype(np.uint32), rng.integers(1, 4, v).astype(np.uint32)) for n, v in ((40, 30), (3, 20), (5, 5), (0, 9), (60, 60))]
    sides.append((sides[0][0], sides[0][0]))
    for (a, b), (xs, ys) in zip(sides, chaining.common_runs(sides), strict=True):
        every = [(i, j) for i in range(len(a) - 4) for j in range(len(b) - 4) if (a[i : i + 5] == b[j : j + 5]).all()]
        first = {}
        for i, j in every:
            first.setdefault((i // 5, i - j), (i, j))
        assert list(zip(xs, ys, strict=True)) == sorted(first.values())
