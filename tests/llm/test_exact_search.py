import math
import random

import numpy as np
import pytest

from gleaner.llm import exact_search

SCHEMA = "vec_id long, embedding array<float>, label int, row int, slice int"


def brute(rows, k=10, every=100):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    held = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for a, (i, v) in enumerate(held):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(held) if a != b)
            out += [(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(frame, rows, **kw):
    made = exact_search.top_k(frame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA), **kw)
    assert made.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, made.collect()))


def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=width).round(3).tolist()) for i in range(n)]


@pytest.mark.parametrize("width, numbers", [(40, 2_000_000), (5, 100), (1, 16)])
def test_against_brute_force(frame, monkeypatch, width, numbers):
    monkeypatch.setattr(exact_search, "SLICE_NUMBERS", numbers)
    monkeypatch.setattr(exact_search, "QUERY_NUMBERS", numbers // 4)
    rows = vectors(1, 400, width)
    assert found(frame, rows, every=20) == brute(rows, every=20)


def test_odd_rows(frame):
    inf, nan = float("inf"), float("nan")
    rows = [(100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (None, [9.0, 9.0])]
    rows += [(6, [0.5, 0.25]), (7, [0.5, 0.25]), (100, [1.0, 2.0]), (200, []), (8, [3.0]), (9, [1.0, 1.0, 5.0])]
    assert found(frame, rows) == brute(rows)


def test_ties_and_copies(frame):
    rows = [(i, [1.0, -1.0, 0.5]) for i in range(60)] + [(i, [0.0, 0.0, 0.0]) for i in range(100, 130)]
    assert found(frame, rows, every=10) == brute(rows, every=10)


def test_huge_numbers(frame):
    rows = [(100 * i, [1e15 * (-1) ** i, 3.0 * i]) for i in range(6)] + [(1, [1e38, 1.0])]
    got, want = found(frame, rows), brute(rows)
    small = lambda out: [x for x in out if abs(x[3]) < 2**62]
    assert [x[:2] for x in got] == [x[:2] for x in want] and small(got) == small(want)


def test_bounds_drop_candidates():
    rng = np.random.default_rng(3)
    weights = np.linspace(1, 0.01, 64)
    rows = np.floor(1024 * rng.normal(size=(3000, 64)) * weights).astype(np.int64)
    alive, score = exact_search.Vertical(rows, True).top(rows[0], 10, 0)
    assert len(alive) < 1000 and sorted(score.astype(int).tolist())[-10:] == sorted((rows[1:] @ rows[0]).tolist())[-10:]


def test_empty_table_and_no_query(frame):
    assert found(frame, [(1, [1.0])]) == []
    assert exact_search.top_k(frame([(1, [1.0], 1, 1, 1)], SCHEMA).limit(0)).collect() == []
