import math
import random

import numpy as np
import pytest
from rollbook.llm import multi_index as m

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, cell string, score string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 0, "x", "x", "x", "x") for i, v in vectors], SCHEMA)


def product(a, b):
    out = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        out += x * y
    return out


def brute(vectors, queries, k):
    good = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = []
    for q in sorted(i for i in good if i % queries == 0):
        for mine in good[q][:1]:
            scores = sorted((-max(product(mine, v) for v in vs), i) for i, vs in good.items() if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(90)]  # one vector many times: ties, a hot cell
    rows += [rows[3], rows[3], (None, rows[4][1]), (500, None), (501, []), (502, [0.0] * 6), (503, [1.0, None, 0, 0, 0, 0]),
             (504, [float("nan")] * 6), (505, [float("inf")] * 6)]
    got = sorted(tuple(r) for r in m.search(table(spark, rows), lambda c: c % 5 == 0, k=20).collect())
    want = brute(rows, 5, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == [w[3] for w in want]


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(120)]
    monkeypatch.setattr(m, "BLOCK", 7)
    monkeypatch.setattr(m, "QUERY_BLOCK", 3)
    got = sorted(tuple(r) for r in m.search(table(spark, rows), lambda c: c % 3 == 0, k=4, centroids=4).collect())
    assert got == brute(rows, 3, 4)


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [-1.0])]
    assert sorted(tuple(r) for r in m.search(table(spark, rows), lambda c: c % 20 == 0).collect()) == [(0, 1, 1, 2.0), (0, 2, 2, -1.0)]
    assert m.search(table(spark, [(0, [1.0])]), lambda c: c % 20 == 0).count() == 0
    assert m.search(table(spark, []), lambda c: c % 20 == 0).count() == 0
    assert m.search(table(spark, [(1, [1.0]), (3, [1.0])]), lambda c: c % 20 == 0).count() == 0


def test_recall_beyond_the_whole_search(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(20, size=4000)] + 0.7 * rng.normal(size=(4000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    got = m.search(table(spark, list(enumerate(x.tolist()))), lambda c: c % 40 == 0, least=500).collect()
    hits = 0
    for q in range(0, 4000, 40):
        s = x @ x[q]
        s[q] = -9
        mine = {r.vec_id for r in got if r.query_id == q}
        assert len(mine) == 20
        hits += len(mine & set(np.argsort(-s)[:20].tolist()))
    assert hits / 2000 >= 0.9


def test_walk_visits_cells_by_rising_sum():
    rng = random.Random(3)
    a, b = np.array([rng.random() for _ in range(6)]), np.array([rng.random() for _ in range(5)])
    counts = np.array([[rng.randint(0, 3) for _ in range(5)] for _ in range(6)])
    order = [(a[i] + b[j], i * 5 + j) for i in range(6) for j in range(5) if counts[i, j]]
    for wanted in (1, 7, int(counts.sum()), 999):
        got = m.cells_of_query(a, b, counts, wanted)
        want = [c for _, c in sorted(order)]
        assert got == want[:len(got)]
        held = [counts.flat[c] for c in got]
        assert sum(held) >= min(wanted, counts.sum()) and sum(held[:-1]) < wanted


def test_codebook_of_few_different_rows():
    assert len(m.codebook(np.array([[1.0, 2], [1, 2], [3, 4]]), 8, 0)) == 2
    assert m.codebook(np.random.default_rng(0).normal(size=(100, 3)), 8, 0).shape == (8, 3)


@pytest.mark.parametrize("n", [600, 1800])
def test_recall_at_two_sizes_without_structure(spark, n):
    """One rule at every size: half of all vectors, 256 at least, through the cells."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16)).astype(np.float32).astype(float)
    got = m.search(table(spark, list(enumerate(x.tolist()))), lambda c: c % 20 == 0).collect()
    hits = 0
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = {r.vec_id for r in got if r.query_id == q}
        assert len(mine) == 20
        hits += len(mine & set(np.argsort(-s)[:20].tolist()))
    assert hits / n >= 0.9
