"""Exact nearest vectors against all pairs: clustered, uniform, tied and awkward vectors, and how many pairs are compared."""

from __future__ import annotations

import numpy as np
import pytest

from foliate.operators import nearest


def brute(queries, vectors, k, threshold):
    out = []
    for qi in sorted({i for i, _ in queries}):
        found = []
        for i, q in queries:
            if i != qi:
                continue
            for vi, v in vectors:
                if vi is None or vi == qi or v is None or q is None or len(v) != len(q) or any(x is None for x in [*v, *q]) or not any(v) or not any(q):
                    continue
                score = round(float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v))), 6)
                if score >= threshold:
                    found.append((-score, vi))
        out += [(qi, vi, -s, r) for r, (s, vi) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows], "vec_id long, embedding array<double>, query_id string, pivot int, angle double")


@pytest.mark.parametrize(("k", "threshold", "most"), [(5, 0.2, 1 << 26), (3, -1.0, 300), (1, 0.95, 1 << 26), (500, 0.0, 1 << 26)])
def test_same_as_all_pairs(spark, k, threshold, most):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5))
    rows = [(i, [float(round(x, 3)) for x in (centres[i % 6] + rng.normal(size=5) * (0.1 if i % 2 else 1.0))]) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 2.0, 0.0, 0.0]) for i in range(40)] + [(340, [2.0, 4.0, 4.0, 0.0, 0.0])]  # ties
    rows += [(350, None), (351, []), (352, [0.0] * 5), (353, [1.0, None, 2.0, 0.0, 0.0]), (354, [1.0, 2.0]), (355, [2.0, 1.0]), (None, [1.0] * 5), (10, [-1.0] * 5)]
    queries = [r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] > 345)] + [(999, [1.0, 2.0, 2.0, 0.0, 0.0])]
    got = nearest.top_k(frame(spark, queries), frame(spark, rows).repartition(5), k, threshold, most_bytes=most, pivots=9)
    assert got.columns == ["query_id", "vec_id", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(queries, rows, k, threshold)


def test_no_rows(spark):
    none, some = frame(spark, [(1, [0.0])]), frame(spark, [(1, [1.0]), (2, [2.0])])
    assert nearest.top_k(none, some).count() == nearest.top_k(some, none).count() == 0
    assert [tuple(r) for r in nearest.top_k(some.where("vec_id = 1"), some).collect()] == [(1, 2, 1.0, 1)]


def test_few_pairs_are_compared_where_vectors_cluster(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.05 * rng.normal(size=16)).tolist()) for i in range(12_000)]
    vectors, queries, seen = frame(spark, rows), frame(spark, rows[::40]), []
    got = sorted(map(tuple, nearest.top_k(queries, vectors, observed=seen).collect()))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(x[::40] @ x.T, 6)
    want = [(q * 40, int(v), float(scores[q, v]), r) for q in range(len(scores)) for r, v in enumerate([v for v in np.lexsort((np.arange(12_000), -scores[q]))[:6] if v != q * 40][:5], 1)]
    assert got == sorted(want)
    pairs = sum(o.get["pairs"] for o in seen)
    assert 0 < pairs < 12_000 * 300 / 10


def test_held_candidates_are_bounded(monkeypatch):
    monkeypatch.setattr(nearest, "HELD", 50)
    rng = np.random.default_rng(3)
    x, ids = rng.normal(size=(2000, 4)), np.arange(2000)
    search = nearest.Search(ids[:30], x[:30], nearest._unit(x[:3]), np.full(30, -1.0), 4, False)
    for a in range(0, 2000, 100):
        search.block(ids[a : a + 100], x[a : a + 100], 0, 0.0, np.pi)
        assert search.size <= 30 * 4
    search.shrink()
    assert len(search.held[0][0]) == 120 and search.pairs == 60_000
