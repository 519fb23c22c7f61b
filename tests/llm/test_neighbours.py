"""Neighbours against brute force: every small table whole, data far from the origin, odd rows."""

import numpy as np
import pytest

from tessera.llm.graph_ann import _single, build_graph, nearest, search


def exact(x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]


@pytest.mark.parametrize("kind", ["gauss", "line", "stretched"])
def test_small_tables_are_searched_whole(kind):
    for n in range(1, 61):
        rng = np.random.default_rng(n)
        x = {"gauss": rng.normal(size=(n, 8)), "line": np.arange(n)[:, None] * np.ones(3), "stretched": rng.normal(size=(n, 4)) * [1000, 1, 1, 0.01]}[kind]
        xs = _single(x)[0]
        graph, start = build_graph(xs)
        found = search(xs, graph, start, xs, n)
        assert all(sorted(f[f >= 0]) == list(range(n)) for f in found)


@pytest.mark.parametrize("offset", [0, 1000])
def test_recall_does_not_fall_with_the_offset(offset):
    x = np.random.default_rng(5).normal(size=(3000, 32)) + offset
    xs = _single(x)[0]
    graph, start = build_graph(xs)
    queries = range(0, 3000, 50)
    found = search(xs, graph, start, xs[::50], 11)
    hits = sum(len(set(exact(x, q, 10)) & set(f.tolist())) for q, f in zip(queries, found, strict=True))
    assert hits >= 0.9 * 10 * len(queries)


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert nearest(spark.createDataFrame([], kind)).count() == 0
    rows = [(100 * i, [float(i), 1000.0]) for i in range(5)] + [(7, [2.0]), (None, [1.0, 1000.0]), (100, [1.0, 1000.0]), (9, None), (11, [0.0, 0.0]), (13, [None, 1.0])]
    got = nearest(spark.createDataFrame(rows, kind)).collect()
    for q in range(5):
        own = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 100 * q)
        want = sorted((abs(float(i - q)), 100 * i) for i in range(5) if i != q)
        assert own == [(n + 1, v, d) for n, (d, v) in enumerate(want)]
