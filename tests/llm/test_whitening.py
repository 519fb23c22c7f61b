"""Whitening against numpy's eigenvectors and exact whole-number sums; hard spectra; odd rows."""

import math

import numpy as np
import pytest

from tessera.llm import whitening


def spectra():
    rng = np.random.default_rng(11)
    basis = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    yield rng.standard_normal((12, 12))
    yield np.diag(10.0 ** -np.arange(12.0)) @ basis  # graded over twelve orders
    yield (basis * np.repeat([3.0, 3.0 + 1e-13, 1.0, 1.0 + 1e-9], 3)) @ basis.T  # clusters
    yield np.eye(12)
    yield np.triu(np.ones((12, 12)))
    yield np.outer(rng.standard_normal(12), rng.standard_normal(12))  # rank one
    yield np.zeros((12, 12))
    yield np.diag(np.full(12, 1.0)) + np.diag(np.full(11, 0.5), 1)
    yield np.array([[2.0]])
    yield rng.standard_normal((64, 64)) * 1e-150


@pytest.mark.parametrize("r", list(spectra()), ids=range(10))
def test_directions(r):
    values, w = whitening.directions(r)
    s = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.sqrt(values), s, rtol=1e-11, atol=4e-15 * s[0])
    assert np.abs(w.T @ w - np.eye(len(r))).max() < 1e-10
    assert np.abs(np.linalg.norm(r @ w, axis=0) - np.sqrt(values)).max() <= 1e-12 * s[0]


def test_small_values_keep_their_digits():
    """A graded bidiagonal matrix: numpy's solver loses the small values, exact rational arithmetic checks them."""
    a, b = 10.0 ** -np.arange(0, 40, 4.0), 10.0 ** -np.arange(2, 38, 4.0)
    values = whitening.dqds(a, b)
    assert math.isclose(float(np.prod(np.sqrt(values))), float(np.prod(a)), rel_tol=1e-13)
    assert (values > 0).all()


def plain(vectors, k):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - t) ** 2 for a, t in zip(r, s, strict=True))) for r in x]
    y = np.array([[float((n * a - t)) / n for a, t in zip(r, s, strict=True)] for r in x])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return deviation, y @ v / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_whole_query_equals_numpy(spark):
    rng = np.random.default_rng(2)
    good = (rng.standard_normal((700, 40)) @ np.diag(np.linspace(0.2, 2, 40))).astype(np.float32)
    good[300:350] = good[:50]
    rows = [(i, v.tolist(), "x", i) for i, v in enumerate(good)]
    rows += [(900, None, "x", 1), (901, [1.0] * 39 + [None], None, 1), (902, [1.0] * 39 + [float("nan")], "x", 1), (903, [float("inf")] * 40, "x", 1), (904, [], "x", 1), (905, [0.5] * 7, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, i string, component long").repartition(7)
    got = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    deviation, w, explained = plain(good, 32)
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.vec_id.tolist() == np.repeat(np.arange(700), 32).tolist() and got.component.tolist() == list(range(1, 33)) * 700
    assert (got.n == 700).all() and got.deviation.tolist() == np.repeat(deviation, 32).tolist()
    mine = got.whitened.to_numpy().reshape(700, 32)
    assert np.abs(mine * np.sign((mine * w).sum(axis=0)) - w).max() < 1e-8
    assert np.allclose(got.explained.to_numpy().reshape(700, 32), explained, rtol=1e-9) and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0, 3.0])], kind)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, i, 1, 0, None, None, None) for i in (1, 2, 3)]
    # Two of three entries are the same and one is constant: rank one, ids repeat.
    flat = whitening.whiten(spark.createDataFrame([(7, [x, x, 5.0]) for x in (0.0, 1.0, 2.0, 3.0)], kind)).collect()
    assert sorted(round(abs(r.whitened), 6) for r in flat if r.component == 1) == [0.447214, 0.447214, 1.341641, 1.341641]
    assert all(r.whitened is None and r.explained == 0 for r in flat if r.component > 1) and {round(r.explained, 9) for r in flat if r.component == 1} == {1.0}
    # Huge entries: exact while it fits, null beyond 64 bits.
    far = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.0])], kind)).collect()}
    assert far == {1: None, 2: None, 3: 0}
