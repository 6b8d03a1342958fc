"""Whitening (operator 12) against a dense eigenvalue solver."""

import math

import numpy as np
import pytest

from tidewell.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id string, x string, n string, c string"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "i", "x", "n", "c") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def whole(v):
    return [math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v]


def dense(vectors):
    """n, sums, values and vectors of the covariance of the distinct rows, falling."""
    rows = np.array(sorted({tuple(whole(v)) for _, v in vectors}), dtype=np.int64)
    n, sums = len(rows), rows.sum(axis=0)
    c = (n * rows - sums) / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    return n, sums, values[::-1], turn[:, ::-1]


def check(found, vectors, components, digits=1e-9):
    n, sums, values, turn = dense(vectors)
    k = min(components, int((values > len(values) * 2**-52 * values[0]).sum()))
    assert len(found) == k * len(vectors)
    by_id = dict(vectors)
    signs = {}
    for r in sorted(found, key=lambda r: (r["component"], r["vec_id"])):
        d = n * np.array(whole(by_id[r["vec_id"]]), dtype=object) - sums.astype(object)
        j = r["component"] - 1
        expected = float((d / n).astype(float) @ turn[:, j]) / math.sqrt(values[j])
        sign = signs.setdefault(j, 1 if abs(expected - r["whitened"]) <= abs(expected + r["whitened"]) else -1)
        assert abs(sign * expected - r["whitened"]) <= digits * max(1, abs(expected))
        assert r["n"] == n and r["deviation"] == int((d**2).sum())
        assert abs(r["explained"] / (values[j] / values.sum()) - 1) < 1e-9
        assert r["identity_error"] < 1e-9


def usable(rng, n, dims, spread):
    return [(i, (rng.normal(size=dims) * spread).tolist()) for i in range(n)]


@pytest.mark.parametrize("dims", [3, 16, 40])
def test_equal_to_a_dense_solver(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = usable(rng, 150, dims, np.linspace(3, 0.3, dims))
    vectors += [(1000 + i, vectors[7][1]) for i in range(80)]  # a hot vector counts once
    check(whitening.whiten(table(spark, vectors)).collect(), vectors, 16)


def test_awkward_rows(spark):
    rng = np.random.default_rng(8)
    vectors = usable(rng, 60, 6, 1.0)
    odd = [(900, None), (901, [None, 1, 2, 3, 4, 5]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0, 2.0]), (905, [])]
    check(whitening.whiten(table(spark, vectors + odd)).collect(), vectors, 16)


def test_directions_without_variance_are_left_out(spark):
    rng = np.random.default_rng(9)
    flat = [(i, [a, 2 * a, b, 0.0, 1.0]) for i, (a, b) in enumerate(rng.integers(-9, 9, (50, 2)).tolist())]
    found = whitening.whiten(table(spark, flat)).collect()
    assert {r["component"] for r in found} == {1, 2} and len(found) == 100
    check(found, flat, 16)


def test_no_rows(spark):
    for vectors in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 3, [(1, []), (2, [])]):
        assert whitening.whiten(table(spark, vectors)).count() == 0


def test_a_deviation_beyond_64_bits_stops(spark):
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(table(spark, [(1, [1e8, 0.0]), (2, [-1e8, 0.0]), (3, [0.0, 1e8])])).collect()


@pytest.mark.parametrize(
    "values",
    [
        np.geomspace(1, 1e-12, 120),
        np.concatenate([np.ones(10), np.full(10, 1 - 1e-9), np.linspace(0.9, 0, 100)]),
        np.linspace(1, 0.99, 120),
        np.zeros(120),
    ],
)
def test_eigenpairs_reach_double_precision(values):
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(120, 120)))[0]
    a = (turn * values) @ turn.T
    a = (a + a.T) / 2
    passes = []

    def product(z):
        passes.append(z.shape[1])
        return a @ z

    found, vectors = whitening.eigenpairs(product, 120, 16)
    assert np.abs(found - np.sort(values)[::-1][:16]).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() <= whitening.TOLERANCE
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-13
    assert len(passes) < 150


def test_minres_solves_the_projected_system():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    q = np.linalg.qr(rng.normal(size=(30, 4)))[0]
    locked, u = q[:, :2], q[:, 2:]
    theta = np.array([20.0, 25.0])  # beyond the spectrum's bulk: a definite and a shifted system
    r = rng.normal(size=(30, 2))
    z = whitening.corrections(lambda v: a @ v, theta, u, r, locked, 60, 1e-13)
    for j in range(2):
        base = np.hstack([locked, u[:, j : j + 1]])
        p = np.eye(30) - base @ base.T
        left = p @ (a - theta[j] * np.eye(30)) @ p @ z[:, j]
        assert np.linalg.norm(left + p @ r[:, j]) < 1e-9
