"""Nearest vectors (operator 5) and exact top-k (operator 7) against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bitsliced, nearest, tiles

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row string, v string"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "i", "r", "v") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k, value, zero):
    def usable(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return False
        return zero or any(x != 0 for x in v)

    rows = [(n, i, [value(np.float32(x)) for x in v]) for n, (i, v) in enumerate(vectors) if i is not None and usable(v)]
    out = []
    for n, i, v in rows:
        if i % 20 == 0:
            others = [(-sum_in_order(v, w), j) for m, j, w in rows if m != n and len(w) == len(v)]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(others)[:k], 1)]
    return sorted(out)


def sum_in_order(v, w):
    total = 0
    for x, y in zip(v, w, strict=True):
        total += x * y
    return total


def awkward_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 16).tolist()) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(60)]  # many equal vectors: ties
    rows += [(20, rows[20][1]), (20, [-x for x in rows[20][1]])]  # repeated query rows
    rows += [(400, None), (420, [0.0] * 16), (440, [float("nan")] + [0.1] * 15), (460, [float("inf")] + [0.1] * 15)]
    rows += [(480, [None] + [0.1] * 15), (500, [0.5, 0.25]), (501, [0.5, -0.25]), (520, []), (None, rows[1][1])]
    return rows


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(tiles, "QUERIES_A_BLOCK", 7)
    monkeypatch.setattr(tiles, "VECTORS_A_BLOCK", 50)


def test_nearest_is_exact(spark, small_blocks):
    rows = awkward_vectors()
    found = nearest.nearest(table(spark, rows), F.col("id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 20, float, zero=False)


def test_products_of_long_vectors_are_exact():
    rng = np.random.default_rng(6)
    a, b = (rng.integers(100, 128, (4, 9000)).astype(np.int8) for _ in range(2))
    assert (nearest.int_products(a, b.T.astype(np.float32)) == a.astype(np.int64) @ b.T.astype(np.int64)).all()


def test_nearest_of_long_vectors(spark):
    """4,096 components of nearly equal vectors, whose order float32 sums would mix up."""
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, 4096)
    rows = [(i, (base + rng.normal(0, 1e-3, 4096)).tolist()) for i in range(120)]
    found = nearest.nearest(table(spark, rows), F.col("id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 20, float, zero=False)


def test_top_products_are_exact(spark, small_blocks):
    rows = awkward_vectors()
    found = bitsliced.top_products(table(spark, rows), F.col("id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 20, lambda x: math.floor(64 * float(x)), zero=True)


def test_bit_slices_give_scores():
    rng = np.random.default_rng(2)
    values = rng.integers(-90, 70, (130, 9))
    index = bitsliced.BitSlices(np.arange(130), np.arange(130), values)
    for query in (rng.integers(-50, 50, 9), np.zeros(9, dtype=np.int64), np.full(9, -3)):
        slices, shift = index.score_slices(query)
        bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << i for i, s in enumerate(slices)]
        assert (sum(bits, np.zeros(130, np.int64)) + shift == values @ query).all()


def test_error_bound_holds():
    rng = np.random.default_rng(4)
    m = rng.normal(0, 1, (50, 24)) * rng.lognormal(0, 3, (50, 1))
    ints, scale = nearest._scaled(m)
    err, norm = nearest._bounded_errors(m, ints, scale)
    rough = (ints.astype(float) @ ints.T) * scale[:, None] * scale[None, :]
    bound = err[:, None] * (norm + err)[None, :] + norm[:, None] * err[None, :]
    assert (np.abs(rough - m @ m.T) <= bound * (1 + 1e-9)).all()


def test_overlong_vector_stops(spark):
    with pytest.raises(Exception, match="64 bits"):
        bitsliced.top_products(table(spark, [(0, [1e30]), (1, [1.0])]), F.col("id") % 20 == 0).collect()


def test_empty_tables(spark):
    assert nearest.nearest(table(spark, []), F.col("id") % 20 == 0).count() == 0
    assert bitsliced.top_products(table(spark, []), F.col("id") % 20 == 0).count() == 0
