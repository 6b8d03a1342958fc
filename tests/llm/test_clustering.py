"""Centroid clustering (operator 13) against comparing every vector with every centroid."""

import hashlib
import math

import numpy as np
import pytest

from tidewell.llm import clustering
from tidewell.session import work_folder

SCHEMA = "vec_id long, embedding array<float>, id string, cluster string, distance string, x string"


def table(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "i", "c", "d", "x") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k, rounds, dims, scale=1024, salt="3:"):
    def takes_part(v):
        return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in vectors if takes_part(v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"{salt}{i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    for r in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids)) for _, x in kept]
        if r < rounds:
            for j in range(len(centroids)):
                own = [x for (_, x), (_, c) in zip(kept, found, strict=True) if c == j]
                if own:
                    centroids[j] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    inertia = {j: sum(d for d, c in found if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=str
    )


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("k,block", [(1, 4096), (3, 7), (8, 50)])
def test_equal_to_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(5, 6))
    vectors = [(i, (centres[i % 5] + rng.normal(size=6) * 0.4).tolist()) for i in range(200)]
    vectors += [(300 + i, vectors[11][1]) for i in range(100)]  # a hot vector
    vectors += [(11, vectors[11][1]), (12, vectors[3][1]), (None, vectors[4][1])]
    vectors += [(500, None), (501, [0.5] * 5), (502, [None] * 6), (503, [math.nan] * 6), (504, [-math.inf] * 6), (505, [])]
    found = clustering.cluster(table(spark, vectors), k=k, dims=6)
    assert rows_of(found) == brute(vectors, k, 10, 6)


def test_ties_go_to_the_smaller_number(spark):
    vectors = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(6) for y in range(6))]
    found = clustering.cluster(table(spark, vectors), k=4, dims=2, scale=2)
    assert rows_of(found) == brute(vectors, 4, 10, 2, scale=2)


def test_fewer_vectors_than_clusters_and_empty_clusters(spark):
    vectors = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [5.0, 5.0])]
    assert rows_of(clustering.cluster(table(spark, vectors), dims=2)) == brute(vectors, 8, 10, 2)
    assert clustering.cluster(table(spark, []), dims=2).count() == 0
    assert clustering.cluster(table(spark, [(1, None)]), dims=2).count() == 0


def test_bounds_spare_most_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16)) * 3
    vectors = [(i, (centres[i % 8] + rng.normal(size=16) * 0.3).tolist()) for i in range(800)]
    rows = clustering.whole_vectors(table(spark, vectors), "vec_id", "embedding", 16, 1024)
    _, _, scans = clustering.fit(rows, 8, 10, "3:", work_folder(spark, "test"))
    assert scans[0] == 800 and sum(scans[2:]) < 800


def test_losses_hold_and_are_smaller_than_the_drift():
    rng = np.random.default_rng(7)
    smaller = 0
    for _ in range(200):
        k, dims = 4, int(rng.integers(2, 6))
        old = rng.integers(-1000, 1000, (k, dims))
        new = old + rng.integers(-120, 120, (k, dims))
        radius = rng.uniform(0, 900, k)
        loss = clustering.drift_losses(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        assert (loss <= drift[None, :] * (1 + 1e-9) + 1e-9).all()
        smaller += (loss < 0.9 * drift[None, :]).sum()
        for i in range(k):
            way = rng.normal(size=(400, dims))
            way /= np.linalg.norm(way, axis=1, keepdims=True)
            x = old[i] + way * radius[i] * rng.uniform(0, 1, (400, 1)) ** 0.2
            for j in range(k):
                closer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert closer.max() <= loss[i, j] + 1e-6
    assert smaller > 1000


def test_too_large_components_stop(spark):
    with pytest.raises(Exception, match="64 bits"):
        clustering.cluster(table(spark, [(1, [1e6, 0.0])]), dims=2).collect()
