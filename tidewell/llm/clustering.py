"""Centroid clustering with bounds that are loosened by the geometry of the drift.

Every vector carries its cluster, an upper bound on the distance to its own
centroid and a lower bound on the distance to any other.  While the upper one
is smaller the vector cannot change its cluster, and no distance is computed.

When centroids move, the upper bound grows by the drift of the own centroid.
The lower bound of a vector in cluster i would have to fall by the largest
drift of another centroid j; it falls by less.  All vectors of i lie in a
sphere around its centroid c.  With m the middle between the old and the new
place of j and w the step from old to new, a point at angle t from w, seen from
m, comes closer to j by at most |w| cos t: the points that come closer by a
given amount form a sheet of a hyperboloid with the two places as foci, which
lies inside its asymptotic cone.  In the plane through c, m and w the sphere is
seen from m at angles of at least t(c) - asin(r / |c - m|), so

    loss(i, j) = |w| max(0, cos(max(0, t(c) - asin(r / |c - m|)))),

and |w| if the sphere holds m.  Bounds are rounded outwards; whatever stays
ambiguous is compared with all centroids in whole numbers, so the result is
that of comparing every vector with every centroid, ties included.

Spark holds the vectors in blocks, with their bounds, and writes them once per
round, which cuts the lineage.  A round is one pass without a shuffle; its
tasks return the changes of the sums and counts and the radii, k * dims rows
after a sum in Spark.  Only centroids reach the driver.

Vectors that are null, of another length than ``dims``, or hold null or
non-finite components are left out.  Repeated rows and ids are vectors like any
other; a row without an id is clustered but gives no first centroid while there
are others.  Fewer vectors than clusters give as many centroids; an empty table
gives no row.  Components beyond 2^27 in whole numbers stop with an error, as
squares would leave 64 bits.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm import common
from tidewell.session import work_folder

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
BLOCK = 4096
_MOST = 1 << 27
#: Share by which bounds are rounded outwards; far above the rounding of a square root and a few sums.
_SLACK = 1e-12


def whole_vectors(table: DataFrame, id_column: str, vector_column: str, dims: int, scale: int) -> DataFrame:
    """id and x, the components in whole numbers, of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = common.named(table, id=id_column, v=vector_column).where((F.size(v) == dims) & finite)
    return rows.select("id", F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def seeds(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose salted ids have the smallest digests, in their order."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = rows.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(k).collect()
    return np.array([r["x"] for r in first], dtype=np.int64)


def _packed(kind: pa.DataType):
    """Vectors in blocks, so that a round reads bytes instead of lists."""

    def block(ids: list[pa.Array], parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        if len(x) and max(int(x.max()), -int(x.min())) > _MOST:
            raise OverflowError("a component is too large for exact distances in 64 bits")
        held = pa.concat_arrays(ids)
        lists = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        return pa.RecordBatch.from_arrays([lists, pa.array([x.astype(np.int32).tobytes()])], names=["ids", "x"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column("id").cast(kind))
            parts.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            n += batch.num_rows
            if n >= BLOCK:
                yield block(ids, parts)
                ids, parts, n = [], [], 0
        if n:
            yield block(ids, parts)

    return pack


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances."""
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


def nearest_two(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number if tied), its squared distance and the next larger or equal one."""
    best, first = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.iinfo(np.int64).max)
    second = first.copy()
    for j, centroid in enumerate(centroids):
        d = squared(x, centroid)
        closer = d < first
        second = np.where(closer, first, np.minimum(second, d))
        first = np.where(closer, d, first)
        best[closer] = j
    return best, first, second


def _up(distance: np.ndarray) -> np.ndarray:
    return np.sqrt(distance.astype(np.float64)) * (1 + _SLACK)


def _down(distance: np.ndarray) -> np.ndarray:
    return np.sqrt(distance.astype(np.float64)) * (1 - _SLACK)


def drift_losses(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much closer the vectors of cluster i may have come to centroid j, at most: a k by k table."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    step, middle = new - old, (new + old) / 2
    length = np.linalg.norm(step, axis=1)
    loss = np.zeros((len(old), len(old)))
    for i, (centre, r) in enumerate(zip(old, radius, strict=True)):
        to_centre = centre - middle
        away = np.linalg.norm(to_centre, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            along = np.einsum("ij,ij->i", to_centre, step) / (away * length)
            seen = np.arccos(np.clip(along, -1, 1)) - np.arcsin(np.clip(r / away, 0, 1)) - 1e-7
            share = np.maximum(0, np.cos(np.maximum(0, seen)))
        outside = (away > r * (1 + _SLACK)) & (length > 0)
        loss[i] = np.where(outside, length * np.where(outside, share, 1), length)
    return loss * (1 + _SLACK)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By how much the upper bound of each cluster grows and the lower one falls."""
    loss = drift_losses(old, new, radius)
    np.fill_diagonal(loss, 0)
    drift = np.linalg.norm((new - old).astype(np.float64), axis=1) * (1 + _SLACK)
    return drift, loss.max(axis=1, initial=0)


def reassign(
    x: np.ndarray,
    centroids: np.ndarray,
    state: tuple[np.ndarray, np.ndarray, np.ndarray] | None,
    drift: np.ndarray,
    fall: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, upper and lower bound of each vector after a move, and how many vectors met all centroids."""
    if state is None:
        cluster, first, second = nearest_two(x, centroids)
        return cluster, _up(first), _down(second), len(x)
    cluster, upper, lower = (a.copy() for a in state)
    upper = (upper + drift[cluster]) * (1 + _SLACK)
    lower = lower - fall[cluster]
    lower -= _SLACK * (np.abs(lower) + fall[cluster])
    unsure = np.flatnonzero(upper >= lower)
    upper[unsure] = _up(squared(x[unsure], centroids[cluster[unsure]]))
    unsure = unsure[upper[unsure] >= lower[unsure]]
    cluster[unsure], first, second = nearest_two(x[unsure], centroids)
    upper[unsure], lower[unsure] = _up(first), _down(second)
    return cluster, upper, lower, len(unsure)


def _changes(x: np.ndarray, was: np.ndarray | None, now: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds the vectors that came to a cluster, takes off those that left."""
    moved = np.arange(len(now)) if was is None else np.flatnonzero(was != now)
    for j in np.unique(now[moved]):
        own = moved[now[moved] == j]
        sums[j] += x[own].sum(axis=0)
        counts[j] += len(own)
    if was is not None:
        for j in np.unique(was[moved]):
            own = moved[was[moved] == j]
            sums[j] -= x[own].sum(axis=0)
            counts[j] -= len(own)


_STATE = "cluster binary, upper binary, lower binary, sums array<long>, radii array<double>, scanned long"


def _round(ids: pa.DataType, centroids: np.ndarray, drift: np.ndarray, fall: np.ndarray):
    """One round: blocks with their new state; the last row of a task carries its sums, counts and radii."""
    k, dims = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        radii, scanned = np.zeros(k), 0
        lists = pa.list_(ids)

        def row(held, x, cluster, upper, lower, totals, far, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    held,
                    pa.array([x], pa.binary()),
                    pa.array([cluster], pa.binary()),
                    pa.array([upper], pa.binary()),
                    pa.array([lower], pa.binary()),
                    pa.array([totals], pa.list_(pa.int64())),
                    pa.array([far], pa.list_(pa.float64())),
                    pa.array([n], pa.int64()),
                ],
                names=["ids", "x", "cluster", "upper", "lower", "sums", "radii", "scanned"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("x")[i].as_py()
                if held is None:  # the totals of an earlier round
                    continue
                x = np.frombuffer(held, dtype=np.int32).reshape(-1, dims).astype(np.int64)
                state = None
                if "cluster" in batch.schema.names:
                    kinds = zip(("cluster", "upper", "lower"), (np.int32, np.float64, np.float64), strict=True)
                    state = tuple(np.frombuffer(batch.column(c)[i].as_py(), dtype=t) for c, t in kinds)
                cluster, upper, lower, n = reassign(x, centroids, state, drift, fall)
                scanned += n
                _changes(x, None if state is None else state[0], cluster, sums, counts)
                np.maximum.at(radii, cluster, upper)
                own = batch.column("ids").slice(i, 1).cast(lists)
                yield row(own, held, cluster.tobytes(), upper.tobytes(), lower.tobytes(), None, None, None)
        totals = np.concatenate([sums.ravel(), counts]).tolist()
        yield row(pa.array([None], lists), None, None, None, None, totals, radii.tolist(), scanned)

    return run


def _totals(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Changes of sums and counts, radii, and the number of vectors that met all centroids; k * dims numbers."""
    parts = state.where(F.col("sums").isNotNull())
    entries = parts.select("scanned", F.posexplode(F.arrays_zip("sums", "radii")).alias("place", "entry"))
    rows = entries.groupBy("place").agg(
        F.sum("entry.sums").alias("total"), F.max("entry.radii").alias("radius"), F.sum("scanned").alias("scanned")
    )
    total, radii, scanned = np.zeros(k * dims + k, dtype=np.int64), np.zeros(k), 0
    for r in rows.collect():
        total[r["place"]] = r["total"]
        scanned = r["scanned"]
        if r["place"] < k:
            radii[r["place"]] = r["radius"]
    return total[: k * dims].reshape(k, dims), total[k * dims :], radii, scanned


def _distances(ids: pa.DataType, centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("x")[i].as_py(), dtype=np.int32).reshape(-1, centroids.shape[1])
                cluster = np.frombuffer(batch.column("cluster")[i].as_py(), dtype=np.int32)
                distance = squared(x.astype(np.int64), centroids[cluster])
                own = batch.column("ids")[i].values.cast(ids)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"]
                )

    return run


def fit(rows: DataFrame, k: int, rounds: int, salt: str, folder: str) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Blocks with their final clusters, the centroids, and per assignment how many vectors met all centroids."""
    centroids = seeds(rows, k, salt)
    kind = rows.schema["id"].dataType.simpleString()
    id_type = _arrow_type(rows)
    blocks = common.stored(rows.mapInArrow(_packed(id_type), f"ids array<{kind}>, x binary"), f"{folder}/blocks")
    schema = f"ids array<{kind}>, x binary, {_STATE}"
    if not len(centroids):
        empty = [F.lit(None).cast(field.split()[1]).alias(field.split()[0]) for field in _STATE.split(", ")]
        return blocks.select("*", *empty), centroids, []
    k, dims = centroids.shape
    sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
    drift, fall, state, scans = np.zeros(k), np.zeros(k), blocks, []
    for r in range(rounds + 1):
        state = common.stored(state.mapInArrow(_round(id_type, centroids, drift, fall), schema), f"{folder}/{r}")
        change, count, radii, scanned = _totals(state, k, dims)
        scans.append(scanned)
        if r < rounds:
            sums, counts = sums + change, counts + count
            moved = centroids.copy()
            moved[counts > 0] = sums[counts > 0] // counts[counts > 0, None]
            drift, fall = loosening(centroids, moved, radii)
            centroids = moved
    return state.where(F.col("x").isNotNull()), centroids, scans


def _arrow_type(rows: DataFrame) -> pa.DataType:
    return to_arrow_type(rows.schema["id"].dataType)


def cluster(
    table: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = 64,
    scale: int = SCALE,
    salt: str = "3:",
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    spark = table.sparkSession
    folder = work_folder(spark, "clustering")
    rows = whole_vectors(table, id_column, vector_column, dims, scale)
    state, centroids, _ = fit(rows, k, rounds, salt, folder)
    kind = rows.schema["id"].dataType.simpleString()
    shape = centroids if len(centroids) else np.zeros((1, dims), dtype=np.int64)
    found = state.select("ids", "x", "cluster").mapInArrow(
        _distances(_arrow_type(rows), shape), f"id {kind}, cluster int, distance long"
    )
    found = common.stored(found, f"{folder}/found")
    # One row per cluster, k at most.
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [
        (j, own, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest())
        for j, own in sorted(inertia.items())
    ]
    columns = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    facts = F.broadcast(spark.createDataFrame(facts, columns))
    return found.join(facts, "cluster").select(
        F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
