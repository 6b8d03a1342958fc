"""Embedding whitening: leading eigenvectors of the covariance by Jacobi-Davidson.

The covariance is never formed.  Spark holds the distinct vectors in blocks of
centred doubles; a product with a few columns is one pass, C'(C v) / n, whose
dims by columns totals are added up in Spark.  Every entry is centred before it is
multiplied: (n x - S) is exact in whole numbers, and is divided by n once.

Iteration, for all wanted components at a time:

* Rayleigh-Ritz in the search space gives values t, vectors u, residuals r.
* Pairs whose residual is down to rounding (``TOLERANCE`` times the largest
  value) are locked; locked vectors leave the search space.
* For each other wanted pair the correction equation
  (I - QQ') (A - t I) (I - QQ') z = -r, Q being the locked vectors and u, is
  solved roughly by MINRES.  The systems run in step, so that one pass over the
  vectors serves them all.
* The corrections, made orthogonal, widen the search space; a wide one is
  folded down to its best Ritz vectors.

The end is a fresh product with all locked vectors: Rayleigh-Ritz among them,
and their residuals are checked again, so nothing rests on products that were
carried along.

The driver holds numbers of vectors times dims, never rows.  A lost executor
repeats a pass over written blocks.

Vectors that are null or hold null or non-finite entries are left out, and so
are those of another length than the commonest (the shorter one, if tied).
Repeated rows are answered each, but count once in the fit.  Directions without
variance (value at most dims * 2^-52 of the largest) are no components, so one
distinct vector, or an empty table, gives no row.  Deviations beyond 64 bits
stop with an error.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm import common
from tidewell.session import work_folder

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
BLOCK = 4096
#: Bytes of centred vectors that a task writes to one file.
FILE_BYTES = 16 << 20
REDUCERS = 8
#: A residual of so many times the largest value is rounding only.
TOLERANCE = 64 * np.finfo(float).eps
INNER_STEPS = 4
OUTER_STEPS = 200

Product = Callable[[np.ndarray], np.ndarray]


def whole_vectors(table: DataFrame, id_column: str, vector_column: str, scale: int, shift: int) -> DataFrame:
    """id and x, the entries in whole numbers, of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = common.named(table, id=id_column, v=vector_column).where(v.isNotNull() & finite)
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)
    rows = rows.select("id", x.alias("x"))
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("x") == (size["size"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and exact sums of the vectors of a task, one row per dimension."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            part = _matrix(batch.column("x")).sum(axis=0)
            n, total = n + batch.num_rows, part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], names=["j", "s", "n"]
        )


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S in whole numbers, which fit as S is a sum of such x."""
    return n * x - sums


def _centred_blocks(n: int, sums: np.ndarray):
    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(centred(_matrix(batch.column("x")), n, sums) / n)
            if sum(map(len, held)) >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()])], names=["c"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()])], names=["c"])

    return blocks


def _partial(vectors: np.ndarray, gram: bool):
    """C'(C v) of a task, or the products and sums of C v, as one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for held in batch.column("c"):
                c = np.frombuffer(held.as_py()).reshape(-1, len(vectors))
                w = c @ vectors
                part = np.vstack([w.T @ w, w.sum(axis=0)]) if gram else c.T @ w
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

    return run


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the totals of a task."""
    total = None
    for batch in batches:
        for held in batch.column("total"):
            part = np.frombuffer(held.as_py())
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])


class Covariance:
    """Products with the covariance of centred blocks; ``passes`` counts the scans."""

    def __init__(self, blocks: DataFrame, n: int, dims: int):
        self.blocks, self.n, self.dims, self.passes = blocks, n, dims, 0

    def _run(self, vectors: np.ndarray, gram: bool, shape: tuple[int, int]) -> np.ndarray:
        self.passes += 1
        parts = self.blocks.mapInArrow(_partial(np.ascontiguousarray(vectors), gram), "total binary")
        # One row per task, added up by a few tasks, of which the driver adds the last sums.
        rows = parts.repartition(REDUCERS).mapInArrow(_added, "total binary").collect()
        out = sum((np.frombuffer(r["total"]) for r in rows), np.zeros(shape[0] * shape[1]))
        return out.reshape(shape) / self.n

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return self._run(vectors, False, vectors.shape)

    def of_projections(self, vectors: np.ndarray) -> np.ndarray:
        """Covariance of the rows' projections."""
        k = vectors.shape[1]
        moments = self._run(vectors, True, (k + 1, k))
        return moments[:k] - np.outer(moments[k], moments[k])

    def trace(self) -> float:
        """Total variance: the sum of the squares of all entries."""

        def squares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total = [float(np.square(np.frombuffer(h.as_py())).sum()) for h in batch.column("c")]
                yield pa.RecordBatch.from_arrays([pa.array(total, pa.float64())], names=["value"])

        self.passes += 1
        return (self.blocks.mapInArrow(squares, "value double").agg(F.sum("value")).first()[0] or 0.0) / self.n


def orthonormal(new: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """The columns made orthogonal to others and each other; what is left of a dependent one is dropped."""
    kept: list[np.ndarray] = []
    base = np.hstack([b for b in against if b.shape[1]]) if any(b.shape[1] for b in against) else new[:, :0]
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        z = column / size
        for _ in range(3):
            z = z - base @ (base.T @ z)
            for k in kept:
                z = z - k * (k @ z)
            left = np.linalg.norm(z)
            if left < 1e-8:
                break
            z = z / left
        else:
            kept.append(z)
    return np.stack(kept, axis=1) if kept else new[:, :0]


def corrections(
    product: Product, theta: np.ndarray, u: np.ndarray, r: np.ndarray, locked: np.ndarray, steps: int, goal: float
) -> np.ndarray:
    """Rough solutions of the correction equations by MINRES, all columns in step: one product a step."""

    def project(z: np.ndarray) -> np.ndarray:
        for _ in range(2):
            z = z - locked @ (locked.T @ z)
            z = z - u * np.einsum("ij,ij->j", u, z)
        return z

    def apply(z: np.ndarray) -> np.ndarray:
        return project(product(z) - z * theta)

    columns = u.shape[1]
    v_old, v = np.zeros_like(r), project(-r)
    beta = np.linalg.norm(v, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v = v / start
    solution = np.zeros_like(r)
    d_old, d = np.zeros_like(r), np.zeros_like(r)
    c_old, s_old = np.ones(columns), np.zeros(columns)
    c, s = np.ones(columns), np.zeros(columns)
    rest, beta_v = beta.copy(), np.zeros(columns)
    active = beta > 0
    for _ in range(steps):
        if not active.any():
            break
        # Lanczos step.
        p = apply(v)
        alpha = np.einsum("ij,ij->j", v, p)
        p = p - v * alpha - v_old * beta_v
        beta_next = np.linalg.norm(p, axis=0)
        # The new column of the tridiagonal matrix, after the last two rotations.
        top = s_old * beta_v
        middle = c * c_old * beta_v + s * alpha
        bottom = c * alpha - s * c_old * beta_v
        size = np.hypot(bottom, beta_next)
        safe = np.where(size > 0, size, 1.0)
        c_next, s_next = bottom / safe, beta_next / safe
        d_next = (v - d * middle - d_old * top) / safe
        usable = active & (size > 0)
        solution = np.where(usable, solution + d_next * (c_next * rest), solution)
        rest = np.where(usable, -s_next * rest, rest)
        d_old, d = d, d_next
        c_old, s_old, c, s = c, s, c_next, s_next
        v_old, v = v, p / np.where(beta_next > 0, beta_next, 1.0)
        beta_v = beta_next
        active = usable & (beta_next > 1e-14 * start) & (np.abs(rest) > goal * start)
    return project(solution)


def eigenpairs(
    product: Product, dims: int, wanted: int, steps: int = INNER_STEPS, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric product, to rounding."""
    wanted = min(wanted, dims)
    space = orthonormal(np.random.default_rng(1).normal(size=(dims, min(dims, wanted + 4))), [])
    image = product(space)
    locked = space[:, :0]
    # Short vectors may be spanned whole; long ones are folded down before numbers beyond this many columns are held.
    widest = max(3 * wanted + 8, min(dims, 8 * wanted))
    scale, goal = 0.0, 0.5
    for _ in range(OUTER_STEPS):
        h = space.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        scale = max(scale, float(np.abs(values).max(initial=0)))
        left = wanted - locked.shape[1]
        theta, u, au = values[:left], space @ turn[:, :left], image @ turn[:, :left]
        r = au - u * theta
        r -= locked @ (locked.T @ r)
        open_ = np.linalg.norm(r, axis=0) > tolerance * scale / 2
        n_open = int(open_.sum())
        first = left if not n_open else int(np.argmax(open_))
        complete = space.shape[1] + locked.shape[1] >= dims
        if complete:
            # The whole space is spanned: what is left of the residuals is rounding of carried products.
            first = left
        if first:
            locked = np.hstack([locked, orthonormal(u[:, :first], [locked])])
            space, image = space @ turn[:, first:], image @ turn[:, first:]
            image -= locked @ (locked.T @ image)
        if locked.shape[1] >= wanted:
            values, vectors, worst = _settled(product, locked, scale)
            if worst <= tolerance * scale or not scale:
                return values, vectors
            # Carried products were less exact than they looked: go on from the locked vectors.
            space = orthonormal(np.hstack([vectors, space]), [])
            locked = locked[:, :0]
            image = product(space)
            continue
        theta, u, r = theta[first:], u[:, first:], r[:, first:]
        z = corrections(product, theta, u, r, locked, steps, goal)
        goal = max(goal / 4, 1e-6)
        if space.shape[1] + z.shape[1] > widest:
            h = space.T @ image
            _, turn = np.linalg.eigh((h + h.T) / 2)
            keep = turn[:, ::-1][:, : wanted - locked.shape[1] + 4]
            space = orthonormal(space @ keep, [locked])
            image = product(space)
        new = orthonormal(np.hstack([z, r]) if z.shape[1] else r, [locked, space])[:, : max(1, 2 * z.shape[1])]
        if not new.shape[1]:
            fresh = np.random.default_rng(space.shape[1]).normal(size=(dims, wanted))
            new = orthonormal(fresh, [locked, space])
        if new.shape[1]:
            space = np.hstack([space, new])
            image = np.hstack([image, product(new)])
    raise ArithmeticError("the eigenvectors did not reach double precision")


def _settled(product: Product, locked: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Rayleigh-Ritz among the locked vectors with a fresh product, and the largest residual."""
    image = product(locked)
    h = locked.T @ image
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = locked @ turn
    residual = image @ turn - vectors * values
    return values, vectors / np.linalg.norm(vectors, axis=0), float(np.linalg.norm(residual, axis=0).max(initial=0))


def _project(kind: pa.DataType, n: int, sums: np.ndarray, whiten: np.ndarray, explained: list[float], error: float):
    """One row per vector and component."""
    k, dims = whiten.shape[1], len(sums)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = centred(_matrix(batch.column("x")), n, sums)
            if float(np.abs(d).max(initial=0)) ** 2 * dims >= 2.0**63:
                exact = [sum(int(v) ** 2 for v in row) for row in d]
                if max(exact) >= 1 << 63:
                    raise OverflowError("a deviation does not fit into 64 bits")
                deviation = np.array(exact, dtype=np.int64)
            else:
                deviation = np.einsum("ij,ij->i", d, d)
            w = (d / n) @ whiten
            rows = np.repeat(np.arange(batch.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").cast(kind).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(len(rows), n)),
                    pa.array(deviation[rows]),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, batch.num_rows)),
                    pa.array(np.full(len(rows), error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(
    table: DataFrame,
    components: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each vector and component."""
    spark = table.sparkSession
    folder = work_folder(spark, "whitening")
    rows = whole_vectors(table, id_column, vector_column, scale, shift)
    fit = common.stored(rows.select("x").distinct(), f"{folder}/fit")
    per_dim = fit.mapInArrow(_sums, "j long, s long, n long").groupBy("j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    totals = sorted(per_dim.collect())
    n, sums = (totals[0]["n"] if totals else 0), np.array([t["s"] for t in totals], dtype=np.int64)
    values, vectors, trace, error = np.zeros(0), np.zeros((len(sums), 0)), 0.0, 0.0
    if n > 1:
        files = max(1, n * len(sums) * 8 // FILE_BYTES)
        blocks = fit.coalesce(files).mapInArrow(_centred_blocks(n, sums), "c binary")
        blocks = common.stored(blocks, f"{folder}/centred")
        covariance = Covariance(blocks, n, len(sums))
        values, vectors = eigenpairs(covariance, len(sums), components)
        varied = values > len(sums) * np.finfo(float).eps * values[0]
        values, vectors = values[varied], vectors[:, varied]
    turned = vectors / np.sqrt(values)
    if len(values):
        trace = covariance.trace()
        error = float(np.abs(covariance.of_projections(turned) - np.eye(len(values))).max())
    kind = rows.schema["id"].dataType
    schema = (
        f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    if not len(values):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    explained = (values / trace).tolist()
    found = rows.mapInArrow(_project(to_arrow_type(kind), n, sums, turned, explained, error), schema)
    return found.withColumnRenamed("id", id_column)
