"""Nearest vectors by inner product: a block matrix join on int8 tiles.

Each vector is scaled to integers in -127..127.  The product of two such
vectors differs from the true inner product by a bound that follows from the
rounding errors; products are formed in float32, ``_EXACT`` components at a
time, whose sums it holds exactly, and added up in float64.  A pair
survives if its upper bound reaches the k-th largest lower bound of its query
within the tile.  Survivors are computed again in double precision, in the
order of the components, and a heap keeps the k best.  No pair that belongs to
the result can be lost, so recall is 1.

Vectors that are null, zero or hold a null or non-finite component take no
part, neither do rows without an id; a query only meets vectors of its own
length.  Ties go to the smaller id.  A row is never its own neighbour; a further
row with the query's id is one like any other.  Repeated query rows are
answered each.  An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import tiles

_AT_ONCE = 256
#: 127 * 127 * 1024 < 2^24: sums of so many products of int8 values are exact in float32.
_EXACT = 1024
#: Share by which the bound is widened for rounding in its own computation.
_SLACK = 1e-9


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(table.num_rows, -1)


def _scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 vectors and the scale of each."""
    scale = np.abs(m).max(axis=1, keepdims=True) / 127
    return np.rint(m / scale).astype(np.int8), scale[:, 0]


def _bounded_errors(m: np.ndarray, ints: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norm of what rounding has left of each vector, and of the rounded vector."""
    rounded = ints * scale[:, None]
    return np.linalg.norm(m - rounded, axis=1), np.linalg.norm(rounded, axis=1)


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the int8 rows of a with the columns of b, given as float32."""
    total = np.zeros((len(a), b.shape[1]))
    for j in range(0, len(b), _EXACT):
        total += a[:, j : j + _EXACT].astype(np.float32) @ b[j : j + _EXACT]
    return total


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def best_of_tile(k: int):
    """The function that finds the k nearest of one pair of blocks."""

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q, x = _matrix(left), _matrix(right)
            q_id, q_row = left.column("id").to_numpy(), left.column("row").to_numpy()
            x_id, x_row = right.column("id").to_numpy(), right.column("row").to_numpy()
            q_int, q_scale = _scaled(q)
            x_int, x_scale = _scaled(x)
            q_err, q_norm = _bounded_errors(q, q_int, q_scale)
            x_err, x_norm = _bounded_errors(x, x_int, x_scale)
            x_float = x_int.astype(np.float32).T.copy()
            for a in range(0, len(q), _AT_ONCE):
                b = min(a + _AT_ONCE, len(q))
                rough = int_products(q_int[a:b], x_float)
                rough *= q_scale[a:b, None] * x_scale[None, :]
                # |<q,x> - <q',x'>| <= |q - q'| (|x'| + |x - x'|) + |q'| |x - x'|
                error = q_err[a:b, None] * (x_norm + x_err)[None, :] + q_norm[a:b, None] * x_err[None, :]
                error += _SLACK * (q_norm[a:b, None] * x_norm[None, :] + error)
                own = q_row[a:b, None] == x_row[None, :]
                low, high = np.where(own, -np.inf, rough - error), np.where(own, -np.inf, rough + error)
                least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(b - a, -np.inf)
                rows, cols = np.nonzero((high >= least[:, None]) & ~own)
                scores = np.empty(len(rows))
                for s in range(0, len(rows), 1 << 16):
                    e = s + (1 << 16)
                    scores[s:e] = in_order(q[a + rows[s:e]], x[cols[s:e]])
                first = np.searchsorted(rows, np.arange(b - a + 1))
                for i in range(b - a):
                    span = slice(first[i], first[i + 1])
                    pairs = zip((-scores[span]).tolist(), x_id[cols[span]].tolist(), strict=True)
                    out += [(q_id[a + i], q_row[a + i], v, -s) for s, v in heapq.nsmallest(k, pairs)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        names = ["query_id", "query_row", "vec_id", "score"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return tile


def nearest(
    table: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows to each row that meets ``is_query`` (a condition on id)."""
    rows = tiles.vectors(table, id_column, vector_column, zero=False)
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    return tiles.search(rows.where(is_query), rows, best_of_tile(k), k, "double")
