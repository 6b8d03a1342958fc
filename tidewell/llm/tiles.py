"""Pairs blocks of query vectors with blocks of all vectors.

The query set is stated, every query meets every vector, and each pair of
blocks is one task's work of a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERIES_A_BLOCK = 1024
VECTORS_A_BLOCK = 8192
RESULT = "query_id long, vec_id long, score {score}"


def vectors(table: DataFrame, id_column: str, vector_column: str, zero: bool) -> DataFrame:
    """id, v, row and size of the rows whose vector is present and finite throughout.

    ``row`` tells apart rows that repeat an id.  ``zero``: whether vectors of
    nothing but zeros, the empty one included, stay.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).alias("v"),
        F.monotonically_increasing_id().alias("row"),
    )
    kept = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite)
    if not zero:
        kept = kept.where(F.exists(v, lambda x: x != 0))
    return kept.withColumn("size", F.size(v))


def blocks(queries: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the keys (q, c) of the pair of blocks; each row is repeated for each block of the other side."""
    n_q = max(1, -(-queries.count() // QUERIES_A_BLOCK))
    n_c = max(1, -(-candidates.count() // VECTORS_A_BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return (
        queries.withColumn("q", dealt(n_q)).withColumn("c", every(n_c)),
        candidates.withColumn("c", dealt(n_c)).withColumn("q", every(n_q)),
    )


def search(
    queries: DataFrame,
    candidates: DataFrame,
    tile: Callable[[pa.Table, pa.Table], pa.Table],
    k: int,
    score: str,
) -> DataFrame:
    """The k best of all tiles per query: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    ``tile`` returns the k best of one pair of blocks per query row.
    """
    left, right = blocks(queries, candidates)
    keys = ["q", "c", "size"]
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(tile, f"query_id long, query_row long, vec_id long, score {score}")
    )
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
