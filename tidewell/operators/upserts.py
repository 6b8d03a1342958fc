"""Set operations on keyed tables.

Without a table format there is no MERGE: an upsert returns the new snapshot
as a DataFrame and the caller writes it as a new version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key under ``order``; an aggregate, so a hot key is combined map-side."""
    rest = [name for name in rows.columns if name not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col("_row")[name].alias(name) for name in rest])
        .select(*rows.columns)
    )


def first_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key under ``order``."""
    rest = [name for name in rows.columns if name not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col("_row")[name].alias(name) for name in rest])
        .select(*rows.columns)
    )


def one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("loaded",)) -> DataFrame:
    """A reference table with one row per key: the last under the ``order`` columns it has.

    What the order leaves open is settled by the other columns, so the result
    does not depend on how the table is read.  Order columns are dropped.
    """
    given = [name for name in order if name in rows.columns]
    rest = [name for name in rows.columns if name not in keys and name not in given]
    last = F.max_by(F.struct(*rest), F.struct(*given, *rest)).alias("_row")
    picked = rows.groupBy(*keys).agg(last)
    return picked.select(*keys, *[F.col("_row")[name].alias(name) for name in rest])


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace existing rows of the same key; the rest is kept.

    ``incoming`` holds one row per key.
    """
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming)
