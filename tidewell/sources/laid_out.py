"""Tables laid out for the way they are used: keyed registries, and tables that are searched.

A registry is partitioned by a coarse hash of its key and, inside, bucketed and
sorted by the key.  An upsert joins the stored rows where they lie, without
shuffling them, and rewrites only the partitions that the incoming rows touch
(dynamic partition overwrite); the others are not even read.

A searched table is laid out along a space-filling curve over the columns it is
searched by, so that each file covers a small range of every one of them and
the statistics of files and row groups rule most of them out.  Ids, which no
order helps, get bloom filters.
"""

from __future__ import annotations

import contextlib
import functools
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tidewell.session import shuffle_partitions

PART = "part"
PARTS = 64


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of one write."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Registry:
    """A keyed table ``name`` below ``folder``; ``keys`` identify a row, at most one row each."""

    def __init__(self, spark: SparkSession, name: str, folder: str, keys: Sequence[str], parts: int = PARTS):
        self.spark, self.name, self.folder, self.keys, self.parts = spark, name, folder, list(keys), parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def create(self, rows: DataFrame, buckets: int | None = None) -> None:
        """Stores the first rows; as many buckets as shuffle partitions, if not given, so that a join needs no other."""
        buckets = buckets or shuffle_partitions(self.spark)
        laid_out = rows.withColumn(PART, self._part()).repartition(buckets, *self.keys)
        writer = laid_out.write.format("parquet").partitionBy(PART).bucketBy(buckets, *self.keys).sortBy(*self.keys)
        writer.option("path", self.folder).saveAsTable(self.name)

    def stored(self) -> DataFrame:
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        return self.stored().drop(PART)

    def touched(self, keyed: DataFrame) -> list[int]:
        """The partitions that rows with these keys lie in, at most ``parts`` numbers."""
        return sorted(r[0] for r in keyed.select(self._part()).distinct().collect())

    def merged(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """``merge(stored, incoming)`` over the partitions that are touched."""
        own = self.stored().where(F.col(PART).isin(self.touched(incoming)))
        return merge(own.drop(PART), incoming)

    def upsert(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the touched partitions by what ``merge`` makes of them.

        The partitions are swapped when all tasks are done; a failed upsert
        leaves the table as it was, and a repeated one finds its own rows.
        """
        buckets = self._buckets()
        result = self.merged(incoming, merge).withColumn(PART, self._part()).select(*self.stored().columns)
        with setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            result.repartition(buckets, *self.keys).write.mode("overwrite").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def _buckets(self) -> int:
        rows = self.spark.sql(f"describe extended {self.name}").where("col_name = 'Num Buckets'").collect()
        return int(rows[0]["data_type"])


#: Bits of each column's rank on the curve.
RANK_BITS = 6


def _number(column: str, rows: DataFrame) -> Column:
    """A number in the order of the column: itself, its time, or the first six bytes of a text."""
    kind = rows.schema[column].dataType
    if isinstance(kind, NumericType):
        return F.col(column).cast("double")
    if isinstance(kind, StringType):
        head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double")


def curve(rows: DataFrame, columns: Sequence[str]) -> Column:
    """The place of a row on a curve that interleaves the ranks of its columns; a missing value ranks first.

    Ranks are those among 2^``RANK_BITS`` equal shares of the rows, found by one
    aggregate, so a frequent value takes no more of the curve than its rows.
    """
    shares = [i / 2**RANK_BITS for i in range(1, 2**RANK_BITS)]
    numbers = {c: _number(c, rows) for c in columns}
    bounds = rows.agg(*[F.percentile_approx(n, shares, 1000).alias(c) for c, n in numbers.items()]).first()
    place = F.lit(0)
    for at, column in enumerate(columns):
        # A frequent value is the bound of several shares and takes as many ranks.
        steps = Counter(bounds[column] or [])
        ranks = [F.when(numbers[column] >= F.lit(s), n).otherwise(0) for s, n in sorted(steps.items())]
        rank = functools.reduce(lambda a, b: a + b, ranks, F.lit(0))
        for bit in range(RANK_BITS):
            place = place + F.shiftleft(F.shiftright(rank, bit).bitwiseAND(1), bit * len(columns) + at)
    return place


def write_for_search(
    rows: DataFrame, path: str, by: Sequence[str], ids: Sequence[str] = (), files: int | None = None, row_group_bytes: int | None = None
) -> None:
    """Writes a table along the curve over the columns ``by``, with bloom filters on ``ids``."""
    ranked = rows.withColumn("_place", curve(rows, by))
    laid_out = ranked.repartitionByRange(files or shuffle_partitions(rows.sparkSession), "_place", *by)
    writer = laid_out.sortWithinPartitions("_place", *by).drop("_place").write.mode("overwrite")
    for column in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    # Times in the old 96-bit form have no statistics.
    with setting(rows.sparkSession, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):
        writer.parquet(path)
