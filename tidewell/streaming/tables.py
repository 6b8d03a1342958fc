"""Tables written batch by batch.

Every micro-batch writes its own folder ``batch=<id>`` in overwrite mode, so a
batch that is run again after a failure replaces its earlier output and
nothing is counted twice.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.devices import merge_stamped, unstamped


#: Keyed state of the streams is kept in RocksDB, outside the heap.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def finished_folders(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the finished ``name=<number>`` folders below a root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = []
    for status in files.listStatus(path):
        match = re.fullmatch(rf"{name}=(\d+)", status.getPath().getName())
        if match and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(match.group(1)))
    return sorted(found)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store Spark writes to; one that is not there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _save(rows: DataFrame, path: str, layout: list[str]) -> None:
    """Replaces what a folder holds; rows of one layout value go to one file."""
    laid_out = rows.repartition(*layout) if layout else rows
    laid_out.write.mode("overwrite").partitionBy(*layout).parquet(path)


class BatchTable:
    """An append-only table of micro-batches; ``layout``: columns that the rows of a batch are laid out by."""

    def __init__(self, root: str, layout: Sequence[str] = ()):
        self.root = root
        self.layout = list(layout)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        _save(rows, f"{self.root}/batch={batch_id}", self.layout)

    def batches(self, spark: SparkSession, after: int = -1, before: int | None = None) -> list[int]:
        found = finished_folders(spark, self.root, "batch")
        return [b for b in found if b > after and (before is None or b < before)]

    def forget(self, spark: SparkSession, upto: int) -> None:
        """Removes the finished batches up to a number."""
        for batch in self.batches(spark, before=upto + 1):
            remove_folder(spark, f"{self.root}/batch={batch}")

    def read(self, spark: SparkSession, after: int = -1, before: int | None = None) -> DataFrame | None:
        """Rows of the finished batches with their ``batch`` number, None when there is no batch."""
        wanted = self.batches(spark, after, before)
        if not wanted:
            return None
        paths = [f"{self.root}/batch={b}" for b in wanted]
        return spark.read.option("basePath", self.root).parquet(*paths)


class BatchClock:
    """The newest event time of a stream, which only rises; a restart goes on from the ``clock`` column of its table."""

    def __init__(self, table: BatchTable):
        self.table = table
        self.at: datetime.datetime | None = None
        self.started = False

    def advance(self, spark: SparkSession, batch_id: int, newest: datetime.datetime | None) -> datetime.datetime | None:
        if not self.started:
            done = self.table.batches(spark, before=batch_id)
            if done:
                self.at = self.table.read(spark, after=done[-1] - 1, before=batch_id).agg(F.max("clock")).first()[0]
            self.started = True
        self.at = max([t for t in (self.at, newest) if t is not None], default=None)
        return self.at


class MergedTable:
    """A keyed table kept as pieces that an associative ``merge`` folds together.

    A batch appends only the keys it saw, so its cost follows the batch and
    not the size of the table.  ``compact`` folds the pieces into a snapshot;
    nothing is changed in place, and a batch that runs again after a failure
    reads only what was there before it.
    """

    def __init__(
        self,
        root: str,
        merge: Callable[[DataFrame], DataFrame],
        compact_every: int = 100,
        layout: Sequence[str] = (),
    ):
        self.pieces = BatchTable(f"{root}/pieces", layout)
        self.snapshots = f"{root}/snapshots"
        self.merge = merge
        self.compact_every = compact_every

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Writes the piece of a batch, and now and then a snapshot."""
        self.pieces.write(self.merge(rows), batch_id)
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(rows.sparkSession)

    def parts(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The newest snapshot and the pieces after it, not yet merged."""
        done = [n for n in finished_folders(spark, self.snapshots, "upto") if before is None or n < before]
        upto = max(done, default=-1)
        newer = self.pieces.read(spark, after=upto, before=before)
        newer = None if newer is None else newer.drop("batch")
        if upto < 0:
            return newer
        snapshot = spark.read.parquet(f"{self.snapshots}/upto={upto}")
        return snapshot if newer is None else snapshot.unionByName(newer)

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The merged table, None while there is no batch."""
        parts = self.parts(spark, before)
        return None if parts is None else self.merge(parts)

    def compact(self, spark: SparkSession) -> None:
        """Writes a snapshot of everything up to the last finished batch, and removes what no batch can ask for again.

        The snapshot before and the pieces after it stay: the last batch may
        have to run again, and reads only what was there before it.
        """
        last = max(self.pieces.batches(spark), default=-1)
        done = finished_folders(spark, self.snapshots, "upto")
        if last > max(done, default=-1):
            _save(self.read(spark), f"{self.snapshots}/upto={last}", self.pieces.layout)
            for old in done[:-1]:
                remove_folder(spark, f"{self.snapshots}/upto={old}")
            if done:
                self.pieces.forget(spark, done[-1])


class ProfileStore(MergedTable):
    """Device profiles: the newest stamp of each field per device."""

    def __init__(self, root: str, compact_every: int = 100):
        super().__init__(root, merge_stamped, compact_every)

    def profiles(self, spark: SparkSession) -> DataFrame | None:
        """Latest non-empty fields of every device."""
        merged = self.read(spark)
        return None if merged is None else unstamped(merged)


def latest_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the newest batch per key, for tables written in update mode."""
    rest = [c for c in rows.columns if c not in {*keys, "batch"}]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")
