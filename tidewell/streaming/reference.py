"""Reference data that is read again while a stream runs."""

from __future__ import annotations

import datetime
import functools
import logging
import time
from collections.abc import Callable
from typing import Generic, TypeVar

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewell.streaming.tables import finished_folders

REFRESH_SECONDS = 3600

T = TypeVar("T")

log = logging.getLogger(__name__)


class Refreshed(Generic[T]):
    """Reference data for use inside ``foreachBatch``, loaded again once it is older than the interval.

    A reload that fails keeps the last good value; without one the error is
    raised.  A value that ``is_empty`` calls empty is loaded again on the next
    use.
    """

    def __init__(
        self,
        load: Callable[[], T],
        seconds: float = REFRESH_SECONDS,
        clock: Callable[[], float] = time.monotonic,
        is_empty: Callable[[T], bool] = lambda _: False,
    ):
        self._load = load
        self._is_empty = is_empty
        self._seconds = seconds
        self._clock = clock
        self._value: T | None = None
        self._loaded_at = 0.0

    def __call__(self) -> T:
        now = self._clock()
        if self._value is None or now - self._loaded_at >= self._seconds:
            try:
                fresh = self._load()
                empty = self._is_empty(fresh)
                self._value = fresh
                self._loaded_at = now - self._seconds if empty else now
            except Exception:
                if self._value is None:
                    raise
                log.exception("reload failed, keeping what was loaded before")
                self._loaded_at = now
        return self._value


class Versions(Generic[T]):
    """Versions of reference data under one folder, the newest ``keep`` of them.

    A version is built by ``build(folder)`` into one of ``keep`` slots and
    opened by ``open_(spark, folder)``.  It counts once its row in the manifest
    is written: number, slot, and the event time it was loaded at.  The slot of
    the oldest version is taken off the manifest before its files are replaced,
    so a reader sees a whole version or none, and old files go with no more than
    the writer's overwrite mode.
    """

    SCHEMA = "version long, loaded_at timestamp"

    def __init__(
        self, root: str, build: Callable[[str, datetime.datetime], object], open_: Callable[[SparkSession, str], T], keep: int = 4
    ):
        if keep < 2:
            raise ValueError("keep at least two versions: one may be read while another is written")
        self.root, self.keep = root, keep
        self._build, self._open = build, open_

    def manifest(self, spark: SparkSession) -> DataFrame:
        """``version, loaded_at, slot`` of the versions that can be read."""
        slots = finished_folders(spark, f"{self.root}/manifest", "slot")
        if not slots:
            return spark.createDataFrame([], f"{self.SCHEMA}, slot int")
        rows = spark.read.schema(f"{self.SCHEMA}, slot int").option("basePath", f"{self.root}/manifest")
        return rows.parquet(*[f"{self.root}/manifest/slot={s}" for s in slots])

    def known(self, spark: SparkSession) -> list[Row]:
        """The manifest, at most ``keep`` rows, by load time."""
        return sorted(self.manifest(spark).collect(), key=lambda r: (r["loaded_at"], r["version"]))

    def publish(self, spark: SparkSession, loaded_at: datetime.datetime) -> int:
        """Builds the next version; if that fails, the other versions stay."""
        known = self.known(spark)
        version = max((r["version"] for r in known), default=-1) + 1
        slot = version % self.keep
        place = f"{self.root}/manifest/slot={slot}"
        if any(r["slot"] == slot for r in known):
            spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(place)
        self._build(self.folder(slot), loaded_at)
        row = spark.createDataFrame([(version, loaded_at)], self.SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(place)
        return version

    def folder(self, slot: int) -> str:
        return f"{self.root}/slots/{slot}"

    def open(self, spark: SparkSession, slot: int) -> T:
        return self._open(spark, self.folder(slot))

    def as_of(self, known: list[Row], time: Column) -> Column:
        """The slot of the newest version loaded at or before a time; before all of them that of the oldest."""
        slot = F
        for row in reversed(known[1:]):
            slot = slot.when(time >= F.lit(row["loaded_at"]), row["slot"])
        first = F.lit(known[0]["slot"])
        return first if slot is F else slot.otherwise(first)


class Reloading(Generic[T]):
    """Loads a new version at every multiple of the interval that event time passes.

    A load that fails leaves the versions as they are until the next one is
    due; only the first must succeed.  A restart goes on from the manifest.
    """

    def __init__(self, versions: Versions[T], seconds: int = REFRESH_SECONDS):
        self.versions, self.seconds = versions, seconds
        self.tried: datetime.datetime | None = None

    def up_to(self, spark: SparkSession, clock: datetime.datetime) -> list[Row]:
        """Makes the loads that are due at a time, at most as many as are kept; the versions there are then."""
        known = self.versions.known(spark)
        if self.tried is None and known:
            self.tried = known[-1]["loaded_at"]
        epoch = datetime.datetime(1970, 1, 1)
        newest = epoch + (clock - epoch) // datetime.timedelta(seconds=self.seconds) * datetime.timedelta(seconds=self.seconds)
        due = [newest]
        if self.tried is not None:
            missed = (newest - self.tried) // datetime.timedelta(seconds=self.seconds)
            due = [newest - datetime.timedelta(seconds=self.seconds * k) for k in reversed(range(min(missed, self.versions.keep)))]
        for time_ in due:
            self.tried = time_
            try:
                self.versions.publish(spark, time_)
            except Exception:
                if not self.versions.known(spark):
                    self.tried = None
                    raise
                log.exception("loading the version of %s failed, keeping the earlier ones", time_)
        return self.versions.known(spark) if due else known


def by_version(
    rows: DataFrame, versions: Versions[T], known: list[Row], time: str, apply: Callable[[DataFrame, T], DataFrame]
) -> DataFrame:
    """``apply`` to the rows of each version with what that version holds, with ``loaded_at``; at most ``keep`` branches."""
    spark = rows.sparkSession
    marked = rows.withColumn("_slot", versions.as_of(known, F.col(time)))
    parts = []
    for row in known:
        own = marked.where(F.col("_slot") == row["slot"]).drop("_slot")
        found = apply(own, versions.open(spark, row["slot"]))
        parts.append(found.withColumn("loaded_at", F.lit(row["loaded_at"]).cast("timestamp")))
    return functools.reduce(DataFrame.unionByName, parts)
