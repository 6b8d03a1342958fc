"""Counters per time window over the stream of registration outcomes.

Windows are published once, when event time has passed their end and the
allowed lateness; rows that come later are published as corrections.  Two
levels, so that a crowded window is never one task's rows:

1. ``counted`` reduces each micro-batch to its counters per window, combined
   before the shuffle.
2. ``published`` passes those through ``transformWithState``, keyed by window.
   The state holds the counters of open windows only.  A timer publishes a
   window as revision 0 and removes its state.  Counters that reach a closed
   window become a correction at once, with the number of the batch that
   counted them plus one as its revision, so (window, revision) is unique and a
   repeated batch repeats its own revisions.

A window's counters are the sums over its revisions; while it is open they are
in the state, which ``open_windows`` reads.  Event time is the newest row seen,
carried as a rising ``clock``, so nothing is too late to be counted.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tidewell.operators import devices
from tidewell.session import shuffle_partitions
from tidewell.streaming.tables import BatchClock, BatchTable, ROCKSDB, STATE_STORE

INTERVAL = "30 minutes"
LATENESS_MS = 30 * 60 * 1000

_COUNTS = ", ".join(f"{name} long" for name in devices.COUNTERS)
COUNTED = f"source_batch long, start_ms long, end_ms long, clock timestamp, {_COUNTS}"
REVISIONS = f"start_ms long, end_ms long, revision long, {_COUNTS}"
_STATE = f"end_ms long, {_COUNTS}"


def windowed(outcomes: DataFrame, interval: str = INTERVAL, lateness: str = INTERVAL) -> DataFrame:
    """Streaming counters by the built-in aggregate, with one window of allowed lateness.

    In append mode a window is published once, when the watermark has passed
    it; in update mode whenever it changes.  A window without any call has no
    row, so nothing is published for it.  Rows behind the watermark are
    dropped; ``published`` corrects its windows by them.
    """
    counted = devices.count_registrations(outcomes.withWatermark("ts", lateness), interval)
    return devices.metrics_events(counted.filter(F.col("api_calls") > 0))


def counted(outcomes: DataFrame, pieces: BatchTable, interval: str = INTERVAL) -> DataStreamWriter:
    """Writes each batch's counters per window; a repeated batch replaces its own."""
    clock = BatchClock(pieces)

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        counters = [column.alias(name) for name, column in devices.counter_columns().items()]
        windows = rows.groupBy(F.window("ts", interval)).agg(*counters, F.max("ts").alias("newest_ts"))
        per_window = windows.persist()
        try:
            newest = clock.advance(spark, batch_id, per_window.agg(F.max("newest_ts")).first()[0])
            kept = per_window.select(
                F.lit(batch_id).cast("long").alias("source_batch"),
                F.unix_millis(F.col("window")["start"]).alias("start_ms"),
                F.unix_millis(F.col("window")["end"]).alias("end_ms"),
                F.lit(newest).cast("timestamp").alias("clock"),
                *devices.COUNTERS,
            )
            pieces.write(kept.repartition(shuffle_partitions(spark), "start_ms"), batch_id)
        finally:
            per_window.unpersist()

    return outcomes.writeStream.foreachBatch(write)


class Publish(StatefulProcessor):
    """Open windows gather their counters; closed ones publish what still comes."""

    def __init__(self, lateness_ms: int):
        self.lateness_ms = lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        gathered = None
        for row in rows:
            counts = [row[name] for name in devices.COUNTERS]
            if watermark >= row["end_ms"] + self.lateness_ms:
                yield self._revision(key[0], row["end_ms"], row["source_batch"] + 1, counts)
            elif gathered is None:
                gathered = [row["end_ms"], *counts]
            else:
                gathered[1:] = [a + b for a, b in zip(gathered[1:], counts, strict=True)]
        if gathered is not None:
            held = self.open.get()
            if held is None:
                self.handle.registerTimer(gathered[0] + self.lateness_ms)
            else:
                gathered[1:] = [a + b for a, b in zip(gathered[1:], held[1:], strict=True)]
            self.open.update(tuple(gathered))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.open.get()
        if held is not None:
            self.open.clear()
            yield self._revision(key[0], held[0], 0, list(held[1:]))

    @staticmethod
    def _revision(start_ms: int, end_ms: int, revision: int, counts: list[int]) -> Row:
        names = dict(zip(devices.COUNTERS, counts, strict=True))
        return Row(start_ms=start_ms, end_ms=end_ms, revision=revision, **names)

    def close(self) -> None:
        pass


def counted_batches(spark: SparkSession, pieces: BatchTable, files: int | None = None) -> DataFrame:
    """The table that ``counted`` writes as a stream, so many files, or about one of its batches, at a time.

    What is read together is on time together.
    """
    each = str(files or shuffle_partitions(spark))
    return spark.readStream.schema(COUNTED).option("maxFilesPerTrigger", each).parquet(f"{pieces.root}/batch=*")


def published(pieces: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Revisions of the windows: 0 when a window closes, later ones for rows that come after."""
    pieces.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    clocked = pieces.withWatermark("clock", "1 second")  # rows of the newest clock are not late
    return clocked.groupBy("start_ms").transformWithState(
        Publish(lateness_ms), REVISIONS, outputMode="Append", timeMode="EventTime"
    )


def publish(pieces: DataFrame, revisions: BatchTable, lateness_ms: int = LATENESS_MS) -> DataStreamWriter:
    """The stream writer of ``published`` into a table of micro-batches."""
    return published(pieces, lateness_ms).writeStream.outputMode("append").foreachBatch(revisions.write)


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The counters of windows that are not published yet, read from the state of ``publish``."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return state.select("key.start_ms", "value.end_ms", *[f"value.{name}" for name in devices.COUNTERS])


def _window(start_ms: Column, end_ms: Column) -> Column:
    return F.struct(F.timestamp_millis(start_ms).alias("start"), F.timestamp_millis(end_ms).alias("end"))


def totals(revisions: DataFrame) -> DataFrame:
    """Published counters per window: the sums over its revisions, and of open windows if they are among the rows."""
    sums = [F.sum(name).alias(name) for name in devices.COUNTERS]
    summed = revisions.groupBy("start_ms", "end_ms").agg(*sums).filter(F.col("api_calls") > 0)
    return devices.metrics_events(summed.withColumn("window", _window(F.col("start_ms"), F.col("end_ms"))))
