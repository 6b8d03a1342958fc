"""Remembered experiment lookups: keyed state with a lifetime.

A lookup that finds an experiment is remembered for good, one that finds none
for a limited time.  The flow has two levels, so that a hot key is never one
task's rows:

1. ``search_stream``.  Each micro-batch reduces its lookups to one row per
   lookup key, combined before the shuffle, and searches those.  The lookups
   themselves stay where they are, in the table of the batch.
2. ``answer_stream``.  The searched keys of a batch are joined with what is
   remembered, a table of one row per key that is kept as pieces of a batch
   each; what a batch changes is its piece, so a batch that runs again reads
   what was there before it.  A miss is removed once event time has passed its
   expiry.  The join gets one row per key and batch, however hot the key is, and
   runs no Python.  Its decisions are joined back to the batch's lookups, a
   join whose hot keys adaptive execution splits.

Event time is the newest lookup seen, carried as a rising ``clock`` on every
searched key; so a late lookup is still answered, and no clock of a machine is
read.  The index comes from a callable and may be loaded again between batches:
an edit of an experiment shows for keys that are not remembered.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewell.functions.hashing import lookup_key
from tidewell.operators import experiments
from tidewell.session import shuffle_partitions
from tidewell.streaming.tables import BatchClock, BatchTable, MergedTable

FOUND = "experiment_id string, score double, passes boolean, document struct<{}>".format(
    ", ".join(f"{name}: string" for name in experiments.DOCUMENT)
)
_FOUND_COLUMNS = ["experiment_id", "score", "passes", "document"]
#: Searched keys: what the batch's search found is one JSON text, null when it found none.
SEARCHED = "source_batch long, lookup_key string, first_us long, last_us long, clock timestamp, found string"
#: What a key remembers: an answer for good, or until when it found none.
MEMORY = "lookup_key string, answer string, expires long, version long"
_DECISIONS = "array<struct<source_batch: long, remembered: string, covered_until: long, found: string>>"
#: Times are microseconds; a hit is covered until the end of time.
FOR_GOOD = 2**63 - 1


def with_key(lookups: DataFrame) -> DataFrame:
    return lookups.withColumn("lookup_key", lookup_key(*[F.col(c) for c in ("deviceId", "userId", "url", "producer")]))


def searched_keys(keyed: DataFrame, index: DataFrame, batch: int) -> DataFrame:
    """One row per lookup key of a batch: its first and last time, and what a search finds for it."""
    first = [F.any_value(F.col(c)).alias(c) for c in experiments.FIELDS]  # the key determines the fields
    # A lookup without a time is answered by the search of its batch.
    times = [F.coalesce(F.unix_micros(t), F.lit(0)).alias(n) for n, t in (("first_us", F.min("ts")), ("last_us", F.max("ts")))]
    asked = keyed.groupBy("lookup_key").agg(*times, *first)
    found = F.when(F.col("experiment_id").isNotNull(), F.to_json(F.struct(*_FOUND_COLUMNS)))
    return experiments.match(asked, index).select(
        F.lit(batch).cast("long").alias("source_batch"), "lookup_key", "first_us", "last_us", found.alias("found")
    )


def search_stream(
    lookups: DataFrame, index: Callable[[], DataFrame], keyed: BatchTable, searched: BatchTable, checkpoint: str
) -> DataStreamWriter:
    """Writes each batch's lookups with their keys, and its distinct keys with what a search finds."""
    clock = BatchClock(searched)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed.write(with_key(batch), batch_id)
        rows = spark.read.schema(with_key(batch).schema).parquet(f"{keyed.root}/batch={batch_id}")
        newest = clock.advance(spark, batch_id, rows.agg(F.max("ts")).first()[0])
        found = searched_keys(rows, index(), batch_id)
        clocked = found.withColumn("clock", F.lit(newest).cast("timestamp"))
        # As many files as there are tasks of the second level, so that a reader can take a batch at a time.
        searched.write(clocked.repartition(shuffle_partitions(spark), "lookup_key"), batch_id)

    return lookups.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)


def searched_batches(spark: SparkSession, searched: BatchTable) -> DataFrame:
    """The table that ``search_stream`` writes as a stream, about one of its batches at a time."""
    each = str(shuffle_partitions(spark))
    return spark.readStream.schema(SEARCHED).option("maxFilesPerTrigger", each).parquet(f"{searched.root}/batch=*")


def _newest(rows: DataFrame, expired: int | None = None) -> DataFrame:
    """The newest memory of each key, without misses whose expiry the time ``expired`` has passed.

    A key never forgets a hit, and a miss is followed only by later ones, so
    dropping one brings back none before it.
    """
    newest = rows.groupBy("lookup_key").agg(F.max_by(F.struct("answer", "expires", "version"), "version").alias("_row"))
    newest = newest.select("lookup_key", "_row.*")
    return newest if expired is None else newest.where(F.col("expires").isNull() | (F.col("expires") > expired))


def decide(searched: DataFrame, memory: DataFrame, miss_seconds: int = experiments.MISS_SECONDS) -> DataFrame:
    """Per key its ``decisions``, one a batch, and what it remembers then: ``answer``, ``expires`` and whether that ``changed``.

    A decision is what was remembered, for lookups before ``covered_until``, and what the others get.
    """
    lifetime = miss_seconds * 1_000_000
    rows = searched.groupBy("lookup_key").agg(F.array_sort(F.collect_list(F.struct("source_batch", "first_us", "last_us", "found"))).alias("rows"))
    held = memory.select("lookup_key", "answer", "expires", F.lit(True).alias("held"))
    none = F.array().cast(_DECISIONS)
    zero = F.struct(F.coalesce("held", F.lit(False)).alias("held"), "answer", "expires", F.lit(False).alias("changed"), none.alias("decisions"))

    def step(before: Column, row: Column) -> Column:
        until = F.when(before["held"], F.when(before["answer"].isNotNull(), F.lit(FOR_GOOD)).otherwise(before["expires"]))
        decision = F.struct(row["source_batch"].alias("source_batch"), before["answer"].alias("remembered"), until.alias("covered_until"), row["found"].alias("found"))
        # Some lookup was not covered: what the search of this batch found is remembered.
        taken = until.isNull() | (row["last_us"] >= until)
        expires = F.when(row["found"].isNull(), F.greatest(row["first_us"], until) + lifetime)
        return F.struct(
            (before["held"] | taken).alias("held"),
            F.when(taken, row["found"]).otherwise(before["answer"]).alias("answer"),
            F.when(taken, expires).otherwise(before["expires"]).alias("expires"),
            (before["changed"] | taken).alias("changed"),
            F.concat(before["decisions"], F.array(decision)).alias("decisions"),
        )

    folded = rows.join(held, "lookup_key", "left").select("lookup_key", F.aggregate("rows", zero, step).alias("after"))
    return folded.select("lookup_key", "after.decisions", "after.answer", "after.expires", "after.changed")


def answered(keyed: DataFrame, decided: DataFrame) -> DataFrame:
    """The lookups with their experiment, whether they were ``covered`` by what was remembered, and their actions."""
    joined = keyed.join(decided, ["source_batch", "lookup_key"], "left")
    covered = F.coalesce(F.unix_micros("ts") < F.col("covered_until"), F.lit(False))
    answer = F.from_json(F.when(F.col("covered"), F.col("remembered")).otherwise(F.col("found")), FOUND)
    rows = joined.withColumn("covered", covered).withColumn("answer", answer)
    kept = [c for c in keyed.columns if c != "source_batch"]
    return experiments.assign(rows.select(*kept, "covered", *[F.col(f"answer.{c}").alias(c) for c in _FOUND_COLUMNS]))


def answer_stream(
    searched: DataFrame,
    keyed: BatchTable,
    answers: BatchTable,
    checkpoint: str,
    miss_seconds: int = experiments.MISS_SECONDS,
) -> DataStreamWriter:
    """The stream writer of the second level; ``searched`` streams the table that ``search_stream`` writes."""

    def process(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        clocks = BatchTable(f"{checkpoint}/clocks")
        # Misses leave after the batch that event time passes their expiry before.
        memory = _memory(checkpoint, _passed(spark, clocks, batch_id - 1))
        before = memory.read(spark, before=batch_id)
        decided = decide(rows, spark.createDataFrame([], MEMORY) if before is None else before, miss_seconds).persist()
        try:
            decisions = decided.select("lookup_key", F.explode("decisions").alias("d")).select("lookup_key", "d.*")
            # A few numbers: the searched batches that this one has read.
            sources = [r[0] for r in decisions.select("source_batch").distinct().collect()]
            if sources:
                lookups = keyed.read(spark, after=min(sources) - 1, before=max(sources) + 1)
                lookups = lookups.withColumnRenamed("batch", "source_batch").where(F.col("source_batch").isin(sources))
                answers.write(answered(lookups, decisions), batch_id)
            changed = decided.where("changed").select("lookup_key", "answer", "expires", F.lit(batch_id).cast("long").alias("version"))
            clocks.write(rows.agg(F.max("clock").alias("clock")), batch_id)
            memory.write(changed, batch_id)
        finally:
            decided.unpersist()

    return searched.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)


#: Batches from one snapshot of what is remembered to the next.
COMPACT_EVERY = 20


def _memory(checkpoint: str, expired: int | None) -> MergedTable:
    return MergedTable(f"{checkpoint}/memory", functools.partial(_newest, expired=expired), COMPACT_EVERY)


def _passed(spark: SparkSession, clocks: BatchTable, before: int | None = None) -> int | None:
    """The time that event time has passed in the batches before one, a second behind the newest lookup."""
    seen = clocks.read(spark, before=before)
    newest = None if seen is None else seen.agg(F.unix_micros(F.max("clock"))).first()[0]
    return None if newest is None else newest // 1000 * 1000 - 1_000_000


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What ``answer_stream`` remembers: ``lookup_key, found, expires`` of every key that remembers something."""
    memory = _memory(checkpoint, _passed(spark, BatchTable(f"{checkpoint}/clocks"))).read(spark)
    memory = spark.createDataFrame([], MEMORY) if memory is None else memory
    return memory.select("lookup_key", F.col("answer").alias("found"), F.timestamp_micros("expires").alias("expires"))
