"""Registration stream: enrich, store profiles, publish events, count."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewell.operators import devices
from tidewell.operators.geo import GeoIndex
from tidewell.streaming.reference import Reloading, by_version
from tidewell.streaming.tables import BatchTable, ProfileStore

Sink = Callable[[DataFrame, int], None]


def kafka_sink(servers: str, topic: str, **options: str) -> Sink:
    """Publishes the ``value`` column with a null key."""

    def publish(events: DataFrame, batch_id: int) -> None:
        writer = events.select("value").write.format("kafka").option("kafka.bootstrap.servers", servers)
        writer.option("topic", topic).options(**options).save()

    return publish


def table_sink(root: str) -> Sink:
    """Publishes to a table of micro-batches; safe to repeat."""
    return BatchTable(root).write


def register(
    registrations: DataFrame,
    index: Callable[[], GeoIndex],
    profiles: ProfileStore,
    events: Sink,
    outcomes: BatchTable,
    checkpoint: str,
) -> DataStreamWriter:
    """The stream writer of the registration flow; the caller sets the trigger and starts it.

    Each micro-batch runs the batch operators.  Its enriched rows feed three
    outputs and are kept for the time of the batch.  The index comes from a
    callable, so reference data may be refreshed between batches.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        enriched = devices.enrich(batch, index()).persist()
        try:
            profiles.write(devices.newest_fields(devices.profile_updates(enriched)), batch_id)
            events(devices.device_events(enriched), batch_id)
            outcomes.write(devices.outcomes(enriched), batch_id)
        finally:
            enriched.unpersist()

    return registrations.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)


def locate_by_version(
    registrations: DataFrame, reloading: Reloading[GeoIndex], located: BatchTable, checkpoint: str
) -> DataStreamWriter:
    """Writes each batch's registrations with the place that the ranges of their time give.

    The loads that are due by the newest registration of a batch are made
    first.  A row takes the newest version loaded at or before its own time,
    whichever batch it comes in, so a late row and a repeated batch are
    answered alike while their version is kept.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            newest = rows.agg(F.max("ts")).first()[0] or datetime.datetime(1970, 1, 1)
            known = reloading.up_to(rows.sparkSession, newest)
            located.write(by_version(rows, reloading.versions, known, "ts", devices.enrich), batch_id)
        finally:
            rows.unpersist()

    return registrations.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
