"""Registered queries that run streams over the tables until all input is read."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewell.operators import devices as ops
from tidewell.operators import geo
from tidewell.operators.devices import COUNTERS
from tidewell.plans import devices, experiments
from tidewell.plans.views import table, view, with_views
from tidewell.session import shuffle_partitions, work_folder
from tidewell.sources import tables
from tidewell.streaming import assignments, event_log, metrics, registrations
from tidewell.streaming.reference import Refreshed, Reloading, Versions
from tidewell.streaming.tables import BatchTable, ProfileStore

def run_to_end(writer: DataStreamWriter) -> None:
    """Reads all available input, then stops."""
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


BATCHES = 4


def _stream(spark: SparkSession, sf_dir: str, name: str, view_name: str) -> DataFrame:
    """A view over a table that is read as a stream of several batches.

    The table is first laid out in files that mix early and late rows, of
    which each batch takes a share, so that keys come back and rows come late.
    """
    folder = work_folder(spark, f"{name}-files")
    rows = table(spark, sf_dir, name)
    each = -(-shuffle_partitions(spark) // BATCHES)
    rows.repartition(each * BATCHES, *rows.columns[:1]).write.parquet(folder)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(each)).parquet(folder)
    alias = f"{name}_{uuid.uuid4().hex}"
    source.createOrReplaceTempView(alias)
    try:
        return view(spark, sf_dir, view_name, {name: alias})
    finally:
        spark.catalog.dropTempView(alias)


def _registered(spark: SparkSession, sf_dir: str) -> str:
    """Runs the registration stream and returns the folder of its outputs."""
    folder = work_folder(spark, "registrations")
    writer = registrations.register(
        _stream(spark, sf_dir, "events", "registrations"),
        Refreshed(lambda: devices.geo_index(spark, sf_dir)),
        ProfileStore(f"{folder}/profiles"),
        registrations.table_sink(f"{folder}/events"),
        BatchTable(f"{folder}/outcomes"),
        f"{folder}/checkpoint",
    )
    run_to_end(writer)
    return folder


def device_registration_stream(spark, sf_dir):
    """Profiles after the stream; equal to the batch profile state."""
    return ProfileStore(f"{_registered(spark, sf_dir)}/profiles").profiles(spark)


def device_event_stream(spark, sf_dir):
    """Events published by the stream; equal to the batch events."""
    events = BatchTable(f"{_registered(spark, sf_dir)}/events").read(spark)
    return events.select("event_id", "did", "value")


def device_event_log(spark, sf_dir):
    """Events published by a stream to a log that commits each epoch once; equal to the batch events."""
    folder = work_folder(spark, "event-log")
    enriched = ops.enrich(_stream(spark, sf_dir, "events", "registrations"), devices.geo_index(spark, sf_dir))
    events = ops.device_events(enriched).select("event_id", "did", "value")
    run_to_end(event_log.publish(events, f"{folder}/log", f"{folder}/checkpoint"))
    return event_log.read(spark, f"{folder}/log", "event_id bigint, did string, value string")


def _published(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Revisions of the windows after the metrics stream over the outcomes, and the windows still open."""
    folder = _registered(spark, sf_dir)
    schema = "ts timestamp, ip_status string, resolved boolean"
    each = str(max(1, shuffle_partitions(spark) // BATCHES))
    outcomes = spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/outcomes")
    pieces, revisions = BatchTable(f"{folder}/metrics"), BatchTable(f"{folder}/revisions")
    run_to_end(metrics.counted(outcomes, pieces).option("checkpointLocation", f"{folder}/metrics-checkpoint"))
    checkpoint = f"{folder}/publish-checkpoint"
    stream = metrics.counted_batches(spark, pieces)
    run_to_end(metrics.publish(stream, revisions).option("checkpointLocation", checkpoint))
    return revisions.read(spark).drop("batch"), metrics.open_windows(spark, checkpoint)


def registration_metrics_stream(spark, sf_dir):
    """Published revisions and the windows still open, summed per window; equal to the batch counters."""
    revisions, still_open = _published(spark, sf_dir)
    return metrics.totals(revisions.drop("revision").unionByName(still_open))


def published_windows_stream(spark, sf_dir):
    """The closed windows: sums over their revisions, and how many revisions came twice."""
    revisions, _ = _published(spark, sf_dir)
    twice = F.count(F.lit(1)) - F.count_distinct("revision")
    sums = [F.sum(name).alias(name) for name in COUNTERS]
    return revisions.groupBy(F.col("start_ms").alias("window_start_ms")).agg(*sums, twice.alias("repeated"))


RELOAD_SECONDS = 10 * 86400


def _version_ranges(spark: SparkSession, sf_dir: str, loaded_at: datetime.datetime) -> DataFrame:
    """The ranges that a load at a time finds."""
    rows = view(spark, sf_dir, "geo_range_versions").where(F.col("valid_from") <= F.lit(loaded_at))
    newest = rows.agg(F.max("valid_from")).first()[0]
    return tables.geo_ranges(rows.where(F.col("valid_from") == F.lit(newest)))


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations as a stream of several batches in about the order of time; some come one batch late."""
    folder = work_folder(spark, "arriving")
    rows = view(spark, sf_dir, "arrivals")
    each = shuffle_partitions(spark)
    for batch in range(BATCHES):
        rows.where(F.col("arrival") == batch).drop("arrival").repartition(each, "event_id").write.parquet(f"{folder}/part={batch}")
    schema = rows.drop("arrival").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(each)).parquet(f"{folder}/part=*")


def versioned_location_stream(spark, sf_dir):
    """Registrations located by the ranges of their time, while the ranges change and one reload fails."""
    folder = work_folder(spark, "versions")
    places = tables.locations(view(spark, sf_dir, "geo_city_rows"))
    loads: list[datetime.datetime] = []

    def build(slot: str, loaded_at: datetime.datetime) -> None:
        loads.append(loaded_at)
        if len(loads) == 3:
            raise OSError("the reference tables cannot be reached")
        geo.build_index(_version_ranges(spark, sf_dir, loaded_at), places, slot)

    reloading = Reloading(Versions(f"{folder}/ranges", build, geo.load_index), RELOAD_SECONDS)
    located = BatchTable(f"{folder}/located")
    writer = registrations.locate_by_version(_arriving(spark, sf_dir), reloading, located, f"{folder}/checkpoint")
    run_to_end(writer)
    columns = ["event_id", "ip_status", "in_range", "geoname_id", "state_custom"]
    return located.read(spark).select(*columns, F.date_format("loaded_at", "yyyy-MM-dd").alias("loaded"))


def experiment_assign_stream(spark, sf_dir):
    """Assignments of the stream with remembered lookups; equal to the batch ones, the index being fixed."""
    folder = work_folder(spark, "assignments")
    keyed, searched, answers = (BatchTable(f"{folder}/{name}") for name in ("keyed", "searched", "answers"))
    index = Refreshed(lambda: experiments.experiment_index(spark, sf_dir))
    lookups = _stream(spark, sf_dir, "events", "lookups")
    run_to_end(assignments.search_stream(lookups, index, keyed, searched, f"{folder}/search-checkpoint"))
    stream = assignments.searched_batches(spark, searched)
    run_to_end(assignments.answer_stream(stream, keyed, answers, f"{folder}/answer-checkpoint"))
    return answers.read(spark).select("lookup_id", "experiment_id", "assigned", "actions")


QUERIES = {
    f.__name__: f
    for f in (
        device_registration_stream,
        device_event_stream,
        device_event_log,
        registration_metrics_stream,
        published_windows_stream,
        versioned_location_stream,
        experiment_assign_stream,
    )
}

# A window closes half an hour after its end, by the newest registration less the second that the watermark stays behind.
_CLOSED = f"""{devices.ENRICHED},
counted AS (select time_bucket(interval '30 minutes', ts) w, count(*) api_calls, count(*) filter (where ip_status='ok') hit_count,
 count(*) filter (where ip_status='ok' and resolved) success_count, count(*) filter (where ip_status='ok' and not resolved) miss_count,
 count(*) filter (where ip_status='invalid') error_count, count(*) filter (where ip_status='ok') published_count
 from enriched group by 1)
select epoch_ms(w) window_start_ms, api_calls, hit_count, success_count, miss_count, error_count, published_count, 0 repeated
 from counted where epoch_ms(w)+3600000 <= (select epoch_ms(max(ts))-1000 from enriched)"""

# The third load, of 18 January, fails: the version of 8 January holds until the 28th.
_VERSIONED = f"""{with_views("registrations", "geo_range_versions", "geo_cities")},
timed AS (select *, {devices.EFFECTIVE} effective_ip,
 case when ts < timestamp '2024-01-08' then '2023-12-29' when ts < timestamp '2024-01-28' then '2024-01-08' else '2024-01-28' end loaded,
 case when ts < timestamp '2024-01-08' then timestamp '2023-12-29' when ts < timestamp '2024-01-28' then timestamp '2024-01-05'
  else timestamp '2024-01-25' end valid from registrations),
numbered AS (select *, {devices.ip_number("effective_ip")} ip_int,
 case when effective_ip='' then 'blank' when not {devices.IS_IP.format("effective_ip")} then 'invalid' else 'ok' end ip_status from timed),
hits AS (select ip_int, valid, geoname_id from (
 select ip_int, valid, geoname_id, row_number() over (partition by ip_int, valid order by
  network_last_integer-network_start_integer, network_start_integer, geoname_id) rn
 from (select distinct ip_int, valid from numbered where ip_int is not null) d
 join geo_range_versions on valid=valid_from and ip_int between network_start_integer and network_last_integer) where rn=1)
select event_id, ip_status, h.ip_int is not null in_range, coalesce(c.geoname_id,0) geoname_id,
 coalesce(subdivision_1_custom_name,'') state_custom, n.loaded
from numbered n left join hits h on n.ip_int=h.ip_int and n.valid=h.valid left join geo_cities c on h.geoname_id=c.geoname_id"""

ORACLES = {
    "device_registration_stream": devices.ORACLES["device_profile_state"],
    "device_event_stream": devices.ORACLES["device_event"],
    "device_event_log": devices.ORACLES["device_event"],
    "registration_metrics_stream": devices.ORACLES["registration_metrics"],
    "published_windows_stream": _CLOSED,
    "versioned_location_stream": _VERSIONED,
    "experiment_assign_stream": experiments.ORACLES["experiment_assign"],
}
