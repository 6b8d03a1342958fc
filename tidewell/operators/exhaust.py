"""Telemetry export and its job figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

FORMATS = ("json", "csv")


def export_condition(
    start_date: str,
    end_date: str,
    app_id: str | None = None,
    channel: str | None = None,
    events: list[str] | None = None,
    tags: list[str] | None = None,
    tag_list: bool = False,
) -> Column:
    """Whether a row belongs to an export: its day in [start_date, end_date] and the optional filters.

    Plain comparisons on ``event_day`` prune a table partitioned by it; the
    other filters are pushed into the scan.  ``tags`` works on a ``tag``
    column or, with ``tag_list``, on a ``tags`` array.
    """
    low, high = F.lit(date.fromisoformat(start_date)), F.lit(date.fromisoformat(end_date))
    condition = (F.col("event_day") >= low) & (F.col("event_day") <= high)
    if app_id is not None:
        condition &= F.col("pdata_id") == app_id
    if channel is not None:
        condition &= F.col("channel") == channel
    if events:
        condition &= F.col("eid").isin(events)
    if tags:
        wanted = F.array(*[F.lit(tag) for tag in tags])
        condition &= F.arrays_overlap(F.col("tags"), wanted) if tag_list else F.col("tag").isin(tags)
    return condition


def extract(telemetry: DataFrame, start_date: str, end_date: str, **filters) -> DataFrame:
    """Telemetry of the days in [start_date, end_date] that match the optional filters."""
    return telemetry.filter(export_condition(start_date, end_date, **filters, tag_list="tags" in telemetry.columns))


def write(rows: DataFrame, path: str, output_format: str = "json") -> None:
    """Writes an export by day, as JSON lines or CSV with a header."""
    if output_format not in FORMATS:
        raise ValueError(f"output format must be one of {FORMATS}")
    writer = rows.write.mode("overwrite").partitionBy("event_day")
    if output_format == "csv":
        writer = writer.option("header", "true")
    writer.format(output_format).save(path)


def write_observed(
    telemetry: DataFrame,
    exported: Column,
    path: str,
    columns: Sequence[str],
    groups: Mapping[str, Column],
    output_format: str = "json",
) -> dict[str, dict[str, int | None]]:
    """Writes an export and returns its figures per group, observed while it is written.

    The figures are those of ``job_figures`` for the rows that meet each
    group's condition; a handful of groups, such as the asked event names.  The
    telemetry is scanned once, for the export itself.
    """
    figures = Observation()
    metrics = []
    for i, condition in enumerate(groups.values()):
        moment = F.when(exported & condition, F.unix_millis("ts"))
        metrics += [
            F.count_if(condition).alias(f"input_events_{i}"),
            F.count_if(exported & condition).alias(f"output_events_{i}"),
            F.min(moment).alias(f"dt_first_event_{i}"),
            F.max(moment).alias(f"dt_last_event_{i}"),
        ]
    write(telemetry.observe(figures, *metrics).filter(exported).select(*columns, "event_day"), path, output_format)
    found = figures.get
    names = ("input_events", "output_events", "dt_first_event", "dt_last_event")
    return {group: {n: found[f"{n}_{i}"] for n in names} for i, group in enumerate(groups)}


def job_figures(telemetry: DataFrame, exported: Column, keys: list[str]) -> DataFrame:
    """Input events, and events and first and last time of the rows that meet ``exported``, per key.

    One pass over the telemetry; a null key is a key like any other, and
    without an exported row there is no first and last time.
    """
    moment = F.when(exported, F.col("ts"))
    return telemetry.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("input_events"),
        F.count_if(exported).alias("output_events"),
        F.unix_millis(F.min(moment)).alias("dt_first_event"),
        F.unix_millis(F.max(moment)).alias("dt_last_event"),
    )


def job_times(jobs: DataFrame) -> DataFrame:
    """Latency (submitted to picked up) and execution time (picked up to done) in seconds."""
    submitted, started, done = (
        F.unix_seconds(c) for c in ("dt_job_submitted", "dt_job_processing", "dt_job_completed")
    )
    return jobs.withColumns({"latency": started - submitted, "execution_time": done - started})
