"""The report registry as a log of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.rules import with_status
from tidewell.operators.validation import report_complete, report_failures

# States and messages of the registry.
ACTIVE, INACTIVE = "ACTIVE", "INACTIVE"
ACTIVATED_MESSAGE = "REPORT SUCCESSFULLY ACTIVATED"
DEACTIVATED_MESSAGE = "REPORT DEACTIVATED"
EXISTS = "ReportId already Exists"
NO_REPORT_TO_UPDATE = "no report available with requested reportid"
NO_REPORT_TO_DEACTIVATE = "no report available with requested reportId"
DEACTIVATED = "Successfully DeActivated the Report"

CONTENT = ["description", "created_by", "report_schedule", "config"]


def _first_submits(changes: DataFrame) -> DataFrame:
    order = F.struct("ts", "seq")
    return changes.filter(F.col("action") == "submit").groupBy("report_id").agg(F.min(order).alias("born"))


def apply_changes(changes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Registry after all changes (``seq, ts, report_id, action`` and the content columns).

    A report exists from its first submit on; later submits are refused, and
    changes before it find nothing.  An update replaces the content and
    activates the report again, a deactivation only changes the state.  All of
    it is three stamps per report (first submit, last update, last
    deactivation), so one grouped aggregate with a map-side combine is enough.

    Submits and updates that lack something are not applied.

    ``existing``: a registry of the same columns, whose reports exist before
    every change.
    """
    changes = applicable(changes).filter("report_id is not null")
    stamp = F.struct("ts", "seq", *CONTENT)
    grouped = changes.groupBy("report_id").agg(
        F.min(F.when(F.col("action") == "submit", stamp)).alias("first"),
        F.max(F.when(F.col("action") == "update", stamp)).alias("updated"),
        F.max(F.when(F.col("action") == "deactivate", F.struct("ts", "seq"))).alias("ended"),
    )
    if existing is None:
        base = grouped.withColumn("old", F.lit(None).cast("struct<created_on:timestamp>"))
        old_content = {name: F.lit(None).cast("string") for name in CONTENT}
        old_status, old_message = F.lit(None).cast("string"), F.lit(None).cast("string")
        old_time = {n: F.lit(None).cast("timestamp") for n in ("created_on", "submitted_on", "updated_on")}
    else:
        kept = existing.select("report_id", F.struct(*[c for c in existing.columns if c != "report_id"]).alias("old"))
        base = grouped.join(kept, "report_id", "full_outer")
        old_content = {name: F.col(f"old.{name}") for name in CONTENT}
        old_status, old_message = F.col("old.status"), F.col("old.status_msg")
        old_time = {n: F.col(f"old.{n}") for n in ("created_on", "submitted_on", "updated_on")}

    is_old = F.col("old").isNotNull()
    born = F.struct(F.col("first.ts").alias("ts"), F.col("first.seq").alias("seq"))
    order = {n: F.struct(F.col(f"{n}.ts").alias("ts"), F.col(f"{n}.seq").alias("seq")) for n in ("updated", "ended")}
    seen = {n: F.col(n).isNotNull() & (is_old | (order[n] > born)) for n in order}
    ended_last = seen["ended"] & (~seen["updated"] | (order["ended"] > order["updated"]))
    untouched = is_old & ~seen["updated"]

    content = {
        n: F.when(seen["updated"], F.col(f"updated.{n}")).when(is_old, old_content[n]).otherwise(F.col(f"first.{n}"))
        for n in CONTENT
    }
    created = F.when(is_old, old_time["created_on"]).otherwise(F.col("first.ts"))
    submitted = F.when(is_old, old_time["submitted_on"]).otherwise(F.col("first.ts"))
    changed = (
        F.when(ended_last, F.col("ended.ts"))
        .when(seen["updated"], F.col("updated.ts"))
        .when(is_old, old_time["updated_on"])
        .otherwise(F.col("first.ts"))
    )
    status = F.when(ended_last, INACTIVE).when(untouched, old_status).otherwise(ACTIVE)
    message = F.when(ended_last, DEACTIVATED_MESSAGE).when(untouched, old_message).otherwise(ACTIVATED_MESSAGE)
    return base.filter(is_old | F.col("first").isNotNull()).select(
        "report_id",
        *[value.alias(name) for name, value in content.items()],
        created.alias("created_on"),
        submitted.alias("submitted_on"),
        changed.alias("updated_on"),
        status.alias("status"),
        message.alias("status_msg"),
    )


def change_answers(changes: DataFrame) -> DataFrame:
    """What each change was answered: ``accepted`` and ``message``."""
    checked = valid_changes(changes)
    joined = checked.join(_first_submits(applicable(changes)), "report_id", "left")
    order = F.struct("ts", "seq")
    exists = F.col("born").isNotNull() & (order > F.col("born"))
    message = (
        F.when(F.col("problems").isNotNull(), F.col("problems"))
        .when((F.col("action") == "submit") & exists, EXISTS)
        .when((F.col("action") == "update") & ~exists, NO_REPORT_TO_UPDATE)
        .when((F.col("action") == "deactivate") & ~exists, NO_REPORT_TO_DEACTIVATE)
        .when(F.col("action") == "deactivate", DEACTIVATED)
    )
    accepted = F.col("problems").isNull() & F.when(F.col("action") == "submit", ~exists).otherwise(exists)
    return joined.select("seq", "report_id", "action", accepted.alias("accepted"), message.alias("message"))


def read_reports(registry: DataFrame, asked: DataFrame) -> DataFrame:
    """Reports by id: every row of ``asked`` with ``response_code``, ``message`` and the report, null when there is none."""
    times = ("created_on", "submitted_on", "updated_on")
    columns = [F.unix_millis(n).alias(n) if n in times else F.col(n) for n in registry.columns]
    known = registry.select("report_id", F.to_json(F.struct(*columns)).alias("report"))
    joined = asked.join(known, "report_id", "left")
    message = F.when(F.col("report").isNull(), NO_REPORT_TO_UPDATE)
    return joined.select(*asked.columns, F.lit("OK").alias("response_code"), message.alias("message"), "report")


def _carried() -> list:
    return [F.col(c) for c in ("report_id", "description", "created_by", "config")]


def applicable(changes: DataFrame) -> DataFrame:
    """The changes that lack nothing: complete submits and updates, and all others, which carry no content."""
    carries = F.coalesce(F.col("action").isin("submit", "update"), F.lit(False))
    return changes.filter(~carries | report_complete(*_carried()))


def valid_changes(changes: DataFrame) -> DataFrame:
    """Adds ``problems``, JSON of what a submit or an update lacks, null when nothing; other actions carry no content."""
    lacking = F.col("action").isin("submit", "update") & ~report_complete(*_carried())
    return changes.withColumn("problems", F.when(lacking, F.to_json(with_status(report_failures(*_carried())))))


def list_reports(registry: DataFrame, filters: dict) -> DataFrame:
    """Reports with one of the given states, each as one JSON document."""
    if "status" not in filters:
        raise ValueError("a status filter is required")
    statuses: Sequence[str] = filters["status"]
    times = ("created_on", "submitted_on", "updated_on")
    columns = [F.unix_millis(n).alias(n) if n in times else F.col(n) for n in registry.columns]
    return (
        registry.filter(F.col("status").isin(list(statuses)))
        .select("report_id", "status", F.to_json(F.struct(*columns)).alias("report"))
    )
