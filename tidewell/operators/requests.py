"""Data-export requests: submit, read, list, search."""

from __future__ import annotations

import functools
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import hashing, texts
from tidewell.operators.upserts import first_by_key
from tidewell.operators.validation import check_search_filters

# Request states and default limits.
SUBMITTED, FAILED = "SUBMITTED", "FAILED"
PROCESSED = ["SUCCESS", "FAILED"]
SEARCH_LIMIT = 10
NO_JOB = "no job available with the given request_id and tag"
LIST_LIMIT = 100

KEY = ["tag", "request_id"]


def resolve(requests: DataFrame, *carried: str | Column) -> DataFrame:
    """Submitted requests as job rows: defaults filled in, id computed.

    Takes ``seq, client_tag, dataset, requested_by, channel, dataset_config,
    submission_date``; ``encryption_key`` is optional.  ``carried`` columns are
    added as they are.
    """
    blank = F.lit("")
    kind = F.get_json_object("dataset_config", "$.type")
    tag = F.coalesce(F.col("client_tag"), blank)
    dataset = F.coalesce(F.col("dataset"), blank)
    requested_by = F.coalesce(F.col("requested_by"), blank)
    secret = F.col("encryption_key") if "encryption_key" in requests.columns else F.lit(None).cast("string")
    return requests.select(
        "seq",
        F.concat_ws(":", tag, F.col("channel")).alias("tag"),
        hashing.request_id(dataset, tag, requested_by, F.col("channel"), F.col("submission_date"), kind).alias(
            "request_id"
        ),
        dataset.alias("job_id"),
        F.coalesce(kind, dataset).alias("dataset_sub_id"),
        F.coalesce(F.col("dataset_config"), F.lit("{}")).alias("request_data"),
        requested_by.alias("requested_by"),
        F.col("channel").alias("requested_channel"),
        F.col("submission_date").cast("timestamp").alias("dt_job_submitted"),
        secret.alias("encryption_key"),
        *carried,
    )


def merge_submissions(jobs: DataFrame, submissions: DataFrame) -> DataFrame:
    """The job table after the submissions, with ``action`` per row.

    A new (tag, request_id) is inserted, a failed one is submitted again with
    its iteration kept, any other is left as it is.  Of several submissions of
    one key in a batch the first counts, since the rest find it submitted.
    """
    written = ["job_id", "request_data", "requested_by", "requested_channel", "dt_job_submitted", "encryption_key"]
    incoming = first_by_key(submissions.select(*KEY, "seq", *written), KEY, ["seq"]).select(
        *KEY, *[F.col(name).alias(f"new_{name}") for name in written], F.lit(True).alias("incoming")
    )
    joined = jobs.withColumn("stored", F.lit(True)).join(incoming, KEY, "full_outer")
    is_new = F.col("stored").isNull()
    again = F.col("incoming").isNotNull() & texts.same_text(F.col("status"), F.lit(FAILED))
    taken = is_new | again
    values: dict[str, Column] = {name: F.col(name) for name in jobs.columns}
    for name in written:
        if name in jobs.columns:
            values[name] = F.when(taken, F.col(f"new_{name}")).otherwise(F.col(name))
    values["status"] = F.when(taken, SUBMITTED).otherwise(F.col("status"))
    values["iteration"] = F.when(taken, F.coalesce(F.col("iteration"), F.lit(0))).otherwise(F.col("iteration"))
    action = (
        F.when(is_new, "inserted")
        .when(again, "resubmitted")
        .when(F.col("incoming").isNotNull(), "unchanged")
        .otherwise("kept")
    )
    return joined.select(*[value.alias(name) for name, value in values.items()], action.alias("action"))


def responses(jobs: DataFrame) -> DataFrame:
    """Job rows as they are answered to clients.

    Completion figures and download keys only once a job is processed; times
    are epoch milliseconds; no attempt yet counts as 0.
    """
    done = F.col("status").isin(PROCESSED)
    submitted = F.unix_millis("dt_job_submitted")
    completed = F.unix_millis("dt_job_completed")
    no_urls = F.array().cast("array<string>")
    stats = F.struct(
        submitted.alias("dtJobSubmitted"),
        F.when(done, completed).alias("dtJobCompleted"),
        F.when(done, F.col("execution_time")).alias("executionTime"),
    )
    keys = F.when(done, F.transform(F.coalesce("download_urls", no_urls), texts.object_key)).otherwise(no_urls)
    return jobs.select(
        F.col("request_id"),
        F.col("tag"),
        F.col("job_id").alias("dataset"),
        F.col("requested_by"),
        F.col("requested_channel"),
        F.col("status"),
        F.coalesce(completed, submitted).alias("last_updated"),
        F.col("request_data").alias("dataset_config"),
        F.coalesce(F.col("iteration"), F.lit(0)).alias("attempts"),
        stats.alias("job_stats"),
        keys.alias("download_keys"),
        F.col("err_message").alias("status_message"),
    )


def find(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """Job rows with the given (tag, request_id) keys."""
    return jobs.join(keys.select(*KEY), KEY, "left_semi")


def read(jobs: DataFrame, checked: DataFrame) -> DataFrame:
    """Requests by key for callers whose access was checked (``authorized``, ``reason``).

    Every row of ``checked`` with ``response_code``, ``message`` and the status
    of the request; a refused caller learns nothing about it.
    """
    known = jobs.select(*KEY, F.col("status").alias("found_status"))
    joined = checked.join(known, KEY, "left")
    allowed = F.col("authorized")
    return joined.select(
        *checked.columns,
        F.when(allowed, "OK").otherwise("FORBIDDEN").alias("response_code"),
        F.when(~allowed, F.col("reason")).when(F.col("found_status").isNull(), NO_JOB).alias("message"),
        F.when(allowed, F.col("found_status")).alias("status"),
    )


def newest_per_tag(jobs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest requests of every tag; ties by request_id.

    A rank filter on ``row_number`` is pushed below the shuffle, so each task
    sends at most ``limit`` rows per tag.
    """
    order = Window.partitionBy("tag").orderBy(F.col("dt_job_submitted").desc(), F.col("request_id"))
    return jobs.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def _day_filter(column: str, day: str | date) -> Column:
    first = day if isinstance(day, date) else datetime.strptime(day, "%Y-%m-%d").date()
    low, high = (F.lit(d.isoformat()).cast("timestamp") for d in (first, first + timedelta(days=1)))
    return (F.col(column) >= low) & (F.col(column) < high)


def search_condition(filters: dict) -> Column:
    """Conjunction of the given filters; null values are ignored.

    The day is a half-open range on the plain column, which file statistics
    can prune.
    """
    columns = {"dataset": "job_id", "status": "status", "channel": "requested_channel"}
    parts = [F.col(column) == filters[name] for name, column in columns.items() if filters.get(name) is not None]
    if filters.get("requestedDate") is not None:
        parts.append(_day_filter("dt_job_submitted", filters["requestedDate"]))
    return functools.reduce(lambda a, b: a & b, parts, F.lit(True))


def search(jobs: DataFrame, filters: dict, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The newest requests that match, as a top-k: no full sort."""
    check_search_filters(filters)
    return jobs.filter(search_condition(filters)).orderBy(F.col("dt_job_submitted").desc(), "request_id").limit(limit)


def search_count(jobs: DataFrame, filters: dict) -> DataFrame:
    """How many requests match, whatever the limit."""
    check_search_filters(filters)
    return jobs.filter(search_condition(filters)).agg(F.count(F.lit(1)).alias("total"))
