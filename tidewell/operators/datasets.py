"""Dataset files by day, and the dataset registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates, texts
from tidewell.operators import validation
from tidewell.operators.rules import first_failure
from tidewell.operators.upserts import latest_by_key, upsert

# Messages of the file requests.
NO_FILES = "Files are not available for requested date. Might not yet generated. Please come back later"
UNKNOWN_DATASET = "Provided dataset is invalid. Please use any one from this list - [{}]"
UNKNOWN_INTERVAL = "Provided dateRange %s is not valid. Please use any one from this list - List({})"

DATASET_KEY = ["dataset_id", "dataset_sub_id"]


# -- files --------------------------------------------------------------------


def manifest(files: DataFrame) -> DataFrame:
    """File paths split into folder (with its slash) and day."""
    return files.select(
        "path",
        F.regexp_extract("path", "^(.*/)", 1).alias("folder"),
        texts.file_day(F.col("path")).alias("period"),
    )


def _prefix(dataset: Column, prefixes: Mapping[str, str]) -> Column:
    """Base folder of a dataset, the ``default`` entry for the ones not configured."""
    chain: Column = F.lit(prefixes["default"])
    for name, prefix in prefixes.items():
        if name != "default":
            chain = F.when(dataset == name, prefix).otherwise(chain)
    return chain


def channel_windows(requests: DataFrame, as_of: Column, prefixes: Mapping[str, str]) -> DataFrame:
    """Requests for a channel's files with resolved window, folder and failure.

    ``since`` beats ``from``, which defaults to yesterday; ``to`` defaults to
    today.
    """
    start = F.coalesce("since_day", "from_day", dates.day_text(F.date_sub(as_of, 1)))
    end = F.coalesce(F.col("to_day"), dates.day_text(as_of))
    folder = F.concat(_prefix(F.col("dataset_id"), prefixes), F.col("dataset_id"), F.lit("/"), F.col("channel"), F.lit("/"))
    resolved = requests.withColumns({"start": start, "end": end, "folder": folder})
    failure = validation.window_failure(F.col("start"), F.col("end"), as_of, F.lit(False))
    return resolved.withColumn("failure", failure)


def public_windows(
    requests: DataFrame, as_of: Column, prefixes: Mapping[str, str], datasets: Sequence[str], moment: Column | None = None
) -> DataFrame:
    """Requests for public files: a named interval beats a single day, which beats from / to.

    ``since`` still replaces the start.  Only the listed datasets are public.
    ``moment`` is the time from which intervals count, midnight of ``as_of``
    by default.
    """
    now = moment if moment is not None else as_of.cast("timestamp")
    first, last = dates.interval_range(F.col("date_range"), now)
    named = requests.withColumns({"_first": first, "_last": last})
    chosen = F.col("date_range").isNotNull()
    start = F.coalesce(
        F.col("since_day"),
        F.when(chosen, F.col("_first")).otherwise(F.coalesce("on_day", "from_day")),
        dates.day_text(F.date_sub(as_of, 1)),
    )
    end = F.coalesce(
        F.when(chosen, F.col("_last")).otherwise(F.coalesce("on_day", "to_day")), dates.day_text(as_of)
    )
    folder = F.concat(_prefix(F.col("dataset_id"), prefixes), F.col("dataset_id"), F.lit("/"))
    resolved = named.withColumns({"start": start, "end": end, "folder": folder})
    unknown_dataset = UNKNOWN_DATASET.format(", ".join(datasets))
    unknown_interval = F.format_string(UNKNOWN_INTERVAL.format(", ".join(dates.INTERVAL_NAMES)), F.col("date_range"))
    failure = first_failure(
        [
            (~F.col("dataset_id").isin(list(datasets)), unknown_dataset),
            (chosen & (F.col("_first") == ""), unknown_interval),
        ]
    )
    window = validation.window_failure(F.col("start"), F.col("end"), as_of, F.lit(True))
    return resolved.withColumn("failure", F.coalesce(failure, window)).drop("_first", "_last")


WINDOW = ["folder", "start", "end"]


def window_files(windows: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, start, end, period, path) of the files in each distinct valid window.

    Requests that ask for the same days of a folder point to one window, so
    that its files are listed once.  A valid window has at most 31 days; it is
    spread to one row per day and joined on (folder, day), an equality join
    instead of a date range.
    """
    as_date = lambda c: F.to_date(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")))
    distinct = windows.filter("failure is null").select(*WINDOW).distinct()
    wanted = distinct.select(*WINDOW, F.explode(F.sequence(as_date("start"), as_date("end"))).alias("_day"))
    wanted = wanted.select(*WINDOW, dates.day_text(F.col("_day")).alias("period"))
    return wanted.join(manifest(files), ["folder", "period"]).select(*WINDOW, "period", "path")


def period_counts(listed: DataFrame) -> DataFrame:
    """Files per window and day: the day-wise grouping, without holding a day's files in one row."""
    return listed.groupBy(*WINDOW, "period").agg(F.count(F.lit(1)).alias("files"))


def file_periods(files: DataFrame) -> DataFrame:
    """Files per folder and day over the whole manifest, undated ones under ``default``."""
    return manifest(files).groupBy("folder", "period").agg(F.count(F.lit(1)).alias("files"))


def window_answers(windows: DataFrame, listed: DataFrame, keys: Sequence[str], public: bool) -> DataFrame:
    """One row per request: status, message and number of files."""
    counts = listed.groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("files"))
    joined = windows.select(*keys, *WINDOW, "failure").join(counts, WINDOW, "left")
    valid = F.col("failure").isNull()
    files = F.when(valid, F.coalesce("files", F.lit(0).cast("bigint"))).otherwise(0)
    nothing = F.lit(NO_FILES) if public else F.lit(None).cast("string")
    return joined.select(
        *keys,
        F.when(F.col("failure").isNull(), "OK").otherwise("CLIENT_ERROR").alias("response_code"),
        F.coalesce("failure", F.when(files == 0, nothing)).alias("message"),
        files.alias("files"),
    )


# -- registry -----------------------------------------------------------------


def dataset_rows(requests: DataFrame, as_of: Column) -> DataFrame:
    """Valid add requests as registry rows: defaults for what is absent."""
    blank, no_map, no_list = F.lit(""), F.lit("{}"), F.array().cast("array<string>")
    given = set(requests.columns)

    def column(name: str, default: Column, kind: str = "string") -> Column:
        return F.coalesce(F.col(name), default) if name in given else default.cast(kind)

    failure = validation.dataset_failure(
        *[F.col(n) for n in ("dataset", "dataset_type", "version", "visibility", "authorized_roles", "available_from")]
    )
    return requests.filter(failure.isNull()).select(
        "seq",
        F.col("dataset").alias("dataset_id"),
        column("dataset_sub_id", F.col("dataset")).alias("dataset_sub_id"),
        column("dataset_config", no_map).alias("dataset_config"),
        "visibility",
        "dataset_type",
        "version",
        "authorized_roles",
        F.coalesce(F.try_to_timestamp("available_from", F.lit("yyyy-MM-dd")), as_of.cast("timestamp")).alias("available_from"),
        column("sample_request", blank).alias("sample_request"),
        column("sample_response", blank).alias("sample_response"),
        column("validation_json", no_map).alias("validation_json"),
        column("druid_query", no_map).alias("druid_query"),
        column("limits", no_map).alias("limits"),
        column("supported_formats", no_list, "array<string>").alias("supported_formats"),
        column("exhaust_type", blank).alias("exhaust_type"),
    )


def upsert_datasets(registry: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """The registry after the add requests; of several for one key the last wins."""
    rows = latest_by_key(dataset_rows(requests, as_of), DATASET_KEY, ["seq"]).drop("seq")
    return upsert(registry, rows.select(*registry.columns), DATASET_KEY)


def listing(registry: DataFrame) -> DataFrame:
    """Registry rows as they are listed: without roles, stored query and limits."""
    return registry.select(
        F.col("dataset_id").alias("dataset"),
        "dataset_sub_id",
        "dataset_type",
        "dataset_config",
        "visibility",
        "version",
        "sample_request",
        "sample_response",
        dates.day_text(F.col("available_from")).alias("available_from"),
        "validation_json",
        "supported_formats",
        "exhaust_type",
    )


def by_id(registry: DataFrame, keys: DataFrame, column: str = "dataset_id") -> DataFrame:
    """Registry rows whose id, or sub id, is among the keys."""
    return registry.join(keys.select(column), column, "left_semi")
