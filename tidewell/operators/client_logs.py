"""Client logs: screening and append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.texts import is_blank
from tidewell.operators.validation import client_log_failure
from tidewell.sources.documents import parse_client_logs


def screen(requests: DataFrame, body: str = "body") -> DataFrame:
    """Adds the typed ``request``, ``accepted`` and the reject ``reason``."""
    parsed = parse_client_logs(requests, body)
    return parsed.withColumn("reason", client_log_failure(F.col("request"))).withColumn(
        "accepted", F.col("reason").isNull()
    )


def screen_lines(lines: DataFrame, key: str) -> DataFrame:
    """The same rules for log lines stored flat, one request per key: ``lines`` and the reject ``reason``.

    Only what the rules need is aggregated, so a key with very many lines is
    never gathered in one row.  Flat lines carry ``did, pdata_id, pid, ver, ts,
    log``; the context fields are those of the request and repeat.
    """
    bad = is_blank(F.col("log")) | (F.coalesce(F.col("ts"), F.lit(0)) == 0)
    facts = lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("lines"),
        *[F.max(name).alias(name) for name in ("did", "pdata_id", "pid", "ver")],
        F.bool_or(bad).alias("bad"),
    )
    one_log = F.struct(F.when(F.col("bad"), "").otherwise("-").alias("log"), F.lit(1).cast("bigint").alias("ts"))
    request = F.struct(
        F.struct("did").alias("context"),
        F.struct(F.col("pdata_id").alias("id"), "pid", "ver").alias("pdata"),
        F.array(one_log).alias("logs"),
    )
    return facts.withColumn("request", request).select(key, "lines", client_log_failure(F.col("request")).alias("reason"))


def accepted_lines(screened: DataFrame) -> DataFrame:
    """Accepted requests as JSON text, absent values left out."""
    return screened.filter("accepted").select(F.to_json("request").alias("value"))


def append(screened: DataFrame, path: str) -> None:
    """Appends the accepted requests as JSON lines."""
    accepted_lines(screened).write.mode("append").text(path)
