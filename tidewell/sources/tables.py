"""Readers of the stored tables.

A reader only names the table and the columns it needs; column pruning and
filter pushdown into parquet or JDBC are left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.upserts import one_per_key
from tidewell.schemas import TABLES

# Stored column -> column used by the operators.
LOCATION_NAMES = {
    "geoname_id": "geoname_id",
    "continent_name": "continent_name",
    "country_iso_code": "country_code",
    "country_name": "country_name",
    "subdivision_1_iso_code": "state_code",
    "subdivision_1_name": "state",
    "subdivision_2_name": "sub_div_2",
    "city_name": "city",
    "subdivision_1_custom_name": "state_custom",
    "subdivision_1_custom_code": "state_code_custom",
    "subdivision_2_custom_name": "district_custom",
}


def read_table(
    spark: SparkSession, name: str, location: str, fmt: str = "parquet", options: Mapping[str, str] | None = None
) -> DataFrame:
    """One stored table as parquet, ORC, CSV, JSON or through JDBC.

    For JDBC pass ``url`` and, to read in parallel, ``partitionColumn`` with
    its bounds as options; ``location`` is then the table name.
    """
    reader = spark.read.format(fmt).options(**dict(options or {}))
    if fmt == "jdbc":
        return reader.option("dbtable", location).load()
    return reader.schema(TABLES[name]).load(location)


def geo_ranges(table: DataFrame) -> DataFrame:
    return table.select("network_start_integer", "network_last_integer", "geoname_id")


def locations(table: DataFrame) -> DataFrame:
    loaded = [c for c in ("loaded",) if c in table.columns]
    return table.select(*[F.col(stored).alias(name) for stored, name in LOCATION_NAMES.items()], *loaded)


def geo_cities(table: DataFrame) -> DataFrame:
    loaded = [c for c in ("loaded",) if c in table.columns]
    named = table.select("geoname_id", "subdivision_1_name", "subdivision_2_custom_name", *loaded)
    return one_per_key(named, ["geoname_id"])


def consumer_channels(table: DataFrame) -> DataFrame:
    return table.select("consumer_id", "channel", "status")


def typed_reports(table: DataFrame) -> DataFrame:
    """Report rows with the three times as epoch milliseconds."""
    return table.select(
        "report_id",
        F.unix_millis("updated_on").alias("updated_on"),
        "report_description",
        "requested_by",
        "report_schedule",
        "config",
        F.unix_millis("created_on").alias("created_on"),
        F.unix_millis("submitted_on").alias("submitted_on"),
        "status",
        "status_msg",
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited JSON with a declared schema; lines without any value are dropped."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.dropna(how="all")
