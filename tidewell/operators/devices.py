"""Device registrations: enrichment, events, latest profile, profile reads and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import network, texts
from tidewell.operators.geo import GeoIndex, locate

# Names of the stored profile fields, request fields first.
REQUEST_FIELDS = ["devicespec", "uaspec", "fcm_token", "producer", "user_declared_state", "user_declared_district"]
PLACE_FIELDS = [
    "geoname_id",
    "continent_name",
    "country_code",
    "country_name",
    "state_code",
    "state",
    "city",
    "state_custom",
    "state_code_custom",
    "district_custom",
]
PROFILE_FIELDS = REQUEST_FIELDS + PLACE_FIELDS

# Counter names of the published metrics event.
METRICS_JOB = "DeviceRegisterAPI"
METRICS_VERSION = "v1"
COUNTERS = {
    "api_calls": "api-calls",
    "hit_count": "location-db-hit-count",
    "success_count": "location-db-success-count",
    "miss_count": "location-db-miss-count",
    "error_count": "location-db-error-count",
    "published_count": "log-device-register-success-count",
}


def enrich(registrations: DataFrame, index: GeoIndex, private_prefix: str = "192") -> DataFrame:
    """Adds the effective address, its status and its location to every registration.

    ``ip_status`` is ``ok``, ``invalid`` (not an address: counted as an error,
    neither stored nor published) or ``blank`` (skipped).
    """
    ip = network.effective_ip(F.col("header_ip"), F.col("ip_addr"), private_prefix)
    addressed = registrations.withColumn("effective_ip", ip).withColumn(
        "ip_int", network.ip_to_int(F.col("effective_ip"))
    )
    located = locate(addressed, index, spread=["did", "event_id"])
    return located.withColumn("ip_status", network.ip_status(F.col("effective_ip"), F.col("has_address")))


def accepted(enriched: DataFrame) -> DataFrame:
    return enriched.filter("has_address")


def device_events(enriched: DataFrame) -> DataFrame:
    """One JSON event per accepted registration; absent values are left out."""
    millis = F.unix_millis("ts")
    event = F.struct(
        F.col("did").alias("device_id"),
        "country_code",
        F.col("country_name").alias("country"),
        "state_code",
        "state",
        "city",
        "state_custom",
        "state_code_custom",
        "district_custom",
        texts.device_spec_json(F.col("dspec")).alias("device_spec"),
        texts.user_agent_json(F.col("uaspec")).alias("uaspec"),
        "fcm_token",
        F.col("producer").alias("producer_id"),
        millis.alias("api_last_updated_on"),
        millis.alias("first_access"),
        "user_declared_state",
        "user_declared_district",
    )
    return accepted(enriched).select("event_id", "did", "ts", F.to_json(event).alias("value"))


def profile_updates(enriched: DataFrame) -> DataFrame:
    """The 16 profile fields of each accepted registration, empty ones as null.

    The user agent is still the raw text here: it is parsed once per device,
    after the newest one is known.
    """
    fields = {
        "devicespec": texts.non_blank(F.col("dspec")),
        "uaspec": F.col("uaspec"),
        **{name: texts.non_blank(F.col(name)) for name in REQUEST_FIELDS[2:]},
        "geoname_id": F.col("geoname_id").cast("string"),
        **{name: texts.non_blank(F.col(name)) for name in PLACE_FIELDS[1:]},
    }
    return accepted(enriched).select("did", "ts", "event_id", *[value.alias(name) for name, value in fields.items()])


def newest_fields(
    updates: DataFrame, fields: Sequence[str] = PROFILE_FIELDS, order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """Newest value of each field per device as a stamp ``struct(order columns, value)``, null when it has none.

    The stamps are formed inside the aggregate, so only plain columns are
    sorted and combined on the map side, where a hot device shrinks to one row
    per task.
    """
    stamps = [
        F.max(F.when(F.col(name).isNotNull(), F.struct(*order, F.col(name).alias("value")))).alias(name)
        for name in fields
    ]
    return updates.groupBy("did").agg(*stamps)


def merge_stamped(rows: DataFrame, fields: Sequence[str] = PROFILE_FIELDS) -> DataFrame:
    """Newest stamp of each field per device.

    ``max`` over the stamps is associative: partial results of batches can be
    merged in any order, and late rows never overwrite newer fields.
    """
    return rows.groupBy("did").agg(*[F.max(name).alias(name) for name in fields])


def unstamped(state: DataFrame, fields: Sequence[str] = PROFILE_FIELDS) -> DataFrame:
    """The profile values without their stamps, the user agent parsed."""
    values = state.select("did", *[F.col(name)["value"].alias(name) for name in fields])
    return values.withColumn("uaspec", texts.user_agent_json(F.col("uaspec")))


def profile_state(enriched: DataFrame) -> DataFrame:
    """Latest non-empty value of every profile field per device."""
    return unstamped(newest_fields(profile_updates(enriched)))


def declared(profiles: DataFrame) -> DataFrame:
    """Declared location per device, null unless a state was declared."""
    has_state = ~texts.is_blank(F.col("user_declared_state"))
    return profiles.select(
        "did",
        F.when(has_state, F.col("user_declared_state")).alias("declared_state"),
        F.when(has_state, F.col("user_declared_district")).alias("declared_district"),
    )


def read_profiles(requests: DataFrame, profiles: DataFrame, index: GeoIndex) -> DataFrame:
    """Profile reads: stored declared location plus the location of the caller's address.

    Requests without an address or with one that is not an address have no
    answer and are left out.
    """
    addressed = requests.withColumn("ip_int", network.ip_to_int(F.col("header_ip")))
    located = locate(addressed, index, spread=["did"])
    return (
        accepted(located).select(*requests.columns, F.col("state_custom").alias("ip_state"), F.col("district_custom").alias("ip_district"))
        .join(declared(profiles), "did", "left")
    )


def outcomes(enriched: DataFrame) -> DataFrame:
    """What the counters need from a registration: its time and what happened."""
    return enriched.select("ts", "ip_status", "resolved")


def counter_columns() -> dict[str, Column]:
    """Additive counters over ``outcomes`` rows.

    Only an address that parses is looked up, so hits = successes + misses;
    what does not parse counts as an error.
    """
    ok = F.col("ip_status") == "ok"
    return {
        "api_calls": F.count(F.lit(1)),
        "hit_count": F.count_if(ok),
        "success_count": F.count_if(ok & F.col("resolved")),
        "miss_count": F.count_if(ok & ~F.col("resolved")),
        "error_count": F.count_if(F.col("ip_status") == "invalid"),
        "published_count": F.count_if(ok),
    }


def count_registrations(rows: DataFrame, interval: str = "30 minutes") -> DataFrame:
    """Counters per tumbling window; works on a batch and on a watermarked stream alike."""
    counters = [column.alias(name) for name, column in counter_columns().items()]
    return rows.groupBy(F.window("ts", interval)).agg(*counters)


def metrics_events(counted: DataFrame) -> DataFrame:
    """Counter rows as published JSON events, stamped with the end of their window."""
    event = F.struct(
        F.lit(METRICS_JOB).alias("job-name"),
        F.lit(METRICS_VERSION).alias("api-version"),
        F.unix_millis(F.col("window")["end"]).alias("timestamp"),
        *[F.col(name).alias(label) for name, label in COUNTERS.items()],
    )
    return counted.select(
        F.unix_millis(F.col("window")["start"]).alias("window_start_ms"), *COUNTERS, F.to_json(event).alias("value")
    )
