"""Who may read which data: consumer grants and user roles.

Every check is an equality join on a key of the request followed by a row
predicate, so no pair of unrelated requests and users is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.texts import is_blank, same_text
from tidewell.operators.upserts import one_per_key

# Roles used when a dataset declares none of its own.
STANDARD_ROLES = ["ORG_ADMIN", "REPORT_ADMIN"]
ON_DEMAND_ROLES = ["ORG_ADMIN", "REPORT_ADMIN", "COURSE_ADMIN"]

# Reasons of a refusal.
MISSING_CHANNEL = "X-Channel-ID is missing in request header"
NOT_AUTHORIZED = "You are not authorized."
NOT_GRANTED = "Given X-Consumer-ID='%s' and X-Channel-ID='%s' are not authorized"


def _ordered(table: DataFrame, *columns: str) -> DataFrame:
    """The named columns, with the load order if the table has one."""
    return table.select(*columns, *[c for c in ("loaded",) if c in table.columns])


def _not_granted(consumer: Column, channel: Column) -> Column:
    return F.format_string(NOT_GRANTED, F.coalesce(consumer, F.lit("")), channel)


def grants(requests: DataFrame, consumer_channels: DataFrame) -> DataFrame:
    """Adds ``granted``: the last row of the (consumer, channel) pair has status 1."""
    pairs = one_per_key(_ordered(consumer_channels, "consumer_id", "channel", "status"), ["consumer_id", "channel"])
    pairs = pairs.withColumnRenamed("status", "_status")
    joined = requests.join(pairs, ["consumer_id", "channel"], "left")
    return joined.withColumn("granted", F.coalesce(F.col("_status"), F.lit(0)) == 1).drop("_status")


def authorize(
    requests: DataFrame,
    consumer_channels: DataFrame,
    users: DataFrame,
    dataset_roles: DataFrame | None = None,
    default_roles: Sequence[str] = ON_DEMAND_ROLES,
    admin_channel: str | None = None,
) -> DataFrame:
    """Adds ``authorized`` and ``reason`` (null when authorized).

    Requests carry ``channel, consumer_id, user_id, has_token`` and, when
    ``dataset_roles`` is given, ``dataset_sub_id``.  Without a token the
    consumer grant decides.  With one the user needs a role in common and the
    channel must be the user's root organisation; with ``admin_channel`` the
    channel must be the organisation's slug, or the organisation's channel the
    admin channel.  Of repeated rows of a pair, user or dataset the last counts.
    """
    known = _ordered(users, "user_id", "roles", "root_org_id", "root_org_slug", "root_org_channel")
    roles_of = one_per_key(known, ["user_id"]).select(
        "user_id",
        F.col("roles").alias("_roles"),
        F.col("root_org_id").alias("_org"),
        F.col("root_org_slug").alias("_slug"),
        F.col("root_org_channel").alias("_org_channel"),
    )
    rows = grants(requests, consumer_channels).join(roles_of, "user_id", "left")
    fallback = F.array(*[F.lit(role) for role in default_roles])
    if dataset_roles is not None:
        wanted = one_per_key(_ordered(dataset_roles, "dataset_sub_id", "authorized_roles"), ["dataset_sub_id"])
        wanted = wanted.withColumnRenamed("authorized_roles", "_wanted")
        rows = rows.join(wanted, "dataset_sub_id", "left")
        allowed_roles = F.coalesce(F.col("_wanted"), fallback)
    else:
        allowed_roles = fallback
    if admin_channel is None:
        right_place = same_text(F.col("channel"), F.col("_org"))
    else:
        right_place = same_text(F.col("channel"), F.col("_slug")) | same_text(F.col("_org_channel"), F.lit(admin_channel))
    has_role = F.coalesce(F.arrays_overlap(F.col("_roles"), allowed_roles), F.lit(False))
    reason = (
        F.when(is_blank(F.col("channel")), MISSING_CHANNEL)
        .when(~F.col("has_token") & ~F.col("granted"), _not_granted(F.col("consumer_id"), F.col("channel")))
        .when(F.col("has_token") & ~(has_role & right_place), NOT_AUTHORIZED)
    )
    dropped = [c for c in rows.columns if c.startswith("_")]
    return rows.withColumn("reason", reason).withColumn("authorized", F.col("reason").isNull()).drop("granted", *dropped)


def authorized_only(requests: DataFrame, consumer_channels: DataFrame) -> DataFrame:
    """Requests whose consumer holds an active grant, as a semi join."""
    pairs = one_per_key(_ordered(consumer_channels, "consumer_id", "channel", "status"), ["consumer_id", "channel"])
    active = pairs.filter(F.col("status") == 1)
    return requests.join(active, ["consumer_id", "channel"], "left_semi")
