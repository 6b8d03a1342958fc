"""JSON documents to columns: declared schemas, unknown keys ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import schemas


def experiment_documents(spark: SparkSession, path: str) -> DataFrame:
    """Experiment documents from JSON lines, without the ones that have no id."""
    return spark.read.schema(schemas.EXPERIMENT_DOCUMENTS).json(path).filter("id is not null")


def parse_registrations(requests: DataFrame, body: str = "body") -> DataFrame:
    """Registration bodies to columns; the device spec stays JSON text."""
    document = F.from_json(body, schemas.REGISTRATION_BODY)
    parsed = requests.withColumn("_request", document["request"])
    field = parsed["_request"]
    return parsed.select(
        *[parsed[name] for name in requests.columns if name != body],
        field["ip_addr"].alias("ip_addr"),
        field["fcmToken"].alias("fcm_token"),
        field["producer"].alias("producer"),
        field["first_access"].alias("first_access"),
        field["dspec"].alias("dspec"),
        field["userDeclaredLocation"]["state"].alias("user_declared_state"),
        field["userDeclaredLocation"]["district"].alias("user_declared_district"),
        field["ext"]["userid"].alias("user_id"),
        field["ext"]["url"].alias("url"),
    )


def parse_client_logs(requests: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``request``, the typed client-log request; malformed JSON gives null."""
    return requests.withColumn("request", F.from_json(body, schemas.CLIENT_LOG_BODY)["request"])


def parse_users(users: DataFrame, document: str = "document") -> DataFrame:
    """User documents to root organisation fields and one flat list of roles."""
    parsed = users.withColumn("_user", F.from_json(document, schemas.USER_DOCUMENT))
    root = parsed["_user"]["rootOrg"]
    blank = F.lit("")
    no_roles = F.array().cast("array<string>")
    roles = F.transform(
        F.coalesce(parsed["_user"]["organisations"], F.array().cast("array<struct<roles:array<string>>>")),
        lambda org: F.coalesce(org["roles"], no_roles),
    )
    return parsed.select(
        *[parsed[name] for name in users.columns if name != document],
        F.coalesce(root["id"], blank).alias("root_org_id"),
        F.coalesce(root["slug"], blank).alias("root_org_slug"),
        F.coalesce(root["channel"], blank).alias("root_org_channel"),
        F.flatten(roles).alias("roles"),
    )


def admin_slug(document: Column) -> Column:
    """Slug of the first organisation of a search result, empty when there is none."""
    content = F.from_json(document, schemas.ORG_SEARCH_DOCUMENT)["content"]
    return F.coalesce(F.try_element_at(content, F.lit(1))["slug"], F.lit(""))
