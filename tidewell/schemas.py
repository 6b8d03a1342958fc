"""Schemas of the stored tables and of the JSON documents, as DDL text."""

from __future__ import annotations

GEO_RANGES = "network_start_integer bigint, network_last_integer bigint, geoname_id int"

GEO_LOCATIONS = (
    "geoname_id int, locale_code string, continent_code string, continent_name string, country_iso_code string, "
    "country_name string, subdivision_1_iso_code string, subdivision_1_name string, subdivision_2_iso_code string, "
    "subdivision_2_name string, city_name string, metro_code string, time_zone string, is_in_european_union smallint, "
    "subdivision_1_custom_code string, subdivision_1_custom_name string, subdivision_2_custom_code string, "
    "subdivision_2_custom_name string"
)

CONSUMER_CHANNELS = (
    "consumer_id string, channel string, status int, created_by string, created_on timestamp, updated_on timestamp"
)

REPORTS = (
    "report_id string, updated_on timestamp, report_description string, requested_by string, "
    "report_schedule string, config string, created_on timestamp, submitted_on timestamp, status string, "
    "status_msg string"
)

JOB_REQUESTS = (
    "tag string, request_id string, job_id string, status string, request_data string, requested_by string, "
    "requested_channel string, dt_job_submitted timestamp, download_urls array<string>, dt_file_created timestamp, "
    "dt_job_completed timestamp, execution_time bigint, err_message string, iteration int, encryption_key string"
)

EXPERIMENTS = (
    "exp_id string, created_by string, created_on timestamp, criteria string, exp_data string, "
    "exp_description string, exp_name string, stats string, status string, status_message string, "
    "updated_by string, updated_on timestamp"
)

DATASETS = (
    "dataset_id string, dataset_sub_id string, dataset_config string, visibility string, dataset_type string, "
    "version string, authorized_roles array<string>, available_from timestamp, sample_request string, "
    "sample_response string, validation_json string, druid_query string, limits string, "
    "supported_formats array<string>, exhaust_type string"
)

EXPERIMENT_DOCUMENTS = (
    "id string, name string, startDate string, endDate string, key string, expType string, userId string, "
    "deviceId string, url string, userIdMod bigint, deviceIdMod bigint"
)

REGISTRATION_BODY = (
    "struct<request: struct<ip_addr: string, fcmToken: string, producer: string, first_access: bigint, "
    "dspec: string, userDeclaredLocation: struct<state: string, district: string>, "
    "ext: struct<userid: string, url: string>>>"
)

CLIENT_LOG_BODY = (
    "struct<request: struct<"
    "context: struct<did: string, dspec: struct<os: string, make: string, mem: int, idisk: string, edisk: string, "
    "scrn: string, camera: string, cpu: string, sims: int, uaspec: struct<agent: string, ver: string, "
    "system: string, platform: string, raw: string>>, extras: map<string,string>>, "
    "pdata: struct<id: string, ver: string, pid: string>, "
    "logs: array<struct<id: string, ts: bigint, log: string, appver: string, pageid: string>>>>"
)

USER_DOCUMENT = (
    "struct<rootOrg: struct<id: string, slug: string, channel: string>, "
    "organisations: array<struct<roles: array<string>>>>"
)

ORG_SEARCH_DOCUMENT = "struct<content: array<struct<id: string, slug: string>>>"

TABLES = {
    "geo_location_city_ipv4": GEO_RANGES,
    "geo_location_city": GEO_LOCATIONS,
    "consumer_channel": CONSUMER_CHANNELS,
    "report_config": REPORTS,
    "job_request": JOB_REQUESTS,
    "experiment_definition": EXPERIMENTS,
    "dataset_metadata": DATASETS,
}
