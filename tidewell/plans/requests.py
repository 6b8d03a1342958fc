"""Registered queries about data requests and access."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import hashing, texts
from tidewell.operators import access, requests, validation
from tidewell.plans.views import view, with_views
from tidewell.session import work_folder
from tidewell.sources import documents, laid_out

SEARCH = {"dataset": "1-URGENT", "status": "SUCCESS", "channel": None}
SEARCH_DAY = {"requestedDate": "1995-02-18"}
ADMIN_CHANNEL = "sunrise"


def _jobs(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "job_requests")
    urls = F.when(F.col("download_url").isNotNull(), F.array("download_url"))
    return rows.withColumn("download_urls", urls).drop("download_url", "o_orderkey")


def _roles(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "dataset_role_rows").withColumn("authorized_roles", F.split("authorized_roles", ","))


def _users(spark, sf_dir) -> DataFrame:
    return documents.parse_users(view(spark, sf_dir, "user_documents"))


def request_id(spark, sf_dir):
    rows = view(spark, sf_dir, "new_requests")
    blank = F.lit("")
    key = hashing.request_id(
        F.coalesce("dataset", blank),
        F.coalesce("client_tag", blank),
        F.col("requested_by"),
        F.col("channel"),
        F.col("submission_date"),
        F.get_json_object("dataset_config", "$.type"),
    )
    return rows.select("seq", key.alias("request_id"))


def request_validate(spark, sf_dir):
    rows = view(spark, sf_dir, "new_requests")
    failure = validation.submit_failure(F.col("client_tag"), F.col("dataset"), F.col("dataset_config"))
    return rows.select("seq", failure.isNull().alias("valid"), failure.alias("message"))


_RULES: dict[tuple[str, str], DataFrame] = {}


def rule_index(spark, sf_dir) -> DataFrame:
    """The compiled schema rules of a table folder, loaded once per application like any reference table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RULES:
        folder = work_folder(spark, "schema-rules")
        compiled = validation.compile_rules(view(spark, sf_dir, "dataset_rule_rows"))
        compiled.write.parquet(folder)
        _RULES[key] = spark.read.schema(compiled.schema).parquet(folder)
    return _RULES[key]


def schema_rules(spark, sf_dir):
    rows = view(spark, sf_dir, "request_bodies").withColumnRenamed("dataset", "dataset_sub_id")
    checked = validation.check_submissions(rows, rule_index(spark, sf_dir))
    return checked.select("o_orderkey", "dataset_sub_id", "failure")


def request_submit(spark, sf_dir):
    merged = requests.merge_submissions(_jobs(spark, sf_dir), requests.resolve(view(spark, sf_dir, "new_requests")))
    return merged.select(
        "tag",
        "request_id",
        "job_id",
        "status",
        "request_data",
        "requested_by",
        "requested_channel",
        F.unix_millis("dt_job_submitted").alias("submitted_ms"),
        F.coalesce("iteration", F.lit(-1)).alias("iteration"),
        "action",
    )


def request_registry_upsert(spark, sf_dir):
    """The stored registry after the submissions: only touched partitions are joined, in place, and written again."""
    folder = work_folder(spark, "request-registry")
    table = laid_out.Registry(spark, f"requests_{uuid.uuid4().hex}", f"{folder}/requests", requests.KEY)
    table.create(_jobs(spark, sf_dir))
    incoming = requests.resolve(view(spark, sf_dir, "new_requests"))
    table.upsert(incoming, lambda jobs, submitted: requests.merge_submissions(jobs, submitted).drop("action"))
    return table.read().select(
        "tag",
        "request_id",
        "job_id",
        "status",
        "requested_by",
        "requested_channel",
        F.unix_millis("dt_job_submitted").alias("submitted_ms"),
        F.coalesce("iteration", F.lit(-1)).alias("iteration"),
    )


def _search_table(spark, sf_dir) -> DataFrame:
    """The job table laid out along the columns that it is searched by."""
    folder = work_folder(spark, "request-search")
    laid_out.write_for_search(_jobs(spark, sf_dir), folder, ["job_id", "requested_channel", "dt_job_submitted"], ["request_id"])
    return spark.read.parquet(folder)


def request_search_laid_out(spark, sf_dir):
    """Searches of three kinds over the laid-out table, under each other."""
    jobs, parts = _search_table(spark, sf_dir), []
    for kind, filters in (("dataset", SEARCH), ("day", SEARCH_DAY), ("channel", {"channel": "ch-7", "status": "FAILED"})):
        found = requests.search(jobs, filters, 20)
        parts.append(found.select(F.lit(kind).alias("kind"), "request_id", "tag", F.unix_millis("dt_job_submitted").alias("submitted_ms")))
    return functools.reduce(DataFrame.unionByName, parts)


def request_submit_answer(spark, sf_dir):
    incoming = view(spark, sf_dir, "new_requests")
    failure = validation.submit_failure(F.col("client_tag"), F.col("dataset"), F.col("dataset_config"))
    resolved = requests.resolve(
        incoming, failure.alias("failure"), "channel", "consumer_id", "user_id", "has_token"
    )
    checked = access.authorize(
        resolved, view(spark, sf_dir, "consumer_channel_rows"), _users(spark, sf_dir), _roles(spark, sf_dir)
    )
    jobs = requests.merge_submissions(_jobs(spark, sf_dir), checked.filter("failure is null and authorized"))
    states = jobs.filter("action <> 'kept'").select("tag", "request_id", "status", "action")
    accepted = F.col("failure").isNull() & F.col("authorized")
    joined = checked.join(states, ["tag", "request_id"], "left")
    return joined.select(
        "seq",
        F.when(F.col("failure").isNotNull(), "CLIENT_ERROR").when(~F.col("authorized"), "FORBIDDEN").otherwise("OK").alias(
            "response_code"
        ),
        F.coalesce("failure", "reason").alias("message"),
        F.when(accepted, F.col("request_id")).alias("request_id"),
        F.when(accepted, F.col("status")).alias("status"),
        F.when(accepted, F.col("action")).alias("action"),
    )


def _flat(answers: DataFrame) -> DataFrame:
    return answers.select(
        "request_id",
        "tag",
        "dataset",
        "status",
        "last_updated",
        "attempts",
        F.to_json("job_stats").alias("job_stats"),
        F.array_join("download_keys", ",").alias("download_keys"),
        "status_message",
    )


def request_status(spark, sf_dir):
    return _flat(requests.responses(_jobs(spark, sf_dir)))


def request_read(spark, sf_dir):
    wanted = requests.resolve(view(spark, sf_dir, "new_requests"))
    return _flat(requests.responses(requests.find(_jobs(spark, sf_dir), wanted)))


def request_read_answer(spark, sf_dir):
    """A read of every incoming request by its key, after the caller's access is checked."""
    rows = requests.resolve(
        view(spark, sf_dir, "new_requests"), "channel", "consumer_id", "user_id", "has_token"
    )
    checked = access.authorize(
        rows, view(spark, sf_dir, "consumer_channel_rows"), _users(spark, sf_dir), _roles(spark, sf_dir)
    )
    found = requests.read(_jobs(spark, sf_dir), checked)
    return found.select("seq", "response_code", "message", "status")


def object_key(spark, sf_dir):
    rows = view(spark, sf_dir, "job_requests").filter("download_url is not null")
    return rows.select("o_orderkey", texts.object_key(F.col("download_url")).alias("object_key"))


def request_list(spark, sf_dir):
    newest = requests.newest_per_tag(_jobs(spark, sf_dir))
    return newest.select("tag", "position", "request_id", "status", F.unix_millis("dt_job_submitted").alias("submitted_ms"))


def request_list_access(spark, sf_dir):
    """Listed requests with the access decision of the first grant holder of their channel."""
    newest = requests.newest_per_tag(_jobs(spark, sf_dir))
    asked = newest.select(
        "tag",
        "position",
        "request_id",
        F.col("requested_channel").alias("channel"),
        F.lit("consumer-1").alias("consumer_id"),
        F.col("requested_by").alias("user_id"),
        (F.col("position") % 2 == 0).alias("has_token"),
        F.coalesce(F.get_json_object("request_data", "$.type"), "job_id").alias("dataset_sub_id"),
    )
    checked = access.authorize(asked, view(spark, sf_dir, "consumer_channel_rows"), _users(spark, sf_dir), _roles(spark, sf_dir))
    return checked.select("tag", "position", "request_id", "authorized", "reason")


def request_search(spark, sf_dir):
    found = requests.search(_jobs(spark, sf_dir), SEARCH)
    return found.select("request_id", "tag", "status", F.unix_millis("dt_job_submitted").alias("submitted_ms"))


def request_search_day(spark, sf_dir):
    found = requests.search(_jobs(spark, sf_dir), SEARCH_DAY, 20)
    return found.select("request_id", "tag", "status", F.unix_millis("dt_job_submitted").alias("submitted_ms"))


def request_search_count(spark, sf_dir):
    return requests.search_count(_jobs(spark, sf_dir), SEARCH)


def search_filter_rules(spark, sf_dir):
    """Whether searches may be run, by the names of their filters."""
    rows = view(spark, sf_dir, "search_filters")
    return rows.select("o_orderkey", validation.search_filters_failure(F.col("filters")).alias("failure"))


def channel_authorize(spark, sf_dir):
    rows = view(spark, sf_dir, "access_requests")
    return access.grants(rows, view(spark, sf_dir, "consumer_channel_rows")).select(
        "o_orderkey", "consumer_id", "channel", "granted"
    )


def channel_authorized_requests(spark, sf_dir):
    rows = view(spark, sf_dir, "access_requests")
    return access.authorized_only(rows, view(spark, sf_dir, "consumer_channel_rows")).select("o_orderkey", "consumer_id", "channel")


def role_authorize(spark, sf_dir):
    checked = access.authorize(
        view(spark, sf_dir, "access_requests"),
        view(spark, sf_dir, "consumer_channel_rows"),
        _users(spark, sf_dir),
        _roles(spark, sf_dir),
    )
    return checked.select("o_orderkey", "authorized", "reason")


def role_authorize_admin(spark, sf_dir):
    checked = access.authorize(
        view(spark, sf_dir, "access_requests"),
        view(spark, sf_dir, "consumer_channel_rows"),
        _users(spark, sf_dir),
        default_roles=access.STANDARD_ROLES,
        admin_channel=ADMIN_CHANNEL,
    )
    return checked.select("o_orderkey", "authorized", "reason")


def admin_slug(spark, sf_dir):
    """Slug of the first organisation of a search result, empty where there is none."""
    rows = view(spark, sf_dir, "organisation_documents")
    return rows.select("user_id", documents.admin_slug(F.col("document")).alias("slug"))


QUERIES = {
    f.__name__: f
    for f in (
        request_id,
        request_validate,
        schema_rules,
        request_submit,
        request_registry_upsert,
        request_search_laid_out,
        request_submit_answer,
        request_status,
        request_read,
        request_read_answer,
        object_key,
        request_list,
        request_list_access,
        request_search,
        request_search_day,
        request_search_count,
        search_filter_rules,
        channel_authorize,
        channel_authorized_requests,
        role_authorize,
        role_authorize_admin,
        admin_slug,
    )
}

# -- SQL twins ---------------------------------------------------------------

_NEW_ID = """upper(md5(concat_ws('|',coalesce(dataset,''),coalesce(client_tag,''),requested_by,channel,
 cast(submission_date as varchar),dataset_config->>'$.type')))"""
_INVALID = """case when client_tag is null then 'tag is empty' when dataset is null then 'dataset is empty'
 when dataset_config is null then 'datasetConfig is empty' end"""
_NEW = f"""incoming AS (select *, concat(coalesce(client_tag,''),':',channel) tag, {_NEW_ID} request_id,
 coalesce(dataset_config->>'$.type',coalesce(dataset,'')) dataset_sub_id, {_INVALID} failure from new_requests)"""


def _merged(source: str) -> str:
    return f"""merged AS (select coalesce(j.tag,n.tag) tag, coalesce(j.request_id,n.request_id) request_id,
 case when j.tag is null then 'inserted' when n.tag is null then 'kept' when lower(j.status)='failed' then 'resubmitted' else 'unchanged' end action,
 case when j.tag is null or (n.tag is not null and lower(j.status)='failed') then 'SUBMITTED' else j.status end status,
 case when j.tag is null or (n.tag is not null and lower(j.status)='failed') then coalesce(n.dataset,'') else j.job_id end job_id,
 case when j.tag is null or (n.tag is not null and lower(j.status)='failed') then coalesce(n.dataset_config,'{{}}') else j.request_data end request_data,
 case when j.tag is null or (n.tag is not null and lower(j.status)='failed') then n.requested_by else j.requested_by end requested_by,
 case when j.tag is null or (n.tag is not null and lower(j.status)='failed') then n.channel else j.requested_channel end requested_channel,
 case when j.tag is null or (n.tag is not null and lower(j.status)='failed') then cast(n.submission_date as timestamp) else j.dt_job_submitted end dt_job_submitted,
 case when j.tag is null or (n.tag is not null and lower(j.status)='failed') then coalesce(j.iteration,0) else coalesce(j.iteration,-1) end iteration
 from job_requests j full outer join (select * from (select *, row_number() over (partition by tag, request_id order by seq) rn
  from {source}) where rn=1) n on j.tag=n.tag and j.request_id=n.request_id)"""


_ANSWER = """answers AS (select request_id, tag, job_id dataset, status,
 coalesce(epoch_us(dt_job_completed),epoch_us(dt_job_submitted))//1000 last_updated, coalesce(iteration,0) attempts,
 concat('{"dtJobSubmitted":',epoch_us(dt_job_submitted)//1000,
  case when status in ('SUCCESS','FAILED') and dt_job_completed is not null then concat(',"dtJobCompleted":',epoch_us(dt_job_completed)//1000) else '' end,
  case when status in ('SUCCESS','FAILED') and execution_time is not null then concat(',"executionTime":',execution_time) else '' end,'}') job_stats,
 case when status in ('SUCCESS','FAILED') and download_url is not null then
  case when contains(download_url,'http') then regexp_replace(download_url,'^([^/]*/){4}','') else regexp_replace(download_url,'^([^/]*/){3}','') end
  else '' end download_keys, err_message status_message from job_requests)"""

# The role and place rules as plain row conditions over the flattened user view.
_ROLES_OVERLAP = "list_has_any(string_split(u.roles,','), {wanted})"


def _decided(source: str, columns: str, wanted: str, place: str) -> str:
    overlap = _ROLES_OVERLAP.format(wanted=wanted)
    return f"""decided AS (select {columns}, case when a.channel='' then 'X-Channel-ID is missing in request header'
 when not a.has_token and coalesce(c.status,0)<>1 then concat('Given X-Consumer-ID=''',a.consumer_id,''' and X-Channel-ID=''',a.channel,''' are not authorized')
 when a.has_token and not coalesce({overlap} and ({place}),false) then 'You are not authorized.' end reason
 from {source} a left join consumer_channels c on a.consumer_id=c.consumer_id and a.channel=c.channel
 left join users u on a.user_id=u.user_id left join dataset_roles d on a.dataset_sub_id=d.dataset_sub_id)"""


_WANTED = "coalesce(string_split(d.authorized_roles,','),['ORG_ADMIN','REPORT_ADMIN','COURSE_ADMIN'])"
_OWN = "lower(a.channel)=lower(u.root_org_id)"
_LISTED = """listed AS (select * from (select *, row_number() over (partition by tag order by dt_job_submitted desc, request_id) position
 from job_requests) where position<=100)"""

ORACLES = {
    "admin_slug": f"""{with_views("users")} select user_id, case when roles='PUBLIC' then '' else root_org_slug end slug from users""",
    "request_id": f"{with_views('new_requests')}, {_NEW} select seq, request_id from incoming",
    "request_validate": f"{with_views('new_requests')}, {_NEW} select seq, failure is null valid, failure message from incoming",
    "schema_rules": f"""{with_views("request_bodies", "dataset_rules")},
facts AS (select o_orderkey, b.dataset, r.validation_json is not null has_schema, b.dataset='1-URGENT' urgent, body,
 json_extract(body,'$.tag') is null no_tag, json_extract(body,'$.dataset') is null no_dataset,
 json_type(body,'$.tag') tag_type, json_type(body,'$.datasetConfig') config_type
 from request_bodies b left join dataset_rules r on b.dataset=r.dataset_sub_id)
select o_orderkey, dataset dataset_sub_id, case
 when not has_schema and no_tag then 'tag is empty' when not has_schema and no_dataset then 'dataset is empty'
 when not has_schema then null
 when urgent and no_tag and no_dataset then 'Request object has missing required properties (["tag","dataset"])'
 when urgent and no_tag then 'Request object has missing required properties (["tag"])'
 when no_dataset then 'Request object has missing required properties (["dataset"])'
 when urgent and tag_type in ('UBIGINT','BIGINT') then 'Request instance type (integer) does not match any allowed primitive type (allowed: ["string","null"])'
 when config_type='ARRAY' then 'Request instance type (array) does not match any allowed primitive type (allowed: ["object"])'
 when urgent and json_extract(body,'$.datasetConfig.a') is null then 'Request object has missing required properties (["a"])'
 end failure from facts""",
    "request_submit": f"""{with_views("new_requests", "job_requests")}, {_NEW}, {_merged("incoming")}
select tag, request_id, job_id, status, request_data, requested_by, requested_channel,
 epoch_us(dt_job_submitted)//1000 submitted_ms, iteration, action from merged""",
    "request_registry_upsert": f"""{with_views("new_requests", "job_requests")}, {_NEW}, {_merged("incoming")}
select tag, request_id, job_id, status, requested_by, requested_channel, epoch_us(dt_job_submitted)//1000 submitted_ms, iteration from merged""",
    "request_search_laid_out": f"""{with_views("job_requests")}, jobs AS (select *, epoch_us(dt_job_submitted)//1000 submitted_ms from job_requests)
select * from (select 'dataset' kind, request_id, tag, submitted_ms from jobs where job_id='1-URGENT' and status='SUCCESS'
 order by dt_job_submitted desc, request_id limit 20)
union all select * from (select 'day', request_id, tag, submitted_ms from jobs where cast(dt_job_submitted as date)=cast('1995-02-18' as date)
 order by dt_job_submitted desc, request_id limit 20)
union all select * from (select 'channel', request_id, tag, submitted_ms from jobs where requested_channel='ch-7' and status='FAILED'
 order by dt_job_submitted desc, request_id limit 20)""",
    "request_submit_answer": f"""{with_views("new_requests", "job_requests", "consumer_channels", "users", "dataset_roles")}, {_NEW},
{_decided("incoming", "a.*", _WANTED, _OWN)},
allowed AS (select * from decided where failure is null and reason is null), {_merged("allowed")}
select d.seq, case when failure is not null then 'CLIENT_ERROR' when reason is not null then 'FORBIDDEN' else 'OK' end response_code,
 coalesce(failure,reason) message, case when failure is null and reason is null then d.request_id end request_id,
 case when failure is null and reason is null then m.status end status,
 case when failure is null and reason is null then m.action end action
from decided d left join merged m on d.tag=m.tag and d.request_id=m.request_id and m.action<>'kept'""",
    "request_status": f"{with_views('job_requests')}, {_ANSWER} select * from answers",
    "request_read": f"""{with_views("job_requests", "new_requests")}, {_NEW}, {_ANSWER}
select * from answers a where exists (select 1 from incoming i where i.tag=a.tag and i.request_id=a.request_id)""",
    "request_read_answer": f"""{with_views("new_requests", "job_requests", "consumer_channels", "users", "dataset_roles")}, {_NEW},
{_decided("incoming", "a.*", _WANTED, _OWN)}
select d.seq, case when reason is null then 'OK' else 'FORBIDDEN' end response_code,
 coalesce(reason, case when j.tag is null then 'no job available with the given request_id and tag' end) message,
 case when reason is null then j.status end status
from decided d left join job_requests j on d.tag=j.tag and d.request_id=j.request_id""",
    "object_key": f"""{with_views("job_requests")} select o_orderkey, concat('',case when contains(download_url,'http')
 then regexp_replace(download_url,'^https://h.example/reports/','') else regexp_replace(download_url,'^wasb://reports@acc.example/','') end) object_key
 from job_requests where download_url is not null""",
    "request_list": f"""{with_views("job_requests")}, {_LISTED}
select tag, cast(position as integer) position, request_id, status, epoch_us(dt_job_submitted)//1000 submitted_ms from listed""",
    "request_list_access": f"""{with_views("job_requests", "consumer_channels", "users", "dataset_roles")}, {_LISTED},
asked AS (select tag, position, request_id, requested_channel channel, 'consumer-1' consumer_id, requested_by user_id,
 mod(position,2)=0 has_token, coalesce(request_data->>'$.type',job_id) dataset_sub_id from listed),
{_decided("asked", "a.tag, a.position, a.request_id", _WANTED, _OWN)}
select tag, cast(position as integer) position, request_id, reason is null authorized, reason from decided""",
    "request_search": f"""{with_views("job_requests")}
select request_id, tag, status, epoch_us(dt_job_submitted)//1000 submitted_ms from job_requests
where job_id='1-URGENT' and status='SUCCESS' order by dt_job_submitted desc, request_id limit 10""",
    "request_search_day": f"""{with_views("job_requests")}
select request_id, tag, status, epoch_us(dt_job_submitted)//1000 submitted_ms from job_requests
where cast(dt_job_submitted as date)=cast('1995-02-18' as date) order by dt_job_submitted desc, request_id limit 20""",
    "request_search_count": f"""{with_views("job_requests")}
select count(*) total from job_requests where job_id='1-URGENT' and status='SUCCESS'""",
    "search_filter_rules": f"""{with_views("search_filters")}
select o_orderkey, case when filters is null or filters='{{}}' then 'Filters are empty'
 when not regexp_matches(filters,'"(dataset|requestedDate|status|channel)":') then 'Unsupported filters' end failure from search_filters""",
    "channel_authorize": f"""{with_views("access_requests", "consumer_channels")}
select o_orderkey, a.consumer_id, a.channel, coalesce(status,0)=1 granted from access_requests a
left join consumer_channels c on a.consumer_id=c.consumer_id and a.channel=c.channel""",
    "channel_authorized_requests": f"""{with_views("access_requests", "consumer_channels")}
select o_orderkey, consumer_id, channel from access_requests a where exists (select 1 from consumer_channels c
where a.consumer_id=c.consumer_id and a.channel=c.channel and c.status=1)""",
    "role_authorize": f"""{with_views("access_requests", "consumer_channels", "users", "dataset_roles")},
{_decided("access_requests", "a.o_orderkey", _WANTED, _OWN)} select o_orderkey, reason is null authorized, reason from decided""",
    "role_authorize_admin": f"""{with_views("access_requests", "consumer_channels", "users", "dataset_roles")},
{_decided("access_requests", "a.o_orderkey", "['ORG_ADMIN','REPORT_ADMIN']",
    "lower(a.channel)=lower(u.root_org_slug) or lower(u.root_org_channel)='sunrise'")}
select o_orderkey, reason is null authorized, reason from decided""",
}
