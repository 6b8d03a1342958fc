"""Registered queries about dataset and report registries and client logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import client_logs, datasets, reports, validation
from tidewell.operators.rules import with_status
from tidewell.plans.views import table, view, with_views
from tidewell.session import work_folder
from tidewell.sources import manifests, tables

AS_OF = "2024-01-15"


# -- datasets ------------------------------------------------------------------


def _registry(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "dataset_registry").withColumns(
        {
            "authorized_roles": F.split("authorized_roles", ","),
            "supported_formats": F.split("supported_formats", ","),
            "validation_json": F.lit("{}"),
            "exhaust_type": F.lit(""),
            "sample_response": F.lit(""),
        }
    )


def _adds(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "new_datasets").withColumns(
        {"authorized_roles": F.split("authorized_roles", ","), "supported_formats": F.split("supported_formats", ",")}
    )


def dataset_validate(spark, sf_dir):
    rows = _adds(spark, sf_dir)
    columns = [
        F.col(c) for c in ("dataset", "dataset_type", "version", "visibility", "authorized_roles", "available_from")
    ]
    return rows.select("seq", validation.dataset_failure(*columns).alias("failure"))


def _upserted(spark, sf_dir) -> DataFrame:
    return datasets.upsert_datasets(_registry(spark, sf_dir), _adds(spark, sf_dir), F.lit(AS_OF).cast("date"))


def dataset_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir).select(
        "dataset_id",
        "dataset_sub_id",
        "dataset_type",
        "dataset_config",
        "visibility",
        "version",
        F.array_join("authorized_roles", ",").alias("authorized_roles"),
        F.unix_millis("available_from").alias("available_ms"),
        "sample_request",
        F.array_join("supported_formats", ",").alias("supported_formats"),
    )


def dataset_list(spark, sf_dir):
    return datasets.listing(_registry(spark, sf_dir)).withColumn("supported_formats", F.array_join("supported_formats", ","))


def dataset_count(spark, sf_dir):
    return _upserted(spark, sf_dir).agg(F.count(F.lit(1)).alias("datasets"))


def dataset_by_id(spark, sf_dir):
    asked = _adds(spark, sf_dir).select(F.col("dataset").alias("dataset_id"))
    return datasets.by_id(_registry(spark, sf_dir), asked).select("dataset_id", "dataset_type", "version")


# -- reports -------------------------------------------------------------------


def report_validate(spark, sf_dir):
    rows = view(spark, sf_dir, "report_requests")
    failures = validation.report_failures(*[F.col(c) for c in ("report_id", "description", "created_by", "config")])
    return rows.select("seq", F.to_json(with_status(failures)).alias("errors"))


def _reports(spark, sf_dir) -> DataFrame:
    return reports.apply_changes(view(spark, sf_dir, "report_changes"))


def report_apply_changes(spark, sf_dir):
    return _reports(spark, sf_dir).select(
        "report_id",
        "description",
        "created_by",
        "report_schedule",
        "config",
        F.unix_millis("created_on").alias("created_ms"),
        F.unix_millis("updated_on").alias("updated_ms"),
        "status",
        "status_msg",
    )


def report_change_answer(spark, sf_dir):
    return reports.change_answers(view(spark, sf_dir, "report_changes"))


def report_read(spark, sf_dir):
    """Reads by id, of which some do not exist."""
    ids = F.concat(F.lit("r-"), (F.col("seq") % 300).cast("string"))
    asked = view(spark, sf_dir, "report_requests").select("seq", ids.alias("report_id"))
    found = reports.read_reports(_reports(spark, sf_dir), asked)
    status = F.get_json_object("report", "$.status").alias("status")
    return found.select("seq", "report_id", "response_code", "message", status)


def report_list(spark, sf_dir):
    return reports.list_reports(_reports(spark, sf_dir), {"status": ["ACTIVE"]})


def report_count(spark, sf_dir):
    return _reports(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("reports"))


# -- client logs ---------------------------------------------------------------


def _screened(spark, sf_dir) -> DataFrame:
    return client_logs.screen(view(spark, sf_dir, "client_log_bodies"))


def client_log_validate(spark, sf_dir):
    return _screened(spark, sf_dir).select("conv_id", "turn", "accepted", "reason")


def client_log_screen_lines(spark, sf_dir):
    """One request per conversation from its flat lines, screened as a whole."""
    lines = view(spark, sf_dir, "client_logs").withColumns({"pdata_id": F.lit("player"), "pid": F.lit("web")})
    return client_logs.screen_lines(lines, "conv_id")


def client_log_sink(spark, sf_dir):
    """Appends the accepted requests and reads the lines back with their schema."""
    folder = work_folder(spark, "client-logs")
    client_logs.append(_screened(spark, sf_dir), folder)
    stored = tables.json_lines(
        spark,
        folder,
        "context struct<did: string, extras: map<string,string>>, pdata struct<id: string, pid: string, ver: string>, "
        "logs array<struct<id: string, ts: bigint, log: string, pageid: string>>",
    )
    log = F.col("logs")[0]
    return stored.select(
        F.col("context.did").alias("did"),
        F.col("context.extras")["role"].alias("role"),
        F.col("pdata.ver").alias("ver"),
        log["ts"].alias("ts"),
        log["log"].alias("log"),
        log["pageid"].alias("pageid"),
    )


def report_rows(spark, sf_dir):
    """Registry rows as a stored report table, read with its times in milliseconds."""
    stored = _reports(spark, sf_dir).withColumnsRenamed({"description": "report_description", "created_by": "requested_by"})
    return tables.typed_reports(stored).drop("config", "report_schedule")


def stored_table_read(spark, sf_dir):
    """Consumer grants written as a stored table and read back with its declared types."""
    folder = work_folder(spark, "stored-table")
    rows = view(spark, sf_dir, "consumer_channels").select("consumer_id", "channel", "status")
    rows.write.mode("overwrite").orc(folder)
    return tables.consumer_channels(tables.read_table(spark, "consumer_channel", folder, "orc"))


def dataset_file_listing(spark, sf_dir):
    """Files of a folder that holds one of each event type."""
    folder = work_folder(spark, "listed-files")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    events.repartition("event_type").write.partitionBy("event_type").json(folder)
    found = manifests.list_files(spark, folder, "*.json")
    return found.select(F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("event_type"), (F.col("length") > 0).alias("filled"))


def json_lines_load(spark, sf_dir):
    """Registration bodies written as JSON lines and loaded again, lines without values dropped."""
    folder = work_folder(spark, "json-lines")
    bodies = view(spark, sf_dir, "registration_bodies")
    lines = bodies.select(F.when(F.col("event_id") % 10 == 3, F.lit("{}")).otherwise(F.col("body")).alias("value"))
    lines.write.mode("overwrite").text(folder)
    loaded = tables.json_lines(
        spark, folder, "id string, request struct<producer: string, fcmToken: string, first_access: bigint>"
    )
    return loaded.select(
        "id",
        F.col("request.producer").alias("producer"),
        F.col("request.fcmToken").alias("fcm_token"),
        F.col("request.first_access").alias("first_access"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        dataset_validate,
        dataset_upsert,
        dataset_list,
        dataset_count,
        dataset_by_id,
        report_validate,
        report_apply_changes,
        report_change_answer,
        report_read,
        report_list,
        report_count,
        client_log_validate,
        client_log_screen_lines,
        client_log_sink,
        report_rows,
        stored_table_read,
        dataset_file_listing,
        json_lines_load,
    )
}

# -- SQL twins ---------------------------------------------------------------

_BAD_ADD = """case when dataset is null then 'dataset is empty' when dataset_type is null then 'datasetType is empty'
 when version is null then 'version is empty' when visibility is null then 'visibility is empty'
 when authorized_roles is null then 'authorizedRoles is empty'
 when available_from is not null and try_cast(available_from as date) is null then 'availableFrom is not a date' end"""
_UPSERTED = f"""{with_views("new_datasets", "dataset_registry")},
adds AS (select * from (select *, coalesce(dataset_sub_id,dataset) sub_id,
  row_number() over (partition by dataset, coalesce(dataset_sub_id,dataset) order by seq desc) rn
  from new_datasets where {_BAD_ADD} is null) where rn=1),
upserted AS (select coalesce(n.dataset,r.dataset_id) dataset_id, coalesce(n.sub_id,r.dataset_sub_id) dataset_sub_id,
 case when n.seq is null then r.dataset_type else n.dataset_type end dataset_type,
 case when n.seq is null then r.dataset_config else coalesce(n.dataset_config,'{{}}') end dataset_config,
 case when n.seq is null then r.visibility else n.visibility end visibility, case when n.seq is null then r.version else n.version end as "version",
 case when n.seq is null then r.authorized_roles else n.authorized_roles end authorized_roles,
 epoch_us(case when n.seq is null then r.available_from else try_cast(coalesce(n.available_from,'2024-01-15') as timestamp) end)//1000 available_ms,
 case when n.seq is null then r.sample_request else coalesce(n.sample_request,'') end sample_request,
 case when n.seq is null then r.supported_formats else coalesce(n.supported_formats,'') end supported_formats
 from dataset_registry r full outer join adds n on n.dataset=r.dataset_id and n.sub_id=r.dataset_sub_id)"""


# Changes replayed by position: a report is alive from its first submit on.
def _entry(key: str, condition: str, message: str) -> str:
    return f"""case when {condition} then '"{key}":"{message}",' else '' end"""


_REPLAY = f"""{with_views("report_changes")},
checked AS (select *, case when action='deactivate' then '' else concat(
 {_entry("request.description", "description is null", "Report Description should not empty")},
 {_entry("request.config.reportConfig", "config='{}'", "Report Config  should not be empty")}) end problems from report_changes),
placed AS (select *, row_number() over (partition by report_id order by ts, seq) pos from checked where problems=''),
born AS (select report_id, min(pos) pos from placed where action='submit' group by 1),
live AS (select p.*, b.pos bpos, case when action='submit' then p.pos=b.pos else p.pos>b.pos end counts
 from placed p left join born b on p.report_id=b.report_id),
last_any AS (select * from (select *, row_number() over (partition by report_id order by pos desc) rn from live where counts) where rn=1),
last_content AS (select * from (select *, row_number() over (partition by report_id order by pos desc) rn from live where counts and action<>'deactivate') where rn=1),
registry AS (select a.report_id, c.description, c.created_by, c.report_schedule, c.config, f.ts created_on, a.ts updated_on,
 case when a.action='deactivate' then 'INACTIVE' else 'ACTIVE' end status,
 case when a.action='deactivate' then 'REPORT DEACTIVATED' else 'REPORT SUCCESSFULLY ACTIVATED' end status_msg
 from last_any a join last_content c on a.report_id=c.report_id join live f on f.report_id=a.report_id and f.pos=f.bpos)"""


_REPORT_ERRORS = f"""judged AS (select seq, concat(
 {_entry("request.reportId", "report_id is null", "Report Id should not be  empty")},
 {_entry("request.description", "description is null", "Report Description should not empty")},
 {_entry("request.createdBy", "created_by is null", "Created By should not be empty")},
 {_entry("request.config", "config is null", "Config should not be empty")},
 {_entry("request.config.reportConfig", "config='{}'", "Report Config  should not be empty")},
 {_entry("request.config.store", "contains(config,'reportConfig') and not contains(config,'store')", "Config Store should not be empty")},
 {_entry("request.config.container", "contains(config,'store') and not contains(config,'container')", "Config Container should not be empty")},
 {_entry("request.config.key", "contains(config,'container') and not contains(config,'key')", "Config Key should not be empty")}) problems from report_requests)"""

_LOG_REASON = """case when n=0 then 'property: request is missing!' when n=1 then 'property: context is missing!'
 when n=2 then 'property: pdata is missing!' when n=3 then 'property: logs is missing!'
 when mod(conv_id,7)=0 then 'property: context.did is null or empty!' when mod(conv_id*10+turn,19)=0 then 'property: pdata.id is null or empty!'
 when mod(conv_id,11)=0 then 'property: pdata.ver is null or empty!'
 when mod(conv_id*10+turn,23)=0 or mod(conv_id*10+turn,13)=0 or text='' then 'property: logs, mandatory fields are missing or type mismatch!' end"""
_LOGS = f"""logs AS (select *, {_LOG_REASON} reason from (select *, mod(conv_id*10+turn,17) n from conversations) x)"""

ORACLES = {
    "dataset_validate": f"{with_views('new_datasets')} select seq, {_BAD_ADD} failure from new_datasets",
    "dataset_upsert": f"{_UPSERTED} select * from upserted",
    "dataset_list": f"""{with_views("dataset_registry")} select dataset_id dataset, dataset_sub_id, dataset_type, dataset_config, visibility, version,
 sample_request, '' sample_response, strftime(available_from,'%Y-%m-%d') available_from, '{{}}' validation_json, supported_formats, '' exhaust_type
 from dataset_registry""",
    "dataset_count": f"{_UPSERTED} select count(*) datasets from upserted",
    "dataset_by_id": f"""{with_views("dataset_registry", "new_datasets")} select dataset_id, dataset_type, version from dataset_registry
 where dataset_id in (select dataset from new_datasets where dataset is not null)""",
    "report_validate": f"""{with_views("report_requests")}, {_REPORT_ERRORS}
select seq, concat('{{',problems,'"status":"',case when problems='' then 'success' else 'failed' end,'"}}') errors from judged""",
    "report_apply_changes": f"""{_REPLAY} select report_id, description, created_by, report_schedule, config,
 epoch_us(created_on)//1000 created_ms, epoch_us(updated_on)//1000 updated_ms, status, status_msg from registry""",
    "report_change_answer": f"""{_REPLAY} select seq, report_id, action, coalesce(counts,false) accepted, case
 when action='submit' and not counts then 'ReportId already Exists'
 when action='update' and not coalesce(counts,false) then 'no report available with requested reportid'
 when action='deactivate' and not coalesce(counts,false) then 'no report available with requested reportId'
 when action='deactivate' then 'Successfully DeActivated the Report' end message from live
union all select seq, report_id, action, false, concat('{{',problems,'"status":"failed"}}') from checked where problems<>''""",
    "report_read": f"""{_REPLAY} select q.seq, concat('r-',mod(q.seq,300)) report_id, 'OK' response_code,
 case when r.report_id is null then 'no report available with requested reportid' end message, r.status
 from (select p_partkey seq from part) q left join registry r on r.report_id=concat('r-',mod(q.seq,300))""",
    "report_rows": f"""{_REPLAY} select report_id, epoch_us(updated_on)//1000 updated_on, description report_description, created_by requested_by,
 epoch_us(created_on)//1000 created_on, epoch_us(created_on)//1000 submitted_on, status, status_msg from registry""",
    "stored_table_read": f"{with_views('consumer_channels')} select consumer_id, channel, status from consumer_channels",
    "dataset_file_listing": "select distinct event_type, true filled from events",
    "report_list": f"""{_REPLAY} select report_id, status, concat('{{"report_id":',to_json(report_id),',"description":',to_json(description),
 ',"created_by":',to_json(created_by),',"report_schedule":',to_json(report_schedule),',"config":',to_json(config),
 ',"created_on":',epoch_us(created_on)//1000,',"submitted_on":',epoch_us(created_on)//1000,',"updated_on":',epoch_us(updated_on)//1000,
 ',"status":',to_json(status),',"status_msg":',to_json(status_msg),'}}') report from registry where status='ACTIVE'""",
    "report_count": f"{_REPLAY} select status, count(*) reports from registry group by 1",
    "client_log_validate": f"with {_LOGS} select conv_id, turn, reason is null accepted, reason from logs",
    "client_log_screen_lines": f"""{with_views("client_logs")} select conv_id, count(*) as lines,
 case when max(did)='' then 'property: context.did is null or empty!' when max(ver) is null then 'property: pdata.ver is null or empty!'
 when bool_or(coalesce(log,'')='' or ts=0) then 'property: logs, mandatory fields are missing or type mismatch!' end reason
 from client_logs group by conv_id""",
    "client_log_sink": f"""with {_LOGS} select concat('d-',conv_id) did, role, '1.0' ver, conv_id*1000+turn+1 ts, text log,
 cast(turn as varchar) pageid from logs where reason is null""",
    "json_lines_load": f"""{with_views("registrations")} select 'device.register' id, producer, fcm_token, event_id*1000 first_access
 from registrations where mod(event_id,10)<>3""",
}
