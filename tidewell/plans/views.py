"""Input views over the parquet tables.

Each view is one SELECT that Spark and DuckDB both understand, so a query and
its SQL twin read the same rows.  The texts hold no row subset: every view
covers the whole of its tables.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]

_DOTTED = (
    "concat(cast(cast(floor(ip_int/16777216) as bigint) as string),'.',"
    "cast(mod(cast(floor(ip_int/65536) as bigint),256) as string),'.',"
    "cast(mod(cast(floor(ip_int/256) as bigint),256) as string),'.',cast(mod(ip_int,256) as string))"
)


def _last(rows: str, keys: str) -> str:
    """The last loaded row per key; the twins read these, the queries the repeated rows."""
    return f"""
select * from (select *, row_number() over (partition by {keys} order by loaded desc) place from {rows}) x where place=1"""


VIEWS = {
    # -- devices ---------------------------------------------------------
    "reg0": """
select event_id, ts, user_id, event_type, cast(regexp_extract(props,'([0-9]+)',1) as int) k,
 16777216+mod(event_id*7919,130000000) ip_int from events""",
    "registrations": f"""
select event_id, ts, concat('device-',cast(user_id as string)) did,
 case when mod(event_id,37)=0 then 'not-an-ip' when mod(event_id,10)=0 then '192.168.1.7' else {_DOTTED} end header_ip,
 case when mod(event_id,20)=0 then {_DOTTED} end ip_addr,
 case when mod(k,3)=0 then '' else concat('tok-',cast(k as string)) end fcm_token, event_type producer,
 case when mod(k,4)=1 then null else concat('{{"os":"Android ',cast(mod(k,12) as string),'","cpu":"abi: v',
  cast(mod(k,3) as string),'","sims":',cast(mod(k,2) as string),'}}') end dspec,
 case mod(event_id,6)
  when 0 then concat('Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/',cast(60+mod(k,40) as string),'.0.1 Safari/537.36')
  when 1 then concat('Mozilla/5.0 (X11; Linux x86_64; rv:',cast(50+mod(k,30) as string),'.0) Gecko/20100101 Firefox/',cast(50+mod(k,30) as string),'.0')
  when 2 then concat('Mozilla/5.0 (iPhone; CPU iPhone OS 13_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/',cast(10+mod(k,5) as string),'.0 Mobile/15E148 Safari/604.1')
  when 3 then concat('Mozilla/5.0 (Windows NT 6.1; Win64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0 Safari/537.36 Edg/',cast(80+mod(k,20) as string),'.0.8')
  when 4 then concat('okhttp/',cast(mod(k,4) as string),'.12') end uaspec,
 case when mod(k,5)=0 then '' else concat('NATION_',cast(mod(user_id,25) as string)) end user_declared_state,
 case when mod(k,7)=0 then null else concat('district-',cast(mod(user_id,9) as string)) end user_declared_district,
 concat('user-',cast(user_id as string)) user_id,
 case when mod(k,2)=0 then concat('/p/',cast(mod(k,25) as string)) end url from reg0""",
    "registration_bodies": """
select event_id, did, concat('{"id":"device.register","request":{"producer":"',producer,'","fcmToken":"',fcm_token,'"',
 case when ip_addr is null then '' else concat(',"ip_addr":"',ip_addr,'"') end,
 case when dspec is null then '' else concat(',"dspec":',dspec) end,
 ',"first_access":',cast(event_id*1000 as string),
 ',"userDeclaredLocation":{"state":"',user_declared_state,'"',
 case when user_declared_district is null then '' else concat(',"district":"',user_declared_district,'"') end,'}',
 ',"ext":{"userid":"',user_id,'"',case when url is null then '' else concat(',"url":"',url,'"') end,'}}}') body
 from registrations""",
    "geo_ranges": """
select 16777216+s_suppkey*1000000 network_start_integer, 16777216+s_suppkey*1000000+899999 network_last_integer,
 1000+s_nationkey geoname_id from supplier
 union all
select 16777216+s_suppkey*1000000+100000, 16777216+s_suppkey*1000000+100000+1000*(1+mod(s_suppkey,7)),
 1000+cast(mod(s_suppkey,25) as int) from supplier""",
    # Bounds and places move from version to version.
    "geo_range_versions": """
select network_start_integer, network_last_integer, cast(geoname_id as int) geoname_id, cast('2023-12-29 00:00:00' as timestamp) valid_from from geo_ranges
 union all
select network_start_integer+50000, network_last_integer+50000, cast(1000+mod(geoname_id+3,25) as int), cast('2024-01-05 00:00:00' as timestamp) from geo_ranges
 union all
select network_start_integer+1000, network_last_integer, cast(1000+mod(geoname_id+5,25) as int), cast('2024-01-15 00:00:00' as timestamp) from geo_ranges
 union all
select network_start_integer-20000, network_last_integer-60000, cast(1000+mod(geoname_id+7,25) as int), cast('2024-01-25 00:00:00' as timestamp)
 from geo_ranges where network_last_integer-60000 >= network_start_integer-20000""",
    # In about the order of time, a tenth of the rows one batch late.
    "arrivals": """
select r.*, least(3, case when extract(day from ts)<8 then 0 when extract(day from ts)<18 then 1 when extract(day from ts)<28 then 2 else 3 end
 + case when mod(event_id,10)=0 then 1 else 0 end) arrival from registrations r""",
    "geo_city_rows": """
select case when n_nationkey=24 then 9024 else 1000+n_nationkey end geoname_id, r_name continent_name, concat('C',cast(r_regionkey as string)) country_iso_code,
 concat('Country ',cast(r_regionkey as string)) country_name, concat('S',cast(n_nationkey as string)) subdivision_1_iso_code,
 case when n_nationkey=7 then '' else n_name end subdivision_1_name, '' subdivision_2_name,
 concat('City ',cast(n_nationkey as string)) city_name,
 case when mod(n_nationkey,6)=5 then '' else concat('Custom ',n_name) end subdivision_1_custom_name,
 cast(n_nationkey as string) subdivision_1_custom_code, concat('D',cast(mod(n_nationkey,7) as string)) subdivision_2_custom_name, 2 loaded
 from nation join region on n_regionkey=r_regionkey
 union all
select case when n_nationkey=24 then 9024 else 1000+n_nationkey end, 'Old', 'O', 'Old country', 'O', 'Old state', '', 'Old city',
 'Old', 'O', 'O', 1 from nation""",
    "geo_cities": _last("geo_city_rows", "geoname_id"),
    # -- experiments -----------------------------------------------------
    "experiments": """
select concat('exp-',cast(c_custkey as string)) id, c_name name, '2024-01-01' start_date, '2024-01-31' end_date,
 concat('key-',cast(mod(c_custkey,10) as string)) exp_key,
 case when mod(b,2)=1 then concat('user-',cast(mod(c_custkey,151) as string)) end userId,
 case when b in (2,3,6,7) then concat('device-',cast(mod(c_custkey,149) as string)) end deviceId,
 case when b>=4 then concat('/p/',cast(c_nationkey as string)) end url,
 case when mod(c_custkey,4)=0 then 'modulus' else 'default' end expType,
 1+mod(c_custkey,3) userIdMod, 1+mod(c_custkey,2) deviceIdMod
 from (select *, 1+mod(cast(floor(c_custkey/10) as bigint),7) b from customer) x""",
    "lookups": """
select event_id lookup_id, ts, case when mod(k,11)=0 then null else concat('user-',cast(user_id as string)) end userId,
 case when mod(k,13)=0 then null else concat('device-',cast(user_id as string)) end deviceId,
 case when mod(k,2)=0 then concat('/p/',cast(mod(k,25) as string)) end url, event_type producer from reg0""",
    "repeated_lookups": """
select lookup_id seq, case when mod(lookup_id,5)=0 then null else mod(lookup_id,97) end lookup_id, userId, deviceId, url from lookups""",
    "experiment_definitions": """
select concat('e-',cast(p_partkey as string)) exp_id, p_name exp_name, concat('About ',p_name) exp_description,
 p_brand created_by, 'registry' updated_by,
 case mod(p_partkey,4) when 0 then 'ACTIVE' when 1 then 'Failed' when 2 then 'SUBMITTED' else 'PROCESSING' end status,
 'loaded' status_message, concat('{"matched":',cast(p_size as string),'}') stats,
 concat('{"type":"user","filters":{"brand":"',p_brand,'"}}') criteria,
 concat('{"startDate":"2024-01-01","endDate":"2024-01-31","modulus":',cast(p_size as string),'}') exp_data,
 cast('2024-01-01 00:00:00' as timestamp) created_on, cast('2024-01-02 00:00:00' as timestamp) updated_on from part""",
    "experiment_requests": """
select p_partkey seq, case when mod(p_partkey,19)=0 then null else concat('e-',cast(p_partkey*2 as string)) end exp_id,
 case when mod(p_partkey,17)=0 then null else p_name end exp_name, p_type exp_description,
 case when mod(p_partkey,13)=0 then null else p_brand end created_by,
 case when mod(p_partkey,11)=0 then null when mod(p_partkey,11)=1 then '{"type":"user"}'
  when mod(p_partkey,11)=2 then '{"filters":{"a":1}}' else '{"type":"user","filters":{"a":1}}' end criteria,
 case when mod(p_partkey,23)=0 then null else concat('{"startDate":"',
  case when mod(p_partkey,9)=0 then '' else cast(cast('2024-01-10' as date)+cast(mod(p_partkey,40) as int) as string) end,
  '","endDate":"',case when mod(p_partkey,8)=0 then '' else cast(cast('2024-01-10' as date)+cast(mod(p_size,50) as int) as string) end,
  '","modulus":5}') end exp_data from part""",
    # -- data requests ---------------------------------------------------
    "job_requests": """
select o_orderkey, concat(lower(c_mktsegment),':ch-',cast(c_nationkey as string)) tag,
 upper(md5(concat_ws('|',o_orderpriority,lower(c_mktsegment),concat('u-',cast(o_orderkey as string)),
  concat('ch-',cast(c_nationkey as string)),cast(cast(o_orderdate as date) as string),
  case when mod(o_orderkey,4)=0 then 'druid' end))) request_id,
 o_orderpriority job_id, case o_orderstatus when 'O' then 'SUBMITTED' when 'F' then 'FAILED' else 'SUCCESS' end status,
 case when mod(o_orderkey,4)=0 then '{"type":"druid"}' else '{}' end request_data,
 concat('u-',cast(o_orderkey as string)) requested_by, concat('ch-',cast(c_nationkey as string)) requested_channel,
 o_orderdate dt_job_submitted, case when o_orderstatus<>'O' then o_orderdate + interval '1' day end dt_job_completed,
 case when o_orderstatus='O' then null when mod(o_orderkey,2)=0
  then concat('https://h.example/reports/',cast(o_orderkey as string),'/f.csv')
  else concat('wasb://reports@acc.example/',cast(o_orderkey as string),'/f.csv') end download_url,
 case when o_orderstatus='F' then 'job failed' end err_message,
 case when mod(o_orderkey,5)=0 then null else mod(o_orderkey,600) end execution_time,
 case when mod(o_orderkey,9)=0 then null else cast(mod(o_orderkey,3) as int) end iteration
 from orders join customer on o_custkey=c_custkey""",
    "search_filters": """
select o_orderkey, case mod(o_orderkey,7) when 0 then null when 1 then '{}' when 2 then concat('{"owner":"',o_orderpriority,'"}')
 when 3 then concat('{"status":"',o_orderstatus,'"}') when 4 then concat('{"owner":"',o_orderpriority,'","channel":"ch-1"}')
 when 5 then concat('{"requestedDate":"',cast(cast(o_orderdate as date) as string),'"}') else concat('{"dataset":"',o_orderpriority,'","size":1}') end filters
 from orders""",
    "new_requests": """
select o_orderkey seq, case when mod(o_orderkey,31)=0 then null else o_orderpriority end dataset,
 case when mod(o_orderkey,29)=0 then null else lower(c_mktsegment) end client_tag,
 concat('ch-',cast(c_nationkey as string)) channel, concat('u-',cast(o_orderkey as string)) requested_by,
 case when mod(o_orderkey,3)=0 then cast('2024-01-02' as date) else cast(o_orderdate as date) end submission_date,
 case when mod(o_orderkey,23)=0 then null when mod(o_orderkey,4)=0 then '{"type":"druid"}' else '{}' end dataset_config,
 concat('consumer-',cast(mod(o_orderkey,10) as string)) consumer_id, concat('u-',cast(o_custkey as string)) user_id,
 mod(o_orderkey,2)=0 has_token from orders join customer on o_custkey=c_custkey""",
    "request_bodies": """
select o_orderkey, o_orderpriority dataset, concat('{"requestedBy":"u-',cast(o_custkey as string),'"',
 case when mod(o_orderkey,7)=0 then '' when mod(o_orderkey,7)=1 then ',"tag":5' else ',"tag":"t1"' end,
 case when mod(o_orderkey,5)=0 then '' else concat(',"dataset":"',o_orderpriority,'"') end,
 case when mod(o_orderkey,3)=0 then ',"datasetConfig":[]' when mod(o_orderkey,11)=0 then ',"datasetConfig":{"b":1}' else ',"datasetConfig":{"a":1}' end,'}') body from orders""",
    "dataset_rule_rows": """
select distinct case when o_orderpriority='5-LOW' then 'none' else o_orderpriority end dataset_sub_id, case when o_orderpriority='1-URGENT'
 then '{"type":"object","properties":{"tag":{"type":["string","null"]},"dataset":{"type":"string"},"datasetConfig":{"type":"object","required":["a"]}},"required":["tag","dataset"]}'
 when o_orderpriority='2-HIGH' then '{"type":"object","properties":{"datasetConfig":{"type":"object"}},"required":["dataset"]}'
 end validation_json, 2 loaded from orders
 union all
select distinct case when o_orderpriority='5-LOW' then 'none' else o_orderpriority end, '{"required":["older"]}', 1 from orders""",
    "dataset_rules": _last("dataset_rule_rows", "dataset_sub_id"),
    "dataset_role_rows": """
select distinct case when o_orderpriority='5-LOW' then 'none' else o_orderpriority end dataset_sub_id, case when o_orderpriority='1-URGENT' then 'ORG_ADMIN,REPORT_ADMIN'
 else 'PROGRAM_MANAGER,COURSE_ADMIN' end authorized_roles, 2 loaded from orders
 union all
select distinct case when o_orderpriority='5-LOW' then 'none' else o_orderpriority end, 'OLDER', 1 from orders""",
    "dataset_roles": _last("dataset_role_rows", "dataset_sub_id"),
    "consumer_channel_rows": """
select concat('consumer-',cast(s_suppkey as string)) consumer_id, concat('ch-',cast(s_nationkey as string)) channel,
 case when mod(s_suppkey,4)=0 then 0 else 1 end status, 2 loaded from supplier
 union all
select concat('consumer-',cast(s_suppkey as string)), concat('ch-',cast(s_nationkey as string)),
 case when mod(s_suppkey,4)=0 then 1 else 0 end, 1 from supplier""",
    "consumer_channels": _last("consumer_channel_rows", "consumer_id, channel"),
    "user_rows": """
select concat('u-',cast(c_custkey as string)) user_id,
 case when mod(c_custkey,6)=0 then 'CH-0' else concat('CH-',cast(c_nationkey as string)) end root_org_id,
 concat('ch-',cast(mod(c_nationkey,5) as string)) root_org_slug,
 case when mod(c_custkey,7)=0 then 'sunrise' else 'other' end root_org_channel,
 case mod(c_custkey,3) when 0 then 'ORG_ADMIN' when 1 then 'REPORT_ADMIN,COURSE_ADMIN' else 'PUBLIC' end roles,
 2 loaded from customer
 union all
select concat('u-',cast(c_custkey as string)), concat('CH-',cast(c_nationkey as string)), 'ch-1', 'sunrise', 'ORG_ADMIN', 1 from customer""",
    "users": _last("user_rows", "user_id"),
    "user_documents": """
select user_id, loaded, concat('{"rootOrg":{"id":"',root_org_id,'","slug":"',root_org_slug,'","channel":"',root_org_channel,
 '","hash":"x"},"organisations":[{"roles":["',replace(roles,',','"]},{"roles":["'),'"]}]}') document from user_rows""",
    "organisation_documents": """
select user_id, case when roles='PUBLIC' then '{"content":[]}' else
 concat('{"content":[{"id":"',root_org_id,'","slug":"',root_org_slug,'"},{"slug":"second"}]}') end document from users""",
    "access_requests": """
select o_orderkey, case when mod(o_orderkey,41)=0 then '' else concat('ch-',cast(c_nationkey as string)) end channel,
 case when mod(o_orderkey,7)=0 then 'consumer-none' else concat('consumer-',cast(mod(o_orderkey,10) as string)) end consumer_id,
 case when mod(o_orderkey,43)=0 then 'u-missing' else concat('u-',cast(o_custkey as string)) end user_id,
 mod(o_orderkey,3)>0 has_token, o_orderpriority dataset_sub_id from orders join customer on o_custkey=c_custkey""",
    # -- files -----------------------------------------------------------
    "dataset_files": """
select distinct concat('data-exhaust/raw/ch-',cast(mod(user_id,5) as string),'/',
 case when mod(user_id,50)=0 then 'undated' else cast(cast(ts as date) as string) end,'-',event_type,'.json.gz') path from events""",
    "public_files": """
select distinct concat('data-exhaust/summary-rollup/',cast(cast(ts as date) as string),'-',event_type,'.csv') path from events""",
    "exhaust_requests": """
select c_custkey seq, 'raw' dataset_id, concat('ch-',cast(mod(c_custkey,6) as string)) channel,
 case when mod(c_custkey,31)=0 then 'soon' when mod(c_custkey,5)=0 then null else cast(cast('2024-01-03' as date)+cast(mod(c_custkey,29) as int) as string) end from_day,
 case when mod(c_custkey,7)=0 then null else cast(cast('2024-01-03' as date)+cast(mod(c_custkey,29)+mod(c_custkey,14)-1 as int) as string) end to_day,
 case when mod(c_custkey,9)=0 then '2024-01-24' end since_day from customer""",
    "public_requests": """
select c_custkey seq, case when mod(c_custkey,17)=0 then 'private-rollup' else 'summary-rollup' end dataset_id,
 case when mod(c_custkey,31)=0 then '2024-02-31' when mod(c_custkey,5)=0 then null else cast(cast('2023-11-20' as date)+cast(mod(c_custkey,79) as int) as string) end from_day,
 case when mod(c_custkey,7)=0 then null else cast(cast('2023-11-20' as date)+cast(mod(c_custkey,79)+mod(c_custkey,37)-1 as int) as string) end to_day,
 case when mod(c_custkey,9)=0 then '2024-01-24' end since_day,
 case when mod(c_custkey,4)=0 then cast(cast('2024-01-01' as date)+cast(mod(c_custkey,35) as int) as string) end on_day,
 case mod(c_custkey,11) when 0 then 'LAST_DAY' when 1 then 'LAST_2_DAYS' when 2 then 'LAST_7_DAYS' when 3 then 'LAST_14_DAYS'
  when 4 then 'LAST_30_DAYS' when 5 then 'LAST_WEEK' when 6 then 'LAST_YEAR' end date_range from customer""",
    # -- registries ------------------------------------------------------
    "new_datasets": """
select p_partkey seq, case when mod(p_partkey,37)=0 then null else concat('ds-',cast(mod(p_partkey,500) as string)) end dataset,
 case when mod(p_partkey,4)=0 then concat('sub-',cast(mod(p_partkey,50) as string)) end dataset_sub_id,
 case when mod(p_partkey,11)=0 then null else p_type end dataset_type,
 case when mod(p_partkey,13)=0 then null else 'v1' end version,
 case when mod(p_partkey,17)=0 then null when mod(p_partkey,5)=0 then 'public' else 'private' end visibility,
 case when mod(p_partkey,19)=0 then null else concat(p_brand,',ORG_ADMIN') end authorized_roles,
 case when mod(p_partkey,41)=0 then 'later' when mod(p_partkey,3)=0 then cast(cast('2024-01-01' as date)+cast(mod(p_partkey,20) as int) as string) end available_from,
 case when mod(p_partkey,2)=0 then concat('{"size":',cast(p_size as string),'}') end dataset_config,
 case when mod(p_partkey,6)=0 then 'csv,json' end supported_formats, case when mod(p_partkey,7)=0 then 'sample' end sample_request
 from part""",
    "dataset_registry": """
select concat('ds-',cast(s_suppkey*7 as string)) dataset_id, concat('ds-',cast(s_suppkey*7 as string)) dataset_sub_id,
 '{}' dataset_config, 'private' visibility, s_name dataset_type, 'v0' version, 'ORG_ADMIN' authorized_roles,
 cast('2023-01-01 00:00:00' as timestamp) available_from, '' sample_request, 'json' supported_formats from supplier""",
    "report_changes": """
select o_orderkey seq, o_orderdate ts, concat('r-',cast(mod(o_custkey,200) as string)) report_id,
 case mod(o_orderkey,5) when 0 then 'deactivate' when 1 then 'update' when 2 then 'update' else 'submit' end action,
 case when mod(o_orderkey,13)=0 then null else concat('report by ',o_orderpriority) end description, concat('u-',cast(o_custkey as string)) created_by,
 o_orderpriority report_schedule, case when mod(o_orderkey,17)=0 then '{}' else concat('{"reportConfig":{"id":',cast(o_orderkey as string),'},"store":"s","container":"c","key":"k"}') end config
 from orders""",
    "report_requests": """
select p_partkey seq, case when mod(p_partkey,7)=0 then null else p_name end report_id,
 case when mod(p_partkey,5)=0 then null else p_type end description,
 case when mod(p_partkey,3)=0 then null else p_brand end created_by,
 case mod(p_partkey,6) when 0 then null when 1 then '{}' when 2 then '{"reportConfig":{}}'
  when 3 then '{"reportConfig":{},"store":"s"}' when 4 then '{"reportConfig":{},"store":"s","container":"c"}'
  else '{"reportConfig":{},"store":"s","container":"c","key":"k"}' end config from part""",
    # -- client logs -----------------------------------------------------
    "client_logs": """
select conv_id, turn, case when mod(conv_id,7)=0 then '' else concat('d-',cast(conv_id as string)) end did,
 case when mod(conv_id,11)=0 then null else '1.0' end ver, conv_id*1000+turn ts,
 case when mod(conv_id*10+turn,13)=0 then '' else text end log from conversations""",
    "client_log_bodies": """
select conv_id, turn, case when mod(conv_id*10+turn,17)=0 then '{}' when mod(conv_id*10+turn,17)=1 then '{"request":{}}'
 when mod(conv_id*10+turn,17)=2 then '{"request":{"context":{}}}' when mod(conv_id*10+turn,17)=3 then '{"request":{"context":{},"pdata":{}}}'
 else concat('{"request":{"context":{"did":"',case when mod(conv_id,7)=0 then '' else concat('d-',cast(conv_id as string)) end,
  '","extras":{"role":"',role,'"}},"pdata":{"pid":"web"',
  case when mod(conv_id*10+turn,19)=0 then '' else ',"id":"player"' end,
  case when mod(conv_id,11)=0 then '' else ',"ver":"1.0"' end,
  '},"logs":[{"id":"',role,'","ts":',case when mod(conv_id*10+turn,23)=0 then '0' else cast(conv_id*1000+turn+1 as string) end,
  ',"log":"',case when mod(conv_id*10+turn,13)=0 then '' else
   replace(replace(replace(replace(replace(text,chr(92),concat(chr(92),chr(92))),'"',concat(chr(92),'"')),chr(10),concat(chr(92),'n')),chr(13),concat(chr(92),'r')),chr(9),concat(chr(92),'t')) end,
  '","pageid":"',cast(turn as string),'"}]}}') end body from conversations""",
    # -- telemetry -------------------------------------------------------
    "telemetry": """
select event_id, ts, cast(ts as date) event_day, event_type eid, concat('device-',cast(user_id as string)) did,
 concat('ch-',cast(mod(user_id,5) as string)) channel, case when mod(user_id,3)=0 then 'portal' else 'app' end pdata_id,
 case when mod(user_id,10)=9 then null else concat('NATION_',cast(mod(user_id,25) as string)) end state,
 case when mod(user_id,8)=7 then null else concat('district-',cast(mod(user_id,9) as string)) end district,
 concat('tag-',cast(mod(event_id,6) as string)) tag, concat('content-',cast(mod(event_id,97) as string)) content_id,
 concat('user-',cast(user_id as string)) user_id, value from events""",
}


@cache
def _needs(name: str) -> tuple[str, ...]:
    """Views that a view reads, in order, the view itself last."""
    found: list[str] = []
    for word in re.findall(r"\b(?:from|join)\s+(\w+)", VIEWS[name]):
        if word in VIEWS:
            found += [n for n in _needs(word) if n not in found]
    return (*found, name)


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views and all they read."""
    ordered: list[str] = []
    for name in names:
        ordered += [n for n in _needs(name) if n not in ordered]
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, replaced: dict[str, str] | None = None) -> DataFrame:
    """A view as a DataFrame; times without a zone become UTC timestamps.

    ``replaced`` names a temporary view to read instead of a table, for
    example a stream.
    """
    clause = with_views(name)
    used = [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", clause)]
    origin = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in used} | (replaced or {})
    sources = ",\n".join(f"{t} AS (SELECT * FROM {origin[t]})" for t in used)
    frame = spark.sql(f"WITH {sources},\n{clause.removeprefix('WITH ')}\nSELECT * FROM {name}")
    zoned = {
        field.name: frame[field.name].cast("timestamp")
        for field in frame.schema.fields
        if field.dataType.typeName() == "timestamp_ntz"
    }
    return frame.withColumns(zoned) if zoned else frame
