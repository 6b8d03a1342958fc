"""Registered queries about devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import network, texts
from tidewell.operators import devices, geo
from tidewell.operators.upserts import latest_by_key
from tidewell.plans.views import view, with_views
from tidewell.sources import documents, tables


_INDEXES: dict[tuple[str, str], geo.GeoIndex] = {}


def build_index(spark: SparkSession, sf_dir: str) -> geo.GeoIndex:
    return geo.build_index(
        tables.geo_ranges(view(spark, sf_dir, "geo_ranges")), tables.locations(view(spark, sf_dir, "geo_city_rows"))
    )


def geo_index(spark: SparkSession, sf_dir: str) -> geo.GeoIndex:
    """The index of a table folder, built once per application like any loaded reference table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(spark, sf_dir)
    return _INDEXES[key]


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "registrations")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.enrich(registrations(spark, sf_dir), geo_index(spark, sf_dir))


def ip_to_int(spark, sf_dir):
    rows = view(spark, sf_dir, "registrations")
    return rows.select(
        "event_id", "header_ip", F.coalesce(network.ip_to_int(F.col("header_ip")), F.lit(-1)).alias("ip_int")
    )


def effective_ip(spark, sf_dir):
    rows = view(spark, sf_dir, "registrations")
    chosen = rows.select("event_id", network.effective_ip(F.col("header_ip"), F.col("ip_addr")).alias("effective_ip"))
    ip = F.col("effective_ip")
    return chosen.withColumn("ip_status", network.ip_status(ip, network.ip_to_int(ip).isNotNull()))


def registration_parse(spark, sf_dir):
    parsed = documents.parse_registrations(view(spark, sf_dir, "registration_bodies"))
    return parsed.withColumn("first_access", F.coalesce("first_access", F.lit(-1)))


def ip_location_enrich(spark, sf_dir):
    return enriched(spark, sf_dir).select(
        "event_id", "effective_ip", "ip_status", "in_range", "resolved", "geoname_id", *geo.LOCATION_FIELDS
    )


def registrations_by_state(spark, sf_dir):
    return (
        devices.accepted(enriched(spark, sf_dir))
        .groupBy("continent_name", "state")
        .agg(F.count(F.lit(1)).alias("registrations"), F.countDistinct("did").alias("devices"))
    )


def geo_city_lookup(spark, sf_dir):
    cities = tables.geo_cities(view(spark, sf_dir, "geo_city_rows"))
    return tables.geo_ranges(view(spark, sf_dir, "geo_ranges")).join(cities, "geoname_id")


def user_agent_enrich(spark, sf_dir):
    rows = registrations(spark, sf_dir).select("event_id", "uaspec")
    parsed = rows.withColumn("parsed", texts.user_agent(F.col("uaspec")))
    return parsed.select("event_id", "parsed.agent", "parsed.ver", "parsed.system", F.to_json("parsed").alias("uaspec"))


def device_event(spark, sf_dir):
    return devices.device_events(enriched(spark, sf_dir)).select("event_id", "did", "value")


def device_profile_state(spark, sf_dir):
    return devices.profile_state(enriched(spark, sf_dir))


def device_profile(spark, sf_dir):
    rows, index = registrations(spark, sf_dir), geo_index(spark, sf_dir)
    profiles = devices.profile_state(devices.enrich(rows, index))
    return devices.read_profiles(rows.select("event_id", "did", "header_ip"), profiles, index)


def registration_metrics(spark, sf_dir):
    return devices.metrics_events(devices.count_registrations(devices.outcomes(enriched(spark, sf_dir))))


def dedupe_last(spark, sf_dir):
    rows = view(spark, sf_dir, "registrations").select("did", "event_id", "ts", "producer", "fcm_token")
    return latest_by_key(rows, ["did"], ["ts", "event_id"]).select("did", "event_id", "producer", "fcm_token")


QUERIES = {
    f.__name__: f
    for f in (
        ip_to_int,
        effective_ip,
        registration_parse,
        ip_location_enrich,
        registrations_by_state,
        geo_city_lookup,
        user_agent_enrich,
        device_event,
        device_profile_state,
        device_profile,
        registration_metrics,
        dedupe_last,
    )
}

# -- SQL twins ---------------------------------------------------------------

_OCTET = "(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IS_IP = f"regexp_full_match({{0}}, '{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}')"


def ip_number(text: str) -> str:
    part = [f"cast(string_split({text}, '.')[{i}] as bigint)" for i in (1, 2, 3, 4)]
    return (
        f"case when {IS_IP.format(text)} then {part[0]}*16777216+{part[1]}*65536+{part[2]}*256+{part[3]} end"
    )


EFFECTIVE = "case when starts_with(header_ip,'192') then coalesce(ip_addr,'') else header_ip end"

# Every address against every range: the plain reading of "narrowest range that contains it".
ENRICHED = f"""{with_views("registrations", "geo_ranges", "geo_cities")},
addressed AS (select *, {EFFECTIVE} effective_ip from registrations),
numbered AS (select *, {ip_number("effective_ip")} ip_int,
  case when effective_ip='' then 'blank' when not {IS_IP.format("effective_ip")} then 'invalid' else 'ok' end ip_status
  from addressed),
hits AS (select ip_int, geoname_id from (
  select ip_int, geoname_id, row_number() over (partition by ip_int order by
    network_last_integer-network_start_integer, network_start_integer, geoname_id) rn
  from (select distinct ip_int from numbered where ip_int is not null) d
  join geo_ranges on ip_int between network_start_integer and network_last_integer) where rn=1),
enriched AS (select n.* exclude (user_id), h.ip_int is not null in_range,
  coalesce(subdivision_1_name,'')<>'' resolved, coalesce(c.geoname_id,0) geoname_id,
  coalesce(continent_name,'') continent_name, coalesce(country_iso_code,'') country_code,
  coalesce(country_name,'') country_name, coalesce(subdivision_1_iso_code,'') state_code,
  coalesce(subdivision_1_name,'') state, coalesce(subdivision_2_name,'') sub_div_2, coalesce(city_name,'') city,
  coalesce(subdivision_1_custom_name,'') state_custom, coalesce(subdivision_1_custom_code,'') state_code_custom,
  coalesce(subdivision_2_custom_name,'') district_custom
  from numbered n left join hits h on n.ip_int=h.ip_int left join geo_cities c on h.geoname_id=c.geoname_id)
"""

_AGENT_RULES = [
    ("Internet Explorer", "MSIE |Trident/", "(MSIE |rv:)([.0-9]+)", 2),
    ("Edge", "Edge/|Edg/|EdgiOS/|EdgA/", "Edg(e|iOS|A)?/([.0-9]+)", 2),
    ("Opera", "OPR/|Opera", "(OPR|Opera)[/ ]([.0-9]+)", 2),
    ("Firefox", "FxiOS/|Firefox/", "(FxiOS|Firefox)/([.0-9]+)", 2),
    ("Chrome", "Chrome/|CrMo/|CriOS/", "(Chrome|CrMo|CriOS)/([.0-9]+)", 2),
    ("Safari", "Safari/", "Version/([.0-9]+)", 1),
]


def _agent_case(kind: str) -> str:
    arms = " ".join(
        f"when regexp_matches(uaspec,'{shown}') then "
        + (f"'{name}'" if kind == "agent" else f"coalesce(nullif(regexp_extract(uaspec,'{pattern}',{group}),''),'UNKNOWN')")
        for name, shown, pattern, group in _AGENT_RULES
    )
    return f"case when uaspec is null then null {arms} else 'UNKNOWN' end"


_SYSTEM_CASE = (
    "case when uaspec is null then null "
    + " ".join(f"when contains(uaspec,'{word}') then '{name}'" for name, word in texts.SYSTEMS)
    + " else 'UNKNOWN' end"
)
_AGENT = f"""agents AS (select event_id agent_event, {_agent_case("agent")} agent, {_agent_case("ver")} ver, {_SYSTEM_CASE} system,
  uaspec raw from registrations r),
agent_text AS (select *, case when raw is not null then concat('{{"agent":',to_json(agent),',"ver":',to_json(ver),
  ',"system":',to_json(system),',"raw":',to_json(raw),'}}') end ua_json from agents)"""

_SPEC = "case when dspec is null then '{}' else regexp_replace(dspec, '\"sims\":([0-9]+)', '\"sims\":\"\\1\"') end"


def _event_part(name: str, value: str) -> str:
    return f"""case when {value} is null then '' else concat('"{name}":',to_json({value}),',') end"""


_EVENT = ",".join(
    _event_part(name, value)
    for name, value in [
        ("device_id", "did"),
        ("country_code", "country_code"),
        ("country", "country_name"),
        ("state_code", "state_code"),
        ("state", "state"),
        ("city", "city"),
        ("state_custom", "state_custom"),
        ("state_code_custom", "state_code_custom"),
        ("district_custom", "district_custom"),
        ("device_spec", _SPEC),
        ("uaspec", "ua_json"),
        ("fcm_token", "fcm_token"),
        ("producer_id", "producer"),
        ("api_last_updated_on", "epoch_us(ts)//1000"),
        ("first_access", "epoch_us(ts)//1000"),
        ("user_declared_state", "user_declared_state"),
        ("user_declared_district", "user_declared_district"),
    ]
)

_UPDATES = f"""{ENRICHED}, {_AGENT},
updates AS (select did, ts, event_id, dspec devicespec, ua_json uaspec, fcm_token, producer, user_declared_state,
  user_declared_district, cast(geoname_id as varchar) geoname_id, continent_name, country_code, country_name, state_code,
  state, city, state_custom, state_code_custom, district_custom
  from enriched join agent_text on event_id=agent_event where ip_status='ok'),
profiles AS (select did, {", ".join(f"arg_max({f}, (ts, event_id)) filter (where {f}<>'') {f}" for f in devices.PROFILE_FIELDS)}
  from updates group by did)"""

ORACLES = {
    "ip_to_int": f"""{with_views("registrations")}
select event_id, header_ip, coalesce({ip_number("header_ip")},-1) ip_int from registrations""",
    "effective_ip": f"""{with_views("registrations")}
select event_id, effective_ip, case when effective_ip='' then 'blank' when {IS_IP.format("effective_ip")} then 'ok' else 'invalid' end ip_status
from (select event_id, {EFFECTIVE} effective_ip from registrations)""",
    "registration_parse": f"""{with_views("registrations")}
select event_id, did, ip_addr, fcm_token, producer, event_id*1000 first_access, dspec, user_declared_state,
 user_declared_district, user_id, url from registrations""",
    "ip_location_enrich": f"""{ENRICHED}
select event_id, effective_ip, ip_status, in_range, resolved, geoname_id, {", ".join(geo.LOCATION_FIELDS)} from enriched""",
    "registrations_by_state": f"""{ENRICHED}
select continent_name, state, count(*) registrations, count(distinct did) devices from enriched
where ip_status='ok' group by continent_name, state""",
    "geo_city_lookup": f"""{with_views("geo_ranges", "geo_cities")}
select r.geoname_id, network_start_integer, network_last_integer, subdivision_1_name, subdivision_2_custom_name
from geo_ranges r join geo_cities c on r.geoname_id=c.geoname_id""",
    "user_agent_enrich": f"""{with_views("registrations")}, {_AGENT}
select agent_event event_id, agent, ver, system, ua_json uaspec from agent_text""",
    "device_event": f"""{ENRICHED}, {_AGENT}
select event_id, did, concat('{{',rtrim(concat({_EVENT}),','),'}}') value
from enriched join agent_text on event_id=agent_event where ip_status='ok'""",
    "device_profile_state": f"{_UPDATES} select * from profiles",
    "device_profile": f"""{_UPDATES},
seen AS (select distinct {ip_number("header_ip")} ip_int from registrations),
spot AS (select ip_int, geoname_id from (select s.ip_int, geoname_id, row_number() over (partition by s.ip_int order by
  network_last_integer-network_start_integer, network_start_integer, geoname_id) rn
  from seen s join geo_ranges on s.ip_int between network_start_integer and network_last_integer) where rn=1)
select r.event_id, r.did, r.header_ip, coalesce(subdivision_1_custom_name,'') ip_state,
 coalesce(subdivision_2_custom_name,'') ip_district,
 case when p.user_declared_state<>'' then p.user_declared_state end declared_state,
 case when p.user_declared_state<>'' then p.user_declared_district end declared_district
from (select *, {ip_number("header_ip")} n from registrations) r left join spot on n=spot.ip_int
left join geo_cities c on spot.geoname_id=c.geoname_id left join profiles p on r.did=p.did where n is not null""",
    "registration_metrics": f"""{ENRICHED},
counted AS (select time_bucket(interval '30 minutes', ts) w, count(*) api_calls, count(*) filter (where ip_status='ok') hit_count,
 count(*) filter (where ip_status='ok' and resolved) success_count, count(*) filter (where ip_status='ok' and not resolved) miss_count,
 count(*) filter (where ip_status='invalid') error_count, count(*) filter (where ip_status='ok') published_count
 from enriched group by 1)
select epoch_ms(w) window_start_ms, api_calls, hit_count, success_count, miss_count, error_count, published_count,
 concat('{{"job-name":"DeviceRegisterAPI","api-version":"v1","timestamp":',epoch_ms(w)+1800000,',"api-calls":',api_calls,
 ',"location-db-hit-count":',hit_count,',"location-db-success-count":',success_count,',"location-db-miss-count":',miss_count,
 ',"location-db-error-count":',error_count,',"log-device-register-success-count":',published_count,'}}') value from counted""",
    "dedupe_last": f"""{with_views("registrations")}
select did, event_id, producer, fcm_token from (select *, row_number() over (partition by did order by ts desc, event_id desc) rn
from registrations) where rn=1""",
}
