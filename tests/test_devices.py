"""Enrichment, events, profiles and counters on small inputs."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import devices, geo
from tidewell.sources import documents, manifests, tables

ROW = (
    "event_id bigint, ts timestamp, did string, header_ip string, ip_addr string, fcm_token string, producer string, "
    "dspec string, uaspec string, user_declared_state string, user_declared_district string"
)
UA = "Mozilla/5.0 (Macintosh; Intel Mac OS X 12_6) AppleWebKit/605.1 (KHTML, like Gecko) Chrome/99.4.1.2 Safari/605.1"
SPEC = '{"cpu":"two  cores","make":"Acme pad 3","os":"Android 12"}'


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def row(n, did="dev-alpha", header="68.10.20.7", body=None, token="push-7", producer="app", spec=SPEC, ua=UA, state="Rogaland", district="sandnes", minute=None):
    return (n, at(n if minute is None else minute), did, header, body, token, producer, spec, ua, state, district)


@pytest.fixture(scope="module")
def index(spark):
    ranges = spark.createDataFrame([(1141511168, 1141511199, 501), (1291911744, 1291911759, 502)], "network_start_integer bigint, network_last_integer bigint, geoname_id int")
    cities = spark.createDataFrame(
        [
            (501, "Europe", "NO", "Norway", "VL", "Vestland", "", "Bergen", "Vest", "46", "Bergenhus"),
            (502, "Europe", "NO", "Norway", "VL", "Vestland", None, "", "", "46", "Bergenhus"),
        ],
        "geoname_id int, continent_name string, country_iso_code string, country_name string, subdivision_1_iso_code string, "
        "subdivision_1_name string, subdivision_2_name string, city_name string, subdivision_1_custom_name string, "
        "subdivision_1_custom_code string, subdivision_2_custom_name string",
    )
    return geo.build_index(ranges, tables.locations(cities))


def enriched(spark, index, *rows):
    return devices.enrich(spark.createDataFrame(list(rows), ROW), index)


def test_event(spark, index):
    event = json.loads(devices.device_events(enriched(spark, index, row(1), row(2, header="192.1.1.1"), row(3, header="x"))).first()["value"])
    assert event == {
        "device_id": "dev-alpha", "country_code": "NO", "country": "Norway", "state_code": "VL", "state": "Vestland",
        "city": "Bergen", "state_custom": "Vest", "state_code_custom": "46", "district_custom": "Bergenhus",
        "device_spec": SPEC, "uaspec": json.dumps({"agent": "Chrome", "ver": "99.4.1.2", "system": "Mac OSX", "raw": UA}, separators=(",", ":")),
        "fcm_token": "push-7", "producer_id": "app", "api_last_updated_on": 1704067260000, "first_access": 1704067260000,
        "user_declared_state": "Rogaland", "user_declared_district": "sandnes",
    }


def test_event_leaves_out_what_is_absent(spark, index):
    event = json.loads(devices.device_events(enriched(spark, index, row(1, spec=None, ua=None, state=None, district=None, token=None))).first()["value"])
    assert event["device_spec"] == "{}"
    assert not {"uaspec", "user_declared_state", "user_declared_district", "fcm_token"} & set(event)


def test_blank_and_invalid_are_not_published(spark, index):
    frame = enriched(spark, index, row(1), row(2, header="192.1.1.1"), row(3, header="bad"), row(4, header="192.1.1.1", body="91.5.5.5"))
    assert [r["ip_status"] for r in frame.orderBy("event_id").collect()] == ["ok", "blank", "invalid", "ok"]
    assert devices.device_events(frame).count() == 2


def test_profile_keeps_latest_non_empty(spark, index):
    rows = [
        row(1, token="t1", state="s1", district="d1"),
        row(3, token="", state=None, district="d3", header="91.5.5.5"),
        row(2, token="t2", state="", district=None, producer="late"),
    ]
    got = devices.profile_state(enriched(spark, index, *rows)).first()
    assert (got["fcm_token"], got["user_declared_state"], got["user_declared_district"], got["producer"]) == ("t2", "s1", "d3", "app")
    assert (got["geoname_id"], got["city"], got["state_custom"]) == ("0", "Bergen", "Vest")
    assert got["uaspec"].startswith('{"agent":"Chrome"') and got["devicespec"] == SPEC


def test_profile_without_declared_fields(spark, index):
    got = devices.profile_state(enriched(spark, index, row(1, spec=None, state=None, district=None))).first()
    assert got["user_declared_state"] is None and got["devicespec"] is None and got["geoname_id"] == "501"


def test_profile_is_mergeable(spark, index):
    rows = [row(n, did=f"d{n % 3}", token="" if n % 4 else f"t{n}", minute=(n * 7) % 20) for n in range(30)]
    updates = devices.profile_updates(enriched(spark, index, *rows))
    whole = devices.newest_fields(updates)
    early, late = (devices.newest_fields(updates.filter(c)) for c in ("event_id % 2 = 0", "event_id % 2 = 1"))
    assert sorted(whole.collect()) == sorted(devices.merge_stamped(late.unionByName(early)).collect())


def test_read_profiles(spark, index):
    profiles = spark.createDataFrame([("a", "Nordland", "Bodo"), ("b", "", "x"), ("c", "S", None)], "did string, user_declared_state string, user_declared_district string")
    asked = spark.createDataFrame([("a", "77.1.2.70"), ("b", "77.1.2.70"), ("c", "1.1.1.1"), ("d", "77.1.2.70"), ("e", ""), ("f", "x")], "did string, header_ip string")
    got = {r["did"]: tuple(r)[2:] for r in devices.read_profiles(asked, profiles, index).select("did", "header_ip", "ip_state", "ip_district", "declared_state", "declared_district").collect()}
    assert got == {"a": ("", "Bergenhus", "Nordland", "Bodo"), "b": ("", "Bergenhus", None, None), "c": ("", "", "S", None), "d": ("", "Bergenhus", None, None)}


def test_counters(spark, index):
    rows = [row(1), row(2), row(3, header="91.5.5.5"), row(4, header="bad"), row(5, header="192.1.1.1"), row(40)]
    counted = devices.metrics_events(devices.count_registrations(devices.outcomes(enriched(spark, index, *rows))))
    first, second = counted.orderBy("window_start_ms").collect()
    assert tuple(first)[1:7] == (5, 3, 2, 1, 1, 3) and tuple(second)[1:7] == (1, 1, 1, 0, 0, 1)
    assert json.loads(first["value"]) == {
        "job-name": "DeviceRegisterAPI", "api-version": "v1", "timestamp": 1704067200000 + 1800000, "api-calls": 5,
        "location-db-hit-count": 3, "location-db-success-count": 2, "location-db-miss-count": 1,
        "location-db-error-count": 1, "log-device-register-success-count": 3,
    }


def test_enrichment_has_no_pairwise_join(spark, index, plan):
    text = plan(enriched(spark, index, row(1)))
    assert "Python" not in text and "NestedLoop" not in text and "Cartesian" not in text


def test_repeated_places_do_not_multiply_rows(spark):
    ranges = spark.createDataFrame([(1141511168, 1141511199, 501)], "network_start_integer bigint, network_last_integer bigint, geoname_id int")
    names = list(tables.LOCATION_NAMES)
    cities = spark.createDataFrame([(501, *["old"] * 10, 1), (501, *["new"] * 10, 2), (501, *["older"] * 10, 0)], ", ".join(["geoname_id int", *[f"{n} string" for n in names[1:]], "loaded int"]))
    got = enriched(spark, geo.build_index(ranges, tables.locations(cities)), row(1), row(2)).collect()
    assert [r["city"] for r in got] == ["new", "new"]


def test_parse_registrations(spark):
    full = {"id": "x", "request": {"ip_addr": "1.1.1.1", "fcmToken": "t", "producer": "p", "first_access": 5, "dspec": {"os": "A", "n": {"b": 1}}, "userDeclaredLocation": {"state": "s", "district": "d"}, "ext": {"userid": "u", "url": "/x"}, "other": 1}}
    rows = spark.createDataFrame([(1, json.dumps(full)), (2, '{"request":{}}'), (3, "{}"), (4, "broken")], "n int, body string")
    got = {r["n"]: tuple(r)[1:] for r in documents.parse_registrations(rows).collect()}
    assert got[1] == ("1.1.1.1", "t", "p", 5, '{"os":"A","n":{"b":1}}', "s", "d", "u", "/x")
    assert got[2] == got[3] == got[4] == (None,) * 9


def test_parse_users(spark):
    docs = [
        '{"rootOrg":{"id":"o","slug":"s","channel":"c"},"organisations":[{"roles":["A","B"]},{"roles":["C"]},{}]}',
        "{}",
        '{"rootOrg":{},"organisations":[]}',
    ]
    got = documents.parse_users(spark.createDataFrame([(d,) for d in docs], "document string")).collect()
    assert tuple(got[0]) == ("o", "s", "c", ["A", "B", "C"])
    assert tuple(got[1]) == tuple(got[2]) == ("", "", "", [])


def test_admin_slug(spark):
    docs = ['{"content":[{"slug":"first"},{"slug":"second"}]}', '{"content":[]}', '{"content":[{}]}', "{}"]
    rows = spark.createDataFrame([(d,) for d in docs], "d string")
    assert [r[0] for r in rows.select(documents.admin_slug(F.col("d"))).collect()] == ["first", "", "", ""]


def test_tables_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3)], "network_start_integer bigint, network_last_integer bigint, geoname_id int")
    path = str(tmp_path / "ranges")
    for fmt in ("parquet", "orc", "json", "csv"):
        rows.write.format(fmt).mode("overwrite").save(f"{path}-{fmt}")
        assert tables.read_table(spark, "geo_location_city_ipv4", f"{path}-{fmt}", fmt).collect() == rows.collect()
    (tmp_path / "files" / "a").mkdir(parents=True)
    (tmp_path / "files" / "a" / "2024-01-01.gz").write_bytes(b"12345")
    got = manifests.list_files(spark, str(tmp_path / "files")).collect()
    assert len(got) == 1 and got[0]["path"].endswith("a/2024-01-01.gz") and got[0]["length"] == 5


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":1,"extra":2}\n{}\nnot json\n{"a":3}\n')
    assert sorted(r["a"] for r in tables.json_lines(spark, str(tmp_path / "x.json"), "a int").collect()) == [1, 3]
