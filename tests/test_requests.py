"""Requests, access, datasets, reports."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.operators import access, datasets, exhaust, reports, requests, upserts, usage

JOBS = (
    "tag string, request_id string, job_id string, status string, request_data string, requested_by string, "
    "requested_channel string, dt_job_submitted timestamp, dt_job_completed timestamp, download_urls array<string>, "
    "err_message string, execution_time bigint, iteration int, encryption_key string"
)


def at(text):
    return datetime.datetime.fromisoformat(text)


def submission(seq, tag="harbour", by="tester-a", config="{}", day="2024-01-02"):
    return (seq, "scores", tag, "ch-1", by, datetime.date.fromisoformat(day), config)


SUBMISSION = "seq int, dataset string, client_tag string, channel string, requested_by string, submission_date date, dataset_config string"


def stored(row, status, iteration=None):
    return (row["tag"], row["request_id"], "scores", status, "{}", "old", "ch-1", at("2023-03-14"), at("2023-03-15"), ["u"], "e", 10, iteration, None)


def test_submissions(spark):
    rows = [submission(1, by="a"), submission(2, by="b"), submission(3, by="c"), submission(4, by="d")]
    resolved = requests.resolve(spark.createDataFrame(rows, SUBMISSION))
    by = {r["requested_by"]: r for r in resolved.collect()}
    assert by["a"]["tag"] == "harbour:ch-1"
    jobs = spark.createDataFrame(
        [stored(by["a"], "FAILED", 2), stored(by["b"], "SUCCESS", 1), stored(by["c"], "failed"), ("t", "r", "x", "SUCCESS", "{}", "y", "z", at("2020-01-01"), None, None, None, None, None, None)],
        JOBS,
    )
    merged = {r["request_id"]: r for r in requests.merge_submissions(jobs, resolved).collect()}
    assert len(merged) == 5
    failed, done, lower, new = (merged[by[k]["request_id"]] for k in "abcd")
    assert (failed["status"], failed["action"], failed["iteration"], failed["requested_by"]) == ("SUBMITTED", "resubmitted", 2, "a")
    assert failed["download_urls"] == ["u"] and failed["dt_job_submitted"] == at("2024-01-02")
    assert (done["status"], done["action"], done["requested_by"], done["iteration"]) == ("SUCCESS", "unchanged", "old", 1)
    assert (lower["status"], lower["iteration"]) == ("SUBMITTED", 0)
    assert (new["status"], new["action"], new["iteration"], new["download_urls"]) == ("SUBMITTED", "inserted", 0, None)
    assert merged["r"]["action"] == "kept"


def test_same_request_twice_in_a_batch(spark):
    resolved = requests.resolve(spark.createDataFrame([submission(2), submission(1)], SUBMISSION))
    merged = requests.merge_submissions(spark.createDataFrame([], JOBS), resolved).collect()
    assert len(merged) == 1 and merged[0]["status"] == "SUBMITTED"


def test_type_and_channel_change_the_id(spark):
    rows = [submission(1), submission(2, config='{"type":"x"}')]
    resolved = requests.resolve(spark.createDataFrame(rows, SUBMISSION)).orderBy("seq").collect()
    assert resolved[0]["request_id"] != resolved[1]["request_id"]
    assert [r["dataset_sub_id"] for r in resolved] == ["scores", "x"]


def test_responses(spark):
    done = ("t", "1", "d", "SUCCESS", "{}", "b", "c", at("2024-01-01"), at("2024-01-02"), ["https://h/c/a/f.csv", "wasb://c@h/g.csv"], None, 7, None, None)
    open_ = ("t", "2", "d", "SUBMITTED", "{}", "b", "c", at("2024-01-01"), None, ["https://h/c/a/f.csv"], "m", 7, 3, None)
    got = {r["request_id"]: r for r in requests.responses(spark.createDataFrame([done, open_], JOBS)).collect()}
    assert got["1"]["download_keys"] == ["a/f.csv", "g.csv"] and got["2"]["download_keys"] == []
    assert got["1"]["last_updated"] == 1704153600000 and got["2"]["last_updated"] == 1704067200000
    assert got["1"]["job_stats"].asDict() == {"dtJobSubmitted": 1704067200000, "dtJobCompleted": 1704153600000, "executionTime": 7}
    assert got["2"]["job_stats"].asDict() == {"dtJobSubmitted": 1704067200000, "dtJobCompleted": None, "executionTime": None}
    assert (got["1"]["attempts"], got["2"]["attempts"]) == (0, 3)
    assert "encryption_key" not in got["1"].asDict()


def test_newest_per_tag_and_plan(spark, plan):
    rows = [("t" if i % 3 else "hot", f"{i:03d}", at(f"2024-01-{1 + i % 28:02d}")) for i in range(90)]
    jobs = spark.createDataFrame(rows, "tag string, request_id string, dt_job_submitted timestamp")
    newest = requests.newest_per_tag(jobs, 5)
    for tag in ("t", "hot"):
        ours = [r["request_id"] for r in newest.filter(F.col("tag") == tag).orderBy("position").collect()]
        want = sorted((r for r in rows if r[0] == tag), key=lambda r: r[1])
        want = sorted(want, key=lambda r: r[2], reverse=True)[:5]
        assert ours == [r[1] for r in want]
    assert "WindowGroupLimit" in plan(newest)


def test_search(spark, plan):
    rows = [("t", str(i), "d" if i % 2 else "e", "SUCCESS", "c", at(f"2024-01-{1 + i:02d}T10:00:00")) for i in range(20)]
    jobs = spark.createDataFrame(rows, "tag string, request_id string, job_id string, status string, requested_channel string, dt_job_submitted timestamp")
    found = requests.search(jobs, {"dataset": "d", "status": None}, 3)
    assert [r["request_id"] for r in found.collect()] == ["19", "17", "15"]
    assert "TakeOrderedAndProject" in plan(found)
    assert requests.search_count(jobs, {"dataset": "d", "channel": "c"}).first()["total"] == 10
    assert [r["request_id"] for r in requests.search(jobs, {"requestedDate": "2024-01-05"}).collect()] == ["4"]
    with pytest.raises(ValueError):
        requests.search(jobs, {"owner": "x"})


ACCESS = "n int, channel string, consumer_id string, user_id string, has_token boolean, dataset_sub_id string"


@pytest.fixture
def people(spark):
    grants = spark.createDataFrame([("c1", "ch", 1), ("c2", "ch", 0)], "consumer_id string, channel string, status int")
    users = spark.createDataFrame(
        [
            ("admin", "CH", "slug", "other", ["ORG_ADMIN"]),
            ("chief", "zz", "zz", "Sunrise", ["X", "REPORT_ADMIN"]),
            ("plain", "ch", "ch", "other", ["PUBLIC"]),
            ("empty", "ch", "ch", "other", []),
        ],
        "user_id string, root_org_id string, root_org_slug string, root_org_channel string, roles array<string>",
    )
    roles = spark.createDataFrame([("own", ["PUBLIC"])], "dataset_sub_id string, authorized_roles array<string>")
    return grants, users, roles


def decisions(spark, people, rows, **options):
    grants, users, roles = people
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ACCESS)
    got = access.authorize(asked, grants, users, **({"dataset_roles": roles} | options)).orderBy("n").collect()
    return [(r["authorized"], r["reason"]) for r in got]


def test_consumer_access(spark, people):
    rows = [("ch", "c1", None, False, "d"), ("ch", "c2", None, False, "d"), ("ch", "c9", None, False, "d"), ("", "c1", None, False, "d")]
    refused = "Given X-Consumer-ID='{}' and X-Channel-ID='ch' are not authorized"
    assert decisions(spark, people, rows) == [
        (True, None),
        (False, refused.format("c2")),
        (False, refused.format("c9")),
        (False, "X-Channel-ID is missing in request header"),
    ]


def test_user_access(spark, people):
    no = (False, "You are not authorized.")
    rows = [("ch", "c9", u, True, d) for u in ("admin", "plain", "empty", "missing") for d in ("d", "own")]
    assert decisions(spark, people, rows) == [(True, None), no, no, (True, None), no, no, no, no]
    assert decisions(spark, people, [("other", "c1", "admin", True, "d")]) == [no]


def test_admin_access(spark, people):
    no = (False, "You are not authorized.")
    rows = [("SLUG", "c", "admin", True, "d"), ("ch", "c", "admin", True, "d"), ("any", "c", "chief", True, "d"), ("ch", "c", "plain", True, "d")]
    got = decisions(spark, people, rows, dataset_roles=None, admin_channel="sunrise", default_roles=access.STANDARD_ROLES)
    assert got == [(True, None), no, (True, None), no]


def test_access_plan_has_no_pairwise_join(spark, people, plan):
    grants, users, roles = people
    asked = spark.createDataFrame([(1, "ch", "c1", "admin", True, "d")], ACCESS)
    text = plan(access.authorize(asked, grants, users, roles))
    assert "NestedLoop" not in text and "Cartesian" not in text


CHANGES = "seq int, ts timestamp, report_id string, action string, description string, created_by string, report_schedule string, config string"


COMPLETE = '{"reportConfig":{"id":1},"store":"s","container":"c","key":"k"}'


def change(seq, report, action, text="d", config=COMPLETE):
    return (seq, at("2024-01-01") + datetime.timedelta(hours=seq), report, action, text, "u", "Weekly", config)


def test_report_changes(spark):
    rows = [
        change(1, "a", "update", "before birth"),
        change(2, "a", "submit", "born"),
        change(3, "a", "submit", "again"),
        change(4, "a", "deactivate"),
        change(5, "b", "submit", "b1"),
        change(6, "b", "deactivate"),
        change(7, "b", "update", "b2"),
        change(8, "c", "update", "never"),
    ]
    changes = spark.createDataFrame(rows, CHANGES)
    got = {r["report_id"]: r for r in reports.apply_changes(changes).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["description"], got["a"]["status"], got["a"]["status_msg"]) == ("born", "INACTIVE", "REPORT DEACTIVATED")
    assert got["a"]["created_on"] == at("2024-01-01T02:00:00") and got["a"]["updated_on"] == at("2024-01-01T04:00:00")
    assert (got["b"]["description"], got["b"]["status"]) == ("b2", "ACTIVE")
    answers = {r["seq"]: (r["accepted"], r["message"]) for r in reports.change_answers(changes).collect()}
    assert answers[1] == (False, "no report available with requested reportid")
    assert answers[3] == (False, "ReportId already Exists")
    assert answers[4] == (True, "Successfully DeActivated the Report")
    assert answers[2] == answers[7] == (True, None)


def test_invalid_changes_are_answered_and_not_applied(spark):
    rows = [
        change(1, "a", "submit", None),
        change(2, "a", "update", "too early"),
        change(3, "a", "submit", "born"),
        change(4, "a", "update", "lost", "{}"),
        change(5, None, "submit", "no id"),
    ]
    changes = spark.createDataFrame(rows, CHANGES)
    assert [(r["report_id"], r["description"]) for r in reports.apply_changes(changes).collect()] == [("a", "born")]
    answers = {r["seq"]: (r["accepted"], r["message"]) for r in reports.change_answers(changes).collect()}
    assert answers[2] == (False, "no report available with requested reportid") and answers[3] == (True, None)
    assert all(not answers[n][0] and '"status":"failed"' in answers[n][1] for n in (1, 4, 5))
    asked = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "n int, report_id string")
    read = {r["n"]: (r["message"], r["report"] is None) for r in reports.read_reports(reports.apply_changes(changes), asked).collect()}
    missing = ("no report available with requested reportid", True)
    assert read == {1: (None, False), 2: missing, 3: missing}


def test_report_changes_on_existing(spark):
    first = reports.apply_changes(spark.createDataFrame([change(1, "a", "submit", "a1"), change(2, "z", "submit", "z1")], CHANGES))
    later = [change(10, "a", "submit", "ignored"), change(11, "a", "deactivate"), change(12, "n", "submit", "n1")]
    whole = [change(1, "a", "submit", "a1"), change(2, "z", "submit", "z1"), *later]
    step = reports.apply_changes(spark.createDataFrame(later, CHANGES), first)
    once = reports.apply_changes(spark.createDataFrame(whole, CHANGES))
    assert sorted(step.collect()) == sorted(once.select(*step.columns).collect())


def test_report_list_needs_status(spark):
    registry = reports.apply_changes(spark.createDataFrame([change(1, "a", "submit")], CHANGES))
    assert reports.list_reports(registry, {"status": ["ACTIVE", "INACTIVE"]}).count() == 1
    with pytest.raises(ValueError):
        reports.list_reports(registry, {})


def test_upsert_and_latest(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, None), ("k", 2, "b"), ("j", 1, "c")], "k string, o int, v string")
    assert sorted(map(tuple, upserts.latest_by_key(rows, ["k"], ["o"]).collect())) == [("j", 1, "c"), ("k", 3, None)]
    assert sorted(map(tuple, upserts.first_by_key(rows, ["k"], ["o"]).collect())) == [("j", 1, "c"), ("k", 1, "a")]
    merged = upserts.upsert(rows.filter("o = 1"), spark.createDataFrame([("k", 9, "new")], rows.schema), ["k"])
    assert sorted(map(tuple, merged.collect())) == [("j", 1, "c"), ("k", 9, "new")]


def test_channel_files(spark):
    files = spark.createDataFrame(
        [("base/raw/ch/2019-03-14-1.gz",), ("base/raw/ch/2019-03-15-1.gz",), ("base/raw/other/2019-03-14-1.gz",), ("base/raw/ch/undated.gz",)],
        "path string",
    )
    asked = spark.createDataFrame(
        [(1, "raw", "ch", "2019-03-14", "2019-03-14", None), (2, "raw", "ch", "2019-03-01", "2019-03-15", "2019-03-15"), (3, "raw", "ch", None, None, None),
         (4, "raw", "ch", "2019-03-14", "2019-03-14", None), (5, "raw", "ch", "soon", "2019-03-14", None)],
        "seq int, dataset_id string, channel string, from_day string, to_day string, since_day string",
    )
    as_of = F.lit("2019-03-15").cast("date")
    windows = datasets.channel_windows(asked, as_of, {"default": "base/"})
    listed = datasets.window_files(windows, files)
    got = sorted((r["start"], r["end"], r["period"]) for r in listed.collect())
    assert got == [
        ("2019-03-14", "2019-03-14", "2019-03-14"),
        ("2019-03-14", "2019-03-15", "2019-03-14"),
        ("2019-03-14", "2019-03-15", "2019-03-15"),
        ("2019-03-15", "2019-03-15", "2019-03-15"),
    ]
    answers = {r["seq"]: (r["response_code"], r["files"]) for r in datasets.window_answers(windows, listed, ["seq"], False).collect()}
    assert answers == {1: ("OK", 1), 2: ("OK", 1), 3: ("OK", 2), 4: ("OK", 1), 5: ("CLIENT_ERROR", 0)}


def test_public_precedence(spark):
    asked = spark.createDataFrame(
        [
            (1, "open", "2024-01-01", "2024-01-02", None, "2024-01-05", "LAST_DAY"),
            (2, "open", "2024-01-01", "2024-01-02", None, "2024-01-05", None),
            (3, "open", "2024-01-01", "2024-01-02", None, None, None),
            (4, "open", None, None, None, None, None),
            (5, "open", None, None, None, None, "NEVER"),
            (6, "closed", None, None, None, None, None),
        ],
        "seq int, dataset_id string, from_day string, to_day string, since_day string, on_day string, date_range string",
    )
    windows = datasets.public_windows(asked, F.lit("2024-01-10").cast("date"), {"default": "base/"}, ["open"])
    got = {r["seq"]: r for r in windows.collect()}
    assert [(got[i]["start"], got[i]["end"]) for i in (1, 2, 3, 4)] == [
        ("2024-01-09", "2024-01-10"),
        ("2024-01-05", "2024-01-05"),
        ("2024-01-01", "2024-01-02"),
        ("2024-01-09", "2024-01-10"),
    ]
    assert got[5]["failure"].startswith("Provided dateRange NEVER is not valid.")
    assert got[6]["failure"] == "Provided dataset is invalid. Please use any one from this list - [open]"


TELEMETRY = "ts timestamp, event_day date, eid string, did string, channel string, pdata_id string, tags array<string>, value double"


def test_exhaust_filters_and_formats(spark, tmp_path):
    rows = [(at(f"2024-01-0{d}T01:00:00"), datetime.date(2024, 1, d), "E" if d % 2 else "F", "d", "c", "app", ["x", f"t{d}"], 1.0) for d in range(1, 8)]
    telemetry = spark.createDataFrame(rows, TELEMETRY)
    assert exhaust.extract(telemetry, "2024-01-02", "2024-01-05").count() == 4
    assert exhaust.extract(telemetry, "2024-01-01", "2024-01-07", events=["E"], tags=["t3", "t4"]).count() == 1
    assert exhaust.extract(telemetry, "2024-01-01", "2024-01-07", app_id="web").count() == 0
    out = str(tmp_path / "out")
    exhaust.write(telemetry, out)
    pruned = exhaust.extract(spark.read.schema(TELEMETRY).json(out), "2024-01-02", "2024-01-03")
    assert pruned.count() == 2
    assert "PartitionFilters: [isnotnull(event_day" in pruned._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        exhaust.write(telemetry, out, "xml")


def test_sketches_are_close_to_exact(spark):
    rows = spark.range(20000).selectExpr(
        "timestamp_seconds(1704067200 + id * 60) ts", "'c' channel", "'a' app_id", "'t' type", "concat('d', id % 5000) did",
        "concat('u', id % 3000) user_id", "concat('x', id % 100) content_id", "1.0D time_spent",
    )
    rolled = usage.roll_up(usage.daily_sketches(rows), ["channel"]).first()
    for name, exact in (("total_unique_users", 3000), ("total_contents", 100), ("total_device_ids", 5000)):
        assert abs(rolled[name] - exact) <= exact * 0.05
    assert rolled["total_interactions"] == 20000


def test_report_rejects_unknown_parts(spark):
    rows = spark.createDataFrame([], TELEMETRY)
    spec = {
        "id": "r",
        "dateRange": {"staticInterval": "Last7Days"},
        "metrics": [{"druidQuery": {"dimensions": [], "aggregations": [{"name": "n", "type": "count"}], "filters": []}}],
        "output": [{"type": "csv", "metrics": ["n"], "dims": []}],
    }
    assert set(usage.run_report(rows, spec, "2024-01-01")) == {"r"}
    query = spec["metrics"][0]["druidQuery"]
    for broken in (
        {**spec, "extra": 1},
        {**spec, "dateRange": {"staticInterval": "Sometime"}},
        {**spec, "dateRange": {"staticInterval": "LastDay", "granularity": "hour"}},
        {**spec, "output": [{"type": "csv", "metrics": ["other"], "dims": []}]},
        {**spec, "output": [{"type": "csv", "metrics": ["n"], "dims": ["absent"]}]},
        {**spec, "metrics": [{"druidQuery": {**query, "filters": [{"type": "regex", "dimension": "eid"}]}}]},
        {**spec, "metrics": [{"druidQuery": {**query, "aggregations": [{"name": "n", "type": "median"}]}}]},
    ):
        with pytest.raises(ValueError):
            usage.run_report(rows, broken, "2024-01-01")


def test_report_days():
    day = datetime.date(2024, 3, 13)
    assert usage.report_days({"staticInterval": "LastDay"}, day) == (datetime.date(2024, 3, 12),) * 2
    assert usage.report_days({"staticInterval": "LastWeek"}, day) == (datetime.date(2024, 3, 4), datetime.date(2024, 3, 10))
    assert usage.report_days({"staticInterval": "LastMonth"}, day) == (datetime.date(2024, 2, 1), datetime.date(2024, 2, 29))
    bounds = {"interval": {"startDate": "2024-01-02", "endDate": "2024-01-05"}}
    assert usage.report_days(bounds, day) == (datetime.date(2024, 1, 2), datetime.date(2024, 1, 5))
