"""Rule messages, as clients see them."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import client_logs, validation
from tidewell.operators.rules import all_failures, first_failure, with_status



def day(text):
    return F.lit(text).cast("date")


def text(value):
    return F.lit(value).cast("string")


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_first_failure_stops_at_the_first(spark):
    checks = [(F.lit(False), "a"), (F.lit(True), "b"), (F.lit(True), "c")]
    assert one(spark, first_failure(checks)) == "b"
    assert one(spark, first_failure([(F.lit(False), "a")])) is None


def test_all_failures_later_overwrites(spark):
    failures = all_failures([("x", F.lit(True), "1"), ("x", F.lit(True), "2"), ("y", F.lit(False), "3")])
    assert one(spark, with_status(failures)) == {"x": "2", "status": "failed"}
    assert one(spark, with_status(all_failures([("x", F.lit(False), "1")]))) == {"status": "success"}


@pytest.mark.parametrize(
    "tag, dataset, config, message",
    [
        (None, None, None, "tag is empty"),
        ("t", None, None, "dataset is empty"),
        ("t", "d", None, "datasetConfig is empty"),
        ("t", "d", "{}", None),
        ("", "", "", None),
    ],
)
def test_submit(spark, tag, dataset, config, message):
    assert one(spark, validation.submit_failure(text(tag), text(dataset), text(config))) == message


@pytest.mark.parametrize(
    "start, end, public, message",
    [
        ("2019-03-04", "2019-03-24", False, "Date range should be < 10 days"),
        ("2019-03-04", "2019-03-14", False, None),
        ("2019-03-04", "2019-03-15", False, "Date range should be < 10 days"),
        ("2019-04-11", "2019-03-24", False, "Date range should not be -ve. Please check your 'from' & 'to'"),
        ("2019-03-04", "2999-03-14", False, "'to' should be LESSER OR EQUAL TO today's date.."),
        ("2011-07-08", "2011-07-08", True, "Date range cannot be older than 2 months"),
        ("2024-01-01", "2024-01-15", True, None),
        ("soon", "2024-01-15", True, "Please give 'from' & 'to' as dates in the format yyyy-MM-dd"),
        ("2024-01-01", "2024-02-31", False, "Please give 'from' & 'to' as dates in the format yyyy-MM-dd"),
        ("2023-11-15", "2023-12-15", True, None),
        ("2023-11-14", "2023-11-14", True, "Date range cannot be older than 2 months"),
        ("2023-11-15", "2023-12-16", True, "Date range should be < 30 days"),
    ],
)
def test_window(spark, start, end, public, message):
    got = validation.window_failure(text(start), text(end), day("2024-01-15"), F.lit(public))
    assert one(spark, got) == message


SCHEMA = json.dumps(
    {
        "type": "object",
        "properties": {"tag": {"type": "string"}, "n": {"type": "number"}, "list": {"type": "array"}},
        "required": ["tag", "dataset"],
    }
)


@pytest.mark.parametrize(
    "body, message",
    [
        ({"tag": "a"}, 'Request object has missing required properties (["dataset"])'),
        ({}, 'Request object has missing required properties (["tag","dataset"])'),
        ({"tag": "a", "dataset": "b"}, None),
        ({"tag": "a", "dataset": "b", "n": 1, "list": []}, None),
        ({"tag": "a", "dataset": "b", "n": 1.5}, None),
        (
            {"tag": 5, "dataset": "b"},
            'Request instance type (integer) does not match any allowed primitive type (allowed: ["string"])',
        ),
        (
            {"tag": "a", "dataset": "b", "n": "x"},
            'Request instance type (string) does not match any allowed primitive type (allowed: ["number"])',
        ),
        (
            {"tag": "a", "dataset": "b", "list": {"a": 1}},
            'Request instance type (object) does not match any allowed primitive type (allowed: ["array"])',
        ),
        (
            {"tag": None, "dataset": "b"},
            'Request instance type (null) does not match any allowed primitive type (allowed: ["string"])',
        ),
        (
            {"tag": True, "dataset": "b"},
            'Request instance type (boolean) does not match any allowed primitive type (allowed: ["string"])',
        ),
    ],
)
def test_schema(spark, body, message):
    assert violation(spark, body, SCHEMA) == message


def violation(spark, body, schema):
    """What a body is answered by a dataset with a schema."""
    text = body if isinstance(body, str) else json.dumps(body)
    rows = spark.createDataFrame([(1, "d", text)], "n int, dataset_sub_id string, body string")
    rules = spark.createDataFrame([("d", schema if isinstance(schema, str) else json.dumps(schema))], "dataset_sub_id string, validation_json string")
    return validation.check_submissions(rows, rules).first()["failure"]


def experiment(spark, today="2024-01-15", missing=False, **fields):
    given = {
        "exp_id": "e",
        "name": "n",
        "created_by": "u",
        "criteria": '{"type":"user","filters":{"a":1}}',
        "data": '{"startDate":"2024-01-15","endDate":"2024-01-20"}',
        **fields,
    }
    columns = [text(given[k]) for k in ("exp_id", "name", "created_by", "criteria", "data")]
    return one(spark, with_status(validation.experiment_failures(*columns, day(today), F.lit(missing))))


def test_experiment_valid(spark):
    assert experiment(spark) == {"status": "success"}


def test_experiment_all_missing(spark):
    assert experiment(spark, exp_id=None, name=None, created_by=None, criteria=None, data=None) == {
        "status": "failed",
        "request.createdBy": "Criteria should not be empty",
        "request.expid": "Experiment Id should not be  empty",
        "request.data": "Experiment Data should not be empty",
        "request.name": "Experiment Name should not be  empty",
    }


def test_experiment_no_request(spark):
    assert experiment(spark, missing=True) == {"status": "failed", "request": "Request should not be empty"}


@pytest.mark.parametrize(
    "fields, key, message",
    [
        ({"criteria": '{"type":"user"}'}, "request.filters", "Criteria Filters should not be empty"),
        ({"criteria": '{"filters":{}}'}, "request.type", "Criteria Type should not be empty"),
        ({"data": '{"startDate":"2024-01-15"}'}, "data.endDate", "Experiment End_Date should not be empty"),
        ({"data": '{"startDate":"2024-01-15","endDate":"2024-01-14"}'}, "data.endDate", "End_Date should be greater than today's date."),
        ({"data": '{"endDate":"2024-01-15"}'}, "data.startDate", "Experiment Start_Date should not be empty"),
        (
            {"data": '{"startDate":"2024-01-14","endDate":"2024-01-15"}'},
            "data.startDate",
            "Start_Date should be greater than or equal to today's date..",
        ),
        (
            {"data": '{"startDate":"2037-05-19","endDate":"2036-11-02"}'},
            "data.startDate",
            "Date range should not be -ve. Please check your start_date & end_date",
        ),
    ],
)
def test_experiment_rule(spark, fields, key, message):
    assert experiment(spark, **fields) == {"status": "failed", key: message}


def report(spark, missing=False, **fields):
    given = {"id": "r", "description": "d", "by": "u", "config": '{"reportConfig":{},"store":"s","container":"c","key":"k"}', **fields}
    columns = [text(given[k]) for k in ("id", "description", "by", "config")]
    return one(spark, with_status(validation.report_failures(*columns, F.lit(missing))))


def test_report_all_missing(spark):
    assert report(spark, id=None, description=None, by=None, config=None) == {
        "status": "failed",
        "request.reportId": "Report Id should not be  empty",
        "request.createdBy": "Created By should not be empty",
        "request.config": "Config should not be empty",
        "request.description": "Report Description should not empty",
    }
    assert report(spark, missing=True) == {"status": "failed", "request": "Request should not be empty"}
    assert report(spark) == {"status": "success"}


@pytest.mark.parametrize(
    "config, key, message",
    [
        ("{}", "reportConfig", "Report Config  should not be empty"),
        ('{"reportConfig":{}}', "store", "Config Store should not be empty"),
        ('{"reportConfig":{},"store":"s"}', "container", "Config Container should not be empty"),
        ('{"reportConfig":{},"store":"s","container":"c"}', "key", "Config Key should not be empty"),
    ],
)
def test_report_config(spark, config, key, message):
    assert report(spark, config=config) == {"status": "failed", f"request.config.{key}": message}


GOOD = {"context": {"did": "d"}, "pdata": {"id": "i", "pid": "p", "ver": "1"}, "logs": [{"id": "x", "ts": 5, "log": "m"}]}


def _without(path, value=None):
    body = json.loads(json.dumps(GOOD))
    target = body
    *parents, last = path.split(".")
    for name in parents:
        target = target[int(name)] if name.isdigit() else target[name]
    if value is None:
        del target[last]
    else:
        target[last] = value
    return {"request": body}


@pytest.mark.parametrize(
    "body, message",
    [
        ({"request": GOOD}, None),
        ({}, "property: request is missing!"),
        ({"request": {}}, "property: context is missing!"),
        ({"request": {"context": {}}}, "property: pdata is missing!"),
        ({"request": {"context": {}, "pdata": {}}}, "property: logs is missing!"),
        (_without("context.did"), "property: context.did is null or empty!"),
        (_without("pdata.id"), "property: pdata.id is null or empty!"),
        (_without("pdata.pid", ""), "property: pdata.pid is null or empty!"),
        (_without("pdata.ver"), "property: pdata.ver is null or empty!"),
        (_without("logs", [{"id": "Test"}]), "property: logs, mandatory fields are missing or type mismatch!"),
        (_without("logs.0.ts", 0), "property: logs, mandatory fields are missing or type mismatch!"),
        (_without("logs.0.log", ""), "property: logs, mandatory fields are missing or type mismatch!"),
        (_without("logs", []), None),
    ],
)
def test_client_log(spark, body, message):
    rows = spark.createDataFrame([(json.dumps(body),)], "body string")
    got = client_logs.screen(rows).first()
    assert got["reason"] == message and got["accepted"] is (message is None)


def test_malformed_client_log_is_rejected(spark):
    rows = spark.createDataFrame([("not json",), (None,)], "body string")
    assert [r["reason"] for r in client_logs.screen(rows).collect()] == ["property: request is missing!"] * 2


def test_flat_lines(spark):
    rows = [(1, "d", "i", "p", "1", 5, "m"), (1, "d", "i", "p", "1", 6, "n"), (2, "d", "i", "p", "1", 5, "m"), (2, "d", "i", "p", "1", 0, "m"), (3, "", "i", "p", "1", 5, "")]
    lines = spark.createDataFrame(rows, "k int, did string, pdata_id string, pid string, ver string, ts bigint, log string")
    got = {r["k"]: (r["lines"], r["reason"]) for r in client_logs.screen_lines(lines, "k").collect()}
    assert got == {
        1: (2, None),
        2: (2, "property: logs, mandatory fields are missing or type mismatch!"),
        3: (1, "property: context.did is null or empty!"),
    }


def test_search_filters():
    with pytest.raises(ValueError, match="Filters are empty"):
        validation.check_search_filters({})
    with pytest.raises(ValueError, match="Unsupported filters"):
        validation.check_search_filters({"owner": "x"})
    validation.check_search_filters({"status": "x", "owner": "y"})


@pytest.mark.parametrize("filters", [None, {}, {"owner": "x"}, {"status": None}, {"status": "x", "owner": "y"}, {"dataset": "d"}])
def test_search_filters_as_a_column(spark, filters):
    """The column says what the argument check raises."""
    text = None if filters is None else json.dumps(filters)
    found = spark.createDataFrame([(text,)], "filters string").select(validation.search_filters_failure(F.col("filters"))).first()[0]
    try:
        validation.check_search_filters(filters)
        assert found is None
    except ValueError as wrong:
        assert found == str(wrong)


@pytest.mark.parametrize(
    "body, message",
    [
        ({"a": "x", "b": {"c": 1}}, None),
        ({"a": None, "b": {"c": 2.5}}, None),
        ({"a": 1, "b": {"c": 1}}, 'Request instance type (integer) does not match any allowed primitive type (allowed: ["string","null"])'),
        ({"a": "x", "b": {}}, 'Request object has missing required properties (["c"])'),
        ({"a": "x", "b": {"c": "t"}}, 'Request instance type (string) does not match any allowed primitive type (allowed: ["number"])'),
        ({"b": {}}, 'Request object has missing required properties (["a"])'),
        ({"a": "x", "b": [1]}, 'Request instance type (array) does not match any allowed primitive type (allowed: ["object"])'),
    ],
)
def test_type_lists_and_nested_rules(spark, body, message):
    rules = {
        "properties": {
            "a": {"type": ["string", "null"]},
            "b": {"type": "object", "required": ["c"], "properties": {"c": {"type": "number"}}},
        },
        "required": ["a"],
    }
    assert violation(spark, body, rules) == message


DEEP = {
    "required": ["config"],
    "properties": {
        "tag": {"type": "string"},
        "config": {
            "type": "object",
            "required": ["query"],
            "properties": {
                "query": {
                    "type": "object",
                    "required": ["filters", "o'clock"],
                    "properties": {
                        "filters": {"type": "object", "properties": {"a.b": {"type": "object", "required": ["deepest"], "properties": {"deepest": {"type": ["integer", "null"]}}}}},
                        'say "x"': {"type": "object", "required": ["y"]},
                    },
                },
                "mode": {"type": "string"},
            },
        },
    },
}
MISSING = 'Request object has missing required properties (["{}"])'
TYPE = 'Request instance type ({}) does not match any allowed primitive type (allowed: ["{}"])'


def deep(query, **others):
    return {"config": {"query": {"o'clock": 1, **query}, **others}}


@pytest.mark.parametrize(
    "body, message",
    [
        (deep({"filters": {"a.b": {"deepest": 3}}}), None),
        (deep({"filters": {"a.b": {"deepest": None}}}), None),
        (deep({"filters": {"a.b": {"deepest": 1.5}}}), TYPE.format("number", 'integer","null')),
        (deep({"filters": {"a.b": {}}}), MISSING.format("deepest")),
        (deep({"filters": {"a.b": []}}), TYPE.format("array", "object")),
        (deep({"filters": {}, 'say "x"': {}}), MISSING.format("y")),
        (deep({"filters": {"a.b": {}}}, mode=1), TYPE.format("integer", "string")),  # outer objects come first
        ({"config": {}}, MISSING.format("query")),
        ({"config": {"query": {}}}, MISSING.format('filters","o\'clock')),
        ({"config": 5}, TYPE.format("integer", "object")),
        ({}, MISSING.format("config")),
        ("not json", MISSING.format("config")),
        ("[1]", MISSING.format("config")),
    ],
)
def test_rules_at_any_depth(spark, body, message):
    assert violation(spark, body, DEEP) == message


def test_rules_without_content(spark):
    for schema in ("{}", '{"properties": {}}', '{"required": []}', '{"properties": {"a": {}}}', "no json"):
        assert violation(spark, {"a": 1}, schema) is None


def test_too_deep_schemas_are_refused(spark, monkeypatch):
    monkeypatch.setattr(validation, "MAX_DEPTH", 2)
    with pytest.raises(ValueError, match="deeper"):
        violation(spark, {}, DEEP)


def test_a_body_is_parsed_once(spark, plan):
    """However many rules there are, the plan holds one parse of the body and none of the schema."""
    wide = {"required": [f"r{i}" for i in range(30)], "properties": {f"p{i}": {"type": "string"} for i in range(30)}}
    rules = spark.createDataFrame([("d", json.dumps(wide))], "dataset_sub_id string, validation_json string")
    compiled = spark.createDataFrame(validation.compile_rules(rules).collect(), validation.compile_rules(rules).schema)
    rows = spark.range(5).selectExpr("id n", "'d' dataset_sub_id", "concat('{\"p1\":', id, '}') body")
    frame = validation.check_submissions(rows, compiled)
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parse_json") + text.count("parseJson") == 1 and "from_json" not in text
    assert frame.count() == 5
