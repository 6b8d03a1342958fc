"""Physical plans: no pairwise joins, no Python in the tasks, pruned scans, map-side combine."""

import re

import pytest

import __spark_entry__ as entry
from tidewell.operators import devices, exhaust, upserts
from tidewell.plans import catalogue, streams
from tidewell.plans import devices as plan_devices
from tidewell.plans import experiments as plan_experiments
from tidewell.plans import requests as plan_requests

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {n: entry.queries()[n] for n in catalogue.QUERIES if n not in streams.QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_join_and_no_python(spark, plan, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "NestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert word not in text, word


def _scans(text):
    return re.findall(r"FileScan parquet \[([^\]]*)\]", text)


def test_scans_read_only_what_is_used(spark, plan):
    text = plan(QUERIES["request_search_count"](spark, SF_DIR))
    columns = {re.sub(r"#\d+L?", "", c) for scan in _scans(text) for c in scan.split(",")}
    assert columns <= {"o_custkey", "o_orderstatus", "o_orderpriority", "c_custkey"}


def test_filters_reach_the_scan(spark, plan):
    rows = spark.read.parquet(f"{SF_DIR}/events.parquet").selectExpr("event_id", "event_type eid", "cast(ts as date) event_day")
    text = plan(exhaust.extract(rows, "2024-01-01", "2024-01-03", events=["click", "view"]))
    assert re.search(r"PushedFilters: \[.*LessThan\(ts,.*In\(event_", text)


def test_day_search_is_a_range_on_the_plain_column(spark, plan, tmp_path):
    from tidewell.operators import requests

    spark.sql("select 't' tag, '1' request_id, timestamp'2024-01-01 10:00:00' dt_job_submitted").write.parquet(f"{tmp_path}/j")
    found = requests.search(spark.read.parquet(f"{tmp_path}/j"), {"requestedDate": "2024-01-01"})
    assert re.search(r"PushedFilters: \[.*2024-01-01 00:00:00.0\), LessTha", plan(found))
    assert found.count() == 1


@pytest.mark.parametrize(
    "build",
    [
        lambda rows: upserts.latest_by_key(rows, ["did"], ["ts", "event_id"]),
        lambda rows: devices.newest_fields(rows, ["value"]),
        lambda rows: devices.merge_stamped(devices.newest_fields(rows, ["value"]), ["value"]),
    ],
)
def test_hot_keys_are_combined_before_the_shuffle(spark, plan, build):
    """A partial aggregate stands below the exchange, so a task sends one row per key."""
    rows = spark.range(100).selectExpr("if(id % 3 = 0, 'hot', concat('d', id)) did", "timestamp_seconds(id) ts", "id event_id", "cast(id as string) value")
    text = plan(build(rows))
    below = text[text.index("Exchange hashpartitioning(did") :]
    assert "partial_m" in below
    # Merging what is already one row per device needs no second exchange.
    assert text.count("Exchange hashpartitioning") == 1


WRITES = {
    "exhaust_csv", "exhaust_json", "client_log_sink", "json_lines_load", "dataset_file_listing", "stored_table_read",
    "experiment_documents", "exhaust_observed", "dataset_asked_files", "usage_fact", "usage_returning", "request_registry_upsert",
    "request_search_laid_out", "experiment_match_small_weight",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_building_a_query_starts_no_job(spark, name):
    """Nothing runs before the action but reading schemas; reference indexes are loaded once before."""
    plan_devices.geo_index(spark, SF_DIR)
    plan_experiments.experiment_index(spark, SF_DIR)
    plan_requests.rule_index(spark, SF_DIR)
    context = spark.sparkContext
    context.setJobGroup(f"build-{name}", name)
    QUERIES[name](spark, SF_DIR)
    tracker = context.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(f"build-{name}") for s in tracker.getJobInfo(job).stageIds]
    names = {tracker.getStageInfo(s).name.split(" ")[0] for s in stages}
    context.setLocalProperty("spark.jobGroup.id", None)
    assert names <= {"parquet", "sql"}
