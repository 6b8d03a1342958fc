"""The listing source, the event log that commits once, and observed exports."""

import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from tidewell.operators import exhaust
from tidewell.plans.streams import run_to_end
from tidewell.sources import listings
from tidewell.streaming import event_log


def day(n):
    return datetime.date(2024, 1, n)


@pytest.fixture
def tree(tmp_path):
    """Files of two datasets in two buckets, hidden and undated ones among them."""
    names = [
        "a/ex/raw/ch1/2024-01-01/1.json", "a/ex/raw/ch1/2024-01-01/sub/2.json", "a/ex/raw/ch1/2024-01-02/3.json", "a/ex/raw/ch1/undated.json",
        "a/ex/raw/ch2/2024-01-01/4.json", "a/ex/raw/ch1/2024-01-01/_SUCCESS", "a/ex/raw/ch1/2024-01-01/.x", "b/sum/ch1/2024-01-01/5.json",
    ]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * len(name))
    return {"sum": {"bucket": f"{tmp_path}/b"}, "default": {"bucket": f"file://{tmp_path}/a", "prefix": "ex/"}}


def reader(places, *filters):
    found = listings.FolderReader(places, listings.LAYOUT)
    assert list(found.pushFilters(list(filters))) == list(filters)
    return found


def test_only_asked_folders_are_listed(tree):
    asked = reader(
        tree, In(("dataset",), ("raw", "sum")), EqualTo(("channel",), "ch1"), GreaterThan(("day",), day(1)), LessThanOrEqual(("day",), day(3))
    ).partitions()
    assert [(f.path, f.bucket[-1]) for f in asked] == [
        ("ex/raw/ch1/2024-01-02", "a"), ("ex/raw/ch1/2024-01-03", "a"), ("sum/ch1/2024-01-02", "b"), ("sum/ch1/2024-01-03", "b"),
    ]


def test_days_may_be_named_and_filters_meet(tree):
    named = reader(tree, EqualTo(("dataset",), "raw"), In(("dataset",), ("raw", "sum")), EqualTo(("channel",), "ch1"), In(("day",), (day(1), day(5), None)), LessThanOrEqual(("day",), day(4)))
    assert [f.path for f in named.partitions()] == ["ex/raw/ch1/2024-01-01"]


@pytest.mark.parametrize(
    "filters", [[], [EqualTo(("dataset",), "raw")], [EqualTo(("dataset",), "raw"), EqualTo(("channel",), "c"), GreaterThan(("day",), day(1))]]
)
def test_what_is_asked_must_be_named(tree, filters):
    with pytest.raises(ValueError, match="name the"):
        reader(tree, *filters).partitions()


def test_a_dataset_needs_a_place(tree):
    filters = [EqualTo(("dataset",), "raw"), EqualTo(("channel",), "c"), EqualTo(("day",), day(1))]
    with pytest.raises(ValueError, match="no bucket"):
        reader({"sum": tree["sum"]}, *filters).partitions()


def test_listing(spark, tree):
    files = listings.asked_files(spark, tree).where("dataset in ('raw', 'sum') and channel in ('ch1', 'ch2')")
    found = files.where("day between date '2024-01-01' and date '2024-01-02'").collect()
    got = sorted((r["dataset"], r["channel"], r["day"].day, os.path.basename(r["path"]), r["length"]) for r in found)
    assert [g[:4] for g in got] == [
        ("raw", "ch1", 1, "1.json"), ("raw", "ch1", 1, "2.json"), ("raw", "ch1", 2, "3.json"), ("raw", "ch2", 1, "4.json"), ("sum", "ch1", 1, "5.json"),
    ]
    assert all(r["length"] == len(r["path"].split("/a/")[-1].split("/b/")[-1]) + 2 and r["modified"] for r in found)
    assert files.where("day = date '2025-01-01'").count() == 0


# -- the log -----------------------------------------------------------------------


def source(spark, folder, batches):
    for n, values in enumerate(batches):
        spark.createDataFrame([(v,) for v in values], "n int").repartition(2).write.mode("overwrite").parquet(f"{folder}/part={n}")
    return spark.readStream.schema("n int").option("maxFilesPerTrigger", 2).parquet(f"{folder}/part=*")


def values(spark, root):
    return sorted(r["value"] for r in event_log.read(spark, root).collect())


def test_a_broken_epoch_is_published_once(spark, tmp_path):
    """A task breaks after others have written; the restarted query publishes every event once."""
    root, flag = f"{tmp_path}/log", f"{tmp_path}/broken"

    def breaking(batches):
        for batch in batches:
            if 13 in batch.column("value").to_pylist() or "13" in batch.column("value").to_pylist():
                if not os.path.exists(flag):
                    open(flag, "w").close()
                    raise OSError("a task breaks")
            yield batch

    def run():
        rows = source_frame.select(F.col("n").cast("string").alias("value")).mapInArrow(breaking, "value string")
        run_to_end(event_log.publish(rows, root, f"{tmp_path}/c"))

    source_frame = source(spark, f"{tmp_path}/in", [range(5), range(10, 20), range(20, 23)])
    with pytest.raises(Exception, match="a task breaks"):
        run()
    assert os.path.exists(flag) and "13" not in values(spark, root)
    run()
    assert values(spark, root) == sorted(str(n) for n in [*range(5), *range(10, 20), *range(20, 23)])


def test_an_epoch_that_is_run_again_keeps_its_record(spark, tmp_path):
    """The record was written, but the stream stopped before its own checkpoint: the epoch's second run leaves one copy."""
    root = f"{tmp_path}/log"
    rows = source(spark, f"{tmp_path}/in", [range(4)]).select(F.col("n").cast("string").alias("value"))
    run_to_end(event_log.publish(rows, root, f"{tmp_path}/c1"))
    run_to_end(event_log.publish(rows, root, f"{tmp_path}/c2"))  # a lost checkpoint: the same epoch again
    assert values(spark, root) == ["0", "1", "2", "3"]
    parts = set(os.listdir(f"{root}/parts"))
    assert {n for n in parts if n.endswith(".parquet")} == {n for names in event_log.committed(root).values() for n in names}


def test_abort_drops_the_parts(tmp_path):
    import pyarrow as pa

    writer = event_log.LogWriter(str(tmp_path))
    message = writer.write(iter([pa.RecordBatch.from_pydict({"value": ["a"]})]))
    writer.abort([message, None], 0)
    assert os.listdir(f"{tmp_path}/parts") == [] and event_log.committed(str(tmp_path)) == {}
    assert writer.write(iter([])).names == []


def test_an_empty_log(spark, tmp_path):
    assert values(spark, f"{tmp_path}/none") == []


# -- observed exports ----------------------------------------------------------------


def test_observed_figures_equal_job_figures(spark, tmp_path, plan):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=i), day(1) + datetime.timedelta(days=i // 24), "abc"[i % 3], "x" if i % 2 else "y") for i in range(100)]
    telemetry = spark.createDataFrame(rows, "event_id int, ts timestamp, event_day date, eid string, channel string")
    condition = exhaust.export_condition("2024-01-02", "2024-01-03", channel="x", events=["a", "b"])
    groups = {name: F.col("eid") == name for name in ("a", "b", "c", "absent")}
    found = exhaust.write_observed(telemetry, condition, f"{tmp_path}/out", ["event_id", "eid"], groups)
    want = {r["eid"]: r.asDict() for r in exhaust.job_figures(telemetry, condition, ["eid"]).collect()}
    for name in ("a", "b", "c"):
        assert {**found[name], "eid": name} == want[name]
    assert found["c"]["output_events"] == 0 and found["c"]["dt_first_event"] is None
    assert found["absent"]["input_events"] == 0
    assert spark.read.json(f"{tmp_path}/out").count() == found["a"]["output_events"] + found["b"]["output_events"]
