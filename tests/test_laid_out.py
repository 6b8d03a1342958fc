"""Registries that are upserted in place, and tables laid out for search."""

import glob
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewell.operators import requests, upserts
from tidewell.sources import laid_out


@pytest.fixture
def registry(spark, tmp_path):
    table = laid_out.Registry(spark, f"registry_{uuid.uuid4().hex}", f"{tmp_path}/registry", ["tag", "id"], parts=16)
    rows = spark.range(500).selectExpr("concat('t', id % 7) tag", "concat('r', id) id", "'old' state", "id * 2 n")
    table.create(rows)
    yield table
    spark.sql(f"drop table {table.name}")


def incoming(spark, *rows):
    return spark.createDataFrame(list(rows), "tag string, id string, state string, n long")


def replace(stored, new):
    return upserts.upsert(stored, new, ["tag", "id"])


def test_upsert(spark, registry):
    before = {(r["tag"], r["id"]): r for r in registry.read().collect()}
    new = incoming(spark, ("t1", "r1", "new", 1), ("t9", "r1", "added", 2), ("t2", "r9", "new", 3))
    registry.upsert(new, replace)
    after = {(r["tag"], r["id"]): r for r in registry.read().collect()}
    changed = {k: (r["state"], r["n"]) for k, r in after.items() if before.get(k) != r}
    assert changed == {("t1", "r1"): ("new", 1), ("t9", "r1"): ("added", 2), ("t2", "r9"): ("new", 3)}
    assert set(before) <= set(after) and registry.read().count() == 501
    registry.upsert(new, replace)  # a repeated upsert
    assert {(r["tag"], r["id"]): r for r in registry.read().collect()} == after


def test_only_touched_partitions_are_written(spark, registry):
    def files():
        return {f.split("/part=")[1].split("/")[0]: f for f in glob.glob(f"{registry.folder}/part=*/*.parquet")}, set(
            glob.glob(f"{registry.folder}/part=*/*.parquet")
        )

    new = incoming(spark, ("t1", "r1", "new", 1))
    (part,) = registry.touched(new)
    _, before = files()
    registry.upsert(new, replace)
    _, after = files()
    assert {f.split("/part=")[1].split("/")[0] for f in before ^ after} == {str(part)}


def test_stored_rows_are_not_shuffled(spark, registry, plan):
    def merge(stored, new):
        flagged = new.select("tag", "id", F.lit(True).alias("incoming"))
        return stored.join(flagged, ["tag", "id"], "full_outer")

    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(registry.merged(incoming(spark, ("t1", "r1", "new", 1)), merge))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
    assert "PartitionFilters: [(part" in text or "PartitionFilters: [isnotnull(part" in text, text


def test_a_failed_upsert_leaves_the_table(spark, registry):
    before = registry.read().count()

    def broken(stored, new):
        return stored.withColumn("n", F.raise_error(F.lit("broken")).cast("long"))

    with pytest.raises(Exception, match="broken"):
        registry.upsert(incoming(spark, ("t1", "r1", "new", 1)), broken)
    assert registry.read().count() == before


JOBS = "tag string, request_id string, job_id string, status string, requested_channel string, dt_job_submitted timestamp"


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    """The same 20,000 requests as they come, and laid out for search, with 64 files each."""
    rows = spark.range(20_000).selectExpr(
        "concat('t', id) tag", "md5(cast(id as string)) request_id", "concat('d', pmod(xxhash64(id, 1), 10)) job_id",
        "element_at(array('SUBMITTED', 'FAILED', 'SUCCESS', null), cast(1 + pmod(xxhash64(id, 2), 4) as int)) status",
        "concat('ch-', pmod(xxhash64(id, 3), 40)) requested_channel", "timestamp_seconds(1700000000 + pmod(xxhash64(id, 4), 8640000)) dt_job_submitted",
    )
    folder = str(tmp_path_factory.mktemp("search"))
    with laid_out.setting(spark, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):
        rows.repartition(64).write.parquet(f"{folder}/plain")
    laid_out.write_for_search(rows, f"{folder}/curve", ["requested_channel", "job_id", "dt_job_submitted"], ["request_id"], files=64)
    return folder


def files_in_range(folder, column, low, high):
    """The files that may hold a value of a range, by their statistics."""
    found = set()
    for path in glob.glob(f"{folder}/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        if any(s.min <= high and s.max >= low for s in stats if s.has_min_max):
            found.add(path)
    return found


def test_files_are_ruled_out_by_every_column(searched):
    import datetime

    day = datetime.datetime(2023, 12, 24, tzinfo=datetime.timezone.utc)
    ranges = {"requested_channel": ("ch-17", "ch-17"), "job_id": ("d3", "d3"), "dt_job_submitted": (day, day + datetime.timedelta(days=1))}
    for column, (low, high) in ranges.items():
        assert len(files_in_range(f"{searched}/plain", column, low, high)) == 64
    left = {column: files_in_range(f"{searched}/curve", column, low, high) for column, (low, high) in ranges.items()}
    assert all(len(files) <= 40 for files in left.values()), {c: len(f) for c, f in left.items()}
    # A search over two columns, and over all three.
    for one, other in (("requested_channel", "job_id"), ("job_id", "dt_job_submitted"), ("requested_channel", "dt_job_submitted")):
        assert len(left[one] & left[other]) <= 20, (one, other)
    assert len(set.intersection(*left.values())) <= 10


def test_the_same_rows_are_found(spark, searched):
    plain, curve = (spark.read.parquet(f"{searched}/{name}") for name in ("plain", "curve"))
    assert plain.count() == curve.count() == 20_000 and plain.columns == curve.columns
    for filters in ({"dataset": "d3", "channel": "ch-17"}, {"status": "FAILED", "requestedDate": "2023-12-24"}, {"channel": "ch-5", "dataset": "d1", "requestedDate": "2024-01-02"}):
        assert requests.search(plain, filters).collect() == requests.search(curve, filters).collect()
        assert requests.search_count(plain, filters).first() == requests.search_count(curve, filters).first()


def test_bloom_filters_are_written(searched):
    for path in glob.glob(f"{searched}/curve/*.parquet"):
        raw = open(path, "rb").read()
        group = pq.ParquetFile(path).metadata.row_group(0)
        # The filter lies behind the data of the row group and before the footer.
        end = max(group.column(i).file_offset or 0 for i in range(group.num_columns))
        assert len(raw) > end + 1_000


def test_curve_takes_missing_values(spark):
    rows = spark.createDataFrame([(None, None), ("a", 1), ("b", None), (None, 2)], "s string, n int")
    places = {(r["s"], r["n"]): r["place"] for r in rows.withColumn("place", laid_out.curve(rows, ["s", "n"])).collect()}
    assert places[None, None] == 0 and len(set(places.values())) == 4
    assert spark.createDataFrame([], "s string").withColumn("p", laid_out.curve(spark.createDataFrame([], "s string"), ["s"])).count() == 0
