"""Streams over several batches: late rows, repeated batches, expiry, refresh."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.operators import devices, experiments, geo
from tidewell.plans import streams
from tidewell.plans.streams import run_to_end
from tidewell.streaming import assignments, metrics, reference, registrations
from tidewell.streaming.tables import BatchTable, ProfileStore, latest_batch

from test_devices import ROW, row
from test_experiments import DOCS, doc


def files(spark, folder, batches, schema):
    """One input file per batch, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={n}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/part=*")
    )


@pytest.fixture(scope="module")
def index(spark):
    ranges = spark.createDataFrame([(1935923650, 1935923660, 1)], "network_start_integer bigint, network_last_integer bigint, geoname_id int")
    fields = ", ".join(f"{name} string" for name in geo.LOCATION_FIELDS)
    places = spark.createDataFrame([(1, *["x"] * len(geo.LOCATION_FIELDS))], f"geoname_id int, {fields}")
    return geo.build_index(ranges, places)


BATCHES = [
    [row(1, did="a", token="t1"), row(2, did="b", token="t2"), row(3, did="a", header="bad")],
    [row(20, did="a", token="", state="newer"), row(21, did="c", token="t21")],
    [row(5, did="a", token="t5", state="late"), row(70, did="b", token="t70")],
]


def test_registration_stream_equals_batch(spark, index, tmp_path):
    store, outcomes = ProfileStore(f"{tmp_path}/profiles"), BatchTable(f"{tmp_path}/outcomes")
    stream = files(spark, f"{tmp_path}/in", BATCHES, ROW)
    writer = registrations.register(
        stream, lambda: index, store, registrations.table_sink(f"{tmp_path}/events"), outcomes, f"{tmp_path}/checkpoint"
    )
    run_to_end(writer)
    assert len(outcomes.batches(spark)) == 3
    whole = devices.enrich(spark.createDataFrame(sum(BATCHES, []), ROW), index)
    assert sorted(store.profiles(spark).collect()) == sorted(devices.profile_state(whole).collect())
    events = BatchTable(f"{tmp_path}/events").read(spark).drop("batch")
    assert sorted(events.collect()) == sorted(devices.device_events(whole).collect())
    assert store.profiles(spark).filter("did = 'a'").first()["user_declared_state"] == "newer"

    # Counters of a second stream over the outcomes equal the batch counters.
    counted = BatchTable(f"{tmp_path}/metrics")
    source = spark.readStream.schema("ts timestamp, ip_status string, resolved boolean").parquet(f"{tmp_path}/outcomes")
    writer = (
        metrics.windowed(source, lateness="1 day")
        .writeStream.outputMode("update")
        .foreachBatch(counted.write)
        .option("checkpointLocation", f"{tmp_path}/metrics-checkpoint")
    )
    run_to_end(writer)
    newest = latest_batch(counted.read(spark), ["window_start_ms"])
    want = devices.metrics_events(devices.count_registrations(devices.outcomes(whole)))
    assert sorted(newest.select(*want.columns).collect()) == sorted(want.collect())


def test_repeated_batch_changes_nothing(spark, index, tmp_path):
    store = ProfileStore(str(tmp_path))
    for n, rows in enumerate(BATCHES):
        enriched = devices.enrich(spark.createDataFrame(rows, ROW), index)
        store.write(devices.newest_fields(devices.profile_updates(enriched)), n)
    before = sorted(store.profiles(spark).collect())
    enriched = devices.enrich(spark.createDataFrame(BATCHES[2], ROW), index)
    store.write(devices.newest_fields(devices.profile_updates(enriched)), 2)
    assert sorted(store.profiles(spark).collect()) == before
    store.compact(spark)
    store.compact(spark)
    assert sorted(store.profiles(spark).collect()) == before
    later = devices.enrich(spark.createDataFrame([row(90, did="a", token="t90")], ROW), index)
    store.write(devices.newest_fields(devices.profile_updates(later)), 3)
    assert store.profiles(spark).filter("did = 'a'").first()["fcm_token"] == "t90"


def test_old_pieces_and_snapshots_are_removed(spark, index, tmp_path):
    store = ProfileStore(str(tmp_path), compact_every=2)
    seen = []
    for n in range(7):
        enriched = devices.enrich(spark.createDataFrame([row(n, did=f"d{n % 3}", token=f"t{n}")], ROW), index)
        store.write(devices.newest_fields(devices.profile_updates(enriched)), n)
        seen.append((store.pieces.batches(spark), sorted((tmp_path / "snapshots").glob("upto=*"))))
    # Snapshots after batches 1, 3 and 5; the one before the newest, and the pieces after it, stay.
    assert [p.name for p in seen[-1][1]] == ["upto=3", "upto=5"] and seen[-1][0] == [4, 5, 6]
    tokens = {r["did"]: r["fcm_token"] for r in store.profiles(spark).collect()}
    assert tokens == {"d0": "t6", "d1": "t4", "d2": "t5"}
    # The last batch of a snapshot may run again.
    before = store.read(spark, before=5)
    assert {r["did"]: r["fcm_token"]["value"] for r in before.collect()} == {"d0": "t3", "d1": "t4", "d2": "t2"}


def test_work_folders_are_released(spark):
    from tidewell import session

    first, second = session.work_folder(spark, "a"), session.work_folder(spark, "b")
    for folder in (first, second):
        spark.range(3).write.parquet(folder)
    own = session._FOLDERS[spark.sparkContext.applicationId]
    others, own[:] = own[:-2], own[-2:]
    try:
        assert session.release_work_folders(spark, keep=1) == 1
        assert spark.read.parquet(second).count() == 3
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            spark.read.parquet(first)
        assert session.release_work_folders(spark) == 1 and session.release_work_folders(spark) == 0
    finally:
        own[:0] = others


def test_empty_store(spark, tmp_path):
    assert ProfileStore(f"{tmp_path}/none").profiles(spark) is None
    ProfileStore(f"{tmp_path}/none").compact(spark)


def test_unfinished_batch_is_not_read(spark, tmp_path):
    table = BatchTable(str(tmp_path))
    spark.range(3).write.parquet(f"{tmp_path}/batch=0")
    (tmp_path / "batch=1").mkdir()
    assert table.batches(spark) == [0]
    assert table.read(spark).count() == 3


def test_append_mode_publishes_closed_windows_once(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    minutes = [[0, 10], [40], [5], [200], [210]]
    batches = [[(base + datetime.timedelta(minutes=m), "ok", True) for m in batch] for batch in minutes]
    source = files(spark, f"{tmp_path}/in", batches, "ts timestamp, ip_status string, resolved boolean")
    out = BatchTable(f"{tmp_path}/out")
    writer = (
        metrics.windowed(source).writeStream.outputMode("append").foreachBatch(out.write).option("checkpointLocation", f"{tmp_path}/c")
    )
    run_to_end(writer)
    rows = out.read(spark).orderBy("window_start_ms").collect()
    assert [(r["window_start_ms"] // 60000 - 28401120, r["api_calls"]) for r in rows] == [(0, 3), (30, 1)]


OUTCOMES = "ts timestamp, ip_status string, resolved boolean"
BASE = datetime.datetime(2024, 1, 1)


def revisions(spark, folder, minutes, once=True):
    """Counts the batches, then publishes them, batch by batch; the revisions as (minute, revision) -> calls."""
    batches = [[(BASE + datetime.timedelta(minutes=m), "ok", m % 2 == 0) for m in batch] for batch in minutes]
    pieces, out = BatchTable(f"{folder}/pieces"), BatchTable(f"{folder}/revisions")
    if once:
        source = files(spark, f"{folder}/in", batches, OUTCOMES)
        run_to_end(metrics.counted(source, pieces).option("checkpointLocation", f"{folder}/c1"))
    writer = metrics.publish(metrics.counted_batches(spark, pieces, files=1), out).option("checkpointLocation", f"{folder}/c2")
    run_to_end(writer)
    rows = out.read(spark).drop("batch")
    start = int(BASE.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    found = [((r["start_ms"] - start) // 60000, r["revision"], r["api_calls"]) for r in rows.collect()]
    still_open = metrics.open_windows(spark, f"{folder}/c2")
    return batches, sorted(found), rows, still_open


def test_windows_are_published_once_and_corrected(spark, tmp_path):
    minutes = [[0, 10, 11], [40], [5], [200, 201], [7, 41], [210, 8]]
    batches, found, rows, still_open = revisions(spark, tmp_path, minutes)
    # Minute 5 is in time, 7, 8 and 41 come after their windows were published.
    assert found == [(0, 0, 4), (0, 5, 1), (0, 6, 1), (30, 0, 1), (30, 5, 1)]
    assert sorted((r["start_ms"] // 60000 - 28401120, r["api_calls"]) for r in still_open.collect()) == [(180, 2), (210, 1)]
    everything = spark.createDataFrame(sum(batches, []), OUTCOMES)
    want = devices.metrics_events(devices.count_registrations(everything))
    assert sorted(metrics.totals(rows.drop("revision").unionByName(still_open)).collect()) == sorted(want.collect())


def test_a_window_that_is_first_seen_late_is_a_correction(spark, tmp_path):
    _, found, _, still_open = revisions(spark, tmp_path, [[500], [3], [4, 5]])
    assert found == [(0, 2, 1), (0, 3, 2)]
    assert still_open.count() == 1


def test_published_windows_leave_the_state_over_a_restart(spark, tmp_path):
    revisions(spark, tmp_path, [[0, 10], [40]])
    more = [(BASE + datetime.timedelta(minutes=300), "ok", True)]
    spark.createDataFrame(more, OUTCOMES).coalesce(1).write.parquet(f"{tmp_path}/in/part=9")
    source = spark.readStream.schema(OUTCOMES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    run_to_end(metrics.counted(source, BatchTable(f"{tmp_path}/pieces")).option("checkpointLocation", f"{tmp_path}/c1"))
    _, found, _, still_open = revisions(spark, tmp_path, [], once=False)
    assert found == [(0, 0, 2), (30, 0, 1)]
    assert [r["start_ms"] // 60000 - 28401120 for r in still_open.collect()] == [300]


def test_registered_streams_read_several_batches(spark, monkeypatch):
    made = {}

    class Recorded(BatchTable):
        def __init__(self, root, *rest):
            super().__init__(root, *rest)
            made[root.rsplit("/", 1)[1]] = self

    monkeypatch.setattr(streams, "BatchTable", Recorded)
    corrected = streams.published_windows_stream(spark, "/root/testdata/sf0.001")
    assert corrected.count() > 0
    assert len(made["metrics"].batches(spark)) >= streams.BATCHES
    revised = made["revisions"].read(spark)
    assert revised.where("revision > 0").count() > 0 and len(made["revisions"].batches(spark)) > 1
    assert streams.experiment_assign_stream(spark, "/root/testdata/sf0.001").count() > 0
    assert len(made["searched"].batches(spark)) >= streams.BATCHES
    assert made["answers"].read(spark).where("covered").count() > 0


LOOKUPS = "lookup_id int, ts timestamp, userId string, deviceId string, url string, producer string"


def lookup(n, user, day=1, producer="p"):
    return (n, datetime.datetime(2024, 1, day), user, None, None, producer)


def assigned(spark, folder, batches, indexes, miss_seconds=experiments.MISS_SECONDS):
    """Runs both levels, one batch at a time, with the index of each batch; the answers and what stays remembered."""
    keyed, searched, answers = (BatchTable(f"{folder}/{name}") for name in ("keyed", "searched", "answers"))
    source = files(spark, f"{folder}/in", batches, LOOKUPS)
    left = iter(indexes)
    run_to_end(assignments.search_stream(source, lambda: next(left), keyed, searched, f"{folder}/c1"))
    stream = assignments.searched_batches(spark, searched)
    run_to_end(assignments.answer_stream(stream, keyed, answers, f"{folder}/c2", miss_seconds))
    return answers.read(spark), assignments.remembered(spark, f"{folder}/c2")


def test_remembered_lookups(spark, tmp_path):
    """Hits stay, misses are searched again after their expiry, and expired misses leave the state."""
    documents = [
        [doc("old", user="u1")],
        [doc("old", user="u1"), doc("a-new", user="u1"), doc("late", user="u2")],
        [doc("old", user="u1"), doc("a-new", user="u1"), doc("late", user="u2")],
        [doc("other", user="u9")],
    ]
    batches = [
        [lookup(1, "u1"), lookup(2, "u2"), lookup(3, None), lookup(10, "gone")],
        [lookup(4, "u1", 1), lookup(5, "u2", 1), lookup(6, "u1", 1, "other")],
        [lookup(7, "u1", 5), lookup(8, "u2", 5), lookup(9, "u2", 1)],
        [lookup(11, "u1", 9), lookup(12, "u2", 9), lookup(13, "new", 9)],
    ]
    indexes = [experiments.build_index(spark.createDataFrame(d, DOCS)) for d in documents]
    answers, state = assigned(spark, str(tmp_path), batches, indexes)
    got = {r["lookup_id"]: (r["experiment_id"], r["covered"]) for r in answers.collect()}
    assert got == {
        1: ("old", False),
        2: (None, False),
        3: (None, False),
        10: (None, False),
        4: ("old", True),
        5: (None, True),
        6: ("a-new", False),
        7: ("old", True),
        8: ("late", False),
        9: (None, True),
        11: ("old", True),
        12: ("late", True),
        13: (None, False),
    }
    # The misses of the first day have left the state, the hits and the miss of the last day are in it.
    keys = {r["lookup_key"]: r["found"] is not None for r in state.collect()}
    assert keys == {"NA:u1:NA:p": True, "NA:u2:NA:p": True, "NA:u1:NA:other": True, "NA:new:NA:p": False}


def test_a_miss_is_replaced_before_its_timer(spark, tmp_path):
    """A miss that is searched again in time keeps its new expiry; the old timer does not remove it."""
    index = experiments.build_index(spark.createDataFrame([doc("e", user="nobody")], DOCS))
    batches = [[lookup(1, "a", 1)], [lookup(2, "a", 2), lookup(3, "b", 2)], [lookup(4, "c", 2)], [lookup(5, "a", 2)]]
    answers, state = assigned(spark, str(tmp_path), batches, [index] * 4)
    assert {r["lookup_id"]: r["covered"] for r in answers.collect()} == {1: False, 2: False, 3: False, 4: False, 5: True}
    kept = {r["lookup_key"]: r["expires"] for r in state.collect()}
    assert kept == {f"NA:{u}:NA:p": datetime.datetime(2024, 1, 3) for u in "abc"}


def test_a_hot_key_is_one_row_of_the_state_operator(spark):
    rows = spark.range(3000).selectExpr(
        "cast(id as int) lookup_id", "timestamp_seconds(id) ts", "'hot' userId", "cast(null as string) deviceId",
        "cast(null as string) url", "if(id % 3 = 0, concat('p', id), 'p') producer",
    )
    index = experiments.build_index(spark.createDataFrame([doc("e", user="hot")], DOCS))
    found = assignments.searched_keys(assignments.with_key(rows), index, 0)
    assert found.count() == 1001
    hot = found.where("lookup_key = 'NA:hot:NA:p'").first()
    assert (hot["first_us"], '"experiment_id":"e"' in hot["found"]) == (1_000_000, True)


def test_the_second_level_decides_without_python(spark, plan):
    """Two batches at once after a remembered hit, a remembered miss that lasts, one that ends between them, and nothing."""
    memory = spark.createDataFrame([("hit", "x", None, 0), ("lasts", None, 9_000_000, 0), ("ends", None, 5_000_000, 0)], assignments.MEMORY)
    rows = [(key, b, 4_000_000 + b, 4_500_000 + b * 1_000_000, f"new{b}" if b == 1 else None) for key in ("hit", "lasts", "ends", "none") for b in (1, 2)]
    searched = spark.createDataFrame(rows[::-1], "lookup_key string, source_batch long, first_us long, last_us long, found string")
    decided = assignments.decide(searched, memory, 10)
    assert "Python" not in plan(decided) and "Pandas" not in plan(decided)
    got = {r["lookup_key"]: ([tuple(d) for d in r["decisions"]], r["answer"], r["expires"], r["changed"]) for r in decided.collect()}
    assert got == {
        "hit": ([(1, "x", assignments.FOR_GOOD, "new1"), (2, "x", assignments.FOR_GOOD, None)], "x", None, False),
        "lasts": ([(1, None, 9_000_000, "new1"), (2, None, 9_000_000, None)], None, 9_000_000, False),
        "ends": ([(1, None, 5_000_000, "new1"), (2, "new1", assignments.FOR_GOOD, None)], "new1", None, True),
        "none": ([(1, None, None, "new1"), (2, "new1", assignments.FOR_GOOD, None)], "new1", None, True),
    }
    later = assignments.decide(searched.where("source_batch = 2"), memory, 10).collect()
    assert {r["lookup_key"]: r["expires"] for r in later} == {"hit": None, "lasts": 9_000_000, "ends": 15_000_000, "none": 14_000_002}


def test_assignment_stream(spark, tmp_path):
    docs = spark.createDataFrame([doc("e", user="u1"), doc("m", user="user4", kind="modulus", user_mod=3)], DOCS)
    index = experiments.build_index(docs)
    batches = [[lookup(1, "u1"), lookup(2, "user4")], [lookup(3, "u1"), lookup(4, "zz")]]
    answers, _ = assigned(spark, str(tmp_path), batches, [index] * 2)
    got = {r["lookup_id"]: (r["experiment_id"], r["assigned"], r["covered"]) for r in answers.collect()}
    assert got == {1: ("e", True, False), 2: ("m", False, False), 3: ("e", True, True), 4: (None, False, False)}


def test_the_clock_goes_on_after_a_restart(spark, tmp_path):
    """A second run reads the clock of the first from the table, so that late lookups are answered."""
    index = experiments.build_index(spark.createDataFrame([doc("e", user="u1")], DOCS))
    keyed, searched, answers = (BatchTable(f"{tmp_path}/{name}") for name in ("keyed", "searched", "answers"))
    for n, rows in enumerate([[lookup(1, "u1", 9)], [lookup(2, "u1", 2), lookup(3, "zz", 2)]]):
        spark.createDataFrame(rows, LOOKUPS).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        source = spark.readStream.schema(LOOKUPS).parquet(f"{tmp_path}/in/part=*")
        run_to_end(assignments.search_stream(source, lambda: index, keyed, searched, f"{tmp_path}/c1"))
        stream = assignments.searched_batches(spark, searched)
        run_to_end(assignments.answer_stream(stream, keyed, answers, f"{tmp_path}/c2"))
    got = {r["lookup_id"]: (r["experiment_id"], r["covered"]) for r in answers.read(spark).collect()}
    assert got == {1: ("e", False), 2: ("e", True), 3: (None, False)}


def test_refreshed():
    now, loads = [0.0], []

    def load():
        loads.append(now[0])
        if now[0] == 100:
            raise OSError("down")
        return [] if now[0] < 20 else [now[0]]

    table = reference.Refreshed(load, seconds=50, clock=lambda: now[0], is_empty=lambda v: not v)
    assert table() == []
    now[0] = 10
    assert table() == []  # empty: loaded again on the next use
    now[0] = 30
    assert table() == [30]
    now[0] = 79
    assert table() == [30]
    now[0] = 100
    assert table() == [30]  # the reload failed
    now[0] = 151
    assert table() == [151]
    assert loads == [0, 10, 30, 100, 151]


def test_first_load_must_work():
    def load():
        raise OSError("down")

    with pytest.raises(OSError):
        reference.Refreshed(load)()


RANGES = "network_start_integer bigint, network_last_integer bigint, geoname_id int"
DAY = 86400


def at(day):
    return datetime.datetime(2024, 1, day)


@pytest.fixture
def versions(spark, tmp_path):
    """A table that holds the day it was loaded on; days in ``broken`` cannot be loaded."""
    broken, made = set(), []

    def build(folder, loaded_at):
        made.append(loaded_at.day)
        if loaded_at.day in broken:
            spark.range(5).write.mode("overwrite").parquet(f"{folder}/half")
            raise OSError("unreachable")
        spark.range(1).selectExpr(f"{loaded_at.day} place").coalesce(1).write.mode("overwrite").parquet(folder)

    table = reference.Versions(f"{tmp_path}/versions", build, lambda s, folder: s.read.parquet(folder), keep=3)
    return table, broken, made


def test_versions_are_kept_and_replaced(spark, versions):
    table, _, _ = versions
    for day in (1, 2, 3, 4, 5):
        table.publish(spark, at(day))
    assert [(r["version"], r["loaded_at"].day) for r in table.known(spark)] == [(2, 3), (3, 4), (4, 5)]
    assert len({r["slot"] for r in table.known(spark)}) == 3
    rows = spark.createDataFrame([(d, at(d)) for d in (1, 2, 3, 4, 5, 6)], "day int, ts timestamp")
    found = reference.by_version(rows, table, table.known(spark), "ts", lambda own, held: own.join(held, F.lit(True)))
    assert {r["day"]: r["place"] for r in found.collect()} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 5}
    assert {r["loaded_at"].day for r in found.collect()} == {3, 4, 5}


def test_a_version_that_breaks_off_is_not_seen(spark, versions):
    table, broken, _ = versions
    for day in (1, 2, 3):
        table.publish(spark, at(day))
    broken.add(4)
    with pytest.raises(OSError):
        table.publish(spark, at(4))
    # The oldest version has left the manifest before its slot was touched.
    assert [r["loaded_at"].day for r in table.known(spark)] == [2, 3]
    table.publish(spark, at(5))
    assert [r["loaded_at"].day for r in table.known(spark)] == [2, 3, 5]


def test_reloads_follow_event_time(spark, versions):
    table, broken, made = versions
    reloading = reference.Reloading(table, seconds=DAY)
    broken.add(1)
    with pytest.raises(OSError):
        reloading.up_to(spark, at(1))  # the first load must succeed
    broken.clear()
    assert [r["loaded_at"].day for r in reloading.up_to(spark, at(1) + datetime.timedelta(hours=5))] == [1]
    assert [r["loaded_at"].day for r in reloading.up_to(spark, at(1) + datetime.timedelta(hours=9))] == [1]
    broken.add(2)
    assert [r["loaded_at"].day for r in reloading.up_to(spark, at(2))] == [1]
    assert [r["loaded_at"].day for r in reloading.up_to(spark, at(1))] == [1]  # time does not go back
    assert [r["loaded_at"].day for r in reloading.up_to(spark, at(4))] == [1, 3, 4]
    assert made == [1, 1, 2, 3, 4]
    # A restart goes on from the manifest; of many missed loads only as many as are kept are made.
    again = reference.Reloading(table, seconds=DAY)
    assert [r["loaded_at"].day for r in again.up_to(spark, at(4))] == [1, 3, 4]
    assert [r["loaded_at"].day for r in again.up_to(spark, at(20))] == [18, 19, 20]


def test_two_versions_at_least(spark):
    with pytest.raises(ValueError):
        reference.Versions("/nowhere", lambda *_: None, geo.load_index, keep=1)


def test_located_by_the_version_of_their_time(spark, tmp_path):
    fields = ", ".join(f"{name} string" for name in geo.LOCATION_FIELDS)
    places = spark.createDataFrame([(d, *[f"x{d}"] * len(geo.LOCATION_FIELDS)) for d in range(1, 31)], f"geoname_id int, {fields}")
    made = []

    def build(folder, loaded_at):
        made.append(loaded_at.day)
        if loaded_at.day == 3:
            raise OSError("unreachable")
        geo.build_index(spark.createDataFrame([(0, 2**32 - 1, loaded_at.day)], RANGES), places, folder)

    def arriving(*days):
        return [(*row(n, did="d")[:1], at(d), *row(n, did="d")[2:]) for n, d in enumerate(days)]

    table = reference.Versions(f"{tmp_path}/versions", build, geo.load_index, keep=3)
    located = BatchTable(f"{tmp_path}/located")
    stream = files(spark, f"{tmp_path}/in", [arriving(1, 1), arriving(2), arriving(1, 3), arriving(4, 2, 3)], ROW)
    run_to_end(registrations.locate_by_version(stream, reference.Reloading(table, DAY), located, f"{tmp_path}/c"))
    got = sorted((r["batch"], r["ts"].day, r["geoname_id"]) for r in located.read(spark).collect())
    # The load of the third day failed, so its rows take the second day's version, late ones too.
    assert got == [(0, 1, 1), (0, 1, 1), (1, 2, 2), (2, 1, 1), (2, 3, 2), (3, 2, 2), (3, 3, 2), (3, 4, 4)]
    assert made == [1, 2, 3, 4]
