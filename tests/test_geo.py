"""The block index against a plain scan over all ranges."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewell.functions.network import IPV4_MAX
from tidewell.operators import geo

LOCATION = {name: f"{name}-" for name in geo.LOCATION_FIELDS}


def ranges_of(spark, rows):
    return spark.createDataFrame(rows, "network_start_integer bigint, network_last_integer bigint, geoname_id int")


def places_of(spark, ids):
    rows = [(i, *[text + str(i) for text in LOCATION.values()]) for i in ids]
    fields = ", ".join(f"{name} string" for name in LOCATION)
    return spark.createDataFrame(rows, f"geoname_id int, {fields}")


def plain(ranges, ip):
    """Narrowest range with the address, then lowest start, then lowest id."""
    hits = [(last - first, first, gid) for first, last, gid in ranges if first <= ip <= last]
    return min(hits)[2] if hits else None


def looked_up(spark, ranges, ips):
    index = geo.build_index(ranges_of(spark, ranges), places_of(spark, sorted({r[2] for r in ranges}) or [0]))
    rows = spark.createDataFrame(list(enumerate(ips)), "n int, ip_int bigint")
    found = geo.resolve_addresses(rows, index).select("n", "geoname_id").collect()
    assert len(found) == len(ips)
    assert all((r['geoname_id'] is not None) == r['in_range'] for r in geo.resolve_addresses(rows, index).collect())
    return [g for _, g in sorted((r["n"], r["geoname_id"]) for r in found)]


OVERLAPPING = [(100, 1000, 1), (200, 300, 2), (250, 260, 3), (300, 300, 4), (900, 1100, 5), (150, 250, 6), (200, 300, 1)]


def test_overlapping_ranges(spark):
    ips = list(range(90, 1110))
    assert looked_up(spark, OVERLAPPING, ips) == [plain(OVERLAPPING, ip) for ip in ips]


def test_ends_of_the_address_space(spark):
    ranges = [(0, 0, 1), (IPV4_MAX, IPV4_MAX, 2), (2**24 - 1, 2**24, 3), (2**31, 2**31 + 2**20, 4)]
    ips = [0, 1, IPV4_MAX, IPV4_MAX - 1, 2**24 - 2, 2**24 - 1, 2**24, 2**24 + 1, 2**31 - 1, 2**31, 2**31 + 2**20, 2**31 + 2**20 + 1]
    assert looked_up(spark, ranges, ips) == [plain(ranges, ip) for ip in ips]


def test_whole_space_as_one_range(spark):
    assert looked_up(spark, [(0, IPV4_MAX, 7)], [0, 12345, IPV4_MAX]) == [7, 7, 7]


def test_no_ranges(spark):
    assert looked_up(spark, [], [0, 5]) == [None, None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**32))
def test_random_ranges(spark, seed):
    rng = random.Random(seed)
    ranges = []
    for _ in range(rng.randint(1, 40)):
        first = rng.choice([rng.randint(0, IPV4_MAX), rng.randint(2**24 - 500, 2**24 + 500)])
        ranges.append((first, min(IPV4_MAX, first + rng.choice([0, 7, 255, 1000, 2**20])), rng.randint(1, 9)))
    ips = [rng.randint(0, IPV4_MAX) for _ in range(30)]
    for first, last, _ in ranges:
        ips += [first, last, max(0, first - 1), min(IPV4_MAX, last + 1), rng.randint(first, last)]
    assert looked_up(spark, ranges, ips) == [plain(ranges, ip) for ip in ips]


def test_crowded_parts_have_narrow_blocks(spark):
    """Single addresses side by side: no block holds more stretches than it has columns for, and none is lost."""
    ranges = [(first, first, first % 5) for first in range(70_000, 70_400, 2)] + [(5_000_000, 6_000_000, 7)]
    index = geo.build_index(ranges_of(spark, ranges), places_of(spark, [1]))
    widths = {r["part"]: r["width"] for r in index.widths.collect()}
    assert widths[1] == 3 and widths[5_500_000 >> 16] == 16 and 0 not in widths
    ips = list(range(69_990, 70_410)) + [4_999_999, 5_000_000, 6_000_000, 6_000_001]
    assert looked_up(spark, ranges, ips) == [plain(ranges, ip) for ip in ips]


def test_addresses_are_not_shuffled_more_than_once(spark, plan):
    index = geo.build_index(ranges_of(spark, OVERLAPPING), places_of(spark, [1, 2]))
    rows = spark.range(10).selectExpr("id n", "id ip_int")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(geo.resolve_addresses(rows, index))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2 and "Generate" not in text


def test_locate_keeps_every_row(spark):
    index = geo.build_index(ranges_of(spark, [(10, 20, 1), (30, 40, 2)]), places_of(spark, [1]))
    rows = spark.createDataFrame([(1, 15), (2, 35), (3, 25), (4, None), (5, None), (6, 15)], "n int, ip_int bigint")
    found = {r["n"]: r for r in geo.locate(rows, index, spread=["n"]).collect()}
    assert len(found) == 6
    assert found[1]["state"] == "state-1" and found[1]["resolved"] and found[1]["geoname_id"] == 1
    assert (found[2]["in_range"], found[2]["resolved"], found[2]["geoname_id"], found[2]["state"]) == (True, False, 0, "")
    assert (found[3]["in_range"], found[3]["has_address"], found[3]["geoname_id"]) == (False, True, 0)
    assert (found[4]["in_range"], found[4]["has_address"], found[4]["resolved"]) == (False, False, False)
    assert found[6]["city"] == "city-1"


def test_plans_have_no_pairwise_join(spark, plan):
    index = geo.build_index(ranges_of(spark, OVERLAPPING), places_of(spark, [1, 2]))
    rows = spark.createDataFrame([(1, 5)], "n int, ip_int bigint")
    text = plan(geo.locate(rows, index))
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_hot_address_is_one_row(spark):
    """A third of all rows on one address: the probed side holds the address once."""
    index = geo.build_index(ranges_of(spark, [(10, 20, 1)]), places_of(spark, [1]))
    rows = spark.range(3000).selectExpr("id n", "case when id % 3 = 0 then 15 when id % 3 = 1 then null else id end ip_int")
    found = geo.resolve_addresses(rows, index, spread=["n"])
    assert found.count() == 3000
    assert found.filter("geoname_id = 1").count() == 1000 + len([i for i in range(10, 21) if i % 3 == 2])
