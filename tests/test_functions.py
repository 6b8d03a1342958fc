"""Column functions on known values."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates, hashing, network, texts

UTC = datetime.timezone.utc


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def each(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


def test_ip_to_int(spark):
    given = ["106.51.74.185", "115.99.217.196", "0.0.0.0", "255.255.255.255", "::ffff:1.2.3.4"]
    assert each(spark, given, network.ip_to_int) == [1781746361, 1935923652, 0, 2**32 - 1, 16909060]


def test_bad_addresses_are_null(spark):
    given = ["256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "a.b.c.d", "", None, " 1.2.3.4", "1.2.3.4 ", "1..2.3"]
    assert each(spark, given, network.ip_to_int) == [None] * len(given)


@pytest.mark.parametrize(
    "header, body, expected",
    [
        ("1.2.3.4", None, "1.2.3.4"),
        ("192.51.74.185", None, ""),
        ("192.168.0.1", "9.9.9.9", "9.9.9.9"),
        (None, "9.9.9.9", ""),
        ("", "9.9.9.9", ""),
    ],
)
def test_effective_ip(spark, header, body, expected):
    got = one(spark, network.effective_ip(F.lit(header).cast("string"), F.lit(body).cast("string")))
    assert got[0] == expected


def test_private_prefix_can_be_strict(spark):
    assert one(spark, network.effective_ip(F.lit("192.51.74.185"), F.lit("x"), "192.168."))[0] == "192.51.74.185"


def _hash(text):
    """Reference steps of the 32-bit string hash in plain integers."""
    mask = 0xFFFFFFFF

    def rotate(v, n):
        return ((v << n) | (v >> (32 - n))) & mask

    def scramble(k):
        return rotate(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask

    data = text.encode("utf-16-be")
    units = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2)]
    h = 0xF7CA7FD2
    for i in range(0, len(units) - 1, 2):
        h = (rotate(h ^ scramble((units[i] << 16) + units[i + 1] & mask), 13) * 5 + 0xE6546B64) & mask
    if len(units) % 2:
        h ^= scramble(units[-1])
    h ^= len(units)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - 2**32 if h >= 2**31 else h


def test_string_hash_known_values(spark):
    known = {
        "": 377927480,
        "a": -1454233464,
        "user1": -1691347333,
        "user3": 261318336,
        "user4": -1014748436,
        "device3": -1579032615,
        "device4": -1264494004,
    }
    assert each(spark, list(known), hashing.string_hash) == list(known.values())


def test_string_hash_of_any_text(spark):
    given = ["é", "Ωmega", "日本語テキスト", "😀", "a😀b", "x" * 1001, "tab\tnew\nline", None]
    assert each(spark, given, hashing.string_hash) == [None if t is None else _hash(t) for t in given]


@pytest.mark.parametrize("text, divisor, expected", [("user3", 3, True), ("device3", 3, True), ("user4", 3, False), ("user3", 0, False), ("user3", -3, False), ("user3", None, False)])
def test_in_modulus(spark, text, divisor, expected):
    assert one(spark, hashing.in_modulus(F.lit(text), F.lit(divisor).cast("bigint")))[0] is expected


def test_request_id(spark):
    day = F.lit("2022-06-30").cast("date")
    parts = [F.lit(p) for p in ("meadow", "harbour", "tester-a", "ch-1")]
    import hashlib

    plain = hashlib.md5(b"meadow|harbour|tester-a|ch-1|2022-06-30").hexdigest().upper()
    typed = hashlib.md5(b"meadow|harbour|tester-a|ch-1|2022-06-30|druid").hexdigest().upper()
    none = F.lit(None).cast("string")
    assert tuple(one(spark, hashing.request_id(*parts, day, none), hashing.request_id(*parts, day, F.lit("druid")))) == (plain, typed)


def test_lookup_key(spark):
    none = F.lit(None).cast("string")
    assert one(spark, hashing.lookup_key(F.lit("d"), none, F.lit("/u"), none))[0] == "d:NA:/u:NA"


def test_period_of(spark):
    assert each(spark, ["2020-10-10", "2020-10-1o", None, ""], dates.period_of) == [20201010, 0, 0, 0]


def test_weeks_between(spark):
    millis = [F.timestamp_millis(F.lit(m)) for m in (1451650400000, 1454650400000)]
    assert tuple(one(spark, dates.weeks_between(*millis), dates.weeks_between(millis[1], millis[0]))) == (5, -5)


def test_round_half_up(spark):
    assert one(spark, dates.round_half_up(F.lit(12.7345), 2))[0] == 12.73


def test_day_changes_at_local_midnight(spark):
    before, after = (F.timestamp_seconds(F.lit(s)) for s in (1704133799, 1704133800))  # 18:29:59 and 18:30 UTC
    assert tuple(one(spark, dates.day_period(before), dates.day_period(after))) == (20240101, 20240102)


def test_hours_left(spark):
    at = [F.lit(t).cast("timestamp") for t in ("2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 23:30:00")]
    assert tuple(one(spark, *[dates.hours_left_in_day(t) for t in at])) == (24, 23, 0)


@pytest.mark.parametrize(
    "name, expected",
    [
        ("LAST_DAY", ("2024-01-09", "2024-01-10")),
        ("LAST_2_DAYS", ("2024-01-08", "2024-01-10")),
        ("LAST_7_DAYS", ("2024-01-03", "2024-01-10")),
        ("LAST_14_DAYS", ("2023-12-27", "2024-01-10")),
        ("LAST_30_DAYS", ("2023-12-11", "2024-01-10")),
        ("LAST_WEEK", ("2024-01-01", "2024-01-08")),
        ("LAST_YEAR", ("", "")),
    ],
)
def test_interval_range(spark, name, expected):
    moment = F.lit("2024-01-09 19:00:00").cast("timestamp")  # already the 10th at +05:30, a Wednesday
    assert tuple(one(spark, *dates.interval_range(F.lit(name), moment))) == expected


CHROME = "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_13_6) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/70.0.3538.77 Safari/537.36"


def test_user_agent_json(spark):
    expected = '{"agent":"Chrome","ver":"70.0.3538.77","system":"Mac OSX","raw":"' + CHROME + '"}'
    assert each(spark, [CHROME, None], texts.user_agent_json) == [expected, None]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Mozilla/5.0 (Windows NT 10.0; rv:68.0) Gecko/20100101 Firefox/68.0", ("Firefox", "68.0", "Windows 10")),
        ("Mozilla/5.0 (Windows NT 6.1; Trident/7.0; rv:11.0) like Gecko", ("Internet Explorer", "11.0", "Windows 7")),
        ("Mozilla/5.0 (Linux; Android 9) Chrome/74.0 Mobile Safari/537.36 OPR/52.1", ("Opera", "52.1", "Android")),
        ("Mozilla/5.0 (iPad; CPU OS 13_2 like Mac OS X) Version/13.0 Safari/604.1", ("Safari", "13.0", "iPad")),
        ("okhttp/3.12", ("UNKNOWN", "UNKNOWN", "UNKNOWN")),
    ],
)
def test_user_agent(spark, raw, expected):
    got = one(spark, texts.user_agent(F.lit(raw)).alias("u"))["u"]
    assert (got["agent"], got["ver"], got["system"]) == expected


def test_device_spec(spark):
    given = ['{"os":"Android","sims":2,"ok":true}', None, ""]
    assert each(spark, given, texts.device_spec_json) == ['{"os":"Android","sims":"2","ok":"true"}', "{}", "{}"]


def test_object_key(spark):
    given = ["wasb://reports@acc.example/uci/a/b.csv", "https://h.example/reports/a/b.csv", "https://h.example/reports", "x", None]
    assert each(spark, given, texts.object_key) == ["uci/a/b.csv", "a/b.csv", "", "", None]


def test_file_day(spark):
    given = ["raw/ch/2018-05-20-1.json.gz", "raw/2018-05-20/2018-05-21.gz", "raw/undated.gz"]
    assert each(spark, given, texts.file_day) == ["2018-05-20", "2018-05-20", "default"]


def test_has_key(spark):
    rows = spark.createDataFrame([('{"a":null}',), ('{"b":1}',), ("{}",), (None,)], "v string")
    assert [r[0] for r in rows.select(texts.has_key(F.col("v"), "a")).collect()] == [True, False, False, False]
