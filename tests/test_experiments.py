"""Experiment matching against the scoring rule applied to every document."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import experiments

DOCS = "id string, name string, startDate string, endDate string, key string, expType string, userId string, deviceId string, url string, userIdMod bigint, deviceIdMod bigint"
LOOKUPS = "lookup_id int, userId string, deviceId string, url string"
WEIGHTS = {"userId": 3.0, "deviceId": 2.0, "url": 1.0}


def doc(i, user=None, device=None, url=None, kind="test", user_mod=None, device_mod=None):
    return (i, f"name {i}", "2020-01-01", "2020-01-31", f"key {i}", kind, user, device, url, user_mod, device_mod)


GOLDEN = [
    doc("p-01", user="ann"),
    doc("p-02", device="pad7"),
    doc("p-03", url="/garden"),
    doc("p-04", user="ann", device="pad8"),
    doc("p-05", user="ann", device="pad7", url="/garden"),
]


def matched(spark, docs, lookups, weights=WEIGHTS, guarded=False, **options):
    index = experiments.build_index(spark.createDataFrame(docs, DOCS), weights, guarded=guarded)
    rows = spark.createDataFrame([(i, *row) for i, row in enumerate(lookups)], LOOKUPS)
    return experiments.match(rows, index, **options)


def winners(frame):
    return [r["experiment_id"] for r in frame.orderBy("lookup_id").collect()]


def test_known_winners(spark):
    lookups = [
        ("ann", None, None),
        (None, "pad7", None),
        (None, "pad8", "/garden"),
        ("ann", "pad8", None),
        ("ann", "pad7", "/garden"),
        ("bob", None, None),
        (None, None, None),
    ]
    assert winners(matched(spark, GOLDEN, lookups)) == ["p-01", "p-02", "p-03", "p-04", "p-05", None, None]


def test_repeated_and_missing_ids(spark):
    index = experiments.build_index(spark.createDataFrame(GOLDEN, DOCS), WEIGHTS)
    rows = [(1, "ann", None, None), (1, None, "pad7", None), (None, None, None, "/garden"), (None, None, None, None), (1, "ann", None, None)]
    got = experiments.match(spark.createDataFrame(rows, LOOKUPS), index).collect()
    assert sorted((str(r["lookup_id"]), str(r["experiment_id"])) for r in got) == [("1", "p-01"), ("1", "p-01"), ("1", "p-02"), ("None", "None"), ("None", "p-03")]


def plain(docs, lookup, weights, query_weight=9.0):
    """Best document by the definition: every document scored, ties to the lowest id."""
    names = ("userId", "deviceId", "url")
    values = [dict(zip(names, d[6:9])) for d in docs]
    given = {n: v for n, v in zip(names, lookup) if v is not None}
    best = None
    for d, fields in zip(docs, values):
        equal = [n for n, v in given.items() if fields[n] == v]
        if not equal:
            continue
        score = 0.0
        for n in equal:
            total = sum(f[n] is not None for f in values)
            count = sum(f[n] == given[n] for f in values)
            score += math.log(1 + (total - count + 0.5) / (count + 0.5))
        product = query_weight if len(equal) == len(given) else 1.0
        for n, weight in weights.items():
            if fields[n] is None:
                product *= weight
        entry = (-round(score + product, 6), d[0])
        best = min(best, entry) if best else entry
    return best


@pytest.mark.parametrize("seed, weights", [(1, WEIGHTS), (2, {"userId": 3.0, "deviceId": 3.0, "url": 3.0}), (3, {"userId": 0.5, "url": 4.0})])
def test_against_every_document(spark, seed, weights):
    rng = random.Random(seed)

    def some(prefix, n):
        return rng.choice([None, *[f"{prefix}{i}" for i in range(n)]])

    docs = []
    while len(docs) < 80:
        fields = (some("u", 4), some("d", 4), some("l", 3))
        if any(fields):
            docs.append(doc(f"e{len(docs):03d}", *fields))
    lookups = [(some("u", 5), some("d", 5), some("l", 4)) for _ in range(150)]
    frame = matched(spark, docs, lookups, weights).orderBy("lookup_id").collect()
    for row, lookup in zip(frame, lookups):
        want = plain(docs, lookup, weights)
        assert row["experiment_id"] == (want[1] if want else None), lookup
        if want:
            assert row["score"] == pytest.approx(-want[0], abs=2e-6)


def test_common_value_does_not_multiply_rows(spark, plan):
    """A third of the documents and of the lookups share one url: every lookup still reads at most 7 index rows."""
    docs = [doc(f"e{i:04d}", user=f"u{i}" if i % 2 else None, url="/hot" if i % 3 == 0 else f"/p{i}") for i in range(600)]
    index = experiments.build_index(spark.createDataFrame(docs, DOCS))
    assert index.count() == index.select("key").distinct().count()
    lookups = spark.range(900).selectExpr("cast(id as int) lookup_id", "concat('u', id) userId", "cast(null as string) deviceId", "if(id % 3 = 0, '/hot', concat('/p', id)) url")
    frame = experiments.match(lookups, index)
    assert frame.count() == 900
    text = plan(frame)
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_small_query_weights_need_a_guarded_index(spark):
    with pytest.raises(ValueError, match="guarded"):
        matched(spark, GOLDEN, [("ann", None, None)], query_weight=0.5)
    with pytest.raises(ValueError, match="positive"):
        matched(spark, GOLDEN, [("ann", None, None)], guarded=True, query_weight=0)


@pytest.mark.parametrize("seed, query_weight", [(4, 0.01), (5, 0.5), (6, 0.9), (7, 9.0)])
def test_any_query_weight_against_every_document(spark, seed, query_weight):
    rng = random.Random(seed)

    def some(prefix, n):
        return rng.choice([None, *[f"{prefix}{i}" for i in range(n)]])

    docs = []
    while len(docs) < 120:
        fields = (some("u", 3), some("d", 3), some("l", 2))
        if any(fields):
            docs.append(doc(f"e{len(docs):03d}", *fields))
    lookups = [(some("u", 4), some("d", 4), some("l", 3)) for _ in range(150)]
    frame = matched(spark, docs, lookups, WEIGHTS, guarded=True, query_weight=query_weight)
    for row, lookup in zip(frame.orderBy("lookup_id").collect(), lookups):
        want = plain(docs, lookup, WEIGHTS, query_weight)
        assert row["experiment_id"] == (want[1] if want else None), lookup
        if want:
            assert row["score"] == pytest.approx(-want[0], abs=2e-6)


def test_gates(spark):
    docs = [
        doc("a", user="user3", device="device3", kind="modulus", user_mod=3, device_mod=3),
        doc("b", user="user4", kind="modulus", user_mod=3),
        doc("c", device="device3", kind="modulus", device_mod=3),
        doc("d", url="/x", kind="modulus", user_mod=1, device_mod=1),
        doc("e", url="/y", kind="unheard of"),
        doc("f", user="", device="device3", kind="modulus", device_mod=3),
        doc("g", url="/z", kind=None),
        doc("h", user="user3", kind="modulus"),
    ]
    frame = spark.createDataFrame(docs, DOCS).withColumn("passes", experiments.gate())
    assert {r["id"]: r["passes"] for r in frame.collect()} == {
        "a": True, "b": False, "c": True, "d": False, "e": True, "f": True, "g": True, "h": False,
    }


def test_own_resolver(spark):
    resolvers = {**experiments.RESOLVERS, "never": lambda: F.lit(False)}
    docs = spark.createDataFrame([doc("a", user="u", kind="never")], DOCS)
    lookups = spark.createDataFrame([(0, "u", None, None)], LOOKUPS)
    frame = experiments.assign(experiments.match(lookups, experiments.build_index(docs, resolvers=resolvers)))
    row = frame.first()
    assert (row["experiment_id"], row["assigned"], row["actions"]) == ("a", False, "[]")
    assert experiments.assign(experiments.match(lookups, experiments.build_index(docs))).first()["assigned"]


def test_actions(spark):
    row = experiments.assign(matched(spark, GOLDEN, [("ann", None, None)])).first()
    assert row["actions"] == (
        '[{"type":"experiment","data":{"title":"experiment","experimentId":"p-01","experimentName":"name p-01",'
        '"key":"key p-01","startDate":"2020-01-01","endDate":"2020-01-31"}}]'
    )


def test_documents_from_json(spark, tmp_path):
    from tidewell.sources.documents import experiment_documents

    (tmp_path / "docs.json").write_text(
        '{"id":"p-01","name":"n","startDate":"2020-01-01","endDate":"2020-01-31","key":"k","expType":"test","userId":"ann","other":1}\n'
        '{"id":"m","expType":"modulus","userId":"user3","userIdMod":3}\nbroken\n'
    )
    docs = experiment_documents(spark, str(tmp_path / "docs.json"))
    lookups = spark.createDataFrame([(0, "ann", None, None), (1, "user3", None, None)], LOOKUPS)
    got = experiments.assign(experiments.match(lookups, experiments.build_index(docs))).orderBy("lookup_id").collect()
    assert [(r["experiment_id"], r["assigned"]) for r in got] == [("p-01", True), ("m", True)]


REGISTRY = "exp_id string, exp_name string, exp_description string, created_by string, updated_by string, status string, status_message string, stats string, criteria string, exp_data string, created_on timestamp, updated_on timestamp"


def test_registry(spark):
    import datetime

    old = datetime.datetime(2020, 1, 1)
    registry = spark.createDataFrame(
        [("a", "n", "d", "u", "x", "Failed", "m", '{"one":1}', "{}", "{}", old, old), ("b", "n", "d", "u", "x", "ACTIVE", "m", '{"one":1}', "{}", "{}", old, old)],
        REGISTRY,
    )
    requests = spark.createDataFrame(
        [(1, "a", "A", "D", "U", "{}", "{}"), (2, "b", "B", "D", "U", "{}", "{}"), (3, "c", "C", "D", "U", "{}", "{}"), (4, "c", "late", "D", "U", "{}", "{}")],
        "seq int, exp_id string, exp_name string, exp_description string, created_by string, criteria string, exp_data string",
    )
    merged = experiments.merge_experiments(registry, requests, F.lit("2024-01-01").cast("date"))
    got = {r["exp_id"]: r for r in merged.collect()}
    assert (got["a"]["status"], got["a"]["exp_name"], got["a"]["action"], got["a"]["stats"]) == ("SUBMITTED", "A", "resubmitted", "")
    assert (got["b"]["status"], got["b"]["exp_name"], got["b"]["action"]) == ("ACTIVE", "n", "ExperimentId already exists.")
    assert (got["c"]["exp_name"], got["c"]["status_message"]) == ("C", "Experiment successfully submitted")
    answers = {r["exp_id"]: r["stats"] for r in experiments.experiment_answers(merged.drop("action")).collect()}
    assert answers == {"a": "{}", "b": '{"one":1}', "c": "{}"}


def test_guarded_entries_are_formed_by_as_many_tasks_as_the_documents_need(spark, monkeypatch):
    docs = spark.createDataFrame(GOLDEN, DOCS).coalesce(1)
    whole = experiments.index_entries(docs, WEIGHTS, guarded=True)
    monkeypatch.setattr(experiments, "DEALT", 2)
    dealt = experiments.index_entries(docs, WEIGHTS, guarded=True)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({-(-docs.count() // 2)})" in plan
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))
