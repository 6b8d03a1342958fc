"""Registered queries and the pipeline's stages."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidewell.llm import jaccard, passages
from tidewell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) < set(names) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES) and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    result = con.execute(ORACLES[name])
    header = [d[0] for d in result.description]
    assert sorted(header) == columns
    at = [header.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in frame.collect()) == sorted(
        tuple(r[i] for i in at) for r in result.fetchall()
    )


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_covers_its_table(spark, name):
    """One row at least of every document, page or vector, or findings in some of them; see the modules' own tests."""
    found = entry.queries()[name](spark, SF)
    n = found.count()
    counts = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    whole = {"op2": "documents", "op6": "documents", "op9": "pages", "op10": "documents"}
    of = name.split("_")[0]
    if of in whole:
        assert n == counts[whole[of]]
    elif of == "op4":
        assert n >= counts["documents"] == found.select("doc_id").distinct().count()
    elif of == "op12":
        assert n == 16 * counts["embeddings"]
    else:
        assert of in ("op1", "op3") and 0 < n


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns and sizes[-1] <= sizes[-2]
        if i == 1:
            groups = {r.component_id for r in jaccard.link_components(before).collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == groups
        if i == 2:
            spans = {r.doc_id for r in passages.repeated_passages(before).collect()}
            texts = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id for r in docs.collect() if r.text != texts[r.doc_id]} == spans
    assert sum(r.length for r in docs.collect()) == sum(r.doc_tokens for r in docs.where("start = 0").collect())


@pytest.mark.parametrize("rows", ["awkward", "none"])
def test_stages_take_awkward_rows(spark, awkward, rows):
    """Every stage on nulls, empty, very long and repeated texts, clashing names, and on an empty table."""
    docs = awkward if rows == "awkward" else awkward.limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF)
        if i < 4:
            assert found.columns == docs.columns
            assert found.count() <= docs.count()
        elif rows == "none":
            assert found.count() == 0
        else:
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            assert {r.doc_id for r in found.collect()} == kept and {1, 2, 4, 8, 9} <= kept and 5 in kept
        # Each stage is given the whole awkward table, not what the one before has left of it.


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(corpus_pipeline.STAGES) == 5
