"""Registered queries of the operators, over whole tables, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.llm import (
    bitsliced,
    bpe,
    clustering,
    decontamination,
    extraction,
    jaccard,
    nearest,
    packing,
    passages,
    quality,
    secrets,
    toxicity,
    whitening,
)
from tidewell.llm.common import read

EVERY = 20


def op1_repeated_passages(spark, sf_dir):
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def _fold_1() -> Column:
    """The rows held out from learning."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def op2_toxicity(spark, sf_dir):
    learn = read(spark, sf_dir, "labels").where(~_fold_1())
    scored = toxicity.score(read(spark, sf_dir, "documents"), learn)
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return scored.select("doc_id", _fold_1().alias("held_out"), "score", predicted.alias("predicted"))


def op3_secrets(spark, sf_dir):
    model = secrets.train(secrets.labelled_findings(spark))
    found = secrets.scan(read(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "nth", "value", "probability", "is_secret")


def op4_packing(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.digests(packing.pack(read(spark, sf_dir, "documents"), path))


def op5_nearest_vectors(spark, sf_dir):
    return nearest.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


def op6_quality(spark, sf_dir):
    ratings = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("grade"))
    rated = quality.rate(read(spark, sf_dir, "documents").select("doc_id", "text"), ratings)
    return rated.select("doc_id", "expected_grade", F.element_at("tail", 1).alias("p_good"), "selected")


def op7_exact_top_k(spark, sf_dir):
    return bitsliced.top_products(read(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


def op8_jaccard_groups(spark, sf_dir):
    return jaccard.link_components(read(spark, sf_dir, "documents"))


def op9_main_text(spark, sf_dir):
    return extraction.main_text(read(spark, sf_dir, "pages"))


def op10_bpe(spark, sf_dir):
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_benchmark_hits(spark, sf_dir):
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontamination.digests(decontamination.annotate(docs, benchmark, keep=["doc_id"]))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark, sf_dir):
    return clustering.cluster(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repeated_passages,
        op2_toxicity,
        op3_secrets,
        op4_packing,
        op5_nearest_vectors,
        op6_quality,
        op7_exact_top_k,
        op8_jaccard_groups,
        op9_main_text,
        op10_bpe,
        op11_benchmark_hits,
        op12_whitening,
        op13_centroid_clusters,
    )
}

_NEAREST = """
with rows as (
  select vec_id as id, list_transform(embedding, lambda x: {value}) as v, row_number() over () as row
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 {more}
), pairs as (
  select q.id as query_id, q.row as query_row, c.id as vec_id, cast(list_inner_product(q.v, c.v) as {kind}) as score
  from rows q join rows c on q.row <> c.row and len(q.v) = len(c.v)
  where q.id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id, query_row order by score desc, vec_id) as rank from pairs
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '')"

_JACCARD = f"""
with recursive words as (select doc_id, {_WORDS} as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then cast([] as varchar[][]) when len(w) < 5 then [w]
    else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as s from words
),
entries as (select doc_id, len(s) as n, unnest(s) as x from sets),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as common, any_value(a.n) + any_value(b.n) - count(*) as total
  from entries a join entries b on a.x = b.x and a.doc_id <> b.doc_id
  group by 1, 2
),
links as (select a, b from shared where 100 * common >= 75 * total),
reach(doc_id, c) as (
  select doc_id, doc_id from sets
  union
  select l.b, r.c from reach r join links l on l.a = r.doc_id
)
select s.doc_id, len(s.s) as n_shingles, min(r.c) as component_id
from sets s join reach r on r.doc_id = s.doc_id group by 1, 2
"""

_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_LEAKS = f"""
with docs as materialized (select row_number() over () as row, doc_id, {_TOKENS} as w from documents),
items as (select item_id, {_TOKENS} as w from benchmark),
windows as materialized (
  select distinct item_id, unnest(case when len(w) = 0 then cast([] as varchar[][]) when len(w) < 10 then [w]
    else list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) end) as x from items
),
lengths as (select distinct len(x) as n from windows),
places as (
  select row, n, s, w[s:s + n - 1] as x
  from (select row, n, w, unnest(range(1, len(w) - n + 2)) as s from docs join lengths on n <= len(w))
),
hits as materialized (select distinct p.row, p.n, p.s, v.item_id from places p join windows v on p.x = v.x),
covered as (
  select row, count(distinct place) as n_hit from (select row, unnest(range(s, s + n)) as place from hits) group by row
),
found as (
  select row, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct row, cast(item_id as varchar) as name from hits where item_id is not null) group by row
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(f.n_items, 0) as bigint) as n_items, sha256(coalesce(f.names, '')) as items_sha256,
  coalesce(c.n_hit, 0) > 0 as contaminated
from docs d left join covered c on c.row = d.row left join found f on f.row = d.row
"""


def _clusters_sql(rounds: int = clustering.ROUNDS, k: int = clustering.CLUSTERS, dims: int = 64) -> str:
    """Every round compares every vector with every centroid."""
    distance = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - c.c[i]) * (v.x[i] - c.c[i])))"
    steps = [
        f"""kept as materialized (
  select vec_id, row_number() over () as row,
    list_transform(embedding, lambda e: cast(floor({clustering.SCALE} * cast(e as double)) as bigint)) as x
  from embeddings
  where embedding is not null and len(embedding) = {dims}
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
)""",
        f"""c0 as materialized (
  select row_number() over (order by sha256('3:' || cast(vec_id as varchar)), x) - 1 as j, x as c
  from kept qualify j < {k}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (
  select row, vec_id, x, j, d from (
    select v.row, v.vec_id, v.x, c.j, {distance} as d from kept v, c{r} c
  ) qualify row_number() over (partition by row order by d, j) = 1
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} as materialized (
  select o.j, coalesce(m.c, o.c) as c
  from c{r} o left join (
    select j, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c
    from (
      select j, i, sum(e) as s, count(*) as n
      from (select j, unnest(x) as e, generate_subscripts(x, 1) as i from a{r}) group by j, i
    ) group by j
  ) m on m.j = o.j
)""")
    return f"""with {", ".join(steps)}
select a.vec_id, cast(a.j as integer) as cluster, cast(a.d as bigint) as distance,
  cast(sum(a.d) over (partition by a.j) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
  sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on c.j = a.j"""


ORACLES = {
    "op8_jaccard_groups": _JACCARD,
    "op5_nearest_vectors": _NEAREST.format(
        value="cast(x as double)", kind="double", more="and len(list_filter(embedding, lambda x: x <> 0)) > 0"
    ),
    "op11_benchmark_hits": _LEAKS,
    "op13_centroid_clusters": _clusters_sql(),
    "op7_exact_top_k": _NEAREST.format(value="floor(64 * cast(x as double))", kind="bigint", more=""),
}
