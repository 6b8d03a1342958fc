"""Registered queries about experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import hashing
from tidewell.operators import experiments, validation
from tidewell.operators.rules import with_status
from tidewell.plans.views import view, with_views
from tidewell.session import work_folder
from tidewell.sources.documents import experiment_documents as read_documents

AS_OF = "2024-01-15"


def documents(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "experiments")
    return rows.withColumnsRenamed({"start_date": "startDate", "end_date": "endDate", "exp_key": "key"})


_INDEXES: dict[tuple[str, str], DataFrame] = {}


def build_index(spark, sf_dir) -> DataFrame:
    return experiments.build_index(documents(spark, sf_dir))


def experiment_index(spark, sf_dir) -> DataFrame:
    """The index of a table folder, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(spark, sf_dir)
    return _INDEXES[key]


def matched(spark, sf_dir) -> DataFrame:
    return experiments.match(view(spark, sf_dir, "lookups"), experiment_index(spark, sf_dir))


def experiment_key(spark, sf_dir):
    rows = view(spark, sf_dir, "lookups")
    key = hashing.lookup_key(*[F.col(c) for c in ("deviceId", "userId", "url", "producer")])
    return rows.select("lookup_id", key.alias("lookup_key"))


def modulus_bucket(spark, sf_dir):
    rows = view(spark, sf_dir, "experiments")
    return rows.select(
        "id",
        hashing.string_hash(F.col("id")).alias("id_hash"),
        F.coalesce(hashing.string_hash(F.col("userId")), F.lit(0)).alias("user_hash"),
        experiments.modulus_gate().alias("passes"),
    )


def experiment_match(spark, sf_dir):
    return matched(spark, sf_dir).select("lookup_id", "experiment_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def experiment_match_repeated(spark, sf_dir):
    """Lookups whose ids repeat or are missing; every row is answered by its own fields."""
    rows = view(spark, sf_dir, "repeated_lookups")
    found = experiments.match(rows, experiment_index(spark, sf_dir))
    return found.select("seq", "lookup_id", "experiment_id", F.coalesce("score", F.lit(0.0)).alias("score"))


SMALL_WEIGHT = 0.25


def experiment_match_small_weight(spark, sf_dir):
    """Matches in which an equality of all given fields counts less than other documents' lacking fields."""
    index = experiments.build_index(documents(spark, sf_dir), guarded=True)
    found = experiments.match(view(spark, sf_dir, "lookups"), index, SMALL_WEIGHT)
    return found.select("lookup_id", "experiment_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def experiment_assign(spark, sf_dir):
    return experiments.assign(matched(spark, sf_dir)).select("lookup_id", "experiment_id", "assigned", "actions")


def experiment_validate(spark, sf_dir):
    rows = view(spark, sf_dir, "experiment_requests")
    failures = experiments_failures()
    return rows.select("seq", F.to_json(with_status(failures)).alias("errors"))


def experiments_failures():
    columns = [F.col(c) for c in ("exp_id", "exp_name", "created_by", "criteria", "exp_data")]
    return validation.experiment_failures(*columns, F.lit(AS_OF).cast("date"))


def experiment_upsert(spark, sf_dir):
    requests = view(spark, sf_dir, "experiment_requests").filter(F.size(experiments_failures()) == 0)
    registry = view(spark, sf_dir, "experiment_definitions")
    merged = experiments.merge_experiments(registry, requests, F.lit(AS_OF).cast("date"))
    return merged.select(
        "exp_id",
        "exp_name",
        "created_by",
        "updated_by",
        "status",
        "status_message",
        "stats",
        "criteria",
        F.unix_millis("updated_on").alias("updated_ms"),
        "action",
    )


def experiment_get(spark, sf_dir):
    return experiments.experiment_answers(view(spark, sf_dir, "experiment_definitions"))


def experiment_documents(spark, sf_dir):
    """Documents written as JSON lines and loaded again; those without an id are left out."""
    folder = work_folder(spark, "experiment-documents")
    rows = documents(spark, sf_dir).withColumn("id", F.when(~F.col("id").endswith("7"), F.col("id")))
    rows.write.mode("overwrite").json(folder)
    loaded = read_documents(spark, folder)
    return loaded.select("id", "name", "key", "expType", "userId", "deviceId", "url", "userIdMod", "deviceIdMod")


def experiment_read(spark, sf_dir):
    """Reads by id, of which some do not exist."""
    asked = view(spark, sf_dir, "experiment_requests").select("seq", "exp_id")
    return experiments.read_experiments(view(spark, sf_dir, "experiment_definitions"), asked).select(
        "seq", "exp_id", "response_code", "message", F.get_json_object("experiment", "$.status").alias("status")
    )


QUERIES = {
    f.__name__: f
    for f in (
        experiment_key,
        modulus_bucket,
        experiment_match,
        experiment_match_repeated,
        experiment_match_small_weight,
        experiment_assign,
        experiment_validate,
        experiment_upsert,
        experiment_get,
        experiment_read,
        experiment_documents,
    )
}

# -- SQL twins ---------------------------------------------------------------


def _mul(value: str, factor: int) -> str:
    return f"mod(cast({value} as hugeint)*{factor}, 4294967296)"


def _rotl(value: str, bits: int) -> str:
    return f"(mod(({value})*{2**bits}, 4294967296) + ({value})//{2**(32 - bits)})"


# Hash steps of ASCII text, one lateral column after the other; `c` is the list of character codes.
_HASHED = f"""{{name}} AS (
select id, case when h >= 2147483648 then cast(h - 4294967296 as bigint) else cast(h as bigint) end hash from (
 select id, cast(xor(cast(f2 as ubigint), cast(f2//65536 as ubigint)) as hugeint) h from (
 select id, {_mul("cast(xor(cast(f1 as ubigint), cast(f1//8192 as ubigint)) as hugeint)", 3266489909)} f2 from (
 select id, {_mul("cast(xor(cast(f0 as ubigint), cast(f0//65536 as ubigint)) as hugeint)", 2246822507)} f1 from (
 select id, cast(xor(cast(t as ubigint), cast(n as ubigint)) as hugeint) f0 from (
 select id, n, case when mod(n,2)=1 then cast(xor(cast(body as ubigint), cast({_mul(_rotl(_mul("c[n]", 3432918353), 15), 461845907)} as ubigint)) as hugeint)
  else body end t from (
 select id, n, c,
  list_reduce([cast(c[2*i-1] as hugeint)*65536+c[2*i] for i in range(1, n//2+1)],
  lambda a, b: mod({_mul(_rotl("cast(xor(cast(a as ubigint), cast(" + _mul(_rotl(_mul("b", 3432918353), 15), 461845907) + " as ubigint)) as hugeint)", 13), 5)} + 3864292196, 4294967296),
  cast(4157243346 as hugeint)) body
 from (select id, length(s) n, [unicode(s[i]) for i in range(1, length(s)+1)] c from ({{source}})))))))))"""


def _hash_cte(name: str, source: str) -> str:
    return _HASHED.replace("{name}", name).replace("{source}", source)


# Every lookup triple against every document that shares a value, scored by the definition.
_MATCHED = f"""{with_views("experiments", "lookups")},
triples AS (select distinct userId u, deviceId d, url l from lookups),
stat AS (select 'u' f, userId v, count(*) n, (select count(userId) from experiments) t from experiments where userId is not null group by 2
 union all select 'd', deviceId, count(*), (select count(deviceId) from experiments) from experiments where deviceId is not null group by 2
 union all select 'l', url, count(*), (select count(url) from experiments) from experiments where url is not null group by 2),
idf AS (select f, v, ln(1.0+(t-n+0.5)/(n+0.5)) w from stat),
pairs AS (select u,d,l,id from triples join experiments on userId=u union select u,d,l,id from triples join experiments on deviceId=d
 union select u,d,l,id from triples join experiments on url=l),
scored AS (select p.u,p.d,p.l,e.id, coalesce(e.userId=p.u,false) mu, coalesce(e.deviceId=p.d,false) md, coalesce(e.url=p.l,false) ml,
 e.userId is null xu, e.deviceId is null xd, e.url is null xl from pairs p join experiments e on p.id=e.id),
totals AS (select s.u,s.d,s.l,s.id, round(0.0 + case when mu then iu.w else 0.0 end + case when md then i2.w else 0.0 end + case when ml then il.w else 0.0 end
 + (case when xu then 3.0 else 1.0 end * case when xd then 3.0 else 1.0 end * case when xl then 3.0 else 1.0 end)
 * case when (s.u is null or mu) and (s.d is null or md) and (s.l is null or ml) then 9.0 else 1.0 end, 6) score
 from scored s left join idf iu on iu.f='u' and iu.v=s.u left join idf i2 on i2.f='d' and i2.v=s.d left join idf il on il.f='l' and il.v=s.l),
best AS (select * from (select *, row_number() over (partition by u,d,l order by score desc, id) rn from totals) where rn=1)"""

_GATED = f"""{_hash_cte("user_hashes", "select id, userId s from experiments where userId is not null")},
{_hash_cte("device_hashes", "select id, deviceId s from experiments where deviceId is not null")},
gated AS (select e.id, coalesce(case when e.userId is not null then mod(uh.hash,e.userIdMod)=0 when e.deviceId is not null then mod(dh.hash,e.deviceIdMod)=0
 else false end, false) modulus_ok from experiments e left join user_hashes uh on e.id=uh.id left join device_hashes dh on e.id=dh.id)"""

_DATES = """dated AS (select *, coalesce(exp_data->>'$.endDate','') e, coalesce(exp_data->>'$.startDate','') s from experiment_requests)"""


def _entry(key: str, condition: str, message: str) -> str:
    return f"""case when {condition} then '"{key}":"{message}",' else '' end"""


_ERRORS = f"""judged AS (select *, concat(
 {_entry("request.expid", "exp_id is null", "Experiment Id should not be  empty")},
 {_entry("request.name", "exp_name is null", "Experiment Name should not be  empty")},
 {_entry("request.createdBy", "criteria is null", "Criteria should not be empty")},
 {_entry("request.createdBy", "criteria is not null and created_by is null", "Created By should not be empty")},
 {_entry("request.filters", "not contains(criteria,'filters')", "Criteria Filters should not be empty")},
 {_entry("request.type", "contains(criteria,'filters') and not contains(criteria,'type')", "Criteria Type should not be empty")},
 {_entry("request.data", "exp_data is null", "Experiment Data should not be empty")},
 {_entry("data.endDate", "exp_data is not null and e=''", "Experiment End_Date should not be empty")},
 {_entry("data.endDate", "e<>'' and e<'2024-01-15'", "End_Date should be greater than today''s date.")},
 {_entry("data.startDate", "e>='2024-01-15' and s=''", "Experiment Start_Date should not be empty")},
 {_entry("data.startDate", "e>='2024-01-15' and s<>'' and s<'2024-01-15'", "Start_Date should be greater than or equal to today''s date..")},
 {_entry("data.startDate", "e>='2024-01-15' and s>='2024-01-15' and e<s", "Date range should not be -ve. Please check your start_date & end_date")}) problems from dated)"""

ORACLES = {
    "experiment_key": f"""{with_views("lookups")} select lookup_id, concat(coalesce(deviceId,'NA'),':',coalesce(userId,'NA'),':',
 coalesce(url,'NA'),':',coalesce(producer,'NA')) lookup_key from lookups""",
    "modulus_bucket": f"""{with_views("experiments")}, {_hash_cte("id_hashes", "select id, id s from experiments")}, {_GATED}
select e.id, ih.hash id_hash, coalesce(uh.hash,0) user_hash, modulus_ok passes from experiments e join id_hashes ih on e.id=ih.id
left join user_hashes uh on e.id=uh.id join gated g on e.id=g.id""",
    "experiment_match": f"""{_MATCHED} select lookup_id, id experiment_id, coalesce(score,0.0) score from lookups k left join best b
 on k.userId is not distinct from b.u and k.deviceId is not distinct from b.d and k.url is not distinct from b.l""",
    "experiment_match_small_weight": f"""{_MATCHED.replace("then 9.0 else 1.0", f"then {SMALL_WEIGHT} else 1.0")}
select lookup_id, id experiment_id, coalesce(score,0.0) score from lookups k left join best b
 on k.userId is not distinct from b.u and k.deviceId is not distinct from b.d and k.url is not distinct from b.l""",
    "experiment_match_repeated": f"""{_MATCHED} select k.lookup_id seq, case when mod(k.lookup_id,5)=0 then null else mod(k.lookup_id,97) end lookup_id,
 id experiment_id, coalesce(score,0.0) score from lookups k left join best b
 on k.userId is not distinct from b.u and k.deviceId is not distinct from b.d and k.url is not distinct from b.l""",
    "experiment_assign": f"""{_MATCHED}, {_GATED},
chosen AS (select lookup_id, b.id, coalesce(case when e.expType='modulus' then modulus_ok else true end and b.id is not null, false) assigned, e.*
 exclude (id) from lookups k left join best b on k.userId is not distinct from b.u and k.deviceId is not distinct from b.d
 and k.url is not distinct from b.l left join experiments e on b.id=e.id left join gated g on b.id=g.id)
select lookup_id, id experiment_id, assigned, case when assigned then concat('[{{"type":"experiment","data":{{"title":"experiment","experimentId":"',id,
 '","experimentName":"',name,'","key":"',exp_key,'","startDate":"',start_date,'","endDate":"',end_date,'"}}}}]') else '[]' end actions from chosen""",
    "experiment_validate": f"""{with_views("experiment_requests")}, {_DATES}, {_ERRORS}
select seq, concat('{{',problems,'"status":"',case when problems='' then 'success' else 'failed' end,'"}}') errors from judged""",
    "experiment_upsert": f"""{with_views("experiment_requests", "experiment_definitions")}, {_DATES}, {_ERRORS},
incoming AS (select * from (select *, row_number() over (partition by exp_id order by seq) rn from judged where problems='') where rn=1),
merged AS (select coalesce(r.exp_id,n.exp_id) exp_id, r.exp_id is null is_new, n.exp_id is not null and lower(r.status)='failed' again,
 n.exp_id is not null has_new, r.* exclude (exp_id), n.exp_name n_name, n.created_by n_by, n.criteria n_criteria
 from experiment_definitions r full outer join incoming n on r.exp_id=n.exp_id)
select exp_id, case when is_new or again then n_name else exp_name end exp_name, case when is_new or again then n_by else created_by end created_by,
 case when is_new or again then 'Experiment_CREATE_API' else updated_by end updated_by, case when is_new or again then 'SUBMITTED' else status end status,
 case when is_new or again then 'Experiment successfully submitted' else status_message end status_message,
 case when is_new or again then '' else stats end stats, case when is_new or again then n_criteria else criteria end criteria,
 case when is_new or again then epoch_us(timestamp '2024-01-15 00:00:00') else epoch_us(updated_on) end//1000 updated_ms,
 case when is_new then 'inserted' when again then 'resubmitted' when has_new then 'ExperimentId already exists.' else 'kept' end action from merged""",
    "experiment_documents": f"""{with_views("experiments")} select id, name, exp_key as "key", expType, userId, deviceId, url, userIdMod, deviceIdMod
 from experiments where not id like '%7'""",
    "experiment_read": f"""{with_views("experiment_definitions", "experiment_requests")}
select q.seq, q.exp_id, 'OK' response_code, case when d.exp_id is null then 'no experiment available with the given experimentid' end message,
 d.status from experiment_requests q left join experiment_definitions d on q.exp_id=d.exp_id""",
    "experiment_get": f"""{with_views("experiment_definitions")}
select exp_id, exp_name name, created_by, exp_description description, criteria, exp_data data,
 case when upper(status) in ('ACTIVE','FAILED') then stats else '{{}}' end stats, epoch_us(updated_on)//1000 last_updated,
 epoch_us(created_on)//1000 submitted, status, status_message status_msg from experiment_definitions""",
}
