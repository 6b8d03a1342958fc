"""Registered queries about dates and dataset files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dates, texts
from tidewell.operators import datasets, validation
from tidewell.plans.views import table, view, with_views

AS_OF = "2024-01-31"
ORDERS_AS_OF = "2001-06-15"
PREFIXES = {"default": "data-exhaust/", "raw": "data-exhaust/"}
PUBLIC_DATASETS = ["summary-rollup"]
CDN = "https://cdn.example.com/store"


def _day(text: str):
    return F.lit(text).cast("date")


def period_functions(spark, sf_dir):
    moment = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").withColumn("ts", moment)
    ts = F.col("ts")
    days = dates.day_range(ts, 7)
    months = dates.month_range(ts, 2)
    later = ts + F.expr("INTERVAL 50 DAYS")
    return rows.select(
        "event_id",
        dates.period_of(dates.day_text(F.to_date(ts))).alias("period"),
        dates.period_of(F.col("event_type")).alias("bad_period"),
        dates.days_between(ts, later).alias("day_count"),
        dates.weeks_between(ts, later).alias("week_count"),
        dates.weeks_between(later, ts).alias("weeks_back"),
        days[0].alias("day_from"),
        days[1].alias("day_to"),
        months[0].alias("month_from"),
        months[1].alias("month_to"),
        dates.week_period(ts).alias("week_period"),
        dates.week_label(ts).alias("week_label"),
        dates.day_text(F.date_sub(F.to_date(ts), 1)).alias("previous_day"),
        dates.hours_left_in_day(ts).alias("hours_left"),
        dates.round_half_up(F.col("value"), 1).alias("rounded"),
    )


def interval_range(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in [*dates.INTERVAL_NAMES, "LAST_YEAR"]])
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    named = rows.withColumn("name", F.get(names, (F.col("event_id") % 7).cast("int")))
    start, end = dates.interval_range(F.col("name"), F.col("ts"))
    return named.select("event_id", "name", start.alias("from_day"), end.alias("to_day"))


def window_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    first = F.to_date(F.col("o_orderdate").cast("timestamp"))
    shift = ((F.col("o_orderkey") % 47) - 3).cast("int")
    public = F.col("o_orderkey") % 2 == 0
    asked = rows.select(
        "o_orderkey", dates.day_text(first).alias("start"), dates.day_text(F.date_add(first, shift)).alias("end"), public.alias("public")
    )
    failure = validation.window_failure(F.col("start"), F.col("end"), _day(ORDERS_AS_OF), F.col("public"))
    return asked.withColumn("failure", failure)


def _channel(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    windows = datasets.channel_windows(view(spark, sf_dir, "exhaust_requests"), _day(AS_OF), PREFIXES)
    return windows, datasets.window_files(windows, view(spark, sf_dir, "dataset_files"))


def channel_exhaust_windows(spark, sf_dir):
    """The window of each request; its files are those of the window."""
    return _channel(spark, sf_dir)[0].select("seq", "channel", "folder", "start", "end", "failure")


def channel_exhaust_files(spark, sf_dir):
    return _channel(spark, sf_dir)[1]


def channel_exhaust_periods(spark, sf_dir):
    return datasets.period_counts(_channel(spark, sf_dir)[1])


def channel_exhaust_answer(spark, sf_dir):
    windows, files = _channel(spark, sf_dir)
    return datasets.window_answers(windows, files, ["seq", "channel"], public=False)


def _public(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    requests = view(spark, sf_dir, "public_requests")
    windows = datasets.public_windows(requests, _day(AS_OF), PREFIXES, PUBLIC_DATASETS)
    return windows, datasets.window_files(windows, view(spark, sf_dir, "public_files"))


def public_exhaust_files(spark, sf_dir):
    files = _public(spark, sf_dir)[1]
    return files.select("folder", "start", "end", "period", texts.cdn_url(CDN, F.col("path")).alias("url"))


def public_exhaust_answer(spark, sf_dir):
    windows, files = _public(spark, sf_dir)
    return datasets.window_answers(windows, files, ["seq"], public=True)


def dataset_file_periods(spark, sf_dir):
    return datasets.file_periods(view(spark, sf_dir, "dataset_files"))


QUERIES = {
    f.__name__: f
    for f in (
        period_functions,
        interval_range,
        window_rules,
        channel_exhaust_windows,
        channel_exhaust_files,
        channel_exhaust_periods,
        channel_exhaust_answer,
        public_exhaust_files,
        public_exhaust_answer,
        dataset_file_periods,
    )
}

# -- SQL twins ---------------------------------------------------------------

_LOCAL = "cast(ts + interval '330' minute as date)"
_NUMBER = "cast(strftime({0}, '%Y%m%d') as integer)"


def _failure(public: str, as_of: str) -> str:
    return f"""case when try_cast(s_start as date) is null or try_cast(s_end as date) is null
  then 'Please give ''from'' & ''to'' as dates in the format yyyy-MM-dd'
 when s_end > '{as_of}' then '''to'' should be LESSER OR EQUAL TO today''s date..'
 when try_cast(s_end as date) < try_cast(s_start as date) then 'Date range should not be -ve. Please check your ''from'' & ''to'''
 when {public} and date_diff('day',try_cast(s_start as date),try_cast(s_end as date)) > 30 then 'Date range should be < 30 days'
 when not {public} and date_diff('day',try_cast(s_start as date),try_cast(s_end as date)) > 10 then 'Date range should be < 10 days'
 when {public} and try_cast(s_start as date) < cast('{as_of}' as date) - interval 2 month then 'Date range cannot be older than 2 months' end"""


_CHANNEL = f"""{with_views("exhaust_requests", "dataset_files")},
spans AS (select *, coalesce(since_day,from_day,'2024-01-30') s_start, coalesce(to_day,'2024-01-31') s_end from exhaust_requests),
windows AS (select *, concat('data-exhaust/',dataset_id,'/',channel,'/') folder, {_failure("false", AS_OF)} failure from spans),
listed AS (select folder, s_start, s_end, regexp_extract(path,'[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') period, path
 from (select distinct folder, s_start, s_end from windows where failure is null) w join dataset_files on starts_with(path, folder)
 and regexp_extract(path,'[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') between s_start and s_end)"""

_INTERVALS = """case date_range when 'LAST_DAY' then '2024-01-30' when 'LAST_2_DAYS' then '2024-01-29' when 'LAST_7_DAYS' then '2024-01-24'
 when 'LAST_14_DAYS' then '2024-01-17' when 'LAST_30_DAYS' then '2024-01-01' when 'LAST_WEEK' then '2024-01-22' when 'LAST_YEAR' then '' end"""
_PUBLIC = f"""{with_views("public_requests", "public_files")},
named AS (select *, {_INTERVALS} i_from, case when date_range='LAST_WEEK' then '2024-01-29' when date_range='LAST_YEAR' then ''
 when date_range is not null then '2024-01-31' end i_to from public_requests),
spans AS (select *, coalesce(since_day, i_from, on_day, from_day, '2024-01-30') s_start, coalesce(i_to, on_day, to_day, '2024-01-31') s_end from named),
windows AS (select *, concat('data-exhaust/',dataset_id,'/') folder, case when dataset_id<>'summary-rollup' then 'Provided dataset is invalid. Please use any one from this list - [summary-rollup]'
 when date_range='LAST_YEAR' then 'Provided dateRange LAST_YEAR is not valid. Please use any one from this list - List(LAST_DAY, LAST_2_DAYS, LAST_7_DAYS, LAST_14_DAYS, LAST_30_DAYS, LAST_WEEK)'
 else {_failure("true", AS_OF)} end failure from spans),
listed AS (select folder, s_start, s_end, regexp_extract(path,'[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') period, path
 from (select distinct folder, s_start, s_end from windows where failure is null) w join public_files on starts_with(path, folder)
 and regexp_extract(path,'[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') between s_start and s_end)"""

_EMPTY = "Files are not available for requested date. Might not yet generated. Please come back later"

ORACLES = {
    "period_functions": f"""select event_id, {_NUMBER.format("ts")} period, 0 bad_period, 50 day_count, 7 week_count, -7 weeks_back,
 {_NUMBER.format("ts + interval '330' minute - interval '7' day")} day_from, {_NUMBER.format("ts + interval '330' minute")} day_to,
 cast(strftime(ts - interval 2 month + interval '330' minute,'%Y%m') as integer) month_from,
 cast(strftime(ts + interval '330' minute,'%Y%m') as integer) month_to,
 cast(concat(year({_LOCAL}),'7',lpad(cast(weekofyear({_LOCAL}) as varchar),2,'0')) as integer) week_period,
 concat(year({_LOCAL}),'-',lpad(cast(weekofyear({_LOCAL}) as varchar),2,'0')) week_label,
 strftime(ts - interval '1' day,'%Y-%m-%d') previous_day,
 (epoch_us(date_trunc('day',ts) + interval '1' day) - epoch_us(ts))//3600000000 hours_left,
 round(value,1) rounded from events""",
    "interval_range": f"""with named as (select event_id, {_LOCAL} d,
 ['LAST_DAY','LAST_2_DAYS','LAST_7_DAYS','LAST_14_DAYS','LAST_30_DAYS','LAST_WEEK','LAST_YEAR'][mod(event_id,7)+1] name from events)
select event_id, name, case name when 'LAST_DAY' then strftime(d-1,'%Y-%m-%d') when 'LAST_2_DAYS' then strftime(d-2,'%Y-%m-%d')
 when 'LAST_7_DAYS' then strftime(d-7,'%Y-%m-%d') when 'LAST_14_DAYS' then strftime(d-14,'%Y-%m-%d') when 'LAST_30_DAYS' then strftime(d-30,'%Y-%m-%d')
 when 'LAST_WEEK' then strftime(date_trunc('week',d - 7),'%Y-%m-%d') else '' end from_day,
 case when name='LAST_YEAR' then '' when name='LAST_WEEK' then strftime(date_trunc('week',d),'%Y-%m-%d') else strftime(d,'%Y-%m-%d') end to_day from named""",
    "window_rules": f"""with asked as (select o_orderkey, strftime(o_orderdate,'%Y-%m-%d') s_start,
 strftime(cast(o_orderdate as date)+cast(mod(o_orderkey,47)-3 as integer),'%Y-%m-%d') s_end, mod(o_orderkey,2)=0 public from orders)
select o_orderkey, s_start as "start", s_end as "end", public, {_failure("public", ORDERS_AS_OF)} failure from asked""",
    "channel_exhaust_windows": f"""{_CHANNEL} select seq, channel, folder, s_start as "start", s_end as "end", failure from windows""",
    "channel_exhaust_files": f"""{_CHANNEL} select folder, s_start as "start", s_end as "end", period, path from listed""",
    "channel_exhaust_periods": f"""{_CHANNEL} select folder, s_start as "start", s_end as "end", period, count(*) files from listed group by 1,2,3,4""",
    "channel_exhaust_answer": f"""{_CHANNEL} select seq, channel, case when failure is null then 'OK' else 'CLIENT_ERROR' end response_code,
 failure message, case when failure is null then coalesce(n,0) else 0 end files from windows w
 left join (select folder, s_start, s_end, count(*) n from listed group by 1,2,3) l on l.folder=w.folder and l.s_start=w.s_start and l.s_end=w.s_end""",
    "public_exhaust_files": f"""{_PUBLIC} select folder, s_start as "start", s_end as "end", period, concat('https://cdn.example.com/store/',path) url from listed""",
    "public_exhaust_answer": f"""{_PUBLIC} select seq, case when failure is null then 'OK' else 'CLIENT_ERROR' end response_code,
 coalesce(failure, case when n=0 then '{_EMPTY}' end) message, n files
 from (select w.seq, failure, case when failure is null then coalesce(c,0) else 0 end n from windows w
 left join (select folder, s_start, s_end, count(*) c from listed group by 1,2,3) l on l.folder=w.folder and l.s_start=w.s_start and l.s_end=w.s_end) x""",
    "dataset_file_periods": f"""{with_views("dataset_files")} select regexp_extract(path,'^(.*/)',1) folder,
 coalesce(nullif(regexp_extract(path,'[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'),''),'default') period, count(*) files from dataset_files group by 1,2""",
}
