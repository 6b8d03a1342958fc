"""Periods, day arithmetic and named intervals; "today" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named intervals in the order in which they are listed to users.
DAY_INTERVALS = {"LAST_DAY": 1, "LAST_2_DAYS": 2, "LAST_7_DAYS": 7, "LAST_14_DAYS": 14, "LAST_30_DAYS": 30}
WEEK_INTERVAL = "LAST_WEEK"
INTERVAL_NAMES = [*DAY_INTERVALS, WEEK_INTERVAL]

LOCAL_OFFSET = "+05:30"
_DAY = "yyyy-MM-dd"


def day_text(day: Column) -> Column:
    return F.date_format(day, _DAY)


def local_day(moment: Column, offset: str = LOCAL_OFFSET) -> Column:
    """Calendar day of a UTC timestamp at a fixed offset."""
    return F.to_date(F.from_utc_timestamp(moment, offset))


def period_of(text: Column) -> Column:
    """``2020-01-02`` to 20200102; anything that is not a number gives 0."""
    return F.coalesce(F.replace(text, F.lit("-"), F.lit("")).try_cast("int"), F.lit(0))


def day_period(moment: Column, offset: str = LOCAL_OFFSET) -> Column:
    return F.date_format(local_day(moment, offset), "yyyyMMdd").cast("int")


def month_period(moment: Column, offset: str = LOCAL_OFFSET) -> Column:
    return F.date_format(local_day(moment, offset), "yyyyMM").cast("int")


def week_period(moment: Column, offset: str = LOCAL_OFFSET) -> Column:
    """Calendar year, ``7``, ISO week: at the turn of a year the two can disagree."""
    day = local_day(moment, offset)
    return F.concat(F.year(day).cast("string"), F.lit("7"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")).cast(
        "int"
    )


def week_label(moment: Column, offset: str = LOCAL_OFFSET) -> Column:
    day = local_day(moment, offset)
    return F.concat_ws("-", F.year(day).cast("string"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(F.to_date(end), F.to_date(start))


def weeks_between(start: Column, end: Column) -> Column:
    """Whole weeks between two moments, by UTC calendar day, truncated toward zero."""
    return (F.datediff(F.to_date(end), F.to_date(start)) / 7).cast("int")


def day_range(moment: Column, count: int, offset: str = LOCAL_OFFSET) -> tuple[Column, Column]:
    return day_period(moment - F.expr(f"INTERVAL {count} DAYS"), offset), day_period(moment, offset)


def month_range(moment: Column, count: int, offset: str = LOCAL_OFFSET) -> tuple[Column, Column]:
    return month_period(moment - F.expr(f"INTERVAL {count} MONTHS"), offset), month_period(moment, offset)


def hours_left_in_day(moment: Column) -> Column:
    """Whole hours until the end of the UTC day."""
    end = F.unix_micros((F.to_date(moment) + F.expr("INTERVAL 1 DAY")).cast("timestamp"))
    return F.floor((end - F.unix_micros(moment)) / F.lit(3_600_000_000)).cast("bigint")


def interval_range(name: Column, moment: Column, offset: str = LOCAL_OFFSET) -> tuple[Column, Column]:
    """(from, to) days of a named interval; empty text for an unknown name."""
    today = local_day(moment, offset)
    monday = F.date_trunc("week", today).cast("date")
    start, end = F.lit(""), F.lit("")
    for label, count in DAY_INTERVALS.items():
        start = F.when(name == label, day_text(F.date_sub(today, count))).otherwise(start)
        end = F.when(name == label, day_text(today)).otherwise(end)
    start = F.when(name == WEEK_INTERVAL, day_text(F.date_sub(monday, 7))).otherwise(start)
    end = F.when(name == WEEK_INTERVAL, day_text(monday)).otherwise(end)
    return start, end


def round_half_up(value: Column, digits: int) -> Column:
    return F.round(value, digits)
