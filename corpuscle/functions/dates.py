"""Dates that are kept as ISO text, windows of the calendar, prices by the hour, and freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days for which a visual record of each status stays fresh.
FRESH_DAYS = {"available": 180, "blocked": 180, "not_found": 30, "error": 1}


def date_precision(c: Column) -> Column:
    """year for empty and January 1st, month for a first day, else day."""
    d = F.coalesce(c, F.lit(""))
    return F.when((d == "") | d.endswith("-01-01"), "year").when(d.endswith("-01"), "month").otherwise("day")


def iso_week(d: Column) -> Column:
    """YYYY-Www of the ISO calendar."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.weekofyear(d))


def week_bounds(d: Column) -> Column:
    """Monday and Sunday of the week."""
    monday = F.date_trunc("week", d).cast("date")
    return F.struct(monday.alias("monday"), F.date_add(monday, 6).alias("sunday"))


def month_windows(start: Column, end: Column) -> Column:
    """(month, from, to) of every calendar month that a closed range touches."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    one = lambda m: F.struct(F.date_format(m, "yyyy-MM").alias("month"), F.greatest(m, start).alias("from_date"), F.least(F.last_day(m), end).alias("to_date"))
    return F.when(start <= end, F.transform(months, one)).otherwise(F.array().cast("array<struct<month:string,from_date:date,to_date:date>>"))


def year_and_month(bucket: Column) -> Column:
    """year and year-month of a bucket name that is a day; nulls otherwise."""
    valid = F.coalesce(bucket, F.lit("")).rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-[0-9]{2}$")
    return F.when(valid, F.struct(F.substring(bucket, 1, 4).cast("int").alias("year"), F.substring(bucket, 1, 7).alias("year_month")))


def in_window(date: Column, start: Column, end: Column) -> Column:
    """the first ten characters are a date within the window; anything else is not."""
    return F.coalesce(F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd").between(start, end), F.lit(False))


def price_window(ts: Column) -> Column:
    """peak on weekdays from 1 to 4 and from 6 to 10 UTC."""
    hour, weekday = F.hour(ts), F.dayofweek(ts).between(2, 6)
    return F.when(weekday & (hour.between(1, 3) | hour.between(6, 9)), "peak").otherwise("off_peak")


def token_cost(hit: Column, miss: Column, prompt: Column, completion: Column, rates: tuple[float, float, float]) -> Column:
    """price of a call at rates per million (cached, uncached, output); without a cache split
    all of the prompt is uncached."""
    known = hit.isNotNull() | miss.isNotNull()
    uncached = F.when(known, F.coalesce(miss, F.lit(0))).otherwise(F.coalesce(prompt, F.lit(0)))
    total = F.coalesce(hit, F.lit(0)) * F.lit(rates[0]) + uncached * F.lit(rates[1]) + F.coalesce(completion, F.lit(0)) * F.lit(rates[2])
    return F.round(total / 1_000_000, 5)


def should_refresh(status: Column, checked_at: Column, now: Column, selector: Column | None = None, current: int = 0) -> Column:
    """A record without a known status or time, past its days, or chosen by an older
    selector is looked up anew."""
    days = F.create_map(*[x for k, v in FRESH_DAYS.items() for x in (F.lit(k), F.lit(v))])
    limit = F.try_element_at(days, status)
    age = F.timestamp_diff("SECOND", checked_at, now)
    stale = F.coalesce(age >= limit * 86400, F.lit(True))
    return stale if selector is None else stale | (F.coalesce(selector, F.lit(0)) < current)
