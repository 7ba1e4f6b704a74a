"""Time functions; every one takes its ``as_of`` instead of reading a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch of a timestamp without zone."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")


def to_madrid(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("Europe/Madrid"), ts)


def age_seconds(ts: Column, as_of: Column) -> Column:
    return seconds(as_of) - seconds(ts)


def time_ago(ts: Column, as_of: Column) -> Column:
    a = age_seconds(ts, as_of)
    num = lambda k: F.floor(a / k).cast("string")
    return (
        F.when(a < 60, F.lit("刚刚"))
        .when(a < 3600, F.concat(num(60), F.lit("分钟前")))
        .when(a < DAY, F.concat(num(3600), F.lit("小时前")))
        .when(a < 2 * DAY, F.lit("昨天"))
        .otherwise(F.concat(num(DAY), F.lit("天前")))
    )


def day_bucket(ts: Column, as_of: Column) -> Column:
    d = F.datediff(to_madrid(as_of).cast("date"), to_madrid(ts).cast("date"))
    return F.when(d == 0, F.lit("today")).when(d == 1, F.lit("yesterday")).otherwise(F.lit("earlier"))


def days_left(created: Column, as_of: Column, days: int) -> Column:
    return F.greatest(F.lit(0), F.lit(days) - F.floor(age_seconds(created, as_of) / DAY)).cast("int")


def top_days_left(is_top: Column, expires: Column, as_of: Column) -> Column:
    return F.when((is_top == 1) & expires.isNotNull(), F.greatest(F.lit(0), F.ceil((seconds(expires) - seconds(as_of)) / DAY)).cast("int"))


def midnight_madrid_utc(as_of: Column) -> Column:
    """The last Madrid midnight before ``as_of``, in UTC."""
    return F.convert_timezone(F.lit("Europe/Madrid"), F.lit("UTC"), F.date_trunc("day", to_madrid(as_of)).cast("timestamp_ntz"))


def purge_after(day: Column, days: int = 90) -> Column:
    """The day from which a record collected on ``day`` may go."""
    return F.date_add(day.cast("date"), days)
