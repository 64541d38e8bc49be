"""Months as ``yyyy-MM`` texts and epoch seconds in UTC, whatever the session's time zone."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400


def epoch_seconds(ts: Column) -> Column:
    """Seconds of a timestamp without zone, taken as UTC; by its parts, none of which asks for the session's zone."""
    return F.unix_date(ts.cast("date")).cast("bigint") * DAY + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def first_day(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")


def month_start(month: Column) -> Column:
    return F.unix_date(first_day(month)).cast("bigint") * DAY


def month_end(month: Column) -> Column:
    """The first second after the month."""
    return (F.unix_date(F.last_day(first_day(month))).cast("bigint") + 1) * DAY


def month_of(epoch: Column) -> Column:
    return F.substring(F.date_from_unix_date(F.floor(epoch / DAY).cast("int")).cast("string"), 1, 7)


def is_truncated(month: Column, last_ts: Column, days: int = 2) -> Column:
    """Whether the data of a month stop more than ``days`` days before its last second."""
    return last_ts < month_end(month) - 1 - days * DAY


def month_grid(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row, ``month``, for each month from start to end, both included."""
    days = F.sequence(first_day(F.lit(start)), first_day(F.lit(end)), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(days).alias("day")).select(F.date_format("day", "yyyy-MM").alias("month"))


def last_full_month(today: date) -> str:
    y, m = divmod(today.year * 12 + today.month - 2, 12)
    return f"{y}-{m + 1:02d}"
