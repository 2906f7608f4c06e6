"""Time buckets. All truncation is in UTC: the session zone must be UTC (see session.py)."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.vocabulary import GRANULARITIES


def instant(value: datetime | None) -> Column:
    """A naive UTC date-time as a timestamp literal, whatever the driver machine's own zone."""
    return F.lit(None if value is None else value.isoformat(sep=" ")).cast("timestamp")


def bucket_start(granularity: str, ts: Column) -> Column:
    """Start of the bucket holding ``ts``; weeks start on Monday."""
    return F.date_trunc(granularity, ts)


def bucket_end(granularity: Column, start: Column) -> Column:
    """First instant after the bucket."""
    return (
        F.when(granularity == "hour", start + F.expr("INTERVAL 1 HOUR"))
        .when(granularity == "day", start + F.expr("INTERVAL 1 DAY"))
        .when(granularity == "week", start + F.expr("INTERVAL 7 DAYS"))
        .otherwise(start + F.expr("INTERVAL 1 MONTH"))
    )


def document_id(granularity: Column, start: Column, key: Column | None = None) -> Column:
    """``granularity:yyyy-MM-ddTHH[:key]``; a null key is left out."""
    parts = [granularity, F.date_format(start, "yyyy-MM-dd'T'HH")]
    return F.concat_ws(":", *parts, *([key] if key is not None else []))


def at_every_granularity(ts: Column) -> Column:
    """Array of the four (granularity, bucket_start) pairs that ``ts`` falls in."""
    return F.array(
        *[
            F.struct(F.lit(g).alias("granularity"), bucket_start(g, ts).alias("bucket_start"))
            for g in GRANULARITIES
        ]
    )


def in_every_bucket(df: DataFrame, ts: str) -> DataFrame:
    """Each row four times, once per granularity, with (granularity, bucket_start) in place of ts."""
    rest = [c for c in df.columns if c != ts]
    return df.select(*rest, F.inline(at_every_granularity(F.col(ts))))


def hours_between(bounds: DataFrame) -> DataFrame:
    """Every hour touching [window_from, window_to), one row each, from a one-row frame."""
    last = F.date_trunc("hour", F.col("window_to") - F.expr("INTERVAL 1 MICROSECOND"))
    return bounds.where("window_to > window_from").select(
        F.explode(
            F.sequence(F.date_trunc("hour", "window_from"), last, F.expr("INTERVAL 1 HOUR"))
        ).alias("hour_start")
    )


def buckets_of_hours(hours: DataFrame) -> DataFrame:
    """Distinct (granularity, bucket_start) pairs covering the given hour_start rows."""
    return in_every_bucket(hours.select("hour_start"), "hour_start").distinct()


def window_of(day: date, granularity: str) -> tuple[datetime, datetime]:
    """[from, to) of the bucket enclosing a date. For ``hour`` the whole date: 24 buckets."""
    midnight = datetime(day.year, day.month, day.day)
    if granularity in ("hour", "day"):
        return midnight, midnight + timedelta(days=1)
    if granularity == "week":
        monday = midnight - timedelta(days=midnight.weekday())
        return monday, monday + timedelta(days=7)
    if granularity == "month":
        first = midnight.replace(day=1)
        return first, (first + timedelta(days=32)).replace(day=1)
    raise ValueError(f"unknown granularity: {granularity}")
