"""Small numeric expressions shared by projections and range queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.functions.vocabulary import CURRENCY


def drop_off(count: Column, previous: Column) -> Column:
    """1 - count/previous; null without a previous stage or when it is 0."""
    return F.lit(1.0) - count.cast("double") / F.nullif(previous, F.lit(0)).cast("double")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    ratio = numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")
    return F.coalesce(ratio, F.lit(0.0))


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def micros_to_hours(micros: Column) -> Column:
    return micros / F.lit(3.6e9)


def money(amount: Column) -> Column:
    return F.struct(amount.alias("amount"), F.lit(CURRENCY).alias("currency"))
