"""Exact percentiles of fulfillment times over any range of days, from stored histograms.

A duration belongs to the day its leg started: from each start event to the order's first end
event. Per day and leg the table ``histogram`` holds how many durations fall in each minute;
these add up over any range, and tell in which minute a wanted rank falls. Only the durations of
that minute are then read, cut into seconds, and of one second into microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.measures import micros_between
from bazaarlens.plans.dashboards import LEGS

MINUTE, SECOND = 60_000_000, 1_000_000


class Durations(NamedTuple):
    """``facts``: (leg, day, minute, micros, n); ``histogram``: (leg, day, minute, n)."""

    facts: DataFrame
    histogram: DataFrame


def duration_facts(events: DataFrame) -> DataFrame:
    """How often each duration occurs by leg, day of its start and minute; orders without an end
    have none, and a duration is negative where the end came first."""
    timed = events.where("order_id is not null").select("event_type", "order_id", "occurred_at")

    def role(position: int) -> DataFrame:
        legs = F.array(*[F.when(F.col("event_type") == t[position], F.lit(leg)) for leg, t in LEGS.items()])
        legs = F.filter(legs, lambda leg: leg.isNotNull())
        return timed.where(F.col("event_type").isin(*[t[position] for t in LEGS.values()])).select(
            "order_id", "occurred_at", F.explode(legs).alias("leg")
        )

    ends = role(1).groupBy("leg", "order_id").agg(F.min("occurred_at").alias("ended_at"))
    pairs = role(0).join(ends, ["leg", "order_id"])
    micros = micros_between(F.col("occurred_at"), F.col("ended_at"))
    rows = pairs.select("leg", F.to_date("occurred_at").alias("day"), micros.alias("micros"))
    rows = rows.groupBy("leg", "day", "micros").agg(F.count("*").alias("n"))
    return rows.withColumn("minute", F.floor(F.col("micros") / MINUTE))


def histogram(facts: DataFrame) -> DataFrame:
    return facts.groupBy("leg", "day", "minute").agg(F.sum("n").alias("n"))


def range_percentiles(durations: Durations, ranges: DataFrame, percents: Sequence[int]) -> DataFrame:
    """(range, leg, percent, micros): nearest-rank percentiles over the days [date_from, date_to) of
    each row of ``ranges`` (range, date_from, date_to). Ranges and legs without a duration give no row.
    """
    last = F.date_sub("date_to", 1)
    days = ranges.where("date_to > date_from").select("range", F.explode(F.sequence("date_from", last)).alias("day"))
    keys = ["range", "leg"]
    bins = durations.histogram.join(days, "day").groupBy(*keys, "minute").agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    wanted = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    ranks = bins.select(*keys, "minute", "n", whole.alias("total")).select(
        *keys, F.col("minute").alias("bin"), "n", "total", wanted
    )
    rank = F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("total") / 100)).cast("long")
    minutes = _holding(ranks.withColumn("rank", rank), [*keys, "percent"])

    inside = durations.facts.join(days, "day").join(minutes.withColumnRenamed("bin", "minute"), [*keys, "minute"])
    seconds = inside.groupBy(*keys, "percent", "rank", "minute", F.floor(F.col("micros") / SECOND).alias("bin")).agg(F.sum("n").alias("n"))
    seconds = _holding(seconds, [*keys, "percent"])
    inside = inside.drop("rank").withColumn("bin", F.floor(F.col("micros") / SECOND)).join(seconds, [*keys, "percent", "bin"])
    values = inside.groupBy(*keys, "percent", "rank", F.col("micros").alias("bin")).agg(F.sum("n").alias("n"))
    return _holding(values, [*keys, "percent"]).select(*keys, "percent", F.col("bin").alias("micros"))


def _holding(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the bin that holds the wanted rank, and the rank inside of it."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    counted = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return counted.select(*keys, "bin", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
