"""One pass from raw events to hourly facts, from which eight dashboards are rolled up.

Counts and money add up, so day, week and month buckets are sums of hours recomputed from raw
events; no counter is ever mutated. Rows combine before the shuffle, so a hot SKU or hour costs
one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.buckets import bucket_start, in_every_bucket
from bazaarlens.functions.payload import MONEY

# The stock movements.
INVENTORY_TYPES = (
    "InventoryReserved",
    "InventoryReservationFailed",
    "InventoryReleased",
    "InventoryReplenished",
)
ROLLUP_INPUT = ("event_type", "occurred_at", "sku", "channel", "rating", "total")


def hourly_rollup(events: DataFrame, dimensions: dict[str, str | None]) -> DataFrame:
    """(hour_start, event_type, dimension) -> events, amount.

    ``dimensions`` names the types to count (those of the registered dashboards) and for each the
    one column it is broken down by, if any. The amount is the sum of the events' totals, null
    where none has one.
    """
    kind = F.col("event_type")
    dimension = F.lit(None).cast("string")
    for name in sorted({c for c in dimensions.values() if c}):
        types = [t for t, c in dimensions.items() if c == name]
        dimension = F.when(kind.isin(*types), F.col(name).cast("string")).otherwise(dimension)
    return (
        events.where(kind.isin(*dimensions))
        .select(
            bucket_start("hour", F.col("occurred_at")).alias("hour_start"),
            "event_type",
            dimension.alias("dimension"),
            F.col("total").cast(MONEY).alias("amount"),
        )
        .groupBy("hour_start", "event_type", "dimension")
        .agg(F.count("*").alias("events"), F.sum("amount").alias("amount"))
    )


def spread(hourly: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """Hourly facts under each of their four buckets, limited to ``buckets`` when given."""
    facts = in_every_bucket(
        hourly.select("hour_start", "event_type", "dimension", "events", "amount"), "hour_start"
    )
    if buckets is None:
        return facts
    return facts.join(
        buckets.select("granularity", "bucket_start"), ["granularity", "bucket_start"], "left_semi"
    )


def with_empty_buckets(facts: DataFrame, buckets: DataFrame) -> DataFrame:
    """A zero fact per recomputed bucket, so that a bucket without events still gets its row."""
    zero = buckets.select(
        "granularity",
        "bucket_start",
        F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("string").alias("dimension"),
        F.lit(0).cast("long").alias("events"),
        F.lit(None).cast("decimal(38,6)").alias("amount"),
    )
    return facts.unionByName(zero)
