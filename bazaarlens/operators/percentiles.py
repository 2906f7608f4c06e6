"""Exact nearest-rank percentiles without holding a group's values in one task.

The built-in exact percentile keeps every distinct value of a group in one buffer, which a
month of orders overflows. Here a coarse histogram locates the bin of each wanted rank, and
only that bin's values are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN_MICROS = 60_000_000


def nearest_rank(
    values: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]
) -> DataFrame:
    """(keys, percent, value) with value at rank ceil(percent/100 * n), for a long ``value``."""
    keys = list(keys)
    counted = (
        values.groupBy(*keys, value)
        .agg(F.count("*").alias("n"))
        .withColumn("bin", F.floor(F.col(value) / BIN_MICROS))
    )
    bins = counted.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    ranked = bins.select(
        *keys,
        "bin",
        "n",
        (F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias(
            "before"
        ),
        F.sum("n").over(whole).alias("total"),
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(p).alias("percent"),
                F.greatest(F.lit(1), F.ceil(F.lit(p / 100.0) * F.col("total"))).alias("rank"),
            )
            for p in percents
        ]
    )
    here = F.filter(
        wanted,
        lambda w: (w["rank"] > F.col("before")) & (w["rank"] <= F.col("before") + F.col("n")),
    )
    targets = ranked.select(*keys, "bin", "before", here.alias("wanted")).where(F.size("wanted") > 0)
    inside = Window.partitionBy(*keys, "bin").orderBy(value).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        counted.join(targets, [*keys, "bin"])
        .withColumn("upto", F.col("before") + F.sum("n").over(inside))
        .select(*keys, value, "upto", F.inline("wanted"))
        .where(F.col("upto") >= F.col("rank"))
        .groupBy(*keys, "percent")
        .agg(F.min(value).alias(value))
    )
