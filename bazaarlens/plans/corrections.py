"""Measures that later events correct, kept incrementally: rating edits and coupon volume.

A batch reads the stored state of its own keys only, and adds rows to the bucket totals: what it
takes back with a minus, what it brings with a plus. Totals are sums of those rows, whatever the
batches they came in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import payload as P
from bazaarlens.functions.buckets import in_every_bucket
from bazaarlens.session import written


class Step(NamedTuple):
    """What a batch makes of the state: the new rows of its keys, and changes of the totals."""

    state: DataFrame
    changes: DataFrame


def fold(
    batches: list[DataFrame], step: Callable[[DataFrame, DataFrame], Step], schema: str, key: str | None
) -> DataFrame:
    """All changes of the totals that batches make one after the other, from an empty state.

    ``key``: a batch's state rows replace those of the same key; None: they are added. Both sides
    of a step are written before the next one reads them.
    """
    state, changes = batches[0].sparkSession.createDataFrame([], schema), []
    for batch in batches:
        made = step(state, batch)
        new, change = written(made.state, "state"), written(made.changes, "changes")
        kept = state if key is None else state.join(new.select(key), key, "left_anti")
        state = written(kept.unionByName(new), "states") if key else kept.unionByName(new)
        changes.append(change)
    return reduce(DataFrame.unionByName, changes)


# --- ratings ---------------------------------------------------------------------------------

RATING = "review string, bucket_hour timestamp, stars int, at timestamp, tie string"


def ratings(events: DataFrame) -> DataFrame:
    """The reviews of some events: one per order and SKU, else the event's own id."""
    fields = P.parse_fields(F.col("payload"), "orderId", "sku", "rating")
    reviews = P.computed_once(events.where("event_type = 'ReviewSubmitted'").select("event_id", "occurred_at", fields.alias("f")))
    key = F.concat_ws("|", P.as_string(F.col("f.orderId")), P.as_string(F.col("f.sku")))
    rating = P.as_int(F.col("f.rating"))
    return reviews.select(
        F.when(key.contains("|"), key).otherwise(F.col("event_id")).alias("review"),
        F.date_trunc("hour", "occurred_at").alias("bucket_hour"),
        rating.alias("stars"),
        F.col("occurred_at").alias("at"),
        F.col("event_id").alias("tie"),
    )


def apply_ratings(state: DataFrame, batch: DataFrame) -> Step:
    """Fold a batch of events into the last rating of each review.

    The last one by time (then event id) counts, in its own bucket; an edit takes the old one out of
    the bucket it was in. An edit that comes after a later one changes nothing. ``changes`` are
    (bucket_hour, stars, n). Applying a batch again changes nothing.
    """
    latest = F.max_by(F.struct("bucket_hour", "stars", "at", "tie"), F.struct("at", "tie")).alias("new")
    new = ratings(batch).groupBy("review").agg(latest)
    old = state.select("review", F.struct("bucket_hour", "stars", "at", "tie").alias("old"))
    both = new.join(old, "review", "left")
    later = F.col("old").isNull() | (F.struct("new.at", "new.tie") > F.struct("old.at", "old.tie"))
    # The state and the changes come from it.
    won = written(both.where(later), "won")
    signed = F.array(
        F.struct(F.col("new.bucket_hour").alias("bucket_hour"), F.col("new.stars").alias("stars"), F.lit(1).alias("n")),
        F.when(F.col("old").isNotNull(), F.struct(F.col("old.bucket_hour").alias("bucket_hour"), F.col("old.stars").alias("stars"), F.lit(-1).alias("n"))),
    )
    changes = won.select(F.inline(F.filter(signed, lambda s: s.isNotNull())))
    changes = changes.groupBy("bucket_hour", "stars").agg(F.sum("n").cast("long").alias("n")).where("n <> 0")
    return Step(won.select("review", "new.*"), changes)


def rating_histogram(changes: DataFrame) -> DataFrame:
    """(granularity, bucket_start, stars, reviews) of all changes so far; empty ones are left out."""
    rows = in_every_bucket(changes, "bucket_hour").groupBy("granularity", "bucket_start", "stars")
    return rows.agg(F.sum("n").alias("reviews")).where("reviews <> 0")


# --- coupons ---------------------------------------------------------------------------------

COUPON_SIDE = "order_id string, side string, event_id string, bucket_hour timestamp, code string, total decimal(38,6)"


def coupon_sides(events: DataFrame) -> DataFrame:
    """Redemptions and orders of some events, by order; each event id once."""
    fields = P.parse_fields(F.col("payload"), "orderId", "code", "total")
    sides = events.where("event_type in ('CouponRedeemed', 'OrderCreated')")
    rows = P.computed_once(sides.select("event_id", "event_type", "occurred_at", fields.alias("f"))).select(
        P.as_string(F.col("f.orderId")).alias("order_id"),
        F.when(F.col("event_type") == "CouponRedeemed", "coupon").otherwise("order").alias("side"),
        "event_id",
        F.date_trunc("hour", "occurred_at").alias("bucket_hour"),
        P.as_string(F.col("f.code")).alias("code"),
        P.as_money(F.col("f.total")).alias("total"),
    )
    return rows.where("order_id is not null").dropDuplicates(["event_id"])


def apply_coupons(state: DataFrame, batch: DataFrame) -> Step:
    """Fold a batch into the volume of orders with a coupon, whichever side comes first.

    An order's total counts once per redemption, in the redemption's bucket, as soon as both are
    there: new redemptions meet all orders, new orders the redemptions stored before. Of several
    order events of one order the one with the smallest event id counts; an event seen before
    changes nothing. ``changes`` are (bucket_hour, code, amount, n).
    """
    seen = coupon_sides(batch)
    known = state.join(seen.select("order_id").distinct(), "order_id", "left_semi")
    new = seen.join(known.select("event_id"), "event_id", "left_anti")
    total = F.min_by("total", "event_id").alias("total")

    def orders(rows: DataFrame) -> DataFrame:
        return rows.where("side = 'order'").groupBy("order_id").agg(total)

    before = orders(known)
    coupons = new.where("side = 'coupon'").select("order_id", "bucket_hour", "code")
    stored = known.where("side = 'coupon'").select("order_id", "bucket_hour", "code")
    # An order counts by the event that came first, so later ones for it are kept out.
    first = orders(new).join(before, "order_id", "left_anti")
    met = coupons.join(before.unionByName(first), "order_id").unionByName(stored.join(first, "order_id"))
    changes = met.groupBy("bucket_hour", "code").agg(F.sum("total").cast("decimal(38,6)").alias("amount"), F.count("*").alias("n"))
    fresh = new.join(before.select("order_id", F.lit("order").alias("side")), ["order_id", "side"], "left_anti")
    kept = fresh.where("side = 'coupon'").unionByName(_smallest(fresh.where("side = 'order'")))
    return Step(kept.select("order_id", "side", "event_id", "bucket_hour", "code", "total"), changes)


def _smallest(orders: DataFrame) -> DataFrame:
    row = F.min_by(F.struct("side", "event_id", "bucket_hour", "code", "total"), "event_id")
    return orders.groupBy("order_id").agg(row.alias("row")).select("order_id", "row.*")


def coupon_volume(changes: DataFrame) -> DataFrame:
    """(granularity, bucket_start, code, amount, redemptions) of all changes so far."""
    rows = in_every_bucket(changes, "bucket_hour").groupBy("granularity", "bucket_start", "code")
    return rows.agg(F.sum("amount").cast("decimal(38,6)").alias("amount"), F.sum("n").alias("redemptions"))
