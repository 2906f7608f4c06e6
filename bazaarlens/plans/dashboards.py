"""The ten dashboards: which events feed each one, and how its read model is computed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.buckets import document_id, in_every_bucket
from bazaarlens.functions.measures import drop_off, micros_between, micros_to_hours, safe_ratio
from bazaarlens.functions.vocabulary import CURRENCY, FUNNEL_STAGES, STARS
from bazaarlens.operators.percentiles import nearest_rank
from bazaarlens.plans.rollup import INVENTORY_TYPES, spread, with_empty_buckets

BUCKET = ("granularity", "bucket_start")
PERCENTS = (50, 95, 99)
LEGS = {
    "time_to_ship": ("OrderConfirmed", "ShipmentDispatched"),
    "time_to_deliver": ("ShipmentDispatched", "OrderDelivered"),
}


@dataclass(frozen=True)
class Dashboard:
    """A registered dashboard. ``rollup`` builds read-model rows from bucketed hourly facts;
    ``from_events`` builds them from events, for measures that do not add up."""

    name: str
    event_types: tuple[str, ...]
    rollup: Callable[[DataFrame], DataFrame] | None = None
    from_events: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    key: str | None = None
    bucketed: bool = True
    #: The events' column by which hourly facts of ``broken_down`` types (all if none) are split.
    dimension: str | None = None
    broken_down: tuple[str, ...] = ()


REGISTRY: dict[str, Dashboard] = {}


def register(dashboard: Dashboard) -> Dashboard:
    """Add a dashboard; every job iterates the registry, so nothing else has to change."""
    REGISTRY[dashboard.name] = dashboard
    return dashboard


def rollup_dimensions() -> dict[str, str | None]:
    """The event types that rolled-up dashboards count, each with the column it is split by."""
    found: dict[str, str | None] = {}
    for d in REGISTRY.values():
        if not d.rollup:
            continue
        for event_type in d.event_types:
            split = d.dimension if event_type in (d.broken_down or d.event_types) else None
            known = found.get(event_type)
            if split and known and split != known:
                raise ValueError(f"{event_type} is split by both {known} and {split}")
            found[event_type] = split or known
    return found


def total(*event_types: str) -> Column:
    """Events of the given types in the bucket."""
    return F.coalesce(
        F.sum(F.when(F.col("event_type").isin(*event_types), F.col("events"))), F.lit(0)
    ).cast("long")


def amount_of(event_type: str) -> Column:
    summed = F.sum(F.when(F.col("event_type") == event_type, F.col("amount")))
    return F.coalesce(summed, F.lit(0)).cast("decimal(38,6)")


def _funnel(facts: DataFrame) -> DataFrame:
    counts = facts.groupBy(*BUCKET).agg(*[total(s).alias(s) for s in FUNNEL_STAGES])
    stages = []
    for no, stage in enumerate(FUNNEL_STAGES):
        rate = (
            drop_off(F.col(stage), F.col(FUNNEL_STAGES[no - 1]))
            if no
            else F.lit(None).cast("double")
        )
        stages.append(
            F.struct(
                F.lit(stage).alias("stage"),
                F.col(stage).alias("count"),
                rate.alias("drop_off_rate"),
            )
        )
    return counts.select(*BUCKET, F.array(*stages).alias("stages"))


def _revenue(facts: DataFrame) -> DataFrame:
    return (
        facts.groupBy(*BUCKET)
        .agg(
            amount_of("OrderCreated").alias("revenue_amount"),
            total("OrderCreated").alias("order_count"),
        )
        .select(
            *BUCKET,
            F.lit(None).cast("string").alias("sku"),
            F.lit(None).cast("string").alias("category"),
            "revenue_amount",
            F.lit(CURRENCY).alias("revenue_currency"),
            "order_count",
        )
    )


def _inventory(facts: DataFrame) -> DataFrame:
    """Bucket totals, and one row per SKU seen; movements without a SKU count in totals only."""
    return (
        facts.groupingSets(
            [BUCKET, (*BUCKET, "dimension")], F.col(BUCKET[0]), F.col(BUCKET[1]), F.col("dimension")
        )
        .agg(
            *[
                total(t).alias(c)
                for t, c in zip(
                    INVENTORY_TYPES, ("reserved", "reservation_failed", "released", "replenished")
                )
            ],
            F.grouping("dimension").alias("is_total"),
        )
        .where("is_total = 1 or dimension is not null")
        .select(
            *BUCKET,
            F.col("dimension").alias("sku"),
            "reserved",
            "reservation_failed",
            "released",
            "replenished",
        )
    )


def _catalog(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*BUCKET).agg(
        total("ProductCreated").alias("products_created"),
        total("ProductPriceChanged").alias("price_changes"),
        total("CategoryUpdated").alias("category_updates"),
    )


def _promotions(facts: DataFrame) -> DataFrame:
    return (
        facts.groupBy(*BUCKET)
        .agg(
            total("CouponRedeemed").alias("coupons_redeemed"),
            total("PriceQuoteIssued").alias("quotes_issued"),
            amount_of("PriceQuoteIssued").alias("attributable_order_volume_amount"),
        )
        .withColumns(
            {
                "attributable_order_volume_currency": F.lit(CURRENCY),
                "redemption_rate": safe_ratio(F.col("coupons_redeemed"), F.col("quotes_issued")),
            }
        )
    )


def _users(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*BUCKET).agg(
        total("UserRegistered").alias("signups"),
        total("SessionCreated").alias("sessions_created"),
        total("UserProfileUpdated", "UserAccountUpdated").alias("profile_changes"),
    )


def _reviews(facts: DataFrame) -> DataFrame:
    def stars(star: str) -> Column:
        return F.coalesce(
            F.sum(F.when(F.col("dimension") == star, F.col("events"))), F.lit(0)
        ).cast("long")

    counted = facts.groupBy(*BUCKET).agg(
        total("ReviewSubmitted").alias("review_count"),
        *[stars(s).alias(f"stars_{s}") for s in STARS],
    )
    histogram = F.map_from_arrays(
        F.array(*[F.lit(s) for s in STARS]), F.array(*[F.col(f"stars_{s}") for s in STARS])
    )
    return counted.select(*BUCKET, "review_count", histogram.alias("rating_distribution"))


def _notifications(facts: DataFrame) -> DataFrame:
    """Bucket totals and one row per channel; price alerts have no channel, so totals only."""
    alerts = total("WishlistPriceAlertTriggered")
    return (
        facts.groupingSets(
            [BUCKET, (*BUCKET, "dimension")], F.col(BUCKET[0]), F.col(BUCKET[1]), F.col("dimension")
        )
        .agg(
            total("NotificationSent").alias("sent"),
            alerts.alias("alerts"),
            F.grouping("dimension").alias("is_total"),
        )
        .where("is_total = 1 or dimension is not null")
        .select(
            *BUCKET,
            F.col("dimension").alias("channel"),
            "sent",
            F.when(F.col("is_total") == 1, F.col("alerts"))
            .otherwise(0)
            .cast("long")
            .alias("price_alerts_triggered"),
        )
    )


def order_durations(events: DataFrame) -> DataFrame:
    """(leg, bucket, micros), one row per start event whose order also ends in that bucket.

    The earliest end per order and bucket counts; each start event gives its own duration.
    Both legs and all granularities share one join. Its end side is unique per key, so a hot
    order only makes the start side large, which adaptive execution splits.
    """
    timed = events.where(F.col("order_id").isNotNull()).select(
        "event_type", "order_id", "occurred_at"
    )

    def role(position: int) -> DataFrame:
        legs = F.array(
            *[
                F.when(F.col("event_type") == types[position], F.lit(leg))
                for leg, types in LEGS.items()
            ]
        )
        return in_every_bucket(
            timed.where(F.col("event_type").isin(*[t[position] for t in LEGS.values()])).select(
                "order_id",
                "occurred_at",
                F.col("occurred_at").alias("at"),
                F.explode(F.filter(legs, lambda leg: leg.isNotNull())).alias("leg"),
            ),
            "occurred_at",
        )

    key = ["leg", *BUCKET, "order_id"]
    ends = role(1).groupBy(*key).agg(F.min("at").alias("ended_at"))
    return (
        role(0)
        .join(ends, key)
        .select("leg", *BUCKET, micros_between(F.col("at"), F.col("ended_at")).alias("micros"))
    )


def _fulfillment(events: DataFrame, buckets: DataFrame) -> DataFrame:
    durations = order_durations(events).join(
        buckets.select(*BUCKET), list(BUCKET), "left_semi"
    )
    ranked = nearest_rank(durations, ["leg", *BUCKET], "micros", PERCENTS)
    empty = buckets.select(
        F.lit(None).cast("string").alias("leg"),
        *BUCKET,
        F.lit(None).cast("int").alias("percent"),
        F.lit(None).cast("long").alias("micros"),
    )

    def hours(leg: str, percent: int) -> Column:
        picked = F.max(
            F.when((F.col("leg") == leg) & (F.col("percent") == percent), F.col("micros"))
        )
        return F.coalesce(micros_to_hours(picked), F.lit(0.0)).alias(f"{leg}_p{percent}_hours")

    return (
        ranked.unionByName(empty)
        .groupBy(*BUCKET)
        .agg(*[hours(leg, p) for leg in LEGS for p in PERCENTS])
    )


def _audit(events: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    return events.where(F.col("event_type") == "AdminActionPerformed").select(
        F.col("event_id").alias("id"),
        "occurred_at",
        F.coalesce("action", F.lit("unknown")).alias("action_type"),
        F.coalesce("admin_id", F.lit("unknown")).alias("admin_id"),
    )


register(Dashboard("order_conversion_funnel", FUNNEL_STAGES, _funnel))
register(Dashboard("revenue", ("OrderCreated",), _revenue))
register(
    Dashboard(
        "fulfillment_performance",
        ("OrderConfirmed", "ShipmentDispatched", "OrderDelivered"),
        from_events=_fulfillment,
    )
)
register(Dashboard("inventory_movement", INVENTORY_TYPES, _inventory, key="sku", dimension="sku"))
register(
    Dashboard(
        "catalog_pricing", ("ProductCreated", "ProductPriceChanged", "CategoryUpdated"), _catalog
    )
)
register(Dashboard("promotions_effectiveness", ("CouponRedeemed", "PriceQuoteIssued"), _promotions))
register(
    Dashboard(
        "user_growth",
        ("UserRegistered", "SessionCreated", "UserProfileUpdated", "UserAccountUpdated"),
        _users,
    )
)
register(Dashboard("reviews_ratings", ("ReviewSubmitted",), _reviews, dimension="rating"))
register(
    Dashboard("admin_audit", ("AdminActionPerformed",), from_events=_audit, bucketed=False)
)
register(
    Dashboard(
        "notification_delivery",
        ("NotificationSent", "WishlistPriceAlertTriggered"),
        _notifications,
        key="channel",
        dimension="channel",
        broken_down=("NotificationSent",),
    )
)


def project(
    name: str,
    buckets: DataFrame | None,
    *,
    hourly: DataFrame | None = None,
    facts: DataFrame | None = None,
    events: DataFrame | None = None,
    only_buckets: bool = True,
) -> DataFrame:
    """Read-model rows of one dashboard for exactly the given buckets.

    Additive dashboards read ``facts`` (``rollup.spread`` of hourly facts over the buckets, made
    here from ``hourly`` when not given), the others ``events``. ``only_buckets=False`` says that
    ``hourly`` holds no hours outside ``buckets``, which saves the semi-join.
    """
    d = REGISTRY[name]
    if d.rollup is None:
        rows = d.from_events(events.where(F.col("event_type").isin(*d.event_types)), buckets)
    else:
        mine = F.col("event_type").isin(*d.event_types)
        if facts is None:
            facts = spread(hourly.where(mine), buckets if only_buckets else None)
        rows = d.rollup(with_empty_buckets(facts.where(mine), buckets))
    if not d.bucketed:
        return rows
    key = F.col(d.key) if d.key else None
    return rows.select(
        document_id(F.col("granularity"), F.col("bucket_start"), key).alias("id"), "*"
    )


def stamp(
    rows: DataFrame, as_of: Column, is_provisional: Column, reconciled_through: Column
) -> DataFrame:
    """The freshness columns every read-model row carries."""
    return rows.withColumns(
        {
            "generated_at": as_of,
            "is_provisional": is_provisional,
            "reconciled_through": reconciled_through.cast("date"),
        }
    )
