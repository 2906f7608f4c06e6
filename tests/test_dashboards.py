import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions.buckets import buckets_of_hours, hours_between, instant
from bazaarlens.operators.percentiles import nearest_rank
from bazaarlens.operators.versions import with_extracted_fields
from bazaarlens.plans import serving
from bazaarlens.plans.dashboards import (
    REGISTRY,
    Dashboard,
    project,
    register,
    rollup_dimensions,
    stamp,
    total,
)
from bazaarlens.plans.rollup import hourly_rollup

T = datetime(2025, 11, 18, 10)
FROM, TO = datetime(2025, 11, 17), datetime(2025, 11, 20)


def events(spark, rows):
    df = spark.createDataFrame(
        [(f"id{n}", t, at, p) for n, (t, at, p) in enumerate(rows)],
        "event_id string, event_type string, occurred_at timestamp, payload string",
    )
    return with_extracted_fields(df)


def buckets(spark, start=FROM, end=TO):
    return buckets_of_hours(
        hours_between(spark.range(1).select(instant(start).alias("window_from"), instant(end).alias("window_to")))
    )


def model(spark, name, rows, provisional=True, through=None):
    ev = events(spark, rows)
    out = project(name, buckets(spark), hourly=hourly_rollup(ev, rollup_dimensions()), events=ev)
    return stamp(out, instant(T), F.lit(provisional), F.lit(through))


def served(spark, name, rows, granularity="day", **filters):
    return serving.dashboard(name, model(spark, name, rows), FROM, TO, granularity, **filters).body.collect()


def test_ten_dashboards_are_registered():
    assert len(REGISTRY) == 10 and set(serving.COMBINE) == set(REGISTRY)


def test_funnel(spark):
    rows = [("CartCheckedOut", T, "{}")] * 4 + [("OrderCreated", T, "{}")] * 2 + [("OrderDelivered", T, "{}")]
    got = served(spark, "order_conversion_funnel", rows)
    assert [(r.stage, r["count"], r.drop_off_rate) for r in got] == [
        ("CartCheckedOut", 4, None),
        ("OrderCreated", 2, 0.5),
        ("OrderConfirmed", 0, 1.0),
        ("PaymentCompleted", 0, None),
        ("OrderDelivered", 1, None),
    ]


def test_revenue_has_zero_rows_and_no_breakdown(spark):
    rows = [("OrderCreated", T, '{"total":10.25}'), ("OrderCreated", T, '{"total":"7"}')]
    got = served(spark, "revenue", rows)
    assert [(r.revenue.amount, r.order_count) for r in got] == [
        (Decimal("0E-6"), 0), (Decimal("10.250000"), 2), (Decimal("0E-6"), 0)
    ]
    assert served(spark, "revenue", rows, sku="sku-1") == []


def test_fulfillment_uses_the_earliest_end_in_the_bucket_and_keeps_negative_durations(spark):
    h = timedelta(hours=1)
    rows = [
        ("OrderConfirmed", T, '{"orderId":"a"}'),
        ("OrderConfirmed", T + h, '{"orderId":"a"}'),
        ("ShipmentDispatched", T + 3 * h, '{"orderId":"a"}'),
        ("ShipmentDispatched", T + 5 * h, '{"orderId":"a"}'),
        ("OrderConfirmed", T, '{"orderId":5}'),
        ("OrderDelivered", T + 2 * h, '{"orderId":"a"}'),
        ("OrderConfirmed", T, '{"orderId":"late"}'),
        ("ShipmentDispatched", T + 24 * h, '{"orderId":"late"}'),
    ]
    day = {r.bucket_start: r for r in model(spark, "fulfillment_performance", rows).where("granularity = 'day'").collect()}
    r = day[datetime(2025, 11, 18)]
    assert (r.time_to_ship_p50_hours, r.time_to_ship_p99_hours) == (2.0, 3.0)
    assert (r.time_to_deliver_p50_hours, r.time_to_deliver_p95_hours) == (-3.0, -1.0)
    week = model(spark, "fulfillment_performance", rows).where("granularity = 'week'").first()
    assert week.time_to_ship_p99_hours == 24.0
    mean = served(spark, "fulfillment_performance", rows)[0]
    assert mean.time_to_ship_p99_hours == pytest.approx(1.0)


def test_inventory_totals_and_skus(spark):
    rows = [
        ("InventoryReserved", T, '{"sku":"a"}'),
        ("InventoryReserved", T, '{"sku":"b"}'),
        ("InventoryReleased", T, '{"sku":"a"}'),
        ("InventoryReservationFailed", T, "{}"),
        ("InventoryReplenished", T, '{"sku":5}'),
    ]
    assert tuple(served(spark, "inventory_movement", rows)[0]) == (2, 1, 1, 1)
    assert tuple(served(spark, "inventory_movement", rows, sku="a")[0]) == (1, 0, 1, 0)
    keyed = model(spark, "inventory_movement", rows).where("granularity = 'day' and sku is not null")
    assert sorted(r.id for r in keyed.collect()) == ["day:2025-11-18T00:a", "day:2025-11-18T00:b"]


def test_catalog_promotions_users(spark):
    assert tuple(served(spark, "catalog_pricing", [("ProductCreated", T, "{}"), ("CategoryUpdated", T, "{}")])[0]) == (1, 0, 1)
    rows = [("CouponRedeemed", T, "{}"), ("PriceQuoteIssued", T, '{"total":5}'), ("PriceQuoteIssued", T, '{"total":2.5}')]
    got = served(spark, "promotions_effectiveness", rows)[0]
    assert (got.coupons_redeemed, got.quotes_issued, got.redemption_rate) == (1, 2, 0.5)
    assert got.attributable_order_volume.amount == Decimal("7.5") and got.attributable_order_volume.currency == "USD"
    users = [(t, T, "{}") for t in ("UserRegistered", "SessionCreated", "UserProfileUpdated", "UserAccountUpdated")]
    assert tuple(served(spark, "user_growth", users)[0]) == (1, 1, 2)


def test_reviews_count_all_but_chart_only_one_to_five(spark):
    rows = [("ReviewSubmitted", T, f'{{"rating":{r}}}') for r in ("0", "1", "5", "5", "6", '"4"', "4.0", "null")]
    got = served(spark, "reviews_ratings", rows)[0]
    assert got.review_count == 8
    assert got.rating_distribution == {"1": 1, "2": 0, "3": 0, "4": 0, "5": 2}


def test_audit(spark):
    rows = [
        ("AdminActionPerformed", T + timedelta(hours=1), '{"action":"x"}'),
        ("AdminActionPerformed", T, '{"adminId":"a","action":"y"}'),
    ]
    got = served(spark, "admin_audit", rows)
    assert [(r.action_type, r.admin_id) for r in got] == [("y", "a"), ("x", "unknown")]
    assert len(served(spark, "admin_audit", rows, action_type="x")) == 1


def test_notifications(spark):
    rows = [
        ("NotificationSent", T, '{"channel":"email"}'),
        ("NotificationSent", T, "{}"),
        ("WishlistPriceAlertTriggered", T, "{}"),
    ]
    got = {r.channel: (r.sent, r.price_alerts_triggered, r.is_total) for r in served(spark, "notification_delivery", rows)}
    assert got == {None: (2, 1, True), "email": (1, 0, False)}
    assert [tuple(r)[:3] for r in served(spark, "notification_delivery", rows, channel="email")] == [("email", 1, 0)]


def test_empty_range_is_provisional(spark):
    answer = serving.dashboard("revenue", model(spark, "revenue", []).limit(0), FROM, TO)
    env = answer.envelope.first()
    assert env.is_provisional is True and env.reconciled_through is None


def test_envelope_takes_the_weakest_document(spark):
    rows = spark.createDataFrame(
        [(1, False, date(2025, 11, 2)), (1, False, date(2025, 11, 1)), (2, True, date(2025, 11, 1)), (3, False, None)],
        "k int, is_provisional boolean, reconciled_through date",
    )
    got = {r.k: (r.is_provisional, r.reconciled_through) for r in serving.envelope(rows, instant(T), "k").collect()}
    assert got == {1: (False, date(2025, 11, 1)), 2: (True, date(2025, 11, 1)), 3: (False, None)}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_range_must_not_be_empty(spark, name):
    with pytest.raises(ValueError):
        serving.dashboard(name, spark.range(1), TO, FROM)


def test_unknown_filter_and_granularity(spark):
    with pytest.raises(ValueError):
        serving.dashboard("revenue", spark.range(1), FROM, TO, channel="x")
    with pytest.raises(ValueError):
        serving.dashboard("revenue", spark.range(1), FROM, TO, "year")


def test_a_further_dashboard_only_has_to_be_registered(spark):
    register(Dashboard("demo", ("OrderConfirmed",), lambda facts: facts.groupBy("granularity", "bucket_start").agg(total("OrderConfirmed").alias("n"))))
    try:
        got = model(spark, "demo", [("OrderConfirmed", T, "{}")]).where("granularity = 'month'").first()
        assert got.n == 1
    finally:
        del REGISTRY["demo"]


def test_percentiles_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for key, n in enumerate((1, 2, 19, 20, 21, 100, 300)):
        rows += [(key, rng.choice([0, 5, rng.randrange(-10**9, 10**10)])) for _ in range(n)]
    got = {
        (r.key, r.percent): r.v
        for r in nearest_rank(spark.createDataFrame(rows, "key int, v bigint"), ["key"], "v", (50, 95, 99)).collect()
    }
    for key in range(7):
        values = sorted(v for k, v in rows if k == key)
        for p in (50, 95, 99):
            rank = max(1, math.ceil(p / 100.0 * len(values)))
            assert got[(key, p)] == values[rank - 1]
