"""As-of joins, revenue breakdowns, range percentiles, corrections."""

import json
import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

from bazaarlens.operators.asof import as_of
from bazaarlens.operators.versions import with_extracted_fields
from bazaarlens.plans import breakdowns, corrections, durations

T = datetime(2025, 3, 4, 10)
H = timedelta(hours=1)
KIND = "event_id string, event_type string, occurred_at timestamp, payload string"


def events(spark, rows):
    return spark.createDataFrame([(f"e{n}", t, at, json.dumps(p)) for n, (t, at, p) in enumerate(rows)], KIND)


def test_as_of_against_brute_force(spark):
    draw = random.Random(1)
    hours = lambda n: T + H * draw.randrange(n)
    left = [(i, draw.choice(["hot"] * 4 + ["a", "b", None]), hours(5000)) for i in range(300)]
    right = [(draw.choice(["hot"] * 4 + ["a"]), hours(5000), draw.randrange(1000)) for _ in range(200)]
    right += [(k, at, v + 1) for k, at, v in right[:20]] + [("hot", left[0][2], 5), (None, T, 1), ("a", None, 1)]
    got = as_of(
        spark.createDataFrame(left, "id int, key string, at timestamp"),
        spark.createDataFrame(right, "key string, at timestamp, v int"), "key", "at", "v",
    )

    def brute(key, at):
        fits = [(w, v) for k, w, v in right if k is not None and k == key and w is not None and w <= at]
        return max(fits)[1] if fits else None

    assert {r.id: r.v for r in got.collect()} == {i: brute(k, at) for i, k, at in left}
    assert got.columns == ["id", "key", "at", "v"]


def test_lines_count_at_the_price_and_category_of_their_order(spark):
    day = timedelta(days=40)
    rows = [
        ("ProductCreated", T, {"sku": "a", "price": 2, "categoryId": "c"}),
        ("ProductPriceChanged", T + day, {"sku": "a", "newPrice": 3.5}),
        ("ProductCreated", T + 2 * day, {"sku": "a", "categoryId": "d"}),
        ("OrderCreated", T - H, {"orderId": "o0", "items": [{"sku": "a", "qty": 9}]}),
        ("OrderCreated", T, {"orderId": "o1", "items": [{"sku": "a", "qty": 1}, {"sku": "a", "qty": 2}, {"qty": 4}]}),
        ("OrderCreated", T + day, {"orderId": "o2", "items": [{"sku": "a", "qty": 2}, {"sku": "b"}]}),
        ("OrderCreated", T + 2 * day, {"orderId": "o3", "items": [{"sku": "a", "qty": 1}]}),
        ("OrderCreated", T, {"orderId": "o4", "items": None}),
    ]
    lines = breakdowns.priced_lines(events(spark, rows)).cache()
    got = {(r.order_id, r.sku): (r.revenue, r.category) for r in lines.collect()}
    assert got == {("o0", "a"): (0, None), ("o1", "a"): (6, "c"), ("o2", "a"): (7, "c"), ("o2", "b"): (0, None), ("o3", "a"): (Decimal("3.5"), "d")}
    months = breakdowns.revenue_by_category(lines).where("granularity = 'month'").collect()
    assert sorted((r.bucket_start.month, r.category, r.revenue_amount, r.order_count) for r in months) == [(3, "c", 6, 1), (4, "c", 7, 1), (5, "d", Decimal("3.5"), 1)]
    hour = breakdowns.revenue_by_sku(lines).where("id = 'hour:2025-03-04T10:a'").first()
    assert (hour.revenue_amount, hour.order_count, hour.category) == (6, 1, None)


def test_range_percentiles_against_sorted_durations(spark):
    draw = random.Random(2)
    rows, wanted = [], {}
    for n in range(300):
        start = T + timedelta(days=draw.randrange(6), seconds=draw.randrange(80000))
        took = timedelta(microseconds=draw.choice([draw.randrange(10**11), -5, 90_000_000 + draw.randrange(10**6), 90_500_000]))
        rows += [("OrderConfirmed", start, {"orderId": f"o{n}"}), ("ShipmentDispatched", start + took, {"orderId": f"o{n}"})]
        wanted.setdefault(start.date(), []).append(took // timedelta(microseconds=1))
    facts = durations.duration_facts(with_extracted_fields(events(spark, rows)))
    stored = durations.Durations(facts, durations.histogram(facts))
    days = [(f"{a}-{b}", (T + timedelta(days=a)).date(), (T + timedelta(days=b)).date()) for a, b in ((0, 1), (0, 6), (2, 5), (3, 3), (9, 12))]
    ranges = spark.createDataFrame(days, "range string, date_from date, date_to date")
    got = {(r["range"], r.percent): r.micros for r in durations.range_percentiles(stored, ranges, (1, 50, 95, 100)).collect()}
    brute = {}
    for name, first, last in days:
        own = sorted(m for d, ms in wanted.items() if first <= d < last for m in ms)
        brute |= {(name, p): own[max(1, math.ceil(p * len(own) / 100)) - 1] for p in (1, 50, 95, 100) if own}
    assert got == brute


def totals(rows):
    return {(r.granularity, r.bucket_start, r[2]): tuple(r[3:]) for r in rows.collect()}


def test_rating_edits_equal_a_full_recompute(spark):
    draw = random.Random(3)
    rows = [
        ("ReviewSubmitted", T + H * draw.randrange(100), {"orderId": f"o{draw.randrange(8)}", "sku": "s", "rating": draw.randrange(1, 6)})
        for _ in range(60)
    ] + [("ReviewSubmitted", T, {"rating": 4}), ("ReviewSubmitted", T, {"orderId": "o1", "rating": "x"})]
    every = events(spark, rows)
    batches = [every.where(f"cast(substring(event_id, 2) as int) % 3 = {n}") for n in (1, 0, 2, 1)]
    apart = corrections.fold(batches, corrections.apply_ratings, corrections.RATING, "review")
    at_once = corrections.fold([every], corrections.apply_ratings, corrections.RATING, "review")
    got, whole = totals(corrections.rating_histogram(apart)), totals(corrections.rating_histogram(at_once))
    assert got == whole and sum(v[0] for k, v in got.items() if k[0] == "month") == len({json.dumps(p.get("orderId")) for _, _, p in rows if "sku" in p}) + 2


def test_coupon_volume_either_side_first(spark):
    rows = [
        ("CouponRedeemed", T, {"code": "c", "orderId": "o1"}), ("OrderCreated", T + 30 * H, {"orderId": "o1", "total": 5}),
        ("OrderCreated", T, {"orderId": "o2", "total": 7}), ("CouponRedeemed", T + 30 * H, {"code": "c", "orderId": "o2"}),
        ("CouponRedeemed", T + H, {"code": "d", "orderId": "o2"}), ("OrderCreated", T, {"orderId": "o3", "total": 9}),
        ("CouponRedeemed", T, {"code": "c"}), ("OrderCreated", T + 9 * H, {"orderId": "o2", "total": 100}),
    ]
    every = events(spark, rows)
    wanted = {("month", datetime(2025, 3, 1), "c"): (12, 2), ("month", datetime(2025, 3, 1), "d"): (7, 1)}
    for split in ([[0, 1, 2, 3, 4, 5, 6, 7]], [[0, 2], [1, 3], [4, 5, 6, 7], [0, 3]], [[n] for n in (3, 2, 7, 0, 1, 4, 5, 6, 2, 1)]):
        batches = [every.where(f"event_id in ({', '.join(repr(f'e{n}') for n in part)})") for part in split]
        changes = corrections.fold(batches, corrections.apply_coupons, corrections.COUPON_SIDE, None)
        got = totals(corrections.coupon_volume(changes))
        assert {k: v for k, v in got.items() if k[0] == "month"} == wanted
