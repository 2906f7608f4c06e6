"""Reference answers in DuckDB SQL over the driver's tables, one per registered query.

Dashboard answers aggregate the base tables directly; ingest, version and redaction answers
first write the same deliveries in SQL (``DELIVERIES``, ``WIRE``).
"""

from __future__ import annotations

# --- the events behind each dashboard, straight from the base tables -----------------------

T0 = "o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR"

ORDER_EVENTS = f"""
  SELECT 'CartCheckedOut' AS t, {T0} AS ts, o_orderkey AS k, o_totalprice AS v FROM orders
  UNION ALL SELECT 'OrderCreated', {T0} + INTERVAL 1 HOUR, o_orderkey, o_totalprice
    FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT 'OrderConfirmed', {T0} + INTERVAL 2 HOUR, o_orderkey, 0
    FROM orders WHERE o_orderkey % 10 > 1
  UNION ALL SELECT 'PaymentCompleted', {T0} + INTERVAL 3 HOUR, o_orderkey, 0
    FROM orders WHERE o_orderkey % 10 > 2
  UNION ALL SELECT 'ShipmentDispatched', {T0} + (2 + o_orderkey % 30) * INTERVAL 1 HOUR,
    o_orderkey, 0 FROM orders WHERE o_orderkey % 10 > 2
  UNION ALL SELECT 'OrderDelivered', {T0} + (24 + o_orderkey % 72) * INTERVAL 1 HOUR,
    o_orderkey, 0 FROM orders WHERE o_orderkey % 10 > 2 AND o_orderstatus = 'F'
"""

STOCK_EVENTS = """
  SELECT CASE l_returnflag WHEN 'N' THEN 'reserved' WHEN 'A' THEN 'released' ELSE 'failed' END AS t,
         l_shipdate + l_linenumber * INTERVAL 1 HOUR AS ts,
         CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE 'sku-' || l_partkey END AS sku
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
                   l_shipdate, l_returnflag) AS rn FROM lineitem)
  WHERE rn = 1
  UNION ALL
  SELECT 'replenished', TIMESTAMP '1998-01-01' + (p_partkey % 365) * INTERVAL 1 DAY,
         'sku-' || p_partkey FROM part
"""

CATALOG_EVENTS = """
  SELECT 'created' AS t, TIMESTAMP '1995-01-01' + (p_partkey % 700) * INTERVAL 1 DAY AS ts FROM part
  UNION ALL SELECT 'price', TIMESTAMP '1995-01-31' + (p_partkey % 700) * INTERVAL 1 DAY
    FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'category', TIMESTAMP '1995-03-02' + (p_partkey % 700) * INTERVAL 1 DAY
    FROM part WHERE p_partkey % 7 = 0
"""

REVIEW_EVENTS = """
  SELECT TIMESTAMP '1996-01-01' + (c_custkey % 900) * INTERVAL 1 DAY AS ts,
         CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE c_custkey % 7 END AS rating
  FROM customer
"""


def span(kind: str) -> str:
    return {
        "orders": "SELECT min(o_orderdate) AS f, max(o_orderdate) + INTERVAL 5 DAY AS t FROM orders",
        "lineitem": "SELECT min(l_shipdate) AS f, max(l_shipdate) + INTERVAL 1 DAY AS t FROM lineitem",
        "events": "SELECT min(ts) AS f, max(ts) + INTERVAL 1 DAY AS t FROM events",
        "catalog": "SELECT TIMESTAMP '1995-01-01' AS f, TIMESTAMP '1997-02-01' AS t",
        "reviews": "SELECT TIMESTAMP '1996-01-01' AS f, TIMESTAMP '1998-07-01' AS t",
    }[kind]


def buckets(kind: str, events: str) -> str:
    """CTEs: spine of every bucket in the span, and b = the events under each granularity."""
    return f"""
WITH span AS ({span(kind)}),
hours AS (SELECT unnest(generate_series(date_trunc('hour', f)::TIMESTAMP,
            date_trunc('hour', t - INTERVAL 1 MICROSECOND)::TIMESTAMP, INTERVAL 1 HOUR)) AS h FROM span),
g(granularity) AS (VALUES ('hour'), ('day'), ('week'), ('month')),
spine AS (SELECT DISTINCT granularity, date_trunc(granularity, h)::TIMESTAMP AS bucket_start
          FROM hours, g),
ev AS ({events}),
b AS (SELECT granularity, date_trunc(granularity, ts)::TIMESTAMP AS bucket_start, ev.* FROM ev, g)"""


ID = "granularity || ':' || strftime(bucket_start, '%Y-%m-%dT%H')"
STAGES = ("CartCheckedOut", "OrderCreated", "OrderConfirmed", "PaymentCompleted", "OrderDelivered")


def funnel_by_bucket() -> str:
    counts = ", ".join(f"count(*) FILTER (t = '{s}') AS c{i}" for i, s in enumerate(STAGES))
    cols = ", ".join(f"coalesce(c{i}, 0)::BIGINT AS count_{i}" for i in range(5))
    rates = ", ".join(
        f"round(1 - coalesce(c{i}, 0)::DOUBLE / nullif(coalesce(c{i - 1}, 0), 0), 6) AS rate_{i}"
        for i in range(1, 5)
    )
    return f"""{buckets("orders", ORDER_EVENTS)},
c AS (SELECT granularity, bucket_start, {counts} FROM b GROUP BY ALL)
SELECT {ID} AS id, granularity, bucket_start, {cols}, {rates}
FROM spine LEFT JOIN c USING (granularity, bucket_start)"""


def funnel_range() -> str:
    rows = ", ".join(f"({i}, '{s}')" for i, s in enumerate(STAGES))
    return f"""
WITH ev AS ({ORDER_EVENTS}), s(stage_no, stage) AS (VALUES {rows}),
c AS (SELECT stage_no, stage, count(t) AS n FROM s LEFT JOIN ev ON t = stage GROUP BY ALL)
SELECT stage_no, stage, n AS count,
       round(1 - n::DOUBLE / nullif(lag(n) OVER (ORDER BY stage_no), 0), 6) AS drop_off_rate
FROM c"""


def revenue_by_bucket() -> str:
    return f"""{buckets("orders", ORDER_EVENTS)},
c AS (SELECT granularity, bucket_start, sum(v::DECIMAL(18,2)) AS a, count(*) AS n
      FROM b WHERE t = 'OrderCreated' GROUP BY ALL)
SELECT {ID} AS id, granularity, bucket_start, NULL::VARCHAR AS sku, NULL::VARCHAR AS category,
       coalesce(a, 0)::DECIMAL(38,2) AS revenue_amount, 'USD' AS revenue_currency,
       coalesce(n, 0)::BIGINT AS order_count
FROM spine LEFT JOIN c USING (granularity, bucket_start)"""


def revenue_series() -> str:
    return f"""SELECT bucket_start, revenue_amount, revenue_currency, order_count
FROM ({revenue_by_bucket()}) WHERE granularity = 'day' ORDER BY bucket_start"""


def _fulfillment(extra: str = "") -> str:
    return f"""{buckets("orders", ORDER_EVENTS)},
ends AS (SELECT granularity, bucket_start, t, k, min(ts) AS ended FROM b
         WHERE t IN ('ShipmentDispatched', 'OrderDelivered') GROUP BY ALL),
d AS (SELECT s.granularity, s.bucket_start, e.t AS leg,
             date_diff('microsecond', s.ts, e.ended) / 3.6e9 AS h
      FROM b s JOIN ends e ON s.granularity = e.granularity AND s.bucket_start = e.bucket_start
       AND s.k = e.k AND ((s.t = 'OrderConfirmed' AND e.t = 'ShipmentDispatched')
                       OR (s.t = 'ShipmentDispatched' AND e.t = 'OrderDelivered'))),
q AS (SELECT granularity, bucket_start,
        quantile_disc(h, 0.5) FILTER (leg = 'ShipmentDispatched') AS s50,
        quantile_disc(h, 0.95) FILTER (leg = 'ShipmentDispatched') AS s95,
        quantile_disc(h, 0.99) FILTER (leg = 'ShipmentDispatched') AS s99,
        quantile_disc(h, 0.5) FILTER (leg = 'OrderDelivered') AS d50,
        quantile_disc(h, 0.95) FILTER (leg = 'OrderDelivered') AS d95,
        quantile_disc(h, 0.99) FILTER (leg = 'OrderDelivered') AS d99
      FROM d GROUP BY ALL),
model AS (SELECT {ID} AS id, granularity, bucket_start,
        coalesce(s50, 0) AS time_to_ship_p50_hours, coalesce(s95, 0) AS time_to_ship_p95_hours,
        coalesce(s99, 0) AS time_to_ship_p99_hours, coalesce(d50, 0) AS time_to_deliver_p50_hours,
        coalesce(d95, 0) AS time_to_deliver_p95_hours, coalesce(d99, 0) AS time_to_deliver_p99_hours
      FROM spine LEFT JOIN q USING (granularity, bucket_start))"""


FULFILLMENT_COLUMNS = [
    f"time_to_{leg}_p{p}_hours" for leg in ("ship", "deliver") for p in (50, 95, 99)
]


def fulfillment_by_bucket() -> str:
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in FULFILLMENT_COLUMNS)
    return f"{_fulfillment()} SELECT id, granularity, bucket_start, {cols} FROM model"


def fulfillment_range() -> str:
    cols = ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in FULFILLMENT_COLUMNS)
    return f"{_fulfillment()} SELECT {cols} FROM model WHERE granularity = 'week'"


STOCK_COUNTS = """count(*) FILTER (t = 'reserved') AS reserved,
  count(*) FILTER (t = 'failed') AS reservation_failed,
  count(*) FILTER (t = 'released') AS released,
  count(*) FILTER (t = 'replenished') AS replenished"""


def inventory_by_bucket() -> str:
    return f"""{buckets("lineitem", STOCK_EVENTS)},
per AS (SELECT granularity, bucket_start, sku, {STOCK_COUNTS} FROM b
        WHERE sku IS NOT NULL GROUP BY ALL),
tot AS (SELECT granularity, bucket_start, {STOCK_COUNTS} FROM b GROUP BY ALL),
m AS (SELECT granularity, bucket_start, NULL AS sku, coalesce(reserved, 0) AS reserved,
             coalesce(reservation_failed, 0) AS reservation_failed,
             coalesce(released, 0) AS released, coalesce(replenished, 0) AS replenished
      FROM spine FULL JOIN tot USING (granularity, bucket_start)
      UNION ALL SELECT * FROM per)
SELECT {ID} || coalesce(':' || sku, '') AS id, * FROM m"""


def inventory_range() -> str:
    return f"SELECT {STOCK_COUNTS} FROM ({STOCK_EVENTS})"


def inventory_range_sku() -> str:
    return f"SELECT {STOCK_COUNTS} FROM ({STOCK_EVENTS}) WHERE sku = 'sku-7'"


CATALOG_COUNTS = """count(*) FILTER (t = 'created') AS products_created,
  count(*) FILTER (t = 'price') AS price_changes,
  count(*) FILTER (t = 'category') AS category_updates"""


def catalog_by_bucket() -> str:
    return f"""{buckets("catalog", CATALOG_EVENTS)},
c AS (SELECT granularity, bucket_start, {CATALOG_COUNTS} FROM b GROUP BY ALL)
SELECT {ID} AS id, granularity, bucket_start, coalesce(products_created, 0) AS products_created,
       coalesce(price_changes, 0) AS price_changes, coalesce(category_updates, 0) AS category_updates
FROM spine LEFT JOIN c USING (granularity, bucket_start)"""


def catalog_range() -> str:
    return f"SELECT {CATALOG_COUNTS} FROM ({CATALOG_EVENTS})"


CLICKSTREAM = "SELECT ts, event_id AS k, user_id AS u, event_type AS t, value AS v FROM events"
COUPON = "t = 'purchase' AND k % 3 = 0"
QUOTE = "t = 'purchase' AND k % 3 <> 0"


def promotions_by_bucket() -> str:
    return f"""{buckets("events", CLICKSTREAM)},
c AS (SELECT granularity, bucket_start, count(*) FILTER ({COUPON}) AS r, count(*) FILTER ({QUOTE}) AS q,
             sum(v::DECIMAL(18,2)) FILTER ({QUOTE}) AS a FROM b GROUP BY ALL)
SELECT {ID} AS id, granularity, bucket_start, coalesce(r, 0) AS coupons_redeemed,
       coalesce(q, 0) AS quotes_issued,
       coalesce(a, 0)::DECIMAL(38,2) AS attributable_order_volume_amount,
       'USD' AS attributable_order_volume_currency,
       round(coalesce(r::DOUBLE / nullif(q, 0), 0), 6) AS redemption_rate
FROM spine LEFT JOIN c USING (granularity, bucket_start)"""


def promotions_range() -> str:
    return f"""SELECT count(*) FILTER ({COUPON}) AS coupons_redeemed,
 count(*) FILTER ({QUOTE}) AS quotes_issued,
 coalesce(sum(v::DECIMAL(18,2)) FILTER ({QUOTE}), 0)::DECIMAL(38,2) AS volume_amount,
 'USD' AS volume_currency,
 round(coalesce((count(*) FILTER ({COUPON}))::DOUBLE / nullif(count(*) FILTER ({QUOTE}), 0), 0), 6)
   AS redemption_rate
FROM ({CLICKSTREAM})"""


USER_COUNTS = """count(*) FILTER (t = 'signup') AS signups,
  count(*) FILTER (t = 'view') AS sessions_created,
  count(*) FILTER (t = 'click') AS profile_changes"""


def user_growth_by_bucket() -> str:
    return f"""{buckets("events", CLICKSTREAM)},
c AS (SELECT granularity, bucket_start, {USER_COUNTS} FROM b GROUP BY ALL)
SELECT {ID} AS id, granularity, bucket_start, coalesce(signups, 0) AS signups,
       coalesce(sessions_created, 0) AS sessions_created,
       coalesce(profile_changes, 0) AS profile_changes
FROM spine LEFT JOIN c USING (granularity, bucket_start)"""


def user_growth_range() -> str:
    return f"SELECT {USER_COUNTS} FROM ({CLICKSTREAM})"


REVIEW_COUNTS = "count(*) AS review_count, " + ", ".join(
    f"count(*) FILTER (rating = {s}) AS stars_{s}" for s in range(1, 6)
)
REVIEW_COLUMNS = ["review_count", *[f"stars_{s}" for s in range(1, 6)]]


def reviews_by_bucket() -> str:
    cols = ", ".join(f"coalesce({c}, 0) AS {c}" for c in REVIEW_COLUMNS)
    return f"""{buckets("reviews", REVIEW_EVENTS)},
c AS (SELECT granularity, bucket_start, {REVIEW_COUNTS} FROM b GROUP BY ALL)
SELECT {ID} AS id, granularity, bucket_start, {cols}
FROM spine LEFT JOIN c USING (granularity, bucket_start)"""


def reviews_range() -> str:
    return f"SELECT {REVIEW_COUNTS} FROM ({REVIEW_EVENTS})"


def admin_audit(where: str = "true") -> str:
    return f"""SELECT * FROM (
SELECT TIMESTAMP '1997-01-01' + (s_suppkey % 300) * INTERVAL 1 HOUR AS occurred_at,
       CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE 'catalog.' || s_nationkey END AS action_type,
       'a-' || s_suppkey AS admin_id
FROM supplier) WHERE {where}"""


SENT = "t = 'error' AND k % 4 <> 0"
ALERT = "t = 'error' AND k % 4 = 0"
CHANNEL = "CASE k % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'sms' ELSE 'push' END"


def notifications_by_bucket() -> str:
    return f"""{buckets("events", CLICKSTREAM)},
tot AS (SELECT granularity, bucket_start, count(*) FILTER ({SENT}) AS sent,
               count(*) FILTER ({ALERT}) AS price_alerts_triggered FROM b GROUP BY ALL),
m AS (SELECT granularity, bucket_start, NULL AS channel, coalesce(sent, 0) AS sent,
             coalesce(price_alerts_triggered, 0) AS price_alerts_triggered
      FROM spine LEFT JOIN tot USING (granularity, bucket_start)
      UNION ALL
      SELECT granularity, bucket_start, {CHANNEL}, count(*), 0 FROM b WHERE {SENT} GROUP BY 1, 2, 3)
SELECT {ID} || coalesce(':' || channel, '') AS id, * FROM m"""


def notifications_range() -> str:
    return f"""
SELECT NULL AS channel, count(*) FILTER ({SENT}) AS sent,
       count(*) FILTER ({ALERT}) AS price_alerts_triggered, true AS is_total FROM ({CLICKSTREAM})
UNION ALL
SELECT {CHANNEL}, count(*), 0, false FROM ({CLICKSTREAM}) WHERE {SENT} GROUP BY 1"""


# --- deliveries and broker messages ---------------------------------------------------------


def uuid_of(text: str) -> str:
    return f"(md5({text})::UUID)::VARCHAR"


def _branch(table, event_type, publisher, key, num, order, when, ts, payload) -> str:
    return f"""SELECT {num}::BIGINT AS num, {key} AS partition_key,
  {uuid_of(f"'{event_type}:' || {num}")} AS event_id, '{event_type}' AS event_type,
  '{publisher}-service' AS publisher_service, ({ts})::TIMESTAMP AS occurred_at,
  {payload} AS payload, (({num} % 100000000) * 10 + {order})::BIGINT AS tie
FROM {table} WHERE {when}"""


_O = """'{"orderId":"o-' || o_orderkey || '"'"""
_OU = f"""{_O} || ',"userId":"u-' || o_custkey || '"'"""
_S = """'{"sku":"sku-' || p_partkey || '"'"""
_U = """'{"userId":"u-' || user_id || '"'"""
_UE = f"""{_U} || ',"email":"u' || user_id || '@example.com"'"""
_P0 = "TIMESTAMP '1995-01-01' + (p_partkey % 700) * INTERVAL 1 DAY"


def _deliveries() -> str:
    o, p, e = ("orders", "'o-' || o_orderkey", "o_orderkey"), ("part", "'sku-' || p_partkey", "p_partkey"), (
        "events",
        "'u-' || user_id",
        "event_id",
    )
    rows = [
        (o, "CartCheckedOut", "cart", 0, "true", T0, f"{_OU} || '}}'"),
        (o, "OrderCreated", "order", 1, "o_orderkey % 10 <> 0", f"{T0} + INTERVAL 1 HOUR",
         f"""{_OU} || ',"total":' || o_totalprice::DECIMAL(18,2) || '}}'"""),
        (o, "OrderConfirmed", "order", 2, "o_orderkey % 10 > 1", f"{T0} + INTERVAL 2 HOUR", f"{_O} || '}}'"),
        (o, "PaymentCompleted", "payment", 3, "o_orderkey % 10 > 2", f"{T0} + INTERVAL 3 HOUR", f"{_O} || '}}'"),
        (o, "PaymentFailed", "payment", 4, "o_orderkey % 10 = 2", f"{T0} + INTERVAL 3 HOUR",
         f"""{_O} || ',"reason":"card_declined"}}'"""),
        (o, "ShipmentDispatched", "shipping", 5, "o_orderkey % 10 > 2",
         f"{T0} + (2 + o_orderkey % 30) * INTERVAL 1 HOUR", f"{_O} || '}}'"),
        (o, "OrderDelivered", "order", 6, "o_orderkey % 10 > 2 AND o_orderstatus = 'F'",
         f"{T0} + (24 + o_orderkey % 72) * INTERVAL 1 HOUR", f"{_O} || '}}'"),
        (p, "InventoryReplenished", "inventory", 0, "true",
         "TIMESTAMP '1998-01-01' + (p_partkey % 365) * INTERVAL 1 DAY",
         f"""{_S} || ',"qtyAdded":' || p_size || '}}'"""),
        (p, "ProductCreated", "product", 1, "true", _P0,
         f"""{_S} || ',"price":' || p_retailprice::DECIMAL(18,2) || '}}'"""),
        (p, "ProductPriceChanged", "product", 2, "p_partkey % 3 = 0", f"{_P0} + INTERVAL 30 DAY", f"{_S} || '}}'"),
        (p, "CategoryUpdated", "category", 3, "p_partkey % 7 = 0", f"{_P0} + INTERVAL 60 DAY",
         """'{"categoryId":"' || p_type || '"}'"""),
        (("customer", "'u-' || c_custkey", "c_custkey"), "ReviewSubmitted", "review", 0, "true",
         "TIMESTAMP '1996-01-01' + (c_custkey % 900) * INTERVAL 1 DAY",
         """'{"userId":"u-' || c_custkey || '","rating":' || CASE WHEN c_custkey % 11 = 0
            THEN '"' || (c_custkey % 7) || '"' ELSE (c_custkey % 7)::VARCHAR END || '}'"""),
        (("supplier", "'a-' || s_suppkey", "s_suppkey"), "AdminActionPerformed", "admin", 0, "true",
         "TIMESTAMP '1997-01-01' + (s_suppkey % 300) * INTERVAL 1 HOUR",
         """'{"adminId":"a-' || s_suppkey || '"' || CASE WHEN s_suppkey % 5 = 0 THEN ''
            ELSE ',"action":"catalog.' || s_nationkey || '"' END || '}'"""),
        (e, "UserRegistered", "identity", 0, "event_type = 'signup'", "ts", f"{_UE} || '}}'"),
        (e, "SessionCreated", "identity", 1, "event_type = 'view'", "ts", f"{_U} || '}}'"),
        (e, "UserProfileUpdated", "user", 2, "event_type = 'click' AND event_id % 2 = 0", "ts", f"{_U} || '}}'"),
        (e, "UserAccountUpdated", "identity", 3, "event_type = 'click' AND event_id % 2 = 1", "ts",
         f"""{_UE} || ',"displayName":"User ' || user_id || '"}}'"""),
        (e, "CouponRedeemed", "offer", 4, "event_type = 'purchase' AND event_id % 3 = 0", "ts",
         """'{"code":"c-' || (event_id % 10) || '"}'"""),
        (e, "PriceQuoteIssued", "offer", 5, "event_type = 'purchase' AND event_id % 3 <> 0", "ts",
         """'{"quoteId":"q-' || event_id || '","total":' || value::DECIMAL(18,2) || '}'"""),
        (e, "NotificationSent", "notification", 6, "event_type = 'error' AND event_id % 4 <> 0", "ts",
         f"""{_U} || ',"channel":"' || CASE event_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'sms'
            ELSE 'push' END || '"}}'"""),
        (e, "WishlistPriceAlertTriggered", "wishlist", 7, "event_type = 'error' AND event_id % 4 = 0", "ts",
         f"{_U} || '}}'"),
        (("(SELECT DISTINCT user_id FROM events)", "'u-' || user_id", "user_id"), "UserDataErased", "user", 0,
         "user_id % 50 = 0", "TIMESTAMP '2024-01-20'", f"{_U} || '}}'"),
    ]
    branches = [
        _branch(t[0], event_type, publisher, t[1], t[2], order, when, ts, payload)
        for t, event_type, publisher, order, when, ts, payload in rows
    ]
    n = "(l_orderkey * 10 + l_linenumber)"
    branches.append(f"""SELECT {n}::BIGINT, 'o-' || l_orderkey,
  {uuid_of("'InventoryMovement:' || l_orderkey || '-' || l_linenumber")},
  CASE l_returnflag WHEN 'N' THEN 'InventoryReserved' WHEN 'A' THEN 'InventoryReleased'
    ELSE 'InventoryReservationFailed' END, 'inventory-service',
  (l_shipdate + l_linenumber * INTERVAL 1 HOUR)::TIMESTAMP,
  '{{"orderId":"o-' || l_orderkey || '"' || CASE WHEN l_partkey % 50 = 0 THEN ''
    ELSE ',"sku":"sku-' || l_partkey || '"' END || '}}',
  (({n} % 10000 * 10000 + l_partkey % 10000) * 10
    + CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END)::BIGINT
FROM lineitem""")
    return "\nUNION ALL ".join(branches)


PII = """('OrderCreated','ReviewSubmitted','UserProfileUpdated','UserDataErased','UserRegistered',
 'SessionCreated','UserAccountUpdated','NotificationSent','CartCheckedOut','WishlistPriceAlertTriggered')"""

DELIVERIES = f"""
WITH e AS ({_deliveries()}),
arr AS (
  SELECT num, tie, event_id, event_type, publisher_service, partition_key, occurred_at,
         occurred_at + INTERVAL 1 MINUTE
           + CASE WHEN num % 29 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS ingested_at,
         payload FROM e
  UNION ALL
  SELECT num, tie, event_id, event_type, publisher_service, partition_key, occurred_at,
         occurred_at + INTERVAL 6 HOUR, left(payload, length(payload) - 1) || ',"attempt":2}}'
  FROM e WHERE num % 13 = 0),
a AS (SELECT *, ingested_at::VARCHAR || md5(event_type || ':' || payload) AS seq,
             event_type IN {PII} AS contains_pii FROM arr)"""


def shape(payload: str) -> str:
    return f"upper(left(sha256(array_to_string(list_sort(json_keys({payload})), ',')), 16))"


def schema_fingerprint() -> str:
    return f"""{DELIVERIES}
SELECT event_type, {shape("payload")} AS schema_id, '1.0' AS schema_version_label,
       count(*) AS deliveries, min(ingested_at) AS first_seen, max(ingested_at) AS last_seen
FROM a GROUP BY 1, 2"""


def pii_classify() -> str:
    return f"""{DELIVERIES}
SELECT event_type, contains_pii, count(*) AS deliveries FROM a GROUP BY 1, 2"""


def raw_upsert_latest() -> str:
    return f"""{DELIVERIES},
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS rn,
             min(ingested_at) OVER (PARTITION BY event_id) AS first_at,
             count(*) OVER (PARTITION BY event_id) AS n FROM a)
SELECT event_id, event_type, publisher_service, partition_key, occurred_at, payload,
       {shape("payload")} AS schema_id, contains_pii, first_at AS ingested_at,
       ingested_at AS updated_at
FROM r WHERE rn = 1"""


# Step-by-step reading of the redaction rule: an erasure redacts what is current at its place in
# the arrival order.
HITS = f"""{DELIVERIES},
er AS (SELECT DISTINCT payload->>'userId' AS uid, event_id AS erasure_id, seq AS eseq,
              ingested_at AS erased_at FROM a WHERE event_type = 'UserDataErased'),
ver AS (SELECT *, payload->>'userId' AS uid,
               lead(seq) OVER (PARTITION BY event_id ORDER BY seq) AS nxt FROM (SELECT DISTINCT * FROM a)),
hit AS (SELECT v.event_id, v.payload AS hit_payload, er.* FROM ver v JOIN er ON v.uid = er.uid
        WHERE v.contains_pii AND v.seq <= er.eseq AND (v.nxt IS NULL OR er.eseq < v.nxt)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY eseq) AS rn FROM hit)
         WHERE rn = 1)"""


def _blank(payload: str, field: str) -> str:
    return f"""regexp_replace({payload}, '"{field}":"[^"]*"', '"{field}":"[redacted]"')"""


def pii_redaction_current() -> str:
    redacted = _blank(_blank(_blank("hit_payload", "email"), "displayName"), "name")
    return f"""{HITS},
cur AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS last_no FROM a)
SELECT c.event_id, c.event_type, c.contains_pii, c.occurred_at,
       CASE WHEN b.event_id IS NOT NULL THEN {redacted} ELSE c.payload END AS payload_text,
       b.erased_at AS pii_redacted_at,
       CASE WHEN b.eseq >= c.seq THEN b.erased_at ELSE c.ingested_at END AS updated_at
FROM cur c LEFT JOIN best b ON c.event_id = b.event_id WHERE c.last_no = 1"""


def pii_redaction_records() -> str:
    return f"""{HITS}
SELECT er.uid AS user_id, er.erasure_id AS triggering_event_id, er.erased_at AS redacted_at,
       (SELECT count(*) FROM best b WHERE b.erasure_id = er.erasure_id AND b.eseq = er.eseq) AS rows_redacted,
       'system:analytics-pii-redaction-sweep' AS created_by
FROM er"""


def pii_pending_scan() -> str:
    return f"""{HITS},
cur AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS last_no FROM a)
SELECT c.payload->>'userId' AS user_id, count(*) AS pending FROM cur c
WHERE c.last_no = 1 AND c.contains_pii AND c.payload->>'userId' IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM best b WHERE b.event_id = c.event_id)
GROUP BY 1"""


WIRE = f"""{DELIVERIES},
styled AS (SELECT *, num % 2 = 0 AS header_style,
    CASE WHEN num % 103 = 0 THEN 'not-a-uuid' ELSE replace(event_id, '-', '') END AS id_text,
    strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS at_text FROM arr),
texted AS (SELECT *, CASE WHEN header_style THEN payload ELSE
    '{{' || CASE WHEN num % 101 = 0 THEN ''
                 ELSE '"eventType":' || CASE WHEN num % 107 = 0 THEN '5' ELSE '"' || event_type || '"' END || ',' END
    || '"eventId":"' || id_text || '","publisherService":"' || publisher_service
    || '","occurredAt":"' || at_text || '",' || substr(payload, 2) END AS t0 FROM styled),
wire AS (SELECT *, CASE WHEN num % 97 = 0 THEN left(t0, length(t0) - 1)
                        WHEN num % 109 = 0 THEN '[' || t0 || ']'
                        WHEN num % 127 = 0 THEN t0 || ' tail' ELSE t0 END AS text,
    CASE event_type
      WHEN 'OrderCreated' THEN 'order' WHEN 'OrderConfirmed' THEN 'order' WHEN 'OrderDelivered' THEN 'order'
      ELSE replace(publisher_service, '-service', '') END AS domain,
    header_style AND num % 113 = 0 AS type_only,
    header_style AND num % 101 = 0 AND num % 113 <> 0 AS header_without_type FROM texted),
m AS (SELECT *, 'commerce.' || domain || '.events' AS topic, (num % 4)::INT AS part,
    (epoch_us(ingested_at) // 1000000) * 1000000000 + tie AS off,
    CASE WHEN num % 89 <> 0 THEN partition_key END AS key,
    CASE WHEN num % 97 = 0 THEN 'broken' WHEN num % 109 = 0 THEN 'array'
         WHEN num % 127 = 0 THEN 'broken' ELSE 'object' END AS body_kind FROM wire),
-- which values the reader sees, by style
seen AS (SELECT *,
    (md5(topic || ':' || part || ':' || off)::UUID)::VARCHAR AS message_id,
    CASE WHEN header_style THEN CASE WHEN NOT header_without_type THEN event_type END
         WHEN body_kind = 'object' AND num % 101 <> 0 AND num % 107 <> 0 THEN event_type END AS r_type,
    CASE WHEN header_style THEN CASE WHEN NOT type_only THEN id_text END
         WHEN body_kind = 'object' THEN id_text END AS r_id,
    CASE WHEN header_style THEN CASE WHEN NOT type_only THEN publisher_service END
         WHEN body_kind = 'object' THEN publisher_service END AS r_pub,
    CASE WHEN header_style THEN CASE WHEN NOT type_only THEN occurred_at END
         WHEN body_kind = 'object' THEN occurred_at END AS r_at,
    (NOT header_style AND (body_kind = 'array'
        OR (body_kind = 'object' AND num % 107 = 0 AND num % 101 <> 0)))
      OR (body_kind = 'array' AND (type_only OR header_without_type)) AS mistyped FROM m),
v AS (SELECT *,
    CASE WHEN mistyped THEN 'mistyped_envelope_field' WHEN r_type IS NULL THEN 'missing_event_type'
         WHEN r_id = 'not-a-uuid' THEN 'invalid_event_id' END AS envelope_failure FROM seen),
parsed AS (SELECT topic, part, off, text,
    CASE WHEN envelope_failure IS NOT NULL THEN message_id
         WHEN r_id IS NULL THEN message_id ELSE (r_id::UUID)::VARCHAR END AS event_id,
    CASE WHEN envelope_failure IS NOT NULL THEN 'Unknown' ELSE r_type END AS event_type,
    coalesce(r_pub, 'unknown') AS publisher_service,
    coalesce(r_at, TIMESTAMP '2025-01-01') AS occurred_at,
    key, ingested_at,
    CASE WHEN envelope_failure IS NOT NULL THEN envelope_failure
         WHEN body_kind = 'broken' THEN 'invalid_json'
         WHEN body_kind = 'array' THEN 'payload_not_object' END AS failure_reason FROM v)"""


def ingest_envelope_parse() -> str:
    return f"""{WIRE}
SELECT topic, part AS partition, off AS offset, event_id, event_type, publisher_service,
       coalesce(key, event_id) AS partition_key, occurred_at, {shape("text")} AS schema_id,
       event_type IN {PII} AS contains_pii
FROM parsed WHERE failure_reason IS NULL"""


def ingest_reject_split() -> str:
    return f"""{WIRE}
SELECT (md5('dlq:' || topic || ':' || part || ':' || off)::UUID)::VARCHAR AS dlq_id, event_id,
       event_type, text AS payload, failure_reason, 3 AS retry_count,
       TIMESTAMP '2025-01-01' AS dlq_landed_at
FROM parsed WHERE failure_reason IS NOT NULL"""


def ingest_outcomes() -> str:
    return f"""{WIRE}
SELECT topic, coalesce(failure_reason, 'accepted') AS outcome, count(*) AS messages
FROM parsed GROUP BY 1, 2"""


DLQ = f"""{WIRE},
dlq AS (SELECT (md5('dlq:' || topic || ':' || part || ':' || off)::UUID)::VARCHAR AS dlq_id, *,
               ingested_at AS landed FROM parsed WHERE failure_reason IS NOT NULL)"""


def dlq_pending_batch() -> str:
    return f"""{DLQ}
SELECT dlq_id, event_type, failure_reason, landed AS dlq_landed_at FROM dlq
ORDER BY landed, dlq_id LIMIT 50"""


def dlq_reprocess() -> str:
    """Rejects whose payload is a JSON object come back; the envelope is rebuilt from the payload."""
    return f"""{DLQ},
ok AS (SELECT *, json_valid(text) AND left(text, 1) = '{{' AS fixable FROM dlq)
SELECT dlq_id, fixable AS reprocessed, event_type,
  CASE WHEN fixable THEN coalesce(CASE WHEN json_type(text, '$.publisherService') = 'VARCHAR'
       THEN text->>'publisherService' END, 'unknown') END AS publisher_service,
  CASE WHEN fixable THEN event_id END AS partition_key,
  CASE WHEN fixable THEN coalesce(try_cast(text->>'occurredAt' AS TIMESTAMP), landed) END AS occurred_at,
  CASE WHEN fixable THEN {shape("CASE WHEN json_valid(text) THEN text ELSE '{}' END")} END AS schema_id
FROM ok"""


def stream_ingest() -> str:
    """Wave by wave the last delivery of each event id wins, by broker time and position inside a wave."""
    return f"""{WIRE},
good AS (SELECT *, ingested_at >= TIMESTAMP '1998-06-01' AS second_wave FROM parsed
         WHERE failure_reason IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id
        ORDER BY second_wave DESC, ingested_at DESC, topic DESC, part DESC, off DESC) AS rn FROM good)
SELECT event_id, event_type, publisher_service, coalesce(key, event_id) AS partition_key,
       CASE WHEN occurred_at = TIMESTAMP '2025-01-01' THEN NULL ELSE occurred_at END AS occurred_at,
       {shape("text")} AS schema_id
FROM r WHERE rn = 1"""


def stream_projection() -> str:
    """Revenue of the final rows, for every bucket that a row of either wave was ever in."""
    return f"""{WIRE},
good AS (SELECT *, ingested_at >= TIMESTAMP '1998-06-01' AS second_wave FROM parsed
         WHERE failure_reason IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id
        ORDER BY second_wave DESC, ingested_at DESC, topic DESC, part DESC, off DESC) AS rn,
        row_number() OVER (PARTITION BY event_id, second_wave
        ORDER BY ingested_at DESC, topic DESC, part DESC, off DESC) AS rn_in_wave FROM good),
g(granularity) AS (VALUES ('hour'), ('day'), ('week'), ('month')),
b AS (SELECT granularity, date_trunc(granularity, occurred_at)::TIMESTAMP AS bucket_start,
             rn = 1 AND event_type = 'OrderCreated' AS counts,
             CASE WHEN rn = 1 AND event_type = 'OrderCreated' THEN (text->>'total')::DECIMAL(18,2) END AS v
      FROM r, g WHERE rn_in_wave = 1 AND occurred_at < TIMESTAMP '2025-01-01')
SELECT {ID} AS id, granularity, bucket_start, coalesce(sum(v), 0)::DECIMAL(38,2) AS revenue_amount,
       count(*) FILTER (counts) AS order_count, true AS is_provisional
FROM b GROUP BY granularity, bucket_start"""


# --- scans, ledger, reconciliation ------------------------------------------------------------

DATES = "SELECT DISTINCT o_orderdate::DATE AS run_date FROM orders"
LEDGER = f"""
WITH d AS ({DATES}),
runs AS (SELECT run_date, CASE WHEN n % 10 = 0 THEN 'failed' WHEN n % 11 = 0 THEN 'running'
                               ELSE 'completed' END AS status,
                run_date::TIMESTAMP + INTERVAL 26 HOUR AS started_at
         FROM (SELECT run_date, date_diff('day', DATE '1970-01-01', run_date) AS n FROM d))"""


def event_scan_window() -> str:
    return f"""SELECT t AS event_type, count(*) AS events, min(ts) AS first_at, max(ts) AS last_at
FROM ({ORDER_EVENTS}) WHERE t = 'OrderCreated' AND ts >= TIMESTAMP '1997-01-01'
 AND ts < TIMESTAMP '1998-01-01' GROUP BY 1
UNION ALL
SELECT t || ' since', count(*), min(ts), max(ts) FROM ({ORDER_EVENTS})
WHERE t = 'OrderDelivered' AND ts >= TIMESTAMP '1999-01-01' GROUP BY 1"""


def event_lookup() -> str:
    return f"""{DELIVERIES},
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS rn FROM a)
SELECT event_id, event_type, partition_key, occurred_at, payload FROM r
WHERE rn = 1 AND event_id = {uuid_of("'OrderCreated:7'")}"""


def last_completed_run() -> str:
    return f"""{LEDGER} SELECT max(run_date) AS run_date FROM runs WHERE status = 'completed'"""


def reconcile_ledger() -> str:
    return f"""{LEDGER}
SELECT run_date, CASE status WHEN 'completed' THEN 'already_completed'
    WHEN 'running' THEN 'skipped_already_running' ELSE 'started' END AS outcome,
  CASE WHEN status = 'failed' THEN 'running' ELSE status END AS status,
  CASE WHEN status = 'failed' THEN TIMESTAMP '2025-01-01' ELSE started_at END AS started_at
FROM runs"""


def reconcile_day() -> str:
    """Revenue buckets enclosing every reconciled date; final once the bucket has fully passed."""
    return f"""
WITH ev AS ({ORDER_EVENTS}), d AS (SELECT max(o_orderdate)::DATE AS d FROM orders),
g(granularity) AS (VALUES ('hour'), ('day'), ('week'), ('month')),
spine AS (SELECT granularity, date_trunc(granularity, h)::TIMESTAMP AS bucket_start, d FROM g,
   (SELECT d, unnest(generate_series(d::TIMESTAMP, d::TIMESTAMP + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS h FROM d)
   GROUP BY ALL),
s AS (SELECT *, CASE granularity WHEN 'hour' THEN bucket_start + INTERVAL 1 HOUR
   WHEN 'day' THEN bucket_start + INTERVAL 1 DAY WHEN 'week' THEN bucket_start + INTERVAL 7 DAY
   ELSE bucket_start + INTERVAL 1 MONTH END AS bucket_end FROM spine)
SELECT {ID} AS id, granularity, bucket_start,
  coalesce(sum(v::DECIMAL(18,2)), 0)::DECIMAL(38,2) AS revenue_amount, count(ts) AS order_count,
  bucket_end > d + INTERVAL 1 DAY AS is_provisional, d AS reconciled_through
FROM s LEFT JOIN (SELECT * FROM ev WHERE t = 'OrderCreated') e
  ON e.ts >= s.bucket_start AND e.ts < s.bucket_end
GROUP BY granularity, bucket_start, bucket_end, d"""


def incremental_tick() -> str:
    return f"""
WITH ev AS ({ORDER_EVENTS}), n AS (SELECT max(o_orderdate) + INTERVAL 630 MINUTE AS as_of FROM orders),
g(granularity) AS (VALUES ('hour'), ('day'), ('week'), ('month')),
s AS (SELECT granularity, date_trunc(granularity, as_of)::TIMESTAMP AS bucket_start, as_of FROM g, n)
SELECT {ID} AS id, granularity, bucket_start,
  coalesce(sum(v::DECIMAL(18,2)), 0)::DECIMAL(38,2) AS revenue_amount, count(ts) AS order_count
FROM s LEFT JOIN (SELECT * FROM ev WHERE t = 'OrderCreated') e
  ON e.ts >= s.bucket_start AND e.ts < s.as_of
GROUP BY granularity, bucket_start"""


def dashboard_envelope() -> str:
    """Day buckets are final where their date's run completed; envelope per calendar month."""
    return f"""{LEDGER},
span AS ({span("orders")}),
days AS (SELECT DISTINCT date_trunc('day', h)::TIMESTAMP AS day FROM
  (SELECT unnest(generate_series(date_trunc('day', f)::TIMESTAMP, t, INTERVAL 1 DAY)) AS h, t FROM span) WHERE h < t),
docs AS (SELECT day, run_date FROM days LEFT JOIN (SELECT * FROM runs WHERE status = 'completed') r
         ON r.run_date = day::DATE)
SELECT date_trunc('month', day)::TIMESTAMP AS month, bool_or(run_date IS NULL) AS is_provisional,
       CASE WHEN count(*) = count(run_date) THEN min(run_date) END AS reconciled_through,
       TIMESTAMP '2025-01-01' AS generated_at
FROM docs GROUP BY 1"""


def read_model_lookup() -> str:
    return f"""SELECT * FROM ({revenue_by_bucket()}) WHERE id = 'month:1997-03-01T00'"""


def replay_equality() -> str:
    return "SELECT 0::BIGINT AS differing_rows"


# --- stored jobs: the last delivery of each event id among all messages ---------------------

STORED = f"""{WIRE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id
             ORDER BY ingested_at DESC, topic DESC, part DESC, off DESC) AS rn
           FROM parsed WHERE failure_reason IS NULL),
cur AS (SELECT event_id, event_type AS t, occurred_at AS ts, text FROM ranked WHERE rn = 1)"""


def reconcile_store() -> str:
    return f"""{STORED}, d AS (SELECT max(o_orderdate)::DATE AS d FROM orders),
g(granularity) AS (VALUES ('hour'), ('day'), ('week'), ('month')),
spine AS (SELECT granularity, date_trunc(granularity, h)::TIMESTAMP AS bucket_start, d FROM g,
   (SELECT d, unnest(generate_series(d::TIMESTAMP, d::TIMESTAMP + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS h FROM d)
   GROUP BY ALL),
s AS (SELECT *, CASE granularity WHEN 'hour' THEN bucket_start + INTERVAL 1 HOUR
   WHEN 'day' THEN bucket_start + INTERVAL 1 DAY WHEN 'week' THEN bucket_start + INTERVAL 7 DAY
   ELSE bucket_start + INTERVAL 1 MONTH END AS bucket_end FROM spine)
SELECT {ID} AS id, granularity, bucket_start,
  coalesce(sum((text->>'total')::DECIMAL(18,2)), 0)::DECIMAL(38,2) AS revenue_amount, count(ts) AS order_count,
  bucket_end > d + INTERVAL 1 DAY AS is_provisional, d AS reconciled_through,
  'completed' AS first_run, 'already_completed' AS second_run
FROM s LEFT JOIN (SELECT * FROM cur WHERE t = 'OrderCreated') e ON e.ts >= s.bucket_start AND e.ts < s.bucket_end
GROUP BY granularity, bucket_start, bucket_end, d"""


def tick_store() -> str:
    counts = ", ".join(f"count(*) FILTER (t = '{s}') AS count_{i}" for i, s in enumerate(STAGES))
    return f"""{STORED}, n AS (SELECT max(o_orderdate) + INTERVAL 630 MINUTE AS as_of FROM orders),
g(granularity) AS (VALUES ('hour'), ('day'), ('week'), ('month')),
s AS (SELECT granularity, date_trunc(granularity, as_of)::TIMESTAMP AS bucket_start, as_of FROM g, n)
SELECT {ID} AS id, granularity, bucket_start, {counts}, true AS is_provisional
FROM s LEFT JOIN cur e ON e.ts >= s.bucket_start AND e.ts < s.as_of
GROUP BY granularity, bucket_start"""


def dlq_drain_store() -> str:
    return f"""{DLQ},
ok AS (SELECT *, json_valid(text) AND left(text, 1) = '{{' AS fixable FROM dlq)
SELECT dlq_id, event_type, failure_reason, CASE WHEN fixable THEN TIMESTAMP '2025-01-02' END AS reprocessed_at,
       CASE WHEN fixable THEN 'system:analytics-dlq-reprocessor' ELSE 'system:analytics-ingestion-consumer' END AS updated_by
FROM ok"""


def serve_store() -> str:
    """Counts over all events; revenue by month; fulfillment as the mean of the months' percentiles."""

    def count(dashboard: str, measure: str, types: str, where: str = "true") -> str:
        return f"SELECT '{dashboard}' AS dashboard, '{measure}' AS measure, count(*)::DOUBLE AS value FROM cur WHERE t IN ({types}) AND {where}"

    rating = "CASE WHEN json_type(text, '$.rating') IN ('UBIGINT', 'BIGINT') THEN (text->>'rating')::BIGINT ELSE 0 END"
    channel = "CASE WHEN json_type(text, '$.channel') = 'VARCHAR' THEN text->>'channel' END"
    rows = [count("order_conversion_funnel", f"{s} count", f"'{s}'") for s in STAGES]
    rows += [count("inventory_movement", c, f"'{t}'") for c, t in (
        ("reserved", "InventoryReserved"), ("reservation_failed", "InventoryReservationFailed"),
        ("released", "InventoryReleased"), ("replenished", "InventoryReplenished"))]
    rows += [count("catalog_pricing", c, f"'{t}'") for c, t in (
        ("products_created", "ProductCreated"), ("price_changes", "ProductPriceChanged"), ("category_updates", "CategoryUpdated"))]
    rows += [count("user_growth", c, t) for c, t in (
        ("signups", "'UserRegistered'"), ("sessions_created", "'SessionCreated'"),
        ("profile_changes", "'UserProfileUpdated', 'UserAccountUpdated'"))]
    rows += [count("promotions_effectiveness", c, f"'{t}'") for c, t in (
        ("coupons_redeemed", "CouponRedeemed"), ("quotes_issued", "PriceQuoteIssued"))]
    rows += [count("reviews_ratings", "review_count", "'ReviewSubmitted'")]
    rows += [count("reviews_ratings", f"stars_{n}", "'ReviewSubmitted'", f"{rating} = {n}") for n in range(1, 6)]
    rows += [count("notification_delivery", "all sent", "'NotificationSent'"),
             count("notification_delivery", "all price_alerts_triggered", "'WishlistPriceAlertTriggered'"),
             count("notification_delivery", "all is_total", "'NotificationSent'")]
    quantiles = ", ".join(
        f"coalesce(quantile_disc(h, {p / 100}) FILTER (leg = '{leg}'), 0) AS time_to_{name}_p{p}_hours"
        for name, leg in (("ship", "ShipmentDispatched"), ("deliver", "OrderDelivered")) for p in (50, 95, 99))
    means = " UNION ALL ".join(
        f"SELECT 'fulfillment_performance', '{c}', coalesce(avg({c}), 0) FROM months" for c in FULFILLMENT_COLUMNS)
    rows = [r for r in rows if "is_total" not in r]
    return f"""{STORED},
legs AS (SELECT date_trunc('month', ts) AS m, t, text->>'orderId' AS k, ts FROM cur
         WHERE t IN ('OrderConfirmed', 'ShipmentDispatched', 'OrderDelivered') AND json_type(text, '$.orderId') = 'VARCHAR'),
ends AS (SELECT m, t, k, min(ts) AS ended FROM legs WHERE t <> 'OrderConfirmed' GROUP BY ALL),
d AS (SELECT s.m, e.t AS leg, date_diff('microsecond', s.ts, e.ended) / 3.6e9 AS h
      FROM legs s JOIN ends e ON s.m = e.m AND s.k = e.k
       AND ((s.t = 'OrderConfirmed' AND e.t = 'ShipmentDispatched') OR (s.t = 'ShipmentDispatched' AND e.t = 'OrderDelivered'))),
spine AS (SELECT DISTINCT date_trunc('month', ts)::TIMESTAMP AS m FROM cur),
months AS (SELECT m, {quantiles} FROM spine LEFT JOIN d USING (m) GROUP BY m),
shown AS (
{" UNION ALL ".join(rows)}
UNION ALL SELECT 'revenue', strftime(m, '%Y-%m') || ' revenue', coalesce(sum((text->>'total')::DECIMAL(18,2)), 0)::DOUBLE
  FROM spine LEFT JOIN (SELECT * FROM cur WHERE t = 'OrderCreated') o ON date_trunc('month', o.ts) = m GROUP BY m
UNION ALL SELECT 'revenue', strftime(m, '%Y-%m') || ' orders', count(o.ts)::DOUBLE
  FROM spine LEFT JOIN (SELECT * FROM cur WHERE t = 'OrderCreated') o ON date_trunc('month', o.ts) = m GROUP BY m
UNION ALL SELECT 'promotions_effectiveness', 'volume', coalesce(sum((text->>'total')::DECIMAL(18,2)), 0)::DOUBLE
  FROM cur WHERE t = 'PriceQuoteIssued'
UNION ALL SELECT 'promotions_effectiveness', 'redemption_rate',
  coalesce((count(*) FILTER (t = 'CouponRedeemed'))::DOUBLE / nullif(count(*) FILTER (t = 'PriceQuoteIssued'), 0), 0) FROM cur
UNION ALL SELECT 'admin_audit', coalesce(text->>'action', 'unknown') || ' ' || coalesce(text->>'adminId', 'unknown'), count(*)::DOUBLE
  FROM cur WHERE t = 'AdminActionPerformed' GROUP BY 1, 2
UNION ALL SELECT 'notification_delivery', {channel} || ' sent', count(*)::DOUBLE
  FROM cur WHERE t = 'NotificationSent' AND {channel} IS NOT NULL GROUP BY 2
UNION ALL SELECT DISTINCT 'notification_delivery', {channel} || ' price_alerts_triggered', 0::DOUBLE
  FROM cur WHERE t = 'NotificationSent' AND {channel} IS NOT NULL
UNION ALL {means})
SELECT dashboard, measure, round(value, 6) AS value FROM shown"""


# --- breakdowns, corrections, exact percentiles -------------------------------------------------


def _priced(key: str, sku: str, category: str) -> str:
    return f"""
WITH lines AS (SELECT o_orderkey AS k, {T0} + INTERVAL 1 HOUR AS ts, 'sku-' || l_partkey AS sku, sum(l_quantity::INT) AS q
     FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 10 <> 0 GROUP BY ALL),
p0 AS (SELECT *, TIMESTAMP '1995-01-01' + (p_partkey % 700) * INTERVAL 1 DAY AS t0, p_retailprice::DECIMAL(18,2) AS price FROM part),
prices AS (SELECT 'sku-' || p_partkey AS sku, t0 AS ts, price FROM p0
           UNION ALL SELECT 'sku-' || p_partkey, t0 + INTERVAL 400 DAY, price + 10 FROM p0 WHERE p_partkey % 3 = 0),
cats AS (SELECT 'sku-' || p_partkey AS sku, t0 AS ts, p_type AS category FROM p0
         UNION ALL SELECT 'sku-' || p_partkey, t0 + INTERVAL 500 DAY, p_type || ' moved' FROM p0 WHERE p_partkey % 7 = 0),
priced AS (SELECT l.*, coalesce(p.price, 0) * l.q AS v FROM lines l ASOF LEFT JOIN prices p ON l.sku = p.sku AND l.ts >= p.ts),
rows AS (SELECT l.k, l.ts, l.v, l.sku, c.category FROM priced l ASOF LEFT JOIN cats c ON l.sku = c.sku AND l.ts >= c.ts),
g(granularity) AS (VALUES ('hour'), ('day'), ('week'), ('month')),
b AS (SELECT granularity, date_trunc(granularity, ts)::TIMESTAMP AS bucket_start, {key} AS key, k, v FROM rows, g WHERE {key} IS NOT NULL)
SELECT {ID} || ':' || key AS id, granularity, bucket_start, {sku} AS sku, {category} AS category,
       sum(v)::DECIMAL(38,2) AS revenue_amount, 'USD' AS revenue_currency, count(DISTINCT k) AS order_count
FROM b GROUP BY granularity, bucket_start, key"""


def revenue_by_sku() -> str:
    return _priced("sku", "key", "NULL::VARCHAR")


def revenue_by_category() -> str:
    return _priced("category", "NULL::VARCHAR", "key")


def rating_edits() -> str:
    key = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))"
    return f"""
WITH e AS (SELECT l_orderkey, l_linenumber, {uuid_of(f"'Review:' || {key}")} AS id,
                  l_shipdate + l_linenumber * INTERVAL 1 HOUR AS ts, l_quantity::INT % 6 AS stars FROM lineitem),
last AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ts DESC, id DESC) AS rn FROM e),
g(granularity) AS (VALUES ('hour'), ('day'), ('week'), ('month'))
SELECT granularity, date_trunc(granularity, ts)::TIMESTAMP AS bucket_start, stars, count(*) AS reviews
FROM last, g WHERE rn = 1 GROUP BY ALL"""


def coupon_volume() -> str:
    return f"""
WITH c AS (SELECT o_orderkey AS k, {T0} + (o_orderkey % 50 - 20 + no) * INTERVAL 1 HOUR AS ts, 'c-' || o_orderkey % 10 AS code,
                  o_totalprice::DECIMAL(18,2) AS v
           FROM orders, (VALUES (0, 4), (1, 12)) x(no, every) WHERE o_orderkey % every = 0 AND o_orderkey % 10 <> 0),
g(granularity) AS (VALUES ('hour'), ('day'), ('week'), ('month'))
SELECT granularity, date_trunc(granularity, ts)::TIMESTAMP AS bucket_start, code,
       sum(v)::DECIMAL(38,2) AS amount, count(*) AS redemptions
FROM c, g GROUP BY ALL"""


def fulfillment_percentiles() -> str:
    legs = "(VALUES ('time_to_ship', 'OrderConfirmed', 'ShipmentDispatched'), ('time_to_deliver', 'ShipmentDispatched', 'OrderDelivered')) l(leg, a, z)"
    picked = " UNION ALL ".join(f"SELECT range, leg, {p} AS percent, quantile_disc(m, {p / 100}) AS micros FROM d GROUP BY ALL" for p in (50, 95, 99))
    return f"""
WITH ev AS ({ORDER_EVENTS}), ends AS (SELECT t, k, min(ts) AS ended FROM ev GROUP BY ALL),
one AS (SELECT leg, s.ts, date_diff('microsecond', s.ts, e.ended) AS m
        FROM {legs} JOIN ev s ON s.t = a JOIN ends e ON e.t = z AND e.k = s.k),
d AS (SELECT year(ts)::VARCHAR AS range, leg, m FROM one UNION ALL SELECT 'ever', leg, m FROM one)
{picked}"""


ORACLES = {
    "reconcile_store": reconcile_store,
    "tick_store": tick_store,
    "dlq_drain_store": dlq_drain_store,
    "serve_store": serve_store,
    "revenue_by_sku": revenue_by_sku,
    "revenue_by_category": revenue_by_category,
    "rating_edits": rating_edits,
    "coupon_volume": coupon_volume,
    "fulfillment_percentiles": fulfillment_percentiles,
    "ingest_envelope_parse": ingest_envelope_parse,
    "ingest_reject_split": ingest_reject_split,
    "ingest_outcomes": ingest_outcomes,
    "raw_upsert_latest": raw_upsert_latest,
    "event_scan_window": event_scan_window,
    "event_lookup": event_lookup,
    "schema_fingerprint": schema_fingerprint,
    "pii_classify": pii_classify,
    "pii_redaction_current": pii_redaction_current,
    "pii_redaction_records": pii_redaction_records,
    "pii_pending_scan": pii_pending_scan,
    "funnel_by_bucket": funnel_by_bucket,
    "funnel_range": funnel_range,
    "revenue_by_bucket": revenue_by_bucket,
    "revenue_series": revenue_series,
    "fulfillment_by_bucket": fulfillment_by_bucket,
    "fulfillment_range": fulfillment_range,
    "inventory_by_bucket": inventory_by_bucket,
    "inventory_range": inventory_range,
    "inventory_range_sku": inventory_range_sku,
    "catalog_by_bucket": catalog_by_bucket,
    "catalog_range": catalog_range,
    "promotions_by_bucket": promotions_by_bucket,
    "promotions_range": promotions_range,
    "user_growth_by_bucket": user_growth_by_bucket,
    "user_growth_range": user_growth_range,
    "reviews_by_bucket": reviews_by_bucket,
    "reviews_range": reviews_range,
    "admin_audit": admin_audit,
    "admin_audit_by_action": lambda: admin_audit("action_type = 'unknown'"),
    "notifications_by_bucket": notifications_by_bucket,
    "notifications_range": notifications_range,
    "dashboard_envelope": dashboard_envelope,
    "read_model_lookup": read_model_lookup,
    "dlq_pending_batch": dlq_pending_batch,
    "dlq_reprocess": dlq_reprocess,
    "reconcile_day": reconcile_day,
    "reconcile_ledger": reconcile_ledger,
    "last_completed_run": last_completed_run,
    "incremental_tick": incremental_tick,
    "stream_ingest": stream_ingest,
    "stream_projection": stream_projection,
    "replay_equality": replay_equality,
}
