"""Commerce events derived from an order/lineitem/part/... star schema.

The star schema holds no platform events, so each table's rows are read as the events that
would have produced them. Every table is scanned once however many event types come from it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.vocabulary import EVENT_TYPES_BY_DOMAIN, domain_of, topic_of

_ORDER_T0 = "o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR"
_ORDER_ID = """'"orderId":"o-', o_orderkey, '"'"""
_ORDER_USER = """',"userId":"u-', o_custkey, '"'"""
_EMAIL = """',"email":"u', user_id, '@example.com"'"""


@dataclass(frozen=True)
class Mapping:
    """One event type read from one table row: when it exists, when it happened, its payload."""

    event_type: str
    when: str
    occurred_at: str
    fields: str


@dataclass(frozen=True)
class TableEvents:
    table: str
    number: str
    partition_key: str
    mappings: tuple[Mapping, ...]


def _hours(expression: str) -> str:
    return f"({expression}) * INTERVAL '1' HOUR"


def _days(expression: str) -> str:
    return f"({expression}) * INTERVAL '1' DAY"


_PART_T0 = f"TIMESTAMP_NTZ '1995-01-01' + {_days('p_partkey % 700')}"
_PART_SKU = """'"sku":"sku-', p_partkey, '"'"""

TABLES = (
    TableEvents(
        "orders",
        "o_orderkey",
        "concat('o-', o_orderkey)",
        (
            Mapping("CartCheckedOut", "true", _ORDER_T0, f"{_ORDER_ID}, {_ORDER_USER}"),
            Mapping(
                "OrderCreated",
                "o_orderkey % 10 <> 0",
                f"{_ORDER_T0} + INTERVAL '1' HOUR",
                f"""{_ORDER_ID}, {_ORDER_USER}, ',"total":', cast(o_totalprice as decimal(18,2))""",
            ),
            Mapping(
                "OrderConfirmed",
                "o_orderkey % 10 > 1",
                f"{_ORDER_T0} + INTERVAL '2' HOUR",
                _ORDER_ID,
            ),
            Mapping(
                "PaymentCompleted",
                "o_orderkey % 10 > 2",
                f"{_ORDER_T0} + INTERVAL '3' HOUR",
                _ORDER_ID,
            ),
            Mapping(
                "PaymentFailed",
                "o_orderkey % 10 = 2",
                f"{_ORDER_T0} + INTERVAL '3' HOUR",
                f"""{_ORDER_ID}, ',"reason":"card_declined"'""",
            ),
            Mapping(
                "ShipmentDispatched",
                "o_orderkey % 10 > 2",
                f"{_ORDER_T0} + {_hours('2 + o_orderkey % 30')}",
                _ORDER_ID,
            ),
            Mapping(
                "OrderDelivered",
                "o_orderkey % 10 > 2 and o_orderstatus = 'F'",
                f"{_ORDER_T0} + {_hours('24 + o_orderkey % 72')}",
                _ORDER_ID,
            ),
        ),
    ),
    TableEvents(
        "part",
        "p_partkey",
        "concat('sku-', p_partkey)",
        (
            Mapping(
                "InventoryReplenished",
                "true",
                f"TIMESTAMP_NTZ '1998-01-01' + {_days('p_partkey % 365')}",
                f"""{_PART_SKU}, ',"qtyAdded":', p_size""",
            ),
            Mapping(
                "ProductCreated",
                "true",
                _PART_T0,
                f"""{_PART_SKU}, ',"price":', cast(p_retailprice as decimal(18,2))""",
            ),
            Mapping(
                "ProductPriceChanged",
                "p_partkey % 3 = 0",
                f"{_PART_T0} + INTERVAL '30' DAY",
                _PART_SKU,
            ),
            Mapping(
                "CategoryUpdated",
                "p_partkey % 7 = 0",
                f"{_PART_T0} + INTERVAL '60' DAY",
                """'"categoryId":"', p_type, '"'""",
            ),
        ),
    ),
    TableEvents(
        "customer",
        "c_custkey",
        "concat('u-', c_custkey)",
        (
            Mapping(
                "ReviewSubmitted",
                "true",
                f"TIMESTAMP_NTZ '1996-01-01' + {_days('c_custkey % 900')}",
                """'"userId":"u-', c_custkey, '","rating":',
                   if(c_custkey % 11 = 0, concat('"', c_custkey % 7, '"'),
                      cast(c_custkey % 7 as string))""",
            ),
        ),
    ),
    TableEvents(
        "supplier",
        "s_suppkey",
        "concat('a-', s_suppkey)",
        (
            Mapping(
                "AdminActionPerformed",
                "true",
                f"TIMESTAMP_NTZ '1997-01-01' + {_hours('s_suppkey % 300')}",
                """'"adminId":"a-', s_suppkey, '"',
                   if(s_suppkey % 5 = 0, '', concat(',"action":"catalog.', s_nationkey, '"'))""",
            ),
        ),
    ),
    TableEvents(
        "events",
        "event_id",
        "concat('u-', user_id)",
        (
            Mapping(
                "UserRegistered",
                "event_type = 'signup'",
                "ts",
                f"""'"userId":"u-', user_id, '"', {_EMAIL}""",
            ),
            Mapping("SessionCreated", "event_type = 'view'", "ts", """'"userId":"u-', user_id, '"'"""),
            Mapping(
                "UserProfileUpdated",
                "event_type = 'click' and event_id % 2 = 0",
                "ts",
                """'"userId":"u-', user_id, '"'""",
            ),
            Mapping(
                "UserAccountUpdated",
                "event_type = 'click' and event_id % 2 = 1",
                "ts",
                f"""'"userId":"u-', user_id, '"', {_EMAIL}, ',"displayName":"User ', user_id, '"'""",
            ),
            Mapping(
                "CouponRedeemed",
                "event_type = 'purchase' and event_id % 3 = 0",
                "ts",
                """'"code":"c-', event_id % 10, '"'""",
            ),
            Mapping(
                "PriceQuoteIssued",
                "event_type = 'purchase' and event_id % 3 <> 0",
                "ts",
                """'"quoteId":"q-', event_id, '","total":', cast(value as decimal(18,2))""",
            ),
            Mapping(
                "NotificationSent",
                "event_type = 'error' and event_id % 4 <> 0",
                "ts",
                """'"userId":"u-', user_id, '","channel":"',
                   element_at(array('email','sms','push'), cast(event_id % 3 + 1 as int)), '"'""",
            ),
            Mapping(
                "WishlistPriceAlertTriggered",
                "event_type = 'error' and event_id % 4 = 0",
                "ts",
                """'"userId":"u-', user_id, '"'""",
            ),
        ),
    ),
)

INVENTORY_BY_FLAG = {
    "N": "InventoryReserved",
    "A": "InventoryReleased",
    "R": "InventoryReservationFailed",
}
ERASED_AT = "2024-01-20"
COLUMNS = (
    "num",
    "partition_key",
    "event_id",
    "event_type",
    "publisher_service",
    "occurred_at",
    "payload",
    "tie",
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def splits(spark: SparkSession, sf_dir: str) -> int:
    """File splits of the tables that deliveries come from: a measure of their number."""
    return sum(read(spark, sf_dir, t).rdd.getNumPartitions() for t in (*[t.table for t in TABLES], "lineitem"))


def platform_events(
    spark: SparkSession, sf_dir: str, types: Iterable[str] | None = None
) -> DataFrame:
    """One row per event: event_id, event_type, publisher_service, partition_key, occurred_at,
    payload, ``num`` (the source row's number) and ``tie``. Only the tables behind ``types`` are read."""
    wanted = _wanted(types)
    branches = _mapped_tables(spark, sf_dir, wanted)
    flags = {f: t for f, t in INVENTORY_BY_FLAG.items() if t in wanted}
    if flags:
        first = read(spark, sf_dir, "lineitem").selectExpr(
            "*",
            """row_number() over (
                 partition by l_orderkey, l_linenumber
                 order by l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
                          l_shipdate, l_returnflag) as rn""",
        )
        rows = first.where("rn = 1").where(F.col("l_returnflag").isin(*flags))
        branches.append(_lineitem_events(rows))
    return _union(branches)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery of every event, in arrival order given by ``arrival_seq``.

    Every 29th event is two days late, every 13th is delivered again with one more field, and
    repeated lineitem keys are redeliveries of one event with changed content.
    """
    branches = _mapped_tables(spark, sf_dir, _wanted(None))
    branches.append(_lineitem_events(read(spark, sf_dir, "lineitem")))
    return (
        _union(branches)
        .selectExpr(
            *[c for c in COLUMNS if c != "payload"],
            """inline(array(
                 named_struct(
                   'ingested_at', occurred_at + INTERVAL 1 MINUTE
                     + if(num % 29 = 0, INTERVAL 2 DAYS, INTERVAL 0 DAYS),
                   'payload', payload,
                   'sent', true),
                 if(num % 13 = 0,
                   named_struct(
                     'ingested_at', occurred_at + INTERVAL 6 HOURS,
                     'payload', concat(left(payload, length(payload) - 1), ',"attempt":2}'),
                     'sent', true),
                   null)))""",
        )
        .where("sent")
        .drop("sent")
        .selectExpr(
            "*",
            """concat_ws('.', lpad(cast(unix_micros(ingested_at) as string), 17, '0'),
                         md5(concat_ws(':', event_type, payload))) as arrival_seq""",
            "cast(datediff(ingested_at, date '1970-01-01') as bigint) as arrival_chunk",
        )
    )


def wire_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries as broker messages, half in header style, half in body style, some broken.

    ``ingested_at`` is kept beside the wire columns so that callers can send them in waves.
    """
    domains = ", ".join(
        f"'{t}', '{topic_of(domain)}'" for domain, ts in EVENT_TYPES_BY_DOMAIN.items() for t in ts
    )
    return (
        arrivals(spark, sf_dir)
        .selectExpr(
            "*",
            "num % 2 = 0 as header_style",
            "if(num % 103 = 0, 'not-a-uuid', replace(event_id, '-', '')) as id_text",
            "date_format(occurred_at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") as at_text",
        )
        .selectExpr(
            f"element_at(map({domains}), event_type) as topic",
            "cast(num % 4 as int) as partition",
            "unix_seconds(ingested_at) * 1000000000 + tie as offset",
            "if(num % 89 <> 0, partition_key, null) as key",
            """case when header_style then payload else concat(
                 '{', if(num % 101 = 0, '', concat('"eventType":',
                          if(num % 107 = 0, '5', concat('"', event_type, '"')), ',')),
                 '"eventId":"', id_text, '","publisherService":"', publisher_service,
                 '","occurredAt":"', at_text, '",', substring(payload, 2)) end as text""",
            """case when not header_style then null
                 when num % 113 = 0 then array(
                   named_struct('key', 'eventType', 'value', cast(event_type as binary)))
                 else filter(array(
                   if(num % 101 = 0, null,
                     named_struct('key', 'eventType', 'value', cast(event_type as binary))),
                   named_struct('key', 'eventId', 'value', cast(id_text as binary)),
                   named_struct('key', 'publisherService',
                                'value', cast(publisher_service as binary)),
                   named_struct('key', 'occurredAt', 'value', cast(at_text as binary))),
                   h -> h is not null) end as headers""",
            "ingested_at",
            "num",
        )
        .selectExpr(
            "topic",
            "partition",
            "offset",
            "key",
            """cast(case when num % 97 = 0 then left(text, length(text) - 1)
                         when num % 109 = 0 then concat('[', text, ']')
                         when num % 127 = 0 then concat(text, ' tail')
                         else text end as binary) as value""",
            "headers",
            "ingested_at as timestamp",
            "ingested_at",
        )
    )


def priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as items, and the products' prices and categories over time: every
    third product's price rises by 10 after 400 days, every seventh moves to another category
    after 500."""
    lines = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "named_struct('sku', concat('sku-', l_partkey), 'qty', cast(l_quantity as int)) as item"
    )
    lines = lines.groupBy("l_orderkey").agg(F.to_json(F.collect_list("item")).alias("items"))
    created = f"cast({_ORDER_T0} + INTERVAL '1' HOUR as timestamp)"
    orders = (
        read(spark, sf_dir, "orders")
        .where("o_orderkey % 10 <> 0")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .selectExpr(
            _uuid("concat('OrderCreated:', o_orderkey)", "event_id"), "'OrderCreated' as event_type",
            f"{created} as occurred_at", f"""concat('{{', {_ORDER_ID}, ',"items":', items, '}}') as payload""",
        )
    )

    def version(kind: str, when: str, days: int, fields: str) -> DataFrame:
        at = f"cast({_PART_T0} + INTERVAL '{days}' DAY as timestamp)"
        return read(spark, sf_dir, "part").where(when).selectExpr(
            _uuid(f"concat('{kind}:{days}:', p_partkey)", "event_id"), f"'{kind}' as event_type", f"{at} as occurred_at",
            f"concat('{{', {_PART_SKU}, {fields}, '}}') as payload",
        )

    price = "cast(p_retailprice as decimal(18,2))"
    return _union(
        [
            orders,
            version("ProductCreated", "true", 0, f"""',"price":', {price}, ',"categoryId":"', p_type, '"'"""),
            version("ProductPriceChanged", "p_partkey % 3 = 0", 400, f"""',"newPrice":', {price} + 10"""),
            version("ProductCreated", "p_partkey % 7 = 0", 500, """',"categoryId":"', p_type, ' moved"'"""),
        ]
    )


def review_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a review, in three batches; lines that share a key are edits of one."""
    key = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int), l_shipdate)"
    return read(spark, sf_dir, "lineitem").selectExpr(
        _uuid(f"concat('Review:', {key})", "event_id"),
        "'ReviewSubmitted' as event_type",
        "cast(l_shipdate + l_linenumber * INTERVAL '1' HOUR as timestamp) as occurred_at",
        """concat('{"orderId":"o-', l_orderkey, '","sku":"line-', l_linenumber, '","rating":', cast(l_quantity as int) % 6, '}')
           as payload""",
        "cast(l_suppkey % 3 as int) as batch",
    )


def coupon_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and the coupons redeemed for every fourth (for some twice), in three batches: either
    side may come in an earlier batch and bucket than the other."""
    orders = read(spark, sf_dir, "orders")
    created = orders.where("o_orderkey % 10 <> 0").selectExpr(
        _uuid("concat('OrderCreated:', o_orderkey)", "event_id"), "'OrderCreated' as event_type",
        f"cast({_ORDER_T0} + INTERVAL '1' HOUR as timestamp) as occurred_at",
        f"""concat('{{', {_ORDER_ID}, ',"total":', cast(o_totalprice as decimal(18,2)), '}}') as payload""",
        "cast(floor(o_orderkey / 7) % 3 as int) as batch",
    )

    def redeemed(when: str, no: int) -> DataFrame:
        at = f"cast({_ORDER_T0} + {_hours(f'o_orderkey % 50 - 20 + {no}')} as timestamp)"
        return orders.where(when).selectExpr(
            _uuid(f"concat('CouponRedeemed:{no}:', o_orderkey)", "event_id"), "'CouponRedeemed' as event_type", f"{at} as occurred_at",
            f"""concat('{{', {_ORDER_ID}, ',"code":"c-', o_orderkey % 10, '"}}') as payload""",
            f"cast((o_orderkey + {no}) % 3 as int) as batch",
        )

    return _union([created, redeemed("o_orderkey % 4 = 0", 0), redeemed("o_orderkey % 12 = 0", 1)])


def reconciliation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger row per order date: most completed, every 10th failed, every 11th running."""
    return (
        read(spark, sf_dir, "orders")
        .selectExpr("to_date(o_orderdate) as run_date")
        .distinct()
        .selectExpr("*", "datediff(run_date, date '1970-01-01') as day_no")
        .selectExpr(
            _uuid("cast(run_date as string)", "run_id"),
            "run_date",
            """case when day_no % 10 = 0 then 'failed' when day_no % 11 = 0 then 'running'
                    else 'completed' end as status""",
            "cast(run_date as timestamp) + INTERVAL 26 HOURS as started_at",
            """if(day_no % 10 <> 0 and day_no % 11 <> 0,
                  cast(run_date as timestamp) + INTERVAL 28 HOURS, null) as completed_at""",
        )
    )


def _wanted(types: Iterable[str] | None) -> set[str]:
    if types is not None:
        return set(types)
    mapped = {m.event_type for t in TABLES for m in t.mappings}
    return mapped | set(INVENTORY_BY_FLAG.values()) | {"UserDataErased"}


def _uuid(text: str, name: str | None = None) -> str:
    """SQL for an md5 in uuid form."""
    groups = "^(.{8})(.{4})(.{4})(.{4})(.{12})$"
    sql = f"regexp_replace(md5({text}), '{groups}', '$1-$2-$3-$4-$5')"
    return f"{sql} as {name}" if name else sql


def _event(no: int, t: TableEvents, m: Mapping) -> str:
    return f"""if({m.when}, named_struct(
      'event_id', {_uuid(f"concat('{m.event_type}:', {t.number})")},
      'event_type', '{m.event_type}',
      'publisher_service', '{domain_of(m.event_type)}-service',
      'occurred_at', cast({m.occurred_at} as timestamp),
      'payload', concat('{{', {m.fields}, '}}'),
      'tie', cast(({t.number} % 100000000) * 10 + {no} as bigint)), null)"""


def _mapped_tables(spark: SparkSession, sf_dir: str, wanted: set[str]) -> list[DataFrame]:
    branches = []
    for t in TABLES:
        events = [
            _event(no, t, m) for no, m in enumerate(t.mappings) if m.event_type in wanted
        ]
        if events:
            rows = read(spark, sf_dir, t.table)
            if len(events) > 1:
                # One row becomes many events: dealt out, for a file may have a single row group, and
                # to so many parts that each makes about as many events as a split has rows.
                rows = rows.repartition((len(events) + 1) // 2 * rows.rdd.getNumPartitions(), t.number)
            branches.append(
                rows.selectExpr(
                    f"cast({t.number} as bigint) as num",
                    f"{t.partition_key} as partition_key",
                    f"inline(array({', '.join(events)}))",
                ).where("event_type is not null")
            )
    if "UserDataErased" in wanted:
        users = read(spark, sf_dir, "events").where("user_id % 50 = 0").select("user_id")
        branches.append(
            users.distinct().selectExpr(
                "cast(user_id as bigint) as num",
                "concat('u-', user_id) as partition_key",
                _uuid("concat('UserDataErased:', user_id)", "event_id"),
                "'UserDataErased' as event_type",
                "'user-service' as publisher_service",
                f"cast('{ERASED_AT}' as timestamp) as occurred_at",
                """concat('{"userId":"u-', user_id, '"}') as payload""",
                "cast(user_id % 100000000 * 10 as bigint) as tie",
            )
        )
    return branches


def _lineitem_events(rows: DataFrame) -> DataFrame:
    number = "(l_orderkey * 10 + l_linenumber)"
    by_flag = " ".join(f"when '{f}' then '{t}'" for f, t in INVENTORY_BY_FLAG.items())
    return rows.selectExpr(
        f"cast({number} as bigint) as num",
        "concat('o-', l_orderkey) as partition_key",
        _uuid("concat('InventoryMovement:', l_orderkey, '-', l_linenumber)", "event_id"),
        f"case l_returnflag {by_flag} end as event_type",
        "'inventory-service' as publisher_service",
        "cast(l_shipdate + l_linenumber * INTERVAL '1' HOUR as timestamp) as occurred_at",
        """concat('{"orderId":"o-', l_orderkey, '"',
                  if(l_partkey % 50 = 0, '', concat(',"sku":"sku-', l_partkey, '"')), '}')
           as payload""",
        f"""cast(({number} % 10000 * 10000 + l_partkey % 10000) * 10
                 + case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end as bigint) as tie""",
    )


def _union(branches: list[DataFrame]) -> DataFrame:
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out
