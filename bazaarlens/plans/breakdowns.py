"""Revenue by SKU and by category: order lines priced and classified as of their order.

A product's price comes from ``ProductCreated`` and ``ProductPriceChanged``, its category from
``ProductCreated`` (again, when it changes). A line counts at the price and in the category that
were valid when its order was created, so a later change moves no revenue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import payload as P
from bazaarlens.functions.buckets import document_id, in_every_bucket
from bazaarlens.functions.vocabulary import CURRENCY
from bazaarlens.operators.asof import as_of

_ITEMS = "struct<items: array<struct<sku: string, qty: int>>>"


def order_lines(events: DataFrame) -> DataFrame:
    """(order_id, sku, quantity, occurred_at): an order's items, those of one SKU together.

    Items without a SKU are left out; one without a quantity counts none.
    """
    items = F.from_json("payload", _ITEMS)["items"]
    order = P.as_string(P.parse_fields(F.col("payload"), "orderId")["orderId"])
    lines = events.where("event_type = 'OrderCreated'").select(
        F.coalesce(order, "event_id").alias("order_id"), "occurred_at", F.inline(items)
    )
    lines = lines.where("sku is not null").groupBy("order_id", "sku", "occurred_at")
    return lines.agg(F.coalesce(F.sum("qty"), F.lit(0)).alias("quantity"))


def _versions(events: DataFrame, fields: dict[str, str], read, name: str) -> DataFrame:
    """(sku, occurred_at, name) of the events that set a product's field."""
    chosen = None
    parsed = P.parse_fields(F.col("payload"), "sku", *fields.values())
    for event_type, f in fields.items():
        value = F.when((F.col("event_type") == event_type) & parsed[f].isNotNull(), read(parsed[f]))
        chosen = value if chosen is None else F.coalesce(chosen, value)
    rows = events.where(F.col("event_type").isin(*fields))
    return rows.select(P.as_string(parsed["sku"]).alias("sku"), "occurred_at", chosen.alias(name)).where(F.col(name).isNotNull())


def priced_lines(events: DataFrame) -> DataFrame:
    """Order lines with ``price`` and ``category`` as of their order; revenue 0 where no price was."""
    prices = _versions(events, {"ProductCreated": "price", "ProductPriceChanged": "newPrice"}, P.as_money, "price")
    categories = _versions(events, {"ProductCreated": "categoryId"}, P.as_string, "category")
    lines = as_of(order_lines(events), prices, "sku", "occurred_at", "price")
    lines = as_of(lines, categories, "sku", "occurred_at", "category")
    revenue = (F.coalesce("price", F.lit(0)) * F.col("quantity")).cast("decimal(38,6)")
    return lines.withColumn("revenue", revenue)


def _by(lines: DataFrame, key: Column, sku: Column, category: Column) -> DataFrame:
    """One row per bucket and key. Lines of one order and key come together first, so that orders
    are counted by adding."""
    orders = lines.where(key.isNotNull()).groupBy(key.alias("key"), "order_id", "occurred_at").agg(F.sum("revenue").alias("revenue"))
    hours = orders.groupBy("key", F.date_trunc("hour", "occurred_at").alias("hour_start")).agg(
        F.sum("revenue").alias("revenue"), F.count("*").alias("orders")
    )
    # A key has one row an hour at most, so its hours meet before they are spread over four buckets.
    rows = in_every_bucket(hours.repartition("key"), "hour_start").groupBy("granularity", "bucket_start", "key")
    rows = rows.agg(F.sum("revenue").alias("revenue_amount"), F.sum("orders").alias("order_count"))
    return rows.select(
        document_id(F.col("granularity"), F.col("bucket_start"), F.col("key")).alias("id"),
        "granularity", "bucket_start", sku.alias("sku"), category.alias("category"),
        "revenue_amount", F.lit(CURRENCY).alias("revenue_currency"), "order_count",
    )


def revenue_by_sku(lines: DataFrame) -> DataFrame:
    return _by(lines, F.col("sku"), F.col("key"), F.lit(None).cast("string"))


def revenue_by_category(lines: DataFrame) -> DataFrame:
    """Lines without a category are left out; the total rows have them."""
    return _by(lines, F.col("category"), F.lit(None).cast("string"), F.col("key"))
