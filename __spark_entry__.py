"""

Each query derives commerce events from the driver's tables (``sources/sample_tables.py``) and
runs the library over all of them.
"""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable
from datetime import datetime, timedelta
from hashlib import md5
from uuid import UUID

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_queries
from bazaarlens.functions import payload as P
from bazaarlens.functions.buckets import buckets_of_hours, hours_between, instant
from bazaarlens.operators import deadletters, ledger, scans
from bazaarlens.operators.envelope import accepted, describe_payload, parse_messages, rejected
from bazaarlens.operators.versions import (
    ERASING,
    as_versions,
    latest_versions,
    redactions,
    resolve,
    with_extracted_fields,
)
from bazaarlens.plans import breakdowns, corrections, durations, projection, serving
from bazaarlens.plans.dashboards import REGISTRY, project, rollup_dimensions, stamp
from bazaarlens.plans.ingest import ingest_batch
from bazaarlens.plans.projection import buckets_of_date, final_unless_open, hourly_until
from bazaarlens.plans.rollup import hourly_rollup
from bazaarlens.session import configure, shared_folder, written, written_by
from bazaarlens.sources import sample_tables as S
from bazaarlens.sources import wire
from bazaarlens.sources.store import EventStore
from bazaarlens.streaming.jobs import drain, start_ingest

Query = Callable[[SparkSession, str], DataFrame]
EVER_FROM, EVER_TO = datetime(1990, 1, 1), datetime(2030, 1, 1)
AS_OF = datetime(2025, 1, 1)
SECOND_WAVE = datetime(1998, 6, 1)
RUN_BY = "system:analytics-reconciliation-job"


# --- shaping for comparison -----------------------------------------------------------------


def comparable(df: DataFrame) -> DataFrame:
    """Timestamps without zone, money with two digits, doubles with six."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind.startswith("decimal"):
            c = c.cast("decimal(38,2)")
        elif kind == "double":
            c = F.round(c, 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def flat(name: str, rows: DataFrame) -> DataFrame:
    """Nested read-model fields as columns."""
    if name == "order_conversion_funnel" and "stages" in rows.columns:
        rest = [c for c in rows.columns if c != "stages"]
        return rows.select(
            *rest,
            *[F.col("stages")[i]["count"].alias(f"count_{i}") for i in range(5)],
            *[F.col("stages")[i]["drop_off_rate"].alias(f"rate_{i}") for i in range(1, 5)],
        )
    if name == "reviews_ratings":
        rest = [c for c in rows.columns if c != "rating_distribution"]
        return rows.select(
            *rest, *[F.col("rating_distribution")[str(s)].alias(f"stars_{s}") for s in range(1, 6)]
        )
    return rows


# --- read models over the whole tables --------------------------------------------------------

# The stretch of time each dashboard's events cover, from cheap table bounds.
SPANS = {
    "order_conversion_funnel": ("orders", "o_orderdate", 5),
    "revenue": ("orders", "o_orderdate", 5),
    "fulfillment_performance": ("orders", "o_orderdate", 5),
    "inventory_movement": ("lineitem", "l_shipdate", 1),
    "promotions_effectiveness": ("events", "ts", 1),
    "user_growth": ("events", "ts", 1),
    "notification_delivery": ("events", "ts", 1),
    "catalog_pricing": (datetime(1995, 1, 1), datetime(1997, 2, 1)),
    "reviews_ratings": (datetime(1996, 1, 1), datetime(1998, 7, 1)),
}


def bounds(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    span = SPANS[name]
    if len(span) == 2:
        return spark.range(1).select(
            instant(span[0]).alias("window_from"), instant(span[1]).alias("window_to")
        )
    table, column, days = span
    return S.read(spark, sf_dir, table).agg(
        F.min(column).cast("timestamp").alias("window_from"),
        (F.max(column).cast("timestamp") + F.expr(f"INTERVAL {days} DAYS")).alias("window_to"),
    )


def events_of(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    types = [t for n in names for t in REGISTRY[n].event_types]
    return with_extracted_fields(S.platform_events(spark, sf_dir, types))


def read_model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    d = REGISTRY[name]
    events = events_of(spark, sf_dir, name)
    if not d.bucketed:
        return project(name, None, events=events)
    buckets = buckets_of_hours(hours_between(bounds(spark, sf_dir, name)))
    hourly = hourly_rollup(events, rollup_dimensions()) if d.rollup else None
    return project(name, buckets, hourly=hourly, events=events, only_buckets=False)


def by_bucket(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return comparable(flat(name, read_model(spark, sf_dir, name)))

    return run


def ranged(name: str, granularity: str, shape=lambda df: df, **filters) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        rows = stamp(
            read_model(spark, sf_dir, name), instant(AS_OF), F.lit(True), F.lit(None)
        )
        served = serving.dashboard(
            name, rows, EVER_FROM, EVER_TO, granularity, as_of=instant(AS_OF), **filters
        )
        return comparable(shape(flat(name, served.body)))

    return run


def split_money(column: str, prefix: str):
    def shape(df: DataFrame) -> DataFrame:
        return df.select(
            *[c for c in df.columns if c != column],
            F.col(f"{column}.amount").alias(f"{prefix}_amount"),
            F.col(f"{column}.currency").alias(f"{prefix}_currency"),
        )

    return shape


def dashboard_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day buckets are final where the date's run completed; one envelope per month."""
    configure(spark)
    done = S.reconciliation_runs(spark, sf_dir).where("status = 'completed'").select("run_date")
    documents = (
        read_model(spark, sf_dir, "revenue")
        .where("granularity = 'day'")
        .withColumn("day", F.to_date("bucket_start"))
        .join(done, F.col("day") == F.col("run_date"), "left")
        .select(
            F.date_trunc("month", "bucket_start").alias("month"),
            F.col("run_date").isNull().alias("is_provisional"),
            F.col("run_date").alias("reconciled_through"),
        )
    )
    return comparable(serving.envelope(documents, instant(AS_OF), "month"))


def read_model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    rows = read_model(spark, sf_dir, "revenue")
    return comparable(scans.read_model_by_id(rows, "month:1997-03-01T00"))


# --- ingest ------------------------------------------------------------------------------------


def parsed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_messages(S.wire_messages(spark, sf_dir), instant(AS_OF))


def ingest_envelope_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    good = parsed_messages(spark, sf_dir).where("failure_reason is null")
    described = describe_payload(good, "ingest")
    return comparable(
        described.select(
            "topic", "partition", "offset", "event_id", "event_type", "publisher_service",
            "partition_key", "occurred_at", "schema_id", "contains_pii",
        )
    )


def ingest_reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return comparable(
        rejected(parsed_messages(spark, sf_dir)).select(
            "dlq_id", "event_id", "event_type", "payload", "failure_reason", "retry_count",
            "dlq_landed_at",
        )
    )


def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    outcome = F.coalesce("failure_reason", F.lit("accepted")).alias("outcome")
    return (
        parsed_messages(spark, sf_dir)
        .groupBy("topic", outcome)
        .agg(F.count("*").alias("messages"))
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_payload(S.arrivals(spark, sf_dir), "ingest")


def delivery_log(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The deliveries as a written log, dealt by event id: resolving reads it several times, a few
    columns each."""
    log = deliveries(spark, sf_dir).select(*columns or ["*"])
    return written_by(log, "event_id", "delivery-log", 2 * S.splits(spark, sf_dir))


def raw_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    content = (
        "event_type", "publisher_service", "partition_key", "occurred_at", "payload", "schema_id",
        "contains_pii",
    )
    log = delivery_log(spark, sf_dir)
    rows = latest_versions(as_versions(log), (*content, "written_at"), dealt=True)
    return comparable(
        rows.select("event_id", *content, "ingested_at", F.col("written_at").alias("updated_at"))
    )


def event_scan_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    events = S.platform_events(spark, sf_dir, ["OrderCreated", "OrderDelivered"])

    def summary(rows: DataFrame, label) -> DataFrame:
        return rows.groupBy(label.alias("event_type")).agg(
            F.count("*").alias("events"),
            F.min("occurred_at").alias("first_at"),
            F.max("occurred_at").alias("last_at"),
        )

    window = scans.events_in_window(
        events, "OrderCreated", datetime(1997, 1, 1), datetime(1998, 1, 1)
    )
    since = scans.events_since(events, "OrderDelivered", datetime(1999, 1, 1))
    return comparable(
        summary(window, F.col("event_type")).unionByName(
            summary(since, F.concat("event_type", F.lit(" since")))
        )
    )


def event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    event_id = str(UUID(md5(b"OrderCreated:7").hexdigest()))
    found = written(scans.event_by_id(deliveries(spark, sf_dir), event_id), "event-lookup")
    current = resolve(found).current
    return comparable(
        current.select("event_id", "event_type", "partition_key", "occurred_at", "payload")
    )


def schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return comparable(
        deliveries(spark, sf_dir)
        .groupBy("event_type", "schema_id", "schema_version_label")
        .agg(
            F.count("*").alias("deliveries"),
            F.min("ingested_at").alias("first_seen"),
            F.max("ingested_at").alias("last_seen"),
        )
    )


def pii_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return (
        S.arrivals(spark, sf_dir)
        .groupBy("event_type", P.contains_pii(F.col("event_type")).alias("contains_pii"))
        .agg(F.count("*").alias("deliveries"))
    )


def pii_redaction_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table. Redacted payloads are compared as text with fields in arrival order."""
    configure(spark)
    rows = resolve(delivery_log(spark, sf_dir), dealt=True).current
    return comparable(
        rows.select(
            "event_id", "event_type", "contains_pii", "occurred_at",
            F.col("payload").alias("payload_text"), "pii_redacted_at", "updated_at",
        )
    )


def pii_redaction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    log = written(deliveries(spark, sf_dir).select(*ERASING), "delivery-log")
    return comparable(redactions(log).drop("redaction_id"))


def pii_pending_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    rows = with_extracted_fields(resolve(delivery_log(spark, sf_dir), dealt=True).current)
    pending = scans.pending_personal_events(rows)
    return pending.groupBy("user_id").agg(F.count("*").alias("pending"))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects landed when their message was sent."""
    messages = S.wire_messages(spark, sf_dir)
    return rejected(parse_messages(messages, F.col("ingested_at")))


def dlq_pending_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    batch = deadletters.pending(dead_letters(spark, sf_dir), 50)
    return comparable(batch.select("dlq_id", "event_type", "failure_reason", "dlq_landed_at"))


def dlq_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dead letter: whether it came back, and as what."""
    configure(spark)
    letters = dead_letters(spark, sf_dir)
    rebuilt = deadletters.rebuild_envelopes(deadletters.pending(letters))
    fit = F.col("failure_reason").isNull()
    return comparable(
        rebuilt.select(
            "dlq_id",
            fit.alias("reprocessed"),
            "event_type",
            *[F.when(fit, F.col(c)).alias(c) for c in ("publisher_service", "partition_key", "occurred_at")],
            F.when(fit, P.shape_fingerprint(F.col("payload"))).alias("schema_id"),
        )
    )


# --- reconciliation ------------------------------------------------------------------------------


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reconciliation_runs(spark, sf_dir).select(
        "*",
        F.lit(RUN_BY).alias("created_by"),
        F.col("started_at").alias("updated_at"),
        F.lit(RUN_BY).alias("updated_by"),
    )


def reconcile_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ask to start a run for every date again: what happens to each."""
    configure(spark)
    runs = ledger_rows(spark, sf_dir)
    begun = ledger.begin(
        runs, runs.select("run_date"), instant(AS_OF), stale_after=timedelta(days=365 * 100)
    )
    return comparable(begun.select("run_date", "outcome", "status", "started_at"))


def last_completed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return scans.last_completed_run(S.reconciliation_runs(spark, sf_dir))


def last_order_date(spark: SparkSession, sf_dir: str):
    row = S.read(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate")).alias("d")).first()
    return row.d


def reconcile_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nightly recompute of the last order date's buckets."""
    configure(spark)
    day = last_order_date(spark, sf_dir)
    hourly = hourly_rollup(events_of(spark, sf_dir, "revenue"), rollup_dimensions())
    rows = project("revenue", buckets_of_date(spark, day), hourly=hourly)
    rows = stamp(rows, instant(AS_OF), final_unless_open(day), F.lit(day))
    return comparable(
        rows.select(
            "id", "granularity", "bucket_start", "revenue_amount", "order_count",
            "is_provisional", "reconciled_through",
        )
    )


def incremental_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets in progress at 10:30 on the last order date, up to that minute."""
    configure(spark)
    day = last_order_date(spark, sf_dir)
    as_of = datetime(day.year, day.month, day.day, 10, 30)
    hour = as_of.replace(minute=0)
    window = spark.range(1).select(
        instant(hour).alias("window_from"), instant(as_of).alias("window_to")
    )
    buckets = buckets_of_hours(hours_between(window))
    events = events_of(spark, sf_dir, "revenue")
    hourly = hourly_until(events, hourly_rollup(events, rollup_dimensions()), as_of)
    rows = project("revenue", buckets, hourly=hourly)
    return comparable(
        rows.select("id", "granularity", "bucket_start", "revenue_amount", "order_count")
    )


# --- streaming -----------------------------------------------------------------------------------


def run_stream(
    spark: SparkSession, sf_dir: str, *, with_dashboards: bool
) -> EventStore:
    """Send the messages in two waves through one checkpointed streaming query."""
    folder = shared_folder(spark, "stream")
    store = EventStore(spark, f"{folder}/store", period="month")
    messages = S.wire_messages(spark, sf_dir)
    second = F.col("ingested_at") >= instant(SECOND_WAVE)
    clocks = iter([datetime(2025, 1, 1), datetime(2025, 1, 2)])
    for wave in (~second, second):
        messages.where(wave).select(*wire.COLUMNS).write.mode("append").parquet(f"{folder}/topic")
        now = next(clocks)
        start_ingest(
            store,
            wire.file_stream(spark, f"{folder}/topic"),
            f"{folder}/checkpoint",
            source="wire",
            with_dashboards=with_dashboards,
            available_now=True,
            clock=lambda now=now: now,
        ).awaitTermination()
    return store


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    events = run_stream(spark, sf_dir, with_dashboards=False).events()
    dated = F.when(F.col("occurred_at") < instant(AS_OF), F.col("occurred_at"))
    return comparable(
        events.select(
            "event_id", "event_type", "publisher_service", "partition_key",
            dated.alias("occurred_at"), "schema_id",
        )
    )


def stream_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revenue read model as the stream left it, for buckets before the stream's own clock."""
    configure(spark)
    store = run_stream(spark, sf_dir, with_dashboards=True)
    rows = store.read_model("revenue").where(F.col("generated_at").isNotNull())
    started = F.col("bucket_start") < instant(datetime(2024, 12, 1))
    return comparable(
        rows.where(started).select(
            "id", "granularity", "bucket_start", "revenue_amount", "order_count", "is_provisional"
        )
    )


def replay_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivering everything twice changes nothing: rows in one result but not in the other."""
    configure(spark)
    once = delivery_log(spark, sf_dir)
    # Each row twice, without a union, which would lose that the log is dealt by event id.
    twice = once.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("time")).drop("time")
    return differing_rows(resolve(once, dealt=True).current, resolve(twice, dealt=True).current)


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The number of rows in one current table but not in the other; each has an event id once."""
    row = P.digest(*[F.col(c).cast("string") for c in sorted(a.columns)])
    # Rows without an id don't meet here, but in the balance.
    both = a.select("event_id", row.alias("a")).join(b.select("event_id", row.alias("b")), "event_id", "full_outer")
    sides = F.array(*[F.struct(F.col(c).alias("row"), F.lit(n).alias("side")) for c, n in (("a", 1), ("b", -1))])
    unequal = both.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.inline(sides)).where("row is not null")
    balance = unequal.groupBy("row").agg(F.sum("side").alias("balance"))
    return balance.agg(F.count_if(F.col("balance") != 0).alias("differing_rows"))


# --- stored jobs, over all messages ----------------------------------------------------------------


def filled_store(spark: SparkSession, sf_dir: str) -> tuple[EventStore, DataFrame]:
    """A store with every message ingested as one batch, and what that changed."""
    store = EventStore(spark, f"{shared_folder(spark, 'store')}/store", period="month")
    messages = S.wire_messages(spark, sf_dir).select(*wire.COLUMNS)
    return store, ingest_batch(store, messages, source="wire", batch_id=0, as_of=AS_OF)


def reconcile_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nightly run of the last order date on the stored tables: its buckets' revenue."""
    configure(spark)
    store, _ = filled_store(spark, sf_dir)
    day = last_order_date(spark, sf_dir)
    outcomes = [projection.reconcile(store, day, as_of=AS_OF) for _ in range(2)]
    rows = store.read_model("revenue")
    return comparable(
        rows.select(
            "id", "granularity", "bucket_start", "revenue_amount", "order_count", "is_provisional",
            "reconciled_through", F.lit(outcomes[0]).alias("first_run"), F.lit(outcomes[1]).alias("second_run"),
        )
    )


def tick_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tick at 10:30 of the last order date on the stored tables: the open buckets' funnel."""
    configure(spark)
    store, staged = filled_store(spark, sf_dir)
    projection.refresh_hourly(store, projection.periods_of(staged))
    day = last_order_date(spark, sf_dir)
    projection.recompute_current(store, datetime(day.year, day.month, day.day, 10, 30))
    rows = flat("order_conversion_funnel", store.read_model("order_conversion_funnel"))
    return comparable(rows.select("id", "granularity", "bucket_start", *[f"count_{i}" for i in range(5)], "is_provisional"))


def dlq_drain_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dead letter of the store after a drain: whether it came back, and when."""
    configure(spark)
    store, _ = filled_store(spark, sf_dir)
    drain(store, clock=lambda: datetime(2025, 1, 2))
    letters = store.dead_letters()
    return comparable(letters.select("dlq_id", "event_type", "failure_reason", "reprocessed_at", "updated_by"))


def serve_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten dashboards written from the stored events and served over all time by month."""
    configure(spark)
    store, staged = filled_store(spark, sf_dir)
    failed = projection.project_batch(store, staged, AS_OF)
    if failed:
        raise RuntimeError(failed)
    out = None
    for name in REGISTRY:
        body = flat(name, projection.serve(store, name, EVER_FROM, EVER_TO, "month", as_of=instant(AS_OF)).body)
        rows = measures(name, body).select(F.lit(name).alias("dashboard"), "measure", F.col("value").cast("double"))
        out = rows if out is None else out.unionByName(rows)
    return comparable(out)


def measures(name: str, body: DataFrame) -> DataFrame:
    """A dashboard's answer as (measure, value) rows."""

    def pairs(prefix, columns: dict) -> DataFrame:
        each = [F.struct(F.concat(prefix, F.lit(c)).alias("measure"), v.cast("double").alias("value")) for c, v in columns.items()]
        return body.select(F.inline(F.array(*each)))

    if name == "order_conversion_funnel":
        return pairs(F.concat("stage", F.lit(" ")), {"count": F.col("count")})
    if name == "revenue":
        at = F.concat(F.date_format("bucket_start", "yyyy-MM"), F.lit(" "))
        return pairs(at, {"revenue": F.col("revenue.amount"), "orders": F.col("order_count")})
    if name == "promotions_effectiveness":
        columns = ("coupons_redeemed", "quotes_issued", "redemption_rate")
        volume = {"volume": F.col("attributable_order_volume.amount")}
        return pairs(F.lit(""), {c: F.col(c) for c in columns} | volume)
    if name == "admin_audit":
        return body.groupBy(F.concat("action_type", F.lit(" "), "admin_id").alias("measure")).agg(F.count("*").alias("value"))
    if name == "notification_delivery":
        columns = ("sent", "price_alerts_triggered")
        return pairs(F.concat(F.coalesce("channel", F.lit("all")), F.lit(" ")), {c: F.col(c) for c in columns})
    return pairs(F.lit(""), {c: F.col(c) for c in body.columns})


# --- breakdowns, corrections, exact percentiles -----------------------------------------------------


def revenue_breakdown(rows) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return comparable(rows(breakdowns.priced_lines(S.priced_orders(spark, sf_dir))))

    return run


def rating_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of reviews and edits, and the first one once more."""
    configure(spark)
    rows = S.review_edits(spark, sf_dir)
    waves = [rows.where(F.col("batch") == n) for n in (2, 0, 1, 2)]
    changes = corrections.fold(waves, corrections.apply_ratings, corrections.RATING, "review")
    return comparable(corrections.rating_histogram(changes))


def coupon_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of coupons and orders, and the first one once more."""
    configure(spark)
    rows = S.coupon_orders(spark, sf_dir)
    waves = [rows.where(F.col("batch") == n) for n in (0, 1, 2, 0)]
    changes = corrections.fold(waves, corrections.apply_coupons, corrections.COUPON_SIDE, None)
    return comparable(corrections.coupon_volume(changes))


def fulfillment_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of every year, and of all time, from stored histograms."""
    configure(spark)
    facts = written(durations.duration_facts(events_of(spark, sf_dir, "fulfillment_performance")), "durations")
    stored = durations.Durations(facts, written(durations.histogram(facts), "histogram"))
    years = spark.range(EVER_FROM.year, EVER_TO.year).selectExpr(
        "cast(id as string) as range", "make_date(id, 1, 1) as date_from", "make_date(id + 1, 1, 1) as date_to"
    )
    ever = spark.range(1).select(
        F.lit("ever").alias("range"), F.lit(EVER_FROM.date()).alias("date_from"), F.lit(EVER_TO.date()).alias("date_to")
    )
    return durations.range_percentiles(stored, years.unionByName(ever), (50, 95, 99))


# --- registry ------------------------------------------------------------------------------------

# The training-data operators and their pipeline are optional: without them the rest works.
OPTIONAL = ("bazaarlens.llm.queries", "corpus_pipeline")


def optional_modules() -> list:
    found = []
    for name in OPTIONAL:
        try:
            found.append(importlib.import_module(name))
        except ModuleNotFoundError as missing:
            # The operators are gone, or something they need is; the library's own errors show.
            if missing.name not in (name, "bazaarlens.llm") and missing.name.startswith("bazaarlens"):
                raise
    return found


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the daily revenue series at sf0.001."""
    return queries()["revenue_series"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {
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
        "funnel_by_bucket": by_bucket("order_conversion_funnel"),
        "funnel_range": ranged("order_conversion_funnel", "week"),
        "revenue_by_bucket": by_bucket("revenue"),
        "revenue_series": ranged("revenue", "day", split_money("revenue", "revenue")),
        "fulfillment_by_bucket": by_bucket("fulfillment_performance"),
        "fulfillment_range": ranged("fulfillment_performance", "week"),
        "inventory_by_bucket": by_bucket("inventory_movement"),
        "inventory_range": ranged("inventory_movement", "day"),
        "inventory_range_sku": ranged("inventory_movement", "day", sku="sku-7"),
        "catalog_by_bucket": by_bucket("catalog_pricing"),
        "catalog_range": ranged("catalog_pricing", "month"),
        "promotions_by_bucket": by_bucket("promotions_effectiveness"),
        "promotions_range": ranged(
            "promotions_effectiveness", "day", split_money("attributable_order_volume", "volume")
        ),
        "user_growth_by_bucket": by_bucket("user_growth"),
        "user_growth_range": ranged("user_growth", "day"),
        "reviews_by_bucket": by_bucket("reviews_ratings"),
        "reviews_range": ranged("reviews_ratings", "month"),
        "admin_audit": ranged("admin_audit", "day"),
        "admin_audit_by_action": ranged("admin_audit", "day", action_type="unknown"),
        "notifications_by_bucket": by_bucket("notification_delivery"),
        "notifications_range": ranged("notification_delivery", "day"),
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
        "reconcile_store": reconcile_store,
        "tick_store": tick_store,
        "dlq_drain_store": dlq_drain_store,
        "serve_store": serve_store,
        "revenue_by_sku": revenue_breakdown(breakdowns.revenue_by_sku),
        "revenue_by_category": revenue_breakdown(breakdowns.revenue_by_category),
        "rating_edits": rating_edits,
        "coupon_volume": coupon_volume,
        "fulfillment_percentiles": fulfillment_percentiles,
    } | {k: f for m in optional_modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    own = {name: build() for name, build in oracle_queries.ORACLES.items()}
    return own | {k: sql for m in optional_modules() for k, sql in m.ORACLES.items()}
