"""Broker message -> envelope columns and an accept/reject verdict, as column expressions.

A bad message never raises: it gets a ``failure_reason`` and goes to the dead letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import payload as P
from bazaarlens.functions.vocabulary import (
    EMPTY_UUID,
    ERASURE_EVENT,
    INGESTION_PRINCIPAL,
    RETRY_BUDGET,
    SCHEMA_VERSION_LABEL,
    UNKNOWN_EVENT_TYPE,
    UNKNOWN_PUBLISHER,
)

ENVELOPE_FIELDS = ("eventType", "eventId", "publisherService", "occurredAt")


def erasure_last() -> Column:
    """An instant after every broker time for erasures, null for other events."""
    return F.when(F.col("event_type") == ERASURE_EVENT, F.expr("timestamp '2200-01-01 00:00:00'"))


def _header(name: str) -> Column:
    """The last header of that name, as text."""
    names = F.col("headers")["key"]
    from_end = F.array_position(F.reverse(names), name).cast("int")
    return F.make_valid_utf8(F.get(F.col("headers")["value"], F.size(names) - from_end).cast("string"))


def message_id() -> Column:
    """An id that every redelivery of the same broker record shares."""
    return P.hyphenate(F.md5(F.concat_ws(":", "topic", "partition", "offset")))


def parse_messages(messages: DataFrame, as_of: Column) -> DataFrame:
    """Add envelope columns, ``failure_reason`` (null = accepted) and the dead-letter identity."""
    text = F.make_valid_utf8(F.col("value").cast("string"))
    staged = messages.select(
        "topic",
        "partition",
        "offset",
        "key",
        F.col("timestamp").alias("broker_at"),
        text.alias("payload"),
        *[_header(f).alias(f"h_{f}") for f in ENVELOPE_FIELDS],
        as_of.alias("as_of"),
    )
    consulted = {f: F.col(f"h_{f}").isNull() for f in ENVELOPE_FIELDS}
    any_consulted = F.lit(False)
    for f in ENVELOPE_FIELDS:
        any_consulted = any_consulted | consulted[f]
    # One pass over the text tells whether it is JSON and holds its fields.
    staged = P.computed_once(staged.withColumn("body", P.framed_variant(F.col("payload"))))
    staged = P.computed_once(
        staged.withColumn("json_ok", P.is_framed(F.col("body"), F.col("payload"))).withColumn(
            "is_object", F.col("json_ok") & F.ltrim("payload").startswith("{")
        )
    )
    # The body is only opened for fields that no header gives.
    field = {f: F.try_variant_get(F.col("body"), f"$[0].{f}", "variant") for f in ENVELOPE_FIELDS}
    opened = {f: consulted[f] & F.col("is_object") for f in ENVELOPE_FIELDS}
    staged = P.computed_once(
        staged.select(
            "topic",
            "partition",
            "offset",
            "key",
            "broker_at",
            "payload",
            "as_of",
            "json_ok",
            "is_object",
            *[f"h_{f}" for f in ENVELOPE_FIELDS],
            *[
                F.when(opened[f], P.kind(field[f])).alias(f"k_{f}")
                for f in ENVELOPE_FIELDS
            ],
            *[
                F.when(opened[f], F.try_variant_get(F.col("body"), f"$[0].{f}", "string")).alias(f"b_{f}")
                for f in ENVELOPE_FIELDS
            ],
        )
    )
    mistyped = any_consulted & F.col("json_ok") & ~F.col("is_object")
    for f in ENVELOPE_FIELDS:
        mistyped = mistyped | F.coalesce(~F.col(f"k_{f}").isin("STRING", "VOID"), F.lit(False))
    staged = staged.select(
        "topic",
        "partition",
        "offset",
        "key",
        "broker_at",
        "payload",
        "as_of",
        "json_ok",
        "is_object",
        mistyped.alias("mistyped"),
        *[
            F.coalesce(f"h_{f}", F.when(F.col(f"k_{f}") == "STRING", F.col(f"b_{f}"))).alias(
                f"r_{f}"
            )
            for f in ENVELOPE_FIELDS
        ],
    )
    staged = P.computed_once(staged).withColumns(
        {
            "event_id": F.when(F.col("r_eventId").isNull(), message_id()).otherwise(
                P.canonical_uuid(F.col("r_eventId"))
            ),
            "occurred_at": F.when(F.col("r_occurredAt").isNull(), F.col("as_of")).otherwise(
                P.iso_timestamp(F.col("r_occurredAt"))
            ),
            "publisher_service": F.coalesce("r_publisherService", F.lit(UNKNOWN_PUBLISHER)),
        }
    )
    staged = staged.withColumn("partition_key", F.coalesce("key", "event_id"))

    envelope_failure = (
        F.when(F.col("mistyped"), "mistyped_envelope_field")
        .when(F.col("r_eventType").isNull(), "missing_event_type")
        .when(F.col("event_id").isNull(), "invalid_event_id")
        .when(F.col("occurred_at").isNull(), "invalid_occurred_at")
    )
    content_failure = (
        F.when(~F.col("json_ok"), "invalid_json")
        .when(~F.col("is_object"), "payload_not_object")
        .when(blank_or_empty(F.col("r_eventType")), "blank_envelope_field")
    )
    envelope_ok = envelope_failure.isNull()
    parsed = staged.select(
        "topic",
        "partition",
        "offset",
        "broker_at",
        F.when(envelope_ok, F.col("event_id")).otherwise(message_id()).alias("event_id"),
        F.when(envelope_ok, F.col("r_eventType"))
        .otherwise(F.lit(UNKNOWN_EVENT_TYPE))
        .alias("event_type"),
        "publisher_service",
        "partition_key",
        "occurred_at",
        "payload",
        F.col("as_of").alias("ingested_at"),
        F.coalesce(envelope_failure, content_failure).alias("failure_reason"),
    )
    return P.computed_once(parsed)


def blank_or_empty(event_type: Column) -> Column:
    """Type, publisher or key without text, or the all-zero id."""
    blank = F.col("event_id") == EMPTY_UUID
    for c in (event_type, F.col("publisher_service"), F.col("partition_key")):
        blank = blank | (F.trim(c) == "")
    return blank


def describe_payload(versions: DataFrame, principal: str) -> DataFrame:
    """Shape id, shape label, PII flag and the writing job's principal."""
    return versions.withColumns(
        {
            "schema_id": P.shape_fingerprint(F.col("payload")),
            "schema_version_label": F.lit(SCHEMA_VERSION_LABEL),
            "contains_pii": P.contains_pii(F.col("event_type")),
            "ingested_by": F.lit(principal),
        }
    )


def sortable_micros(at: Column) -> Column:
    """Microseconds since 1970 as text that sorts like the time."""
    return F.lpad(F.unix_micros(at).cast("string"), 17, "0")


def arrival_order(df: DataFrame) -> DataFrame:
    """``arrival_seq``: processing time of the batch, then the broker's time, then its position.

    ``arrival_chunk`` is the batch and the hour of the broker's time, so that a replay of years as
    one batch has many chunks. A message without a broker time counts as of its batch's time, but
    an erasure without one as the last of its batch: what it came before can't be known, and must
    not stay clear.
    """
    batch = sortable_micros(F.col("ingested_at"))
    at = F.coalesce("broker_at", erasure_last(), "ingested_at")
    return df.withColumns(
        {
            "arrival_seq": F.concat_ws(
                ".",
                batch,
                sortable_micros(at),
                F.col("topic"),
                F.lpad(F.col("partition").cast("string"), 6, "0"),
                F.lpad(F.col("offset").cast("string"), 19, "0"),
            ),
            "arrival_chunk": F.concat_ws(
                ".", batch, sortable_micros(F.date_trunc("hour", at))
            ),
        }
    )


def accepted(parsed: DataFrame) -> DataFrame:
    """Accepted messages as event versions."""
    good = arrival_order(parsed.where("failure_reason is null"))
    return describe_payload(good, INGESTION_PRINCIPAL).drop(
        "topic", "partition", "offset", "broker_at", "failure_reason"
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """Rejected messages as pending dead letters, raw text kept."""
    return parsed.where("failure_reason is not null").select(
        P.hyphenate(
            F.md5(F.concat_ws(":", F.lit("dlq"), "topic", "partition", "offset"))
        ).alias("dlq_id"),
        "event_id",
        "event_type",
        "payload",
        "failure_reason",
        F.lit(RETRY_BUDGET).alias("retry_count"),
        F.col("ingested_at").alias("dlq_landed_at"),
        F.lit(None).cast("timestamp").alias("reprocessed_at"),
        F.lit(INGESTION_PRINCIPAL).alias("created_by"),
        F.lit(INGESTION_PRINCIPAL).alias("updated_by"),
    )
