"""From deliveries to the current table: last arrival wins, erased users stay erased.

Work per task stays bounded even when one event id or one user holds much of the input: the
last version is an aggregate that combines before the shuffle, and ordered lookups run inside
(key, arrival chunk) windows linked through one summary row per key and chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import payload as P
from bazaarlens.functions.vocabulary import ERASURE_EVENT, REDACTION_PRINCIPAL
from bazaarlens.session import written

Keep = Callable[[DataFrame, str], DataFrame]

CONTENT = (
    "event_type",
    "publisher_service",
    "partition_key",
    "occurred_at",
    "payload",
    "schema_id",
    "schema_version_label",
    "contains_pii",
    "arrival_seq",
    "arrival_chunk",
)
LAST = (*CONTENT, "written_at", "written_by")
#: What of a delivery tells which rows an erasure redacts.
ERASING = ("event_id", "event_type", "payload", "contains_pii", "arrival_seq", "arrival_chunk", "ingested_at")


@dataclass(frozen=True)
class Resolved:
    """Current rows of the event ids involved, and one record per erasure delivery."""

    current: DataFrame
    redactions: DataFrame


def resolve(
    arrivals: DataFrame, prior: DataFrame | None = None, keep: Keep = written, dealt: bool = False
) -> Resolved:
    """Apply deliveries to the prior current rows (all rows they can touch, or none).

    Equal to upserting one delivery at a time in arrival order, with each erasure event
    blanking the pending personal rows of its user at its own place in that order.
    ``keep`` stores the small intermediates that are read more than once. ``dealt``: arrivals
    are a table dealt by event id, and there are no prior rows.
    """
    versions = as_versions(arrivals)
    if prior is not None:
        versions = versions.unionByName(prior_as_versions(prior))
    erasures, hits = _swept(arrivals, versions, keep)
    return Resolved(_apply(latest_versions(versions, dealt=dealt), hits), redaction_records(erasures, hits))


def _swept(arrivals: DataFrame, versions: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame | None]:
    """The erasures, and what they redact; none without an erasure."""
    erasures = keep(erasure_deliveries(arrivals), "erasures")
    if erasures.isEmpty():
        return erasures, None
    return erasures, keep(redaction_hits(versions, erasures, keep), "hits")


def redactions(arrivals: DataFrame, keep: Keep = written) -> DataFrame:
    """The records that ``resolve`` of these deliveries, without a prior table, has.

    Only the columns ``ERASING`` are read, so a log for this needs no others.
    """
    versions = arrivals.select(*ERASING, F.lit(None).cast("timestamp").alias("pii_redacted_at"))
    return redaction_records(*_swept(arrivals, versions, keep))


def as_versions(arrivals: DataFrame) -> DataFrame:
    return arrivals.select(
        "event_id",
        *CONTENT,
        F.col("ingested_at").alias("landed_at"),
        F.col("ingested_by").alias("landed_by"),
        F.col("ingested_at").alias("written_at"),
        F.col("ingested_by").alias("written_by"),
        F.lit(None).cast("timestamp").alias("pii_redacted_at"),
    )


def prior_as_versions(prior: DataFrame) -> DataFrame:
    return prior.select(
        "event_id",
        *CONTENT,
        F.col("ingested_at").alias("landed_at"),
        F.col("created_by").alias("landed_by"),
        F.col("updated_at").alias("written_at"),
        F.col("updated_by").alias("written_by"),
        "pii_redacted_at",
    )


def latest_versions(versions: DataFrame, columns: Sequence[str] = LAST, dealt: bool = False) -> DataFrame:
    """Per event id the last arrival's content, the first arrival's landing, any redaction kept.

    ``columns`` are those of the content that are returned. Versions ``dealt`` by event id need no
    shuffle; others go through one.
    """
    arrived = F.col("arrival_seq").isNotNull()
    last = F.max(F.when(arrived, F.struct("arrival_seq", *[c for c in columns if c != "arrival_seq"])))
    kept = F.max(
        F.when(
            F.col("pii_redacted_at").isNotNull(), F.struct("pii_redacted_at", "payload")
        )
    )
    # An id in uuid form goes through the shuffle as its 16 bytes.
    short = P.is_hyphenated(F.col("event_id"))
    packed = F.when(short, F.unhex(F.translate("event_id", "-", ""))).otherwise(F.col("event_id").cast("binary"))
    unpacked = F.when(F.col("short"), P.hyphenate(F.lower(F.hex("packed")))).otherwise(F.col("packed").cast("string"))
    key = ["event_id"] if dealt else [packed.alias("packed"), short.alias("short")]
    return (
        versions.groupBy(*key)
        .agg(
            last.alias("last"),
            F.min("landed_at").alias("ingested_at"),
            F.min(F.when(arrived, F.struct("arrival_seq", "landed_by")))["landed_by"].alias("created_by"),
            kept.alias("kept"),
        )
        .select(
            "event_id" if dealt else unpacked.alias("event_id"),
            *[F.col(f"last.{c}") for c in columns], "ingested_at", "created_by", "kept",
        )
    )


def named_user(payload: Column) -> Column:
    """The payload's user as text, whatever its JSON kind; of a repeated field the last counts."""
    return F.try_variant_get(P.parse_fields(payload, "userId")["userId"], "$", "string")


def erasure_deliveries(arrivals: DataFrame) -> DataFrame:
    """Accepted erasure events that name a user."""
    user = P.as_string(P.parse_fields(F.col("payload"), "userId")["userId"])
    return (
        arrivals.where(F.col("event_type") == ERASURE_EVENT)
        .select(
            user.alias("user_id"),
            F.col("event_id").alias("erasure_id"),
            F.col("arrival_seq"),
            F.col("arrival_chunk"),
            F.col("ingested_at").alias("erased_at"),
        )
        .where(F.trim("user_id") != "")
        .dropDuplicates(["erasure_id", "arrival_seq"])
    )


def redaction_hits(versions: DataFrame, erasures: DataFrame, keep: Keep) -> DataFrame:
    """Per event id the earliest erasure that found a personal, pending version of it current."""
    already = versions.where("pii_redacted_at is not null").select("event_id").distinct()
    named = P.computed_once(
        versions.where("contains_pii and pii_redacted_at is null")
        .withColumn("user_id", named_user(F.col("payload")))
        .select("event_id", "user_id", "payload", "arrival_seq", "arrival_chunk")
    )
    personal = (
        named.join(erasures.select("user_id").distinct(), "user_id", "left_semi")
        .join(already, "event_id", "left_anti")
    )
    personal = keep(personal, "personal")
    erasing = erasures.select(
        "user_id",
        "arrival_seq",
        "arrival_chunk",
        F.struct("arrival_seq", "erasure_id", "erased_at").alias("found"),
    )
    swept = (
        first_following(personal, erasing, "user_id", inclusive=True)
        .where("following is not null")
        .withColumnRenamed("following", "erasure")
    )
    swept = keep(swept, "swept")
    successors = versions.join(swept.select("event_id").distinct(), "event_id", "left_semi").select(
        "event_id", "arrival_seq", "arrival_chunk", F.struct("arrival_seq").alias("found")
    )
    still_current = F.col("following").isNull() | (
        F.col("erasure.arrival_seq") < F.col("following.arrival_seq")
    )
    successors = keep(successors, "successors")
    return (
        first_following(swept, successors, "event_id", inclusive=False)
        .where(still_current)
        .groupBy("event_id")
        .agg(F.min_by(F.struct("payload", "erasure"), F.col("erasure.arrival_seq")).alias("hit"))
        .select(
            "event_id",
            F.col("hit.payload").alias("hit_payload"),
            F.col("hit.erasure").alias("erasure"),
        )
    )


def first_following(left: DataFrame, right: DataFrame, key: str, *, inclusive: bool) -> DataFrame:
    """Add ``following``: the ``found`` value of the first right row of the same key that arrived
    after the left row (or with it, when inclusive).

    Both sides carry key, arrival_seq and arrival_chunk. Ordering inside a chunk is a window over
    that chunk only; what lies in later chunks is read from one summary row per (key, chunk).
    """
    found_type = right.schema["found"].dataType
    role_order = F.desc("role") if inclusive else F.asc("role")
    tagged = left.select(
        "*", F.lit(0).alias("role"), F.lit(None).cast(found_type).alias("found")
    ).unionByName(
        right.select(key, "arrival_seq", "arrival_chunk", F.lit(1).alias("role"), "found"),
        allowMissingColumns=True,
    )
    backwards = (
        Window.partitionBy(key, "arrival_chunk")
        .orderBy(F.desc("arrival_seq"), role_order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    near = tagged.withColumn("near", F.last("found", ignorenulls=True).over(backwards)).where(
        "role = 0"
    )
    later_chunks = (
        Window.partitionBy(key)
        .orderBy(F.desc("arrival_chunk"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    far = (
        tagged.groupBy(key, "arrival_chunk")
        .agg(F.min_by("found", F.when(F.col("role") == 1, F.col("arrival_seq"))).alias("first"))
        .select(
            key, "arrival_chunk", F.last("first", ignorenulls=True).over(later_chunks).alias("far")
        )
    )
    return near.join(far, [key, "arrival_chunk"], "left").select(
        *[near[c] for c in left.columns], F.coalesce("near", "far").alias("following")
    )


def _apply(latest: DataFrame, hits: DataFrame | None) -> DataFrame:
    if hits is None:
        return latest.select(
            "event_id",
            *[c for c in CONTENT if c != "payload"],
            F.coalesce("kept.payload", "payload").alias("payload"),
            F.col("kept.pii_redacted_at").alias("pii_redacted_at"),
            "ingested_at",
            "created_by",
            F.col("written_at").alias("updated_at"),
            F.col("written_by").alias("updated_by"),
        )
    merged = latest.join(hits, "event_id", "left")
    swept_last = F.col("erasure").isNotNull() & (
        F.col("erasure.arrival_seq") >= F.col("arrival_seq")
    )
    return merged.select(
        "event_id",
        *[c for c in CONTENT if c != "payload"],
        F.when(F.col("kept").isNotNull(), F.col("kept.payload"))
        .when(F.col("erasure").isNotNull(), P.redact(F.col("hit_payload")))
        .otherwise(F.col("payload"))
        .alias("payload"),
        F.coalesce("kept.pii_redacted_at", "erasure.erased_at").alias("pii_redacted_at"),
        "ingested_at",
        "created_by",
        F.when(swept_last, F.col("erasure.erased_at"))
        .otherwise(F.col("written_at"))
        .alias("updated_at"),
        F.when(swept_last, F.lit(REDACTION_PRINCIPAL))
        .otherwise(F.col("written_by"))
        .alias("updated_by"),
    )


def redaction_records(erasures: DataFrame, hits: DataFrame | None) -> DataFrame:
    """One record per erasure delivery, with the number of rows it redacted (0 included)."""
    if hits is None:
        return _records(erasures.withColumn("rows_redacted", F.lit(0)))
    counted = hits.groupBy(
        F.col("erasure.erasure_id").alias("erasure_id"),
        F.col("erasure.arrival_seq").alias("arrival_seq"),
    ).agg(F.count("*").alias("rows_redacted"))
    return _records(erasures.join(counted, ["erasure_id", "arrival_seq"], "left"))


def _records(counted: DataFrame) -> DataFrame:
    return counted.select(
        P.hyphenate(F.md5(F.concat_ws(":", "erasure_id", "arrival_seq"))).alias("redaction_id"),
        "user_id",
        F.col("erasure_id").alias("triggering_event_id"),
        F.coalesce("rows_redacted", F.lit(0)).cast("long").alias("rows_redacted"),
        F.col("erased_at").alias("redacted_at"),
        F.lit(REDACTION_PRINCIPAL).alias("created_by"),
    )


def with_extracted_fields(events: DataFrame) -> DataFrame:
    """The payload fields dashboards read, parsed once so that projections never parse JSON."""
    names = ("orderId", "userId", "sku", "channel", "action", "adminId", "rating", "total")
    fields = P.parse_fields(F.col("payload"), *names)
    return (
        events.withColumn("_f", fields)
        .withColumns(
            {
                "order_id": P.as_string(F.col("_f.orderId")),
                "user_id": F.try_variant_get(F.col("_f.userId"), "$", "string"),
                "sku": P.as_string(F.col("_f.sku")),
                "channel": P.as_string(F.col("_f.channel")),
                "action": P.as_string(F.col("_f.action")),
                "admin_id": P.as_string(F.col("_f.adminId")),
                "rating": P.as_int(F.col("_f.rating")),
                "total": P.as_money(F.col("_f.total")),
            }
        )
        .drop("_f")
    )


def event_period(unit: str, ts: Column) -> Column:
    """Partition value of the stored tables: the day, month or year of a timestamp."""
    return F.to_date(ts) if unit == "day" else F.trunc(ts, unit)
