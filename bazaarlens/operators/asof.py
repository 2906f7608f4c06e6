"""As-of join: for each row the last row of the same key that was valid at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators.versions import first_following

#: Larger than any microsecond of a timestamp, for times that count backwards.
_LAST = 10**17


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, chunk: str = "month") -> DataFrame:
    """``left`` with ``value`` of the last ``right`` row of its ``key`` at or before its ``at``.

    Both have ``key`` and ``at`` (a timestamp). Of right rows of one key and instant the largest
    value counts. Null where no right row is early enough; null keys find nothing. Rows are ordered
    within a key's ``chunk`` of time only, and one summary row per key and chunk links these, so
    that neither a hot key nor one with many versions is ordered whole in one task.
    """

    def backwards(df: DataFrame) -> DataFrame:
        place = F.lit(_LAST) - F.unix_micros(at)
        group = F.lit(_LAST) - F.unix_micros(F.date_trunc(chunk, at))
        return df.withColumns(
            {"arrival_seq": F.lpad(place.cast("string"), 18, "0"), "arrival_chunk": F.lpad(group.cast("string"), 18, "0")}
        )

    versions = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.max(value).alias("found"))
    versions = backwards(versions).select(key, "arrival_seq", "arrival_chunk", F.struct("found").alias("found"))
    found = first_following(backwards(left), versions, key, inclusive=True)
    return found.withColumn(value, F.col("following.found")).drop("following", "arrival_seq", "arrival_chunk")
