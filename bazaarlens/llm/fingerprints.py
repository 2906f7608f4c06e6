"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every shingle hash below a fixed fraction of the hash range, so its size follows
the text's. Sketches of parts merge by union, and because both sides keep the same slice of the
hash range, containment is estimated without bias between very unequal documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.llm.common import column, slices

#: Words of a shingle, and the fraction of hashes that a sketch retains.
SHINGLE = 5
FRACTION = 1 / 4

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """A hash of each window of ``shingle`` words (A-Z lower-cased, split at ASCII white space).

    Fewer words are one shingle; no word gives none.
    """
    return shingled(word_digests(text), shingle)


def word_digests(text: str | None) -> np.ndarray:
    """64 bits of each word's hash (A-Z lower-cased, split at ASCII white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingled(each: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of shingles, from those of their words."""
    if not len(each):
        return np.zeros(0, np.uint64)
    n = max(1, len(each) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(each))):
        out = (out ^ each[i : i + n]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sketch(text: str | None, shingle: int = SHINGLE, fraction: float = FRACTION) -> np.ndarray:
    """The distinct 32-bit shingle hashes below ``fraction`` of their range, sorted."""
    hashes = (shingle_hashes(text, shingle) >> np.uint64(32)).astype(np.uint32)
    return np.unique(hashes[hashes < fraction * 2**32])


def encode(values: np.ndarray, text: str | None = None) -> bytes:
    """Four bytes for each hash. A text with words whose sketch is empty has a digest instead."""
    if not len(values) and text and (words := text.encode("utf-8", "surrogatepass").lower().split()):
        return b"\xff" + xxhash.xxh3_64_digest(b" ".join(words))
    return values.astype(">u4").tobytes()


def decode(sketch: bytes) -> np.ndarray:
    """The hashes; none for a digest."""
    return np.frombuffer(sketch if len(sketch) % 4 == 0 else b"", ">u4").astype(np.uint32)


def merge(*sketches: bytes) -> bytes:
    """The sketch of the documents together. Digests of documents without a hash fall away."""
    return encode(np.unique(np.concatenate([decode(s) for s in sketches]))) if sketches else b""


def _common(a: bytes, b: bytes) -> tuple[int, int, int]:
    x, y = decode(a), decode(b)
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets; without a hash on either side, equality."""
    n, m, both = _common(a, b)
    return both / (n + m - both) if n or m else float(a == b)


def containment(a: bytes, b: bytes) -> float:
    """Estimated share of a's shingles that b has; if a's sketch has no hash, equality."""
    n, _, both = _common(a, b)
    return both / n if n else float(a == b)


def fingerprint(text: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """The sketch of a text in bytes; empty for a null or empty text. Equal texts, equal sketches."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(sketch(t, shingle, fraction), t) for t in texts], dtype=object)

    return of(text)


def with_next(
    docs: DataFrame,
    carried: list[str],
    derived: dict[str, Column],
    id_column: str = "doc_id",
    rows_per_range: int = 4_000,
    most_ranges: int = 1 << 16,
) -> DataFrame:
    """``docs`` with the ``derived`` columns, and next_<c> for each carried or derived column c.

    The next row is the one that follows by descending id; after the last row comes the first.
    Rows with a null id come last; rows that share an id are ordered by the carried values, nulls
    first. A window over everything would be one task, so ids are dealt into ranges of about
    ``rows_per_range`` rows (bounds from a quantile sketch). Each range is a window of its own,
    closed by a copy of the next range's first row. Ranges only spread the work; the order is
    exact. What the driver takes is one bound and one id per range. Columns of ``docs`` other
    than the id and the carried ones are dropped.
    """
    own = docs.select(column(id_column).alias(id_column), *[column(c).alias(c) for c in carried])
    n, known = own.agg(F.count(F.lit(1)), F.count(id_column)).first()
    ranges = max(1, min(most_ranges, -(-n // rows_per_range)))
    cuts = [i / ranges for i in range(1, ranges)]
    found = own.select(id_column).dropna().approxQuantile(id_column, cuts, 0.2 / ranges) if known and cuts else []
    bounds = np.unique(np.array(found, np.float64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        # Range 0 has the largest ids, the last one the null ids.
        values = pd.to_numeric(ids, errors="coerce").to_numpy(np.float64)
        at = len(bounds) - np.searchsorted(bounds, values, "left")
        return pd.Series(np.where(np.isnan(values), len(bounds) + 1, at), dtype="int32")

    own = own.withColumn("range", range_of(F.col(id_column)))
    top = own.groupBy("range").agg(F.max(id_column).alias("first")).collect()
    if not top:
        return own.drop("range").withColumns(derived).select(
            "*", *[column(c).alias(f"next_{c}") for c in [*carried, *derived]]
        )
    spark = docs.sparkSession
    kind = own.schema[id_column].dataType.simpleString()
    firsts = F.broadcast(  # one row per range, at most `most_ranges`
        spark.createDataFrame([(r["range"], r["first"]) for r in top], f"at int, first {kind}")
    )
    heads = (
        own.join(firsts, (F.col("range") == F.col("at")) & F.col(id_column).eqNullSafe(F.col("first")))
        .groupBy("range")
        .agg(F.min(F.struct(*[column(c) for c in carried])).alias("head"))
    )
    present = sorted(r["range"] for r in top)
    before = F.broadcast(
        spark.createDataFrame([(r, present[i - 1]) for i, r in enumerate(present)], "range int, closes int")
    )
    closing = heads.join(before, "range").select(
        F.lit(None).cast(kind).alias(id_column),
        *[F.col(f"head.{c}").alias(c) for c in carried],
        F.col("closes").alias("range"),
        F.lit(1).alias("closing"),
    )
    rows = own.withColumn("closing", F.lit(0)).unionByName(closing).withColumns(derived)
    order = ["closing", F.desc_nulls_last(id_column), *[F.asc_nulls_first(column(c)) for c in carried]]
    w = Window.partitionBy("range").orderBy(*order)
    following = [F.lead(column(c)).over(w).alias(f"next_{c}") for c in [*carried, *derived]]
    return rows.select("*", *following).where("closing = 0").drop("range", "closing")


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """For docs (doc_id, text): fingerprints of each text and of its edited text, and likenesses.

    The edit replaces the last floor(n_chars/3) code points by the first as many (or all) of the
    next document by descending doc_id; after the last comes the first. Null texts are empty.
    A document that is alone is its own next. The texts are shuffled once.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, ["text"], {"sketch": fingerprint(F.col("text"))})
    n = F.length("text")

    names = ["doc_id", "n_chars", "edited_sha256", "sketch", "edited", "near_edited", "near_next"]

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sha, own, edit, next_own = [], b.column("sketch").to_pylist(), [], b.column("next_sketch")
            for t, m in zip(b.column("text").to_pylist(), b.column("more").to_pylist()):
                e = t[: len(t) - len(t) // 3] + m
                sha.append(hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest())
                edit.append(encode(sketch(e), e))
            near = [likeness(x, y) for x, y in zip(own, edit)]
            after = [likeness(x, y) for x, y in zip(own, next_own.to_pylist())]
            columns = [b.column("doc_id"), b.column("n_chars"), pa.array(sha, pa.string()), b.column("sketch")]
            columns += [pa.array(edit, pa.binary()), pa.array(near, pa.float64()), pa.array(after, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = texts.schema["doc_id"].dataType.simpleString()
    made = rows.select(
        "doc_id",
        "text",
        n.cast("long").alias("n_chars"),
        F.left("next_text", F.floor(n / 3).cast("int")).alias("more"),
        "sketch",
        "next_sketch",
    ).mapInArrow(
        edited,
        f"doc_id {kind}, n_chars long, edited_sha256 string, sketch binary, edited binary,"
        " near_edited double, near_next double",
    )
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("sketch")).alias("fingerprint"),
        F.lower(F.hex("edited")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
