"""Product codes of vectors: parts, integer codebooks, nearest entries by Walsh-Hadamard sums.

Parts and entries are zero-padded to a power of two and transformed by an integer Walsh-Hadamard
transform, which keeps squared distances up to that power as a factor. Distances are summed in
sequency order; an entry is dropped as soon as its sum passes a whole distance already known.
All arithmetic is on integers: int64 where its range provably suffices, else Python integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import column
from bazaarlens.session import written

ROWS = 2048


@dataclass(frozen=True)
class Codebooks:
    """``entries``: (parts, size, width) integers; at most ``size`` vectors in all, so small."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.reshape(-1)).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def fit(rows: DataFrame, vector: str, order: str, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks from all usable vectors, None where there are none.

    They start from the ``size`` rows of the smallest ``order`` (ties by vector, nulls last).
    Vectors are extended by zeros to the longest one's length, and that to a multiple of
    ``parts``. Each round's sums are those of every row, taken per task and then by Spark.
    """
    kept = rows.select(column(order).alias("at"), column(vector).cast("array<double>").alias("v"))
    kept = kept.where(usable(F.col("v")))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    first = kept.orderBy(F.asc_nulls_last("at"), "v").limit(size).collect()
    vectors = pa.array([r.v for r in first], pa.list_(pa.float64()))
    entries = np.ascontiguousarray(integers(vectors, parts, width, scale).transpose(1, 0, 2))
    for _ in range(rounds):
        entries = _moved(kept.select("v"), Codebooks(entries, scale))
    return Codebooks(entries, scale)


def _moved(kept: DataFrame, books: Codebooks) -> np.ndarray:
    """Each entry replaced by the floor of the mean of the parts next to it."""
    parts, size, width = books.entries.shape

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, size, width), object), np.zeros((parts, size), np.int64)
        for x in _blocks(batches, "v", parts, width, books.scale):
            codes, _ = nearest(x, books.entries)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                there, starts = np.unique(codes[order, p], return_index=True)
                total[p, there] += np.add.reduceat(x[order, p], starts, axis=0).astype(object)
                count[p] += np.bincount(codes[:, p], minlength=size)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()),
                *[pa.array([Decimal(int(s)) for s in total[p, e, i]], pa.decimal128(38, 0)) for i in range(width)],
            ],
            names=["part", "entry", "n", *[f"s{i}" for i in range(width)]],
        )

    schema = "part int, entry int, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(width))
    summed = kept.mapInArrow(sums, schema).groupBy("part", "entry")
    summed = summed.agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    entries = books.entries.astype(object)
    for r in summed.collect():
        entries[r.part, r.entry] = [int(s) // r.n for s in r[3:]]
    return _narrow(entries)


def encode(rows: DataFrame, vector: str, books: Codebooks, keep: list[str]) -> DataFrame:
    """Usable rows' ``keep`` columns, ``code`` (two hexadecimal digits per part) and ``error``, the
    squared distances to the entries summed over parts (null if that passes a long)."""
    parts, _, width = books.entries.shape
    kept = rows.select(
        column(vector).cast("array<double>").alias("_v"), *[column(k).alias(f"_k{i}") for i, k in enumerate(keep)]
    ).where(usable(F.col("_v")))
    kinds = ", ".join(f"_k{i} {kept.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x = integers(some.column(0), parts, width, books.scale)
                code, error = nearest(x, books.entries)
                code = [bytes(c).hex() for c in code.astype(np.uint8)]
                error = [int(e) if e < 1 << 63 else None for e in error.sum(axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[1:], pa.array(code, pa.string()), pa.array(error, pa.int64())],
                    names=[*some.schema.names[1:], "code", "error"],
                )

    coded = kept.mapInArrow(codes, f"{kinds}, code string, error long")
    return coded.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keep)})


def compress(rows: DataFrame, id: str, vector: str, label: str, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Per usable row: ``id``, code, error, label_error (errors summed over equal labels, nulls
    together) and codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are left out; repeated rows
    and ids stay. ``id`` and ``label`` may be null. No usable row gives an empty result. Other
    columns of ``rows`` are not read. Sizes to 256, for codes have two digits per part.
    """
    books = fit(rows, vector, id, parts, size, rounds, scale)
    if books is None:
        kind = rows.schema[id].dataType.simpleString()
        schema = f"`{id}` {kind}, code string, error long, label_error long, codebooks_sha256 string"
        return rows.sparkSession.createDataFrame([], schema)
    plain = rows.select(column(id).alias("_id"), column(label).alias("_label"), column(vector).alias("_vector"))
    coded = written(encode(plain, "_vector", books, ["_id", "_label"]), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")
    by_label = written(coded.groupBy(F.col("_label").alias("_of")).agg(total), "label-errors")
    joined = coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of")))
    return joined.select(
        F.col("_id").alias(id), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


# --- numpy, inside tasks -----------------------------------------------------------------------


def _blocks(batches: Iterable[pa.RecordBatch], name: str, parts: int, width: int, scale: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield integers(batch.column(name).slice(at, ROWS), parts, width, scale)


def integers(vectors: pa.ListArray, parts: int, width: int, scale: int) -> np.ndarray:
    """(rows, parts, width) integers floor(scale * x), zero-extended; int64 or Python integers.

    ``scale`` is a power of two, so the product of doubles is exact.
    """
    flat = np.asarray(vectors.flatten(), np.float64)
    sizes = np.diff(vectors.offsets.to_numpy(zero_copy_only=False))
    x = np.zeros((len(vectors), parts * width))
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[np.repeat(np.arange(len(vectors)), sizes), within] = np.floor(flat * scale)
    x = x.reshape(len(vectors), parts, width)
    if not x.size or np.abs(x).max() <= largest(width):
        return x.astype(np.int64)
    return np.vectorize(int, otypes=[object])(x)


def largest(width: int) -> int:
    """The component size to which int64 holds all sums.

    With n the padded width, transformed differences are at most 2 * n * size, their squares'
    sum 4 * n**3 * size**2 <= 2**54, and so the sum over 512 parts.
    """
    n = 1 << (width - 1).bit_length()
    return math.isqrt((1 << 52) // n**3)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if not x.size or abs(x).max() <= largest(x.shape[-1]) else x


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, zero-padded to a power of two, sequency order."""
    n = 1 << (x.shape[-1] - 1).bit_length()
    y = np.zeros((*x.shape[:-1], n), x.dtype)
    y[..., : x.shape[-1]] = x
    h = 1
    while h < n:
        pairs = y.reshape(*y.shape[:-1], n // (2 * h), 2, h)
        y = np.concatenate([pairs[..., :1, :] + pairs[..., 1:, :], pairs[..., :1, :] - pairs[..., 1:, :]], -2)
        y = y.reshape(*x.shape[:-1], n)
        h *= 2
    return y[..., sequency(n)]


def sequency(n: int) -> list[int]:
    """The rows of the Hadamard matrix by their number of sign changes: bit-reversed Gray codes."""
    bits = n.bit_length() - 1
    return [int(f"{i ^ (i >> 1):0{bits}b}"[::-1], 2) if bits else 0 for i in range(n)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and part the nearest entry (ties: the lower index) and its squared distance."""
    if x.dtype != entries.dtype:
        x, entries = x.astype(object), entries.astype(object)
    rows, parts, _ = x.shape
    codes, errors = np.zeros((rows, parts), np.int64), np.zeros((rows, parts), x.dtype)
    for p in range(parts if rows else 0):
        a, b = transform(x[:, p]), transform(entries[p])
        codes[:, p], scaled = _nearest(a, b)
        errors[:, p] = scaled // a.shape[-1]
    return codes, errors


def _nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one part, on transformed values, with distances times the padded width."""
    so_far = (a[:, :1] - b[None, :, 0]) ** 2
    guess = so_far.argmin(axis=1)
    known = ((a - b[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(so_far <= known[:, None])
    so_far = so_far[row, entry]
    for j in range(1, a.shape[1]):
        so_far = so_far + (a[row, j] - b[entry, j]) ** 2
        left = so_far <= known[row]
        row, entry, so_far = row[left], entry[left], so_far[left]
    # Rows and, in them, entries still ascend, so the first smallest sum of a row is its answer.
    starts = np.searchsorted(row, np.arange(len(a)))
    least = np.minimum.reduceat(so_far, starts)
    hit = np.nonzero(so_far == least[row])[0]
    first = hit[np.searchsorted(row[hit], np.arange(len(a)))]
    return entry[first], least
