"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame doesn't have yet (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def column(name: str) -> Column:
    """A column whose name may hold dots or other marks."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts pass ``most`` bytes, so that long texts don't pile up.

    A row is never cut; one row with a longer text is a batch of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = byte_lengths(batch.column(text))
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def byte_lengths(values: pa.Array) -> np.ndarray:
    """The length in bytes of each string, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Remembered(dict):
    """A function's values for the keys seen lately, at most twice ``most`` of them.

    Two generations: when the young one is full it becomes the old one, from which keys come back
    when they are met again. Keys longer than ``longest`` are worked out anew each time.
    """

    def __init__(self, make: Callable, most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def hex64(value: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def signature(df: DataFrame) -> tuple:
    """Row count and an order-free sum of row hashes, to see whether an iteration changed a frame."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(*[column(c) for c in df.columns]).cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]
