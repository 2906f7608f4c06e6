"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits are linked if at most ``distance`` bits differ. The bits are dealt into
parts, so few that two linked fingerprints differ by at most one bit in some part (two parts of
32 bits for a distance of 3). In each part the anchors are the words of a Hamming code, a perfect
covering code: every value is within covering radius 1 of exactly one anchor, its home. A
fingerprint is replicated to all anchors within covering radius + threshold = 1 + 1 = 2 (16 of
them), and at each anchor those at home are compared, on all 64 bits, with those replicated
there. If x and y differ by one bit in a part, y is within 2 of the home of x: no link is lost.

A code over all 64 bits with the whole threshold of 3 would need either thousands of replicas of
each fingerprint (small radius) or compare about a thousandth of all pairs (large radius); with
parts a fingerprint has 32 replicas and meets one 2^-22nd of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import column, fresh, slices
from bazaarlens.llm.components import connected_components
from bazaarlens.session import written

#: Fingerprints at home at one anchor that one task compares; an anchor with more is split.
HOMES = 4096
#: Up to so many comparisons a group lists its links; a larger one gives a spanning forest.
FEW = 256
_ONE = np.uint64(1)


# --- fingerprints ---------------------------------------------------------------------------


def simhash64(text: str | None, shingle: int) -> int:
    """Bits set in over half the hashes of the word shingles, repeats included; 0 for no word."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 65536):
        part = words[start : min(start + 65536, n) + shingle - 1]
        hashes = np.array(
            [digest(join(w), 42) for w in zip(*(part[i:] for i in range(shingle)))], "<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str, text_column: str, shingle: int = 3) -> DataFrame:
    """(id, version, fp) of every row: the text's hash and its fingerprint as longs.

    A null or empty text has fingerprint 0. Texts are read in slices of some megabytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values = np.array([simhash64(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            columns = [b.column("id"), b.column("version"), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "version", "fp"])

    text = column(text_column)
    rows = docs.select(column(id_column).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, version long, fp long")


# --- anchors --------------------------------------------------------------------------------


def parts_of(distance: int) -> int:
    """So many parts that one of them differs by one bit at most."""
    if not 1 <= distance <= 7:
        raise ValueError("distance must be from 1 to 7")
    return 1 if distance == 1 else 2 if distance <= 3 else 4


def anchors(fingerprints: DataFrame, distance: int) -> DataFrame:
    """(part, anchor, fp, home) for every fingerprint and anchor it is replicated to.

    Positions 1 to n-1 of a part of n bits carry the code, position 0 is left to the comparison.
    The syndrome s of a value is the exclusive or of its set positions: flipping s leads home,
    and flipping any i and i^s leads to an anchor at distance 2.
    """
    parts = parts_of(distance)
    bits = 64 // parts
    low = (1 << bits) - 1 if bits < 64 else -1
    frames = []
    for part in range(parts):
        value = F.shiftrightunsigned("fp", part * bits).bitwiseAND(F.lit(low).cast("long"))
        syndrome = F.lit(0)
        for j in range(bits.bit_length() - 1):
            mask = sum(1 << p for p in range(1, bits) if p >> j & 1)
            mask = mask - (1 << 64) if mask >> 63 else mask
            odd = F.bit_count(F.col("value").bitwiseAND(F.lit(mask).cast("long"))) % 2
            syndrome = syndrome + odd * (1 << j)
        flips = F.expr(
            f"filter(transform(sequence(0, {bits - 1}), i -> struct(i AS i, i ^ s AS j)),"
            " p -> p.i < p.j OR (s = 0 AND p.i = 0))"
        )
        frames.append(
            fingerprints.select("fp", value.alias("value"))
            .select("fp", "value", syndrome.cast("int").alias("s"))
            .select("fp", "value", F.explode(flips).alias("flip"))
            .select(
                F.lit(part).alias("part"),
                F.expr(
                    "(value ^ shiftleft(1L, flip.i) ^ CASE WHEN flip.i = flip.j THEN 0L "
                    "ELSE shiftleft(1L, flip.j) END) & -2L"
                ).alias("anchor"),
                "fp",
                # Position 0 isn't coded: the pair (0, s) flips one bit, or none if s is 0.
                (F.col("flip.i") == 0).alias("home"),
            )
        )
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


# --- comparison per anchor ------------------------------------------------------------------


class Forest:
    """Links between one anchor's home fingerprints and a stream of others, as a forest."""

    def __init__(self, distance: int):
        self.distance = distance
        self.homes = np.zeros(0, np.uint64)
        self.parent = np.zeros(0, np.int64)

    def root(self, i: int) -> int:
        up = self.parent
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, fps: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
        """Edges that join what was not joined before. All at home must come before the others."""
        n = len(self.homes)
        self.homes = np.concatenate([self.homes, fps[home]])
        self.parent = np.concatenate([self.parent, np.arange(n, len(self.homes))])
        edges = []
        for start in range(0, len(fps), 512):
            own = fps[start : start + 512]
            near = np.bitwise_count(own[:, None] ^ self.homes[None, :]) <= self.distance
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                close = np.flatnonzero(near[i])
                first = int(close[0])
                if self.homes[first] != own[i]:
                    edges.append((int(own[i]), int(self.homes[first])))
                top = self.root(first)
                for k in close[self.parent[close] != top].tolist():
                    other = self.root(k)
                    if other != top:
                        self.parent[other] = top
                        edges.append((int(self.homes[k]), int(own[i])))
                    self.parent[k] = top
        return edges


def _matcher(distance: int):
    """Edges (a, b) from rows sorted by group, those at home first."""

    def batch(edges: np.ndarray) -> pa.RecordBatch:
        signed = np.ascontiguousarray(edges.reshape(-1, 2).astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], ["a", "b"])

    def listed(fps, home, starts, sizes) -> np.ndarray:
        """All links of the small groups at once."""
        at = np.flatnonzero(home)
        group = np.searchsorted(starts, at, "right") - 1
        n = sizes[group]
        left = np.repeat(at, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group], n)
        a, b = fps[left], fps[right]
        # From either side the pair is found; the smaller one at home gives it.
        good = (a < b) & (np.bitwise_count(a ^ b) <= distance)
        return np.stack([b[good], a[good]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, open_key, carry = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("part", "anchor", "salt")], 1)
            fps = b.column("fp").to_numpy().view(np.uint64)
            home = b.column("home").to_numpy(zero_copy_only=False)
            if forest is not None:
                same = (keys == open_key).all(axis=1)
                n = len(same) if same.all() else int(np.argmin(same))
                if edges := forest.add(fps[:n], home[:n]):
                    yield batch(np.array(edges, np.uint64))
                if n == len(fps):
                    continue
                forest, keys, fps, home = None, keys[n:], fps[n:], home[n:]
            if carry is not None:
                keys, fps, home = (np.concatenate(x) for x in zip(carry, (keys, fps, home)))
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], new])
            last = int(starts[-1])
            carry = (keys[last:], fps[last:], home[last:])
            if last:
                yield from groups(fps[:last], home[:last], starts[:-1])
            if len(carry[1]) > 20_000:  # a large group streams on
                forest, open_key = Forest(distance), carry[0][0]
                if edges := forest.add(carry[1], carry[2]):
                    yield batch(np.array(edges, np.uint64))
                carry = None
        if carry is not None:
            yield from groups(carry[1], carry[2], np.zeros(1, np.int64))

    def groups(fps, home, starts) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, len(fps)))
        homes = np.add.reduceat(home.astype(np.int64), starts)
        large = homes * sizes > FEW
        for i in np.flatnonzero(large).tolist():
            own = slice(starts[i], starts[i] + sizes[i])
            if edges := Forest(distance).add(fps[own], home[own]):
                yield batch(np.array(edges, np.uint64))
        keep = np.repeat(~large & (homes > 0) & (sizes > 1), sizes)
        if keep.any():
            kept = ~large & (homes > 0) & (sizes > 1)
            new = np.concatenate([[0], np.cumsum(sizes[kept])[:-1]])
            yield batch(listed(fps[keep], home[keep], new, sizes[kept]))

    return run


def links(fingerprints: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp), enough to connect all that are linked.

    Groups of up to ``FEW`` comparisons list their links, larger ones give a spanning forest, so
    the rows stay in proportion to the fingerprints. Where more than ``HOMES`` fingerprints are
    at home at one anchor, they are dealt into salted shares, each compared with all that are
    replicated there, in a stream: no task holds more than its share.
    """
    spread = anchors(fingerprints, distance)
    crowded = (
        spread.where("home")
        .groupBy("part", "anchor")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > HOMES)
        .select("part", "anchor", F.ceil(F.col("n") / HOMES).cast("int").alias("shares"))
    )
    own = F.pmod(F.xxhash64("fp"), F.coalesce("shares", F.lit(1))).cast("int")
    dealt = (
        spread.join(crowded, ["part", "anchor"], "left")
        .select(
            "part",
            "anchor",
            "fp",
            F.when(F.col("home"), own).alias("own"),
            F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("salt"),
        )
        .select("part", "anchor", "salt", "fp", F.coalesce(F.col("own") == F.col("salt"), F.lit(False)).alias("home"))
    )
    return (
        dealt.repartition("part", "anchor", "salt")
        .sortWithinPartitions("part", "anchor", "salt", F.desc("home"))
        .mapInArrow(_matcher(distance), "a long, b long")
    )


# --- documents ------------------------------------------------------------------------------


def _grouped(docs: DataFrame, id_column: str, text_column: str, shingle: int, distance: int):
    """The stored (id, version, fp) of every row, and (fp, component, first) of every fingerprint."""
    rows = written(fingerprints(docs, id_column, text_column, shingle), "simhash")
    each = written(
        rows.groupBy("fp").agg(
            F.min("id").alias("id"),
            F.min(F.struct(F.isnull("id").alias("none"), "id", "version")).alias("first"),
        ),
        "fingerprints",
    )
    labels = connected_components(links(each.select("fp"), distance))
    labelled = each.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    groups = labelled.groupBy("root").agg(F.min("id").alias("component"), F.min("first").alias("first"))
    return rows, labelled.select("fp", "root").join(groups, "root").select("fp", "component", "first")


def near_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 3,
    distance: int = 3,
) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id among the documents reachable by links of at most
    ``distance`` differing bits, itself included. Null and empty texts have fingerprint zero and
    are linked like any other. Rows with a null id take part; a component of null ids only has a
    null component_id. Repeated rows are repeated in the result. Only ids and fingerprints are
    shuffled, and copies meet as one fingerprint.
    """
    rows, groups = _grouped(docs, id_column, text_column, shingle, distance)
    return rows.join(groups, "fp").select(
        F.col("id").alias(id_column),
        F.col("fp").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_one_of_each(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 3,
    distance: int = 3,
) -> DataFrame:
    """The documents, with all columns, that come first (by id, nulls last) in their group.

    Rows that repeat both id and text of the first one count as copies: one of them stays.
    """
    _, groups = _grouped(docs, id_column, text_column, shingle, distance)

    def keys(id: Column, version: Column) -> list[Column]:
        return [version, id.isNull(), F.coalesce(id.cast("string"), F.lit(""))]

    names = []
    for name in ("version", "none", "id"):
        names.append(fresh(docs, name))
        docs = docs.withColumn(names[-1], F.lit(None))
    # The rows are dealt out once, by plain columns, for the join and for the copies.
    first = groups.select("first.id", "first.version").distinct()
    first = written(first.select(*[k.alias(n) for k, n in zip(keys(F.col("id"), F.col("version")), names)]), "kept")
    own = docs.withColumns(dict(zip(names, keys(column(id_column), F.xxhash64(column(text_column))))))
    return own.join(first, names, "left_semi").dropDuplicates(names).drop(*names)
