"""Exact top-k by inner product: a Voronoi kNN join.

Inner product becomes distance by one more coordinate: a data vector x gets sqrt(M^2 - |x|^2),
M being the largest norm, a query gets 0. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest are
those with the largest product, and the triangle inequality holds. Queries and data are grouped
by their nearest pivot. From summaries of the groups each query group gets a bound on the
distance of its k-th neighbour, a data row is replicated only to query groups whose bound it can
meet, and each group is solved by itself (Lu et al., "Efficient Processing of k Nearest Neighbor
Joins using MapReduce"). Large groups are dealt into blocks on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.session import written

#: The most pivots, the queries for which there is one (a data row may have to go to every group of
#: queries), and the rows of a block of data or queries that are solved together.
PIVOTS = 1024
QUERIES_PER_PIVOT = 256
BLOCK = 8192
#: Distances are floats; comparisons of bounds leave this much room.
ROOM = 1e-6


def scaled(embedding, factor: int = 64):
    """Components floor(factor * x) as longs, or null if one is null, not a number or infinite."""
    embedding = F.col(embedding) if isinstance(embedding, str) else embedding
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(factor))))
    finite = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return F.when(embedding.isNotNull() & F.coalesce(finite, F.lit(False)), whole)


def _matrix(vectors: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    values = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _lift(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * a @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def top_products(data: DataFrame, queries: DataFrame, k: int = 20, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest products, ties to smaller vec_id.

    ``data`` and ``queries`` are (vec_id long, v array<long>). Rows with a null id or vector, and
    data of another length than most, take no part. A row is no candidate for the query with its
    own vec_id. Repeated data rows are repeated candidates, repeated queries are asked once, and
    queries that share an id but not a vector are each answered under that id. Products must stay below 2^53. Empty
    frames give an empty result; with fewer candidates than ``k`` all are returned.

    On the driver: pivots, one summary row per group with its k smallest distances, and one
    bound per query group, all bounded by ``PIVOTS`` and ``k``. ``pivots`` is their number if given.
    """
    spark = data.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    data, queries = (x.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").select("vec_id", "v") for x in (data, queries))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    sizes = data.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest"))
    shape = sizes.orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], result)
    d, n, largest = shape["d"], shape["n"], float(shape["largest"])
    data, queries = (x.where(F.size("v") == d) for x in (data, queries))
    queries = queries.distinct()
    pivots = pivots or max(8, min(PIVOTS, queries.count() // QUERIES_PER_PIVOT))
    # Distinct vectors in hash order: about `pivots` of them, whatever the order of rows.
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) / float(1 << 30)
    sample = data.where(share * n < 40 * pivots).select("v").distinct().orderBy(F.xxhash64("v")).limit(pivots)
    points = _lift(np.array([r.v for r in sample.collect()] or [data.first()["v"]], np.float64), largest)

    def assigned(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), d)
            x = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else _lift(x, largest)
            far = _distances(x, points)
            own = far.argmin(axis=1)
            columns = [pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(x)), own])]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "cell", "far"])

    schema = "vec_id long, v array<long>, cell int, far double"
    homes = written(data.mapInArrow(lambda bs: assigned(bs, False), schema), "knn-data")
    asks = written(queries.mapInArrow(lambda bs: assigned(bs, True), schema), "knn-queries")

    # Summaries: the k + 1 smallest distances of each data group (one may be the query's own),
    # the radius and size of each query group.
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"cell": pd.Series([], dtype="int32"), "far": pd.Series([], dtype="float64")})
        for b in batches:
            best = pd.concat([best, b]).sort_values("far", kind="stable").groupby("cell").head(k + 1)
        yield best

    few = homes.select("cell", "far").mapInPandas(nearest, "cell int, far double")
    ranked = few.withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).where(F.col("i") <= k + 1)
    data_side = ranked.groupBy("cell").agg(F.array_sort(F.collect_list("far")).alias("near")).collect()
    query_side = {r.cell: (r.radius, r.n) for r in asks.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    if not query_side:
        return spark.createDataFrame([], result)

    between = _distances(points, points)
    cells = np.array(sorted(query_side))
    radius = np.array([query_side[c][0] for c in cells])
    bound = np.full(len(cells), np.inf)
    for i, c in enumerate(cells):
        # Any query of the group reaches a row of group j within radius + |c, j| + the row's own.
        reach = np.sort(np.concatenate([np.array(r.near) + between[c, r.cell] + radius[i] for r in data_side]))
        if len(reach) > k:
            bound[i] = reach[k]
    reached = bound + radius + ROOM * (1 + np.sqrt(largest))

    def near(b: pa.RecordBatch) -> np.ndarray:
        """Which query groups each row of a batch may have to meet."""
        return _distances(_lift(_matrix(b.column("v"), d), largest), points[cells]) <= reached[None]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells), np.int64)
        for b in batches:
            total += near(b).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total)], ["cell", "n"])

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, rows in zip(cells.tolist(), near(b).T):
                sent = b.filter(pa.array(rows))
                to = pa.array(np.full(sent.num_rows, cell, np.int32))
                yield pa.RecordBatch.from_arrays([*sent.columns, to], [*b.schema.names, "cell"])

    sent = homes.select("vec_id", "v").mapInArrow(replicated, "vec_id long, v array<long>, cell int")
    load = homes.select("v").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    load = {r.cell: r.n for r in load.collect()}
    blocks = spark.createDataFrame(  # one row per query group
        [(int(c), max(1, -(-load.get(c, 0) // BLOCK)), max(1, -(-query_side[c][1] // BLOCK))) for c in cells.tolist()],
        "cell int, data_blocks int, query_blocks int",
    )
    blocks = F.broadcast(blocks)
    # Both sides are salted: each block of queries meets each block of data once.
    left = asks.join(blocks, "cell").select(
        "vec_id", "v", "cell",
        F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("query_blocks")).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("data_blocks") - 1)).alias("db"),
    )
    right = sent.join(blocks, "cell").select(
        "vec_id", "v", "cell",
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"),
        F.pmod(F.xxhash64("vec_id"), F.col("data_blocks")).cast("int").alias("db"),
    )

    fields = pa.schema([(c, pa.int64()) for c in ("query_id", "version", "vec_id", "score")])

    def solve(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and rows.num_rows:
            rows = rows.sort_by("vec_id")
            ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), d)
            names, q = asked.column("vec_id").to_numpy(), _matrix(asked.column("v"), d)
            versions = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) >> 1 for v in q])
            m = min(k, len(ids))
            for start in range(0, len(q), 256):
                products = q[start : start + 256] @ x.T
                products[names[start : start + 256, None] == ids[None]] = -np.inf
                least = -np.partition(-products, m - 1, axis=1)[:, m - 1]
                for i, (line, low) in enumerate(zip(products, least), start):
                    at = np.flatnonzero((line >= low) & (line > -np.inf))
                    at = at[np.lexsort((ids[at], -line[at]))][:k]
                    one = np.ones(len(at), np.int64)
                    out.append((names[i] * one, versions[i] * one, ids[at], line[at].astype(np.int64)))
        arrays = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.Table.from_arrays([pa.array(a) for a in arrays], schema=fields)

    local = (
        left.groupBy("cell", "qb", "db")
        .cogroup(right.groupBy("cell", "qb", "db"))
        .applyInArrow(solve, "query_id long, version long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
