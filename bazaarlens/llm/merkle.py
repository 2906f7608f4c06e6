"""Merkle manifest of a dataset: a tree of hashes per group, and one over the groups' roots.

Each level takes runs of 16 consecutive nodes. Windows over one run give every node its siblings
(lag and lead columns at fixed offsets, masked by the node's slot and the run's length), and the
run's first row hashes the parent. No window is larger than a run, so a group that holds a third
of all rows is spread like any other; its order comes from a range sort and counts by partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.llm.common import column
from bazaarlens.session import written

RUN = 16


def digest(*parts: Column) -> Column:
    """H: lower-case hexadecimal sha256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as ``bytes:value``, null as ``-``, so that no two rows give the same text."""
    text = value.cast("string")
    size = F.octet_length(text).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), text))


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, changed: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its leaf, the way from it to the root, and both roots.

    ``fields`` are hashed in their order. ``changed`` gives other values for some of them; the leaf
    that these give is ``changed_leaf`` (null where ``changed`` is None). ``keep`` columns are
    carried along; these and the result's own must differ in name, other columns of ``docs`` are
    not read.

    Result: ``keep``..., leaf, changed_leaf, left, right (the digests before and after the node in
    its run, joined, from the leaf's level up to the root's), subroot, root.

    Order in a group: ``order`` (null first), then the leaf; wholly equal rows are equal leaves,
    whose order shows nowhere. Null is a group of its own, before all others. A level with a lone
    node in its run hashes it alone; a group of one row has its leaf for subroot. Null fields are
    ``-``, the empty string is ``0:``. An empty table gives no rows.
    """
    spark = docs.sparkSession
    as_is = digest(*[field(column(f)) for f in fields])
    other = F.lit(None).cast("string")
    if changed:
        same = reduce(lambda a, b: a & b, [column(f).eqNullSafe(c) for f, c in changed.items()])
        other = F.when(same, as_is).otherwise(digest(*[field(changed.get(f, column(f))) for f in fields]))
    # The group as text that sorts like it: null is empty, a value has a mark before it.
    named = F.coalesce(F.concat(F.lit("="), column(group).cast("string")), F.lit(""))
    leaves = docs.select(
        named.alias("_group"), column(order).alias("_order"), as_is.alias("digest"), other.alias("_changed"),
        F.struct(*[column(k).alias(f"k{i}") for i, k in enumerate(keep)], F.lit(0).alias("_")).alias("_kept"),
    )
    levels = grow(ranked(written(leaves, "leaves"), "_order", "digest"))
    tops = levels[-1].select("_group", F.col("digest").alias("subroot"))
    upper = grow(ranked(tops.select(F.lit("").alias("_group"), F.col("_group").alias("_order"), F.col("subroot").alias("digest")), "_order"))
    nothing = F.array().cast("array<string>")
    root = upper[-1].select("_group", "_pos", nothing.alias("left"), nothing.alias("right"), F.col("digest").alias("root"))
    over = descend(upper, root).select(F.col("_order").alias("_group"), F.lit(0).cast("long").alias("_pos"), "left", "right", "root", F.col("digest").alias("subroot"))
    rows = descend(levels, written(over, "subroots"))
    return rows.select(
        *[F.col(f"_kept.k{i}").alias(k) for i, k in enumerate(keep)],
        F.col("digest").alias("leaf"), F.col("_changed").alias("changed_leaf"), "left", "right", "subroot", "root",
    )


def proof() -> Column:
    """H of a manifest row's siblings, level by level up to the root, left to right."""
    return F.sha2(F.concat_ws("", F.transform(F.arrays_zip("left", "right"), lambda x: F.concat(x["left"], x["right"]))), 256)


def folded(leaf: Column) -> Column:
    """The root that a leaf gives with a manifest row's siblings."""
    return F.aggregate(F.arrays_zip("left", "right"), leaf, lambda h, x: digest(x["left"], h, x["right"]))


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """Add ``_pos``, the place in the group from 0, and ``_n``, the group's size; written.

    A range sort deals the rows out evenly, whatever the groups; a row's place is that in its
    partition, plus the group's rows in earlier partitions, from one summary row per partition
    and group.
    """
    spread = nodes.withColumn("_tie", F.monotonically_increasing_id())
    by = ["_group", *order, "_tie"]
    ordered = spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    ordered = written(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")
    whole = Window.partitionBy("_group")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    counts = counts.select(
        "_group", "_part", "_first",
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_c").over(whole).alias("_n"),
    )
    placed = ordered.join(written(counts, "counts"), ["_group", "_part"])
    placed = placed.withColumn("_pos", F.col("_at") - F.col("_first") + F.col("_before"))
    return written(placed.drop("_part", "_at", "_first", "_before"), "ranked")


def with_siblings(level: DataFrame) -> DataFrame:
    """Add ``_run``, ``_slot`` and the joined digests ``_before`` and ``_after`` the node in its run."""
    run, slot = F.floor(F.col("_pos") / RUN), F.col("_pos") % RUN
    size = F.least(F.lit(RUN), F.col("_n") - F.col("_run") * RUN)
    w = Window.partitionBy("_group", "_run").orderBy("_pos")
    none = F.lit("")
    before = [F.when(F.col("_slot") >= k, F.lag("digest", k).over(w)).otherwise(none) for k in range(RUN - 1, 0, -1)]
    after = [F.when(F.col("_slot") + k < size, F.lead("digest", k).over(w)).otherwise(none) for k in range(1, RUN)]
    return level.withColumns({"_run": run.cast("long"), "_slot": slot}).withColumns(
        {"_before": F.concat(*before), "_after": F.concat(*after)}
    )


def grow(leaves: DataFrame) -> list[DataFrame]:
    """The levels from the leaves to one node per group; a finished group's node goes up as it is."""
    levels = [leaves]
    most = leaves.agg(F.max("_n")).first()[0] or 0
    while most > 1:
        lone = F.col("_n") == 1
        parents = with_siblings(levels[-1].select("_group", "_pos", "_n", "digest")).where("_slot = 0").select(
            "_group",
            F.col("_run").alias("_pos"),
            F.ceil(F.col("_n") / RUN).cast("long").alias("_n"),
            F.when(lone, F.col("digest")).otherwise(digest(F.col("digest"), F.col("_after"))).alias("digest"),
        )
        levels.append(written(parents, f"level{len(levels)}"))
        most = -(-most // RUN)
    return levels


def descend(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first level's nodes with all that ``top`` says of their groups' last nodes, and their
    siblings of each level put before its ``left`` and ``right``."""
    if len(levels) == 1:
        return levels[0].join(top, ["_group", "_pos"])
    for level in levels[-2::-1]:
        over = top.withColumnsRenamed({"_pos": "_run", "left": "_left", "right": "_right"})
        lone = F.col("_n") == 1
        top = with_siblings(level).join(over, ["_group", "_run"]).withColumns(
            {
                side: F.when(lone, F.col(rest)).otherwise(F.concat(F.array(own), rest))
                for side, own, rest in (("left", "_before", "_left"), ("right", "_after", "_right"))
            }
        )
        top = top.drop("_run", "_slot", "_before", "_after", "_left", "_right")
        if level is not levels[0]:
            top = written(top.drop("_n", "digest"), "paths")
    return top
