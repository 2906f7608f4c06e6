import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import merkle as M

KIND = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, per node its siblings level by level as (left, right))."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for i, a in enumerate(at):
            run = runs[a // 16]
            paths[i].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
            at[i] = a // 16
        level = [H("".join(run)) for run in runs]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[s] = ([leaf_of(r) for r in members], members, *tree([leaf_of(r) for r in members]))
    root, above = tree([built[s][2] for s in names])
    out = []
    for s, up in zip(names, above):
        leaves, members, subroot, paths = built[s]
        for leaf, r, path in zip(leaves, members, paths):
            whole = path + up
            out.append((r[0], leaf, subroot, root, H("".join(a + b for a, b in whole)), whole))
    return out


def answer(spark, rows, kind=KIND, **more):
    docs = spark.createDataFrame(rows, kind)
    out = M.manifest(docs, FIELDS, "source", "doc_id", keep=("doc_id",), **more)
    return out.withColumn("proof", M.proof()).withColumn("back", M.folded(F.col("leaf"))).collect()


def check(spark, rows):
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in answer(spark, rows))
    assert got == sorted((str(a), *rest) for a, *rest, _ in brute(rows))


@pytest.mark.parametrize("sizes", [[17], [257], [300, 1, 16, 33], [2] * 40])
def test_against_brute_force(spark, sizes):
    draw = random.Random(len(sizes))
    rows = []
    for s, n in enumerate(sizes):
        for _ in range(n):
            text = "".join(draw.choices(string.ascii_letters + "é \n", k=draw.randint(0, 9)))
            rows.append((len(rows) * 7 % 1009, f"s{s}", draw.choice(["en", None]), draw.randint(0, 99), text))
    draw.shuffle(rows)
    check(spark, rows)


def test_nulls_repeats_ties_and_long_texts(spark):
    rows = [
        (None, None, None, None, None), (1, None, "", 0, ""), (1, "a", "en", 1, "x"), (1, "a", "en", 1, "y"),
        *[(5, "b", "en", 3, "same")] * 40, (None, "b", None, None, None), (2, "", "en", 1, "z"),
        (3, "é", "de", 10**6, "long " * 200_000),
    ]
    check(spark, rows)


def test_everything_folds_back_to_the_root(spark):
    rows = [(i, f"s{i % 3 if i % 4 else 0}", "en", i, f"text {i}") for i in range(400)]
    assert all(r.back == r.root for r in answer(spark, rows))


def test_a_changed_text_does_not_fold_back(spark):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(40)]
    changed = {"text": F.lower("text")}
    for r in answer(spark, rows, changed=changed):
        docs = leaf_of((r.doc_id, "s", "en", 1, "upper" if r.doc_id % 2 else "lower"))
        assert r.changed_leaf == docs and (r.changed_leaf == r.leaf) == (r.doc_id % 2 == 0)


def test_empty_table_and_clashing_names(spark):
    assert answer(spark, []) == []
    kind = KIND + ", digest string, _pos long, left string, `a.b` int, _group string"
    rows = [(i, "s", "en", 1, f"t{i}", "d", 3, "l", 1, "g") for i in range(20)]
    got = sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in answer(spark, rows, kind))
    assert got == sorted(x[:5] for x in brute([r[:5] for r in rows]))


def test_a_hot_group_is_dealt_out(spark):
    """No window or sort is keyed by the group alone, but for the counts by partition."""
    nodes = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("_group"),
        F.col("id").alias("_order"), F.sha2(F.col("id").cast("string"), 256).alias("digest"),
    )
    placed = M.ranked(nodes, "_order")
    assert placed.where("_group = 'hot'").agg(F.count_distinct("_pos"), F.max("_pos"), F.max("_n")).first()[:] == (2666, 2665, 2666)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = M.with_siblings(placed).where("_before > ''").groupBy(F.spark_partition_id()).agg(F.count("_before")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r[1] for r in parts) < 1500
