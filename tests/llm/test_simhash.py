import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bazaarlens.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, version int"


def brute_fingerprint(text, shingle=3):
    import re

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    spans = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance):
    label = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if bin(a ^ b).count("1") <= distance:
                    label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize(
    "text", ["", "  \n", "One", "one two", "A b  c\td e f", "É ünï Ä 日本 \x0b x y", "a " * 5000]
)
def test_fingerprint(text):
    assert S.simhash64(text, 3) == brute_fingerprint(text)


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_links_connect_what_is_near(spark, distance):
    draw = random.Random(distance)
    values = [draw.getrandbits(64) for _ in range(40)]
    for v in values[:25]:  # neighbours around the limit, and chains of them
        for n in range(1, distance + 3):
            w = v
            for b in draw.sample(range(64), n):
                w ^= 1 << b
            values.append(w)
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    edges = S.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance).collect()
    index = {s: i for i, s in enumerate(signed)}
    for e in edges:
        assert bin(values[index[e.a]] ^ values[index[e.b]]).count("1") <= distance
    label = list(range(len(values)))
    for _ in values:
        for e in edges:
            i, j = index[e.a], index[e.b]
            label[i] = label[j] = min(label[i], label[j])
    assert label == brute_components(values, distance)


def test_dense_group_gives_a_forest(spark, monkeypatch):
    monkeypatch.setattr(S, "HOMES", 50)
    draw = random.Random(5)
    values = {0}
    while len(values) < 700:  # all in one half: one crowded anchor
        values.add(sum(1 << b for b in draw.sample(range(33, 51), 3)))
    rows = [(v,) for v in values]
    edges = S.links(spark.createDataFrame(rows, "fp long"), 3).collect()
    assert len(edges) < 40 * len(values) < len(values) ** 2 / 2
    seen, todo = set(), [0]
    near = {}
    for e in edges:
        near.setdefault(e.a, []).append(e.b)
        near.setdefault(e.b, []).append(e.a)
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += near.get(v, [])
    assert seen == values


def test_groups_with_nulls_copies_and_clashing_columns(spark):
    rows = [(4, "same text as another one", "x", 1), (2, "same  text AS another one", "y", 2), (9, None, "", 3),
            (7, "", None, 4), (None, "lonely words of nobody", "z", 5), (4, "same text as another one", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id) for r in S.near_groups(docs).collect())
    assert got == [(-1, None), (2, 2), (4, 2), (4, 2), (7, 7), (9, 7)]
    kept = S.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.version) for r in kept.collect()) == [(-1, 5), (2, 2), (7, 4)]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.near_groups(docs).count() == 0
    assert S.keep_one_of_each(docs).count() == 0


def test_against_brute_force_on_edited_texts(spark):
    draw = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(60):
        base = [draw.choice(words) for _ in range(draw.choice([1, 3, 60, 400]))]
        rows.append((3 * i, " ".join(base)))
        for k in (1, 2):
            edited = list(base)
            edited[draw.randrange(len(base))] = "edit"
            rows.append((3 * i + k, " ".join(edited)))
    got = {r.doc_id: r.component_id for r in S.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    label = brute_components([brute_fingerprint(t) for _, t in rows], 3)
    assert got == {d: rows[label[i]][0] for i, (d, _) in enumerate(rows)}
    assert S.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).select(F.hex("fingerprint")).count() == len(rows)
