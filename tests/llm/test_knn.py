import math
import random

import pytest

from bazaarlens.llm import knn as K

KIND = "vec_id long, v array<long>"


def brute(data, queries, k):
    out = set()
    for q, v in queries:
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in data if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)}
    return out


def answer(spark, data, queries, k, **more):
    found = K.top_products(spark.createDataFrame(data, KIND), spark.createDataFrame(queries, KIND), k, **more)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,n,d", [(1, 400, 3), (2, 90, 8), (3, 5, 2)])
def test_against_brute_force(spark, seed, n, d, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 60)
    draw = random.Random(seed)
    centres = [[draw.randint(-80, 80) for _ in range(d)] for _ in range(4)]
    data = [(i, [c + draw.randint(-4, 4) for c in draw.choice(centres)]) for i in range(n)]
    data += [(n + i, list(data[0][1])) for i in range(n // 2)]  # one very common vector: ties
    queries = data[:: max(1, n // 15)]
    assert answer(spark, data, queries, 7, pivots=9) == brute(data, queries, 7)


def test_pruning_is_used(spark):
    """Far groups are not replicated, and the result stays exact."""
    data = [(i, [1000 * (i % 2 * 2 - 1), i % 7, 0]) for i in range(300)]
    assert answer(spark, data, data[::50], 5, pivots=8) == brute(data, data[::50], 5)


def test_nulls_other_lengths_and_small_tables(spark):
    data = [(1, [1, 2]), (2, None), (None, [3, 3]), (3, [5, 5]), (4, [1, 2, 3]), (5, [])]
    assert answer(spark, data, data, 20) == {(1, 1, 3, 15), (3, 1, 1, 15)}
    assert answer(spark, [], data, 20) == set() == answer(spark, data, [], 20)
    assert answer(spark, [(1, [1])], [(1, [1])], 20) == set()


def test_scaled(spark):
    rows = [(1, [0.1, -0.1]), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.v for r in df.select("vec_id", K.scaled("embedding").alias("v")).collect()}
    assert got == {1: [6, -7], 2: None, 3: None, 4: None, 5: None, 6: []}
