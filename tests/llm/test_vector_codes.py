import hashlib
import math
import random

import numpy as np
import pytest

from bazaarlens.llm import vector_codes as V

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, size=64, rounds=2):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(r[1]) for r in rows) // parts))
    floats = [np.array(r[1], np.float32).astype(float).tolist() for r in rows]
    vectors = [[math.floor(256 * x) for x in v] + [0] * (parts * width - len(v)) for v in floats]
    cut = [[v[p * width : p * width + width] for p in range(parts)] for v in vectors]
    books = [[list(cut[i][p]) for i in range(min(size, len(cut)))] for p in range(parts)]

    def assign():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(v)]
            for v in cut
        ]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut[i][p] for i in range(len(cut)) if near[i][p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    near = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(e for e, _ in n) for n in near]
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return [(r[0], bytes(k for _, k in n).hex(), e, by_label[r[2]], sha) for r, n, e in zip(rows, near, error)]


def answer(spark, rows, kind=KIND, **more):
    return [tuple(r) for r in V.compress(spark.createDataFrame(rows, kind), "vec_id", "embedding", "label", **more).collect()]


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("dim,parts,size", [(64, 16, 64), (12, 4, 8), (5, 5, 16), (10, 4, 7), (33, 3, 256)])
def test_against_brute_force(spark, dim, parts, size):
    draw = random.Random(dim)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(dim)], draw.choice([1, 2, None])) for i in range(150)]
    rows += [(i, rows[0][1], 1) for i in range(150, 190)]  # copies
    draw.shuffle(rows)
    assert by_text(answer(spark, rows, parts=parts, size=size)) == by_text(brute(rows, parts, size))


def test_rows_left_out_ties_and_lengths(spark):
    rows = [
        (1, [0.5, -0.5], 1), (1, [0.5, 0.5], 1), (None, [1.0, 2.0, 3.0], None), (2, [], None), (3, None, 1),
        (4, [None, 1.0], 1), (5, [math.nan], 1), (6, [math.inf, 0.0], 1), (7, [-0.001], 2), (7, [-0.001], 2),
    ]
    for size in (1, 2, 64):
        assert by_text(answer(spark, rows, parts=2, size=size)) == by_text(brute(rows, 2, size))


def test_large_components_stay_exact(spark):
    rows = [(i, [3e6 * i, -1e7 + i, 0.1, 7.0], 1) for i in range(30)]
    assert by_text(answer(spark, rows, parts=2, size=4)) == by_text(brute(rows, 2, 4))
    huge = answer(spark, [(1, [1e38], 1), (2, [-1e38], 1), (3, [0.0], 2)], parts=1, size=1, rounds=0)
    assert [r[2] for r in sorted(huge)] == [0, None, None]


def test_empty_and_clashing_names(spark):
    assert answer(spark, []) == [] == answer(spark, [(1, None, 1)])
    kind = KIND + ", error string, `a.b` int, v int, _label int, code string"
    rows = [(i, [i / 10, 0.5], i % 2) for i in range(20)]
    assert by_text(answer(spark, [(*r, "e", 1, 2, 3, "c") for r in rows], kind, parts=2, size=4)) == by_text(brute(rows, 2, 4))


def test_string_ids_keep_their_type(spark):
    df = spark.createDataFrame([("b", [0.1], 1), ("a", [0.2], 1)], "vec_id string, embedding array<float>, label int")
    assert sorted(r.vec_id for r in V.compress(df, "vec_id", "embedding", "label", parts=1).collect()) == ["a", "b"]


@pytest.mark.parametrize("n", [1, 2, 4, 8, 16])
def test_transform_is_in_sequency_order_and_keeps_distances(n):
    x, y = np.random.default_rng(n).integers(-99, 99, (2, 5, n))
    a, b = V.transform(x), V.transform(y)
    assert (((a - b) ** 2).sum(1) == n * ((x - y) ** 2).sum(1)).all()
    changes = [(np.diff(np.sign(row)) != 0).sum() for row in V.transform(np.eye(n, dtype=np.int64)).T]
    assert changes == list(range(n))


def test_dropping_entries_early_keeps_the_answer():
    rng = np.random.default_rng(1)
    a, b = V.transform(rng.integers(-500, 500, (200, 16))), V.transform(rng.integers(-500, 500, (64, 16)))
    entry, least = V._nearest(a, b)
    whole = ((a[:, None] - b[None]) ** 2).sum(2)
    assert (entry == whole.argmin(1)).all() and (least == whole.min(1)).all()
