import hashlib
import random

import numpy as np
import pytest

from bazaarlens.llm import fingerprints as P


def words(draw, n):
    return " ".join(f"w{draw.randrange(3000)}" for _ in range(n))


def exact(a, b):
    x, y = set(P.shingle_hashes(a).tolist()), set(P.shingle_hashes(b).tolist())
    return len(x & y) / len(x | y)


def test_likeness_and_containment_estimate_the_sets():
    draw = random.Random(1)
    errors = []
    for _ in range(60):
        base = words(draw, 2000).split()
        cut = draw.randrange(100, 1900)
        other = base[:cut] + words(draw, 2000 - cut).split()
        a, b = " ".join(base), " ".join(other)
        errors.append(P.likeness(P.encode(P.sketch(a), a), P.encode(P.sketch(b), b)) - exact(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.1
    long = words(draw, 40_000)
    part = " ".join(long.split()[500:3000])
    assert P.containment(P.encode(P.sketch(part)), P.encode(P.sketch(long))) == 1
    assert P.containment(P.encode(P.sketch(long)), P.encode(P.sketch(part))) == pytest.approx(2500 / 40_000, abs=0.02)


def test_sketch_keeps_every_hash_below_the_fraction_and_merges():
    draw = random.Random(2)
    a, b = words(draw, 900), words(draw, 700)
    every = {h >> 32 for h in P.shingle_hashes(a).tolist()}
    assert set(P.sketch(a).tolist()) == {h for h in every if h < P.FRACTION * 2**32}
    merged = P.merge(P.encode(P.sketch(a)), P.encode(P.sketch(b)))
    assert set(P.decode(merged).tolist()) == set(P.sketch(a).tolist()) | set(P.sketch(b).tolist())


@pytest.mark.parametrize("a,b,like", [("", "", 1), ("", "x", 0), ("x", "x", 1)])
def test_texts_without_a_hash(a, b, like):
    assert P.likeness(P.encode(P.sketch(a), a), P.encode(P.sketch(b), b)) == like


def brute(rows):
    """Each row's edited text; rows are (id, text), nulls last, then in order of text."""
    rows = [(i, t or "") for i, t in rows]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        cut = len(t) // 3
        out.append((i, len(t), t[: len(t) - cut] + after[:cut]))
    return out


@pytest.mark.parametrize("size", [1, 7, 150])
def test_edit_against_brute_force(spark, size, monkeypatch):
    draw = random.Random(size)
    rows = [(draw.choice([None, 5, *range(1000)]), draw.choice([None, "", "é日\n" * draw.randrange(9), words(draw, draw.randrange(300))])) for _ in range(size)]
    narrow = P.with_next
    monkeypatch.setattr(P, "with_next", lambda *a, **b: narrow(*a, **b, rows_per_range=10))
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, sketch string, range int")
    got = sorted(((r.doc_id or -1), r.n_chars, r.edited_sha256) for r in P.compare_with_edit(docs).collect())
    want = sorted(((i or -1), n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in brute(rows))
    assert got == want


def test_equal_texts_have_equal_fingerprints_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in P.compare_with_edit(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint != ""
    assert got[3].fingerprint == got[4].fingerprint == ""
    assert got[2].near_next == 1 and all(0 <= r.near_edited <= 1 for r in got.values())
    assert P.compare_with_edit(docs.limit(0)).count() == 0
