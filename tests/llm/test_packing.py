import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from bazaarlens.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers(tokenizer):
    draw = random.Random(1)
    letters = "abcé ß\n\t\r'_,.0٣½²\x1c\xa0日ªº́\U0001f600"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(400)]
    texts += ["it's <|endoftext|> we'll", "", "  x", "x" * 500]
    own = P.Ids(PATH).encode(texts)
    for t, ids in zip(texts, own):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_hilbert_visits_neighbours():
    bits, cells = 2, np.array(np.meshgrid(*[range(4)] * 3)).reshape(3, -1).T
    place = P.hilbert(cells, bits)
    assert sorted(place) == list(range(64))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(rows, texts, tokenizer, length, end_id=1):
    """Every token is in one piece, sequences are gapless, and only powers of two are short."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    want = {}
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id]
        want.setdefault(i, []).append(ids)
    assert set(pieces) == set(want)
    for i, copies in want.items():
        if len(copies) > 1:
            continue
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = np.array(copies[0][at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(copies[0]), zlib.crc32(part))
            assert r.ids == part
            at += r.length
        assert at == len(copies[0])
    assert sum(r.length for r in rows) == sum(len(c) for cs in want.values() for c in cs)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == length or at < length and at & (at - 1) == 0


def test_packing(spark, tokenizer):
    draw = random.Random(2)
    texts = [(i, " ".join(f"word{draw.randrange(900)}" for _ in range(draw.choice([0, 1, 40, 900])))) for i in range(80)]
    texts += [(900, None), (901, "z " * 40_000), *[(1000 + i, "copy of a text") for i in range(300)], (None, "no id"), (7000, "twice"), (7000, "twice")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, place int, share int")
    check(P.pack(docs, PATH, length=256).collect(), texts, tokenizer, 256)


def test_copies_at_one_place_are_spread(spark):
    docs = spark.createDataFrame([(i, "the same text " * 30) for i in range(2000)], "doc_id long, text string")
    bounds = P._bounds(docs.withColumnRenamed("doc_id", "id"), PATH, 4)
    assert len({tuple(b) for b in bounds.tolist()}) == 3


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = P.pack(docs, PATH, with_ids=False)
    assert out.count() == 0 and "ids" not in out.columns


def test_neighbours_are_alike(spark):
    """Documents of two kinds, mixed by id, end up in few runs along the curve."""
    draw = random.Random(3)
    kinds = [["red", "rose", "garden", "leaf"], ["engine", "wheel", "road", "fuel"]]
    rows = [(i, " ".join(draw.choice(kinds[i % 2]) for _ in range(200))) for i in range(60)]
    own = P.Ids(PATH)
    place = P.curve_key(own.encode([t for _, t in rows]))
    order = [i % 2 for i in np.argsort(place)]
    assert sum(a != b for a, b in zip(order, order[1:])) <= 10
