import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import sentence_pieces as S
from bazaarlens.llm import token_counts as T
from bazaarlens.llm.common import Remembered

TEXTS = ["", " ", "Hello  world\n", "é½ 日本語 \U0001f600x", "a" * 700, " lead and trail ", "\t\x0b", "x \u2581y"]


def greedy(word, pieces):
    n, at = 0, 0
    while at < len(word):
        fit = next((k for k in range(len(word), at, -1) if word[at:k] in pieces), None)
        if fit is None:
            return 1
        n, at = n + 1, fit
    return n


@pytest.mark.parametrize("seed", range(6))
def test_longest_match_against_greedy(seed):
    draw = random.Random(seed)
    pieces = {bytes(draw.choice(b"ab c") for _ in range(draw.randint(1, 6))) for _ in range(40)}
    pieces |= {bytes([c]) for c in (b"ab c" if seed % 2 else b"a ")}
    automaton = T.LongestMatch(pieces)
    for _ in range(1500):
        word = bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 14)))
        assert automaton.match(b" " + word) == greedy(b" " + word, pieces)


def test_counts_of_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    import base64

    pieces = {base64.b64decode(line.split()[0]) for line in open(path, "rb")}
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])]
    docs = spark.createDataFrame(rows, "n_words long, text string")
    counted = docs.select("n_words", T.count_tokens(F.col("text"), path).alias("c")).collect()
    for r in counted:
        words = (rows[r.n_words][1] or "").encode().split()
        assert (r.c.n_words, r.c.n_tokens) == (len(words), sum(greedy(b" " + w, pieces) for w in words))


def test_remembered_keeps_two_generations():
    made = []
    memo = Remembered(lambda k: made.append(k) or len(k), most=3, longest=4)
    for key in ("a", "bb", "c", "d", "a", "a", "longer", "longer"):
        assert memo[key] == len(key)
    assert made == ["a", "bb", "c", "d", "longer", "longer"] and len(memo) <= 3


def best(text, pieces, worst):
    """Exhaustive dynamic programme over whole texts; ties to the earliest start."""
    score, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, len(text) + 1):
            if (p := pieces.get(text[i:j])) is not None:
                single = single or j == i + 1
                if score[i] + p[1] > score[j]:
                    score[j], back[j] = score[i] + p[1], (i, p[0])
        if not single and score[i] + worst > score[i + 1]:
            score[i + 1], back[i + 1] = score[i] + worst, (i, -1)
    out, at = [], len(text)
    while at:
        i, piece = back[at]
        out.append(piece if piece >= 0 else 0)
        at = i
    return out[::-1]


@pytest.mark.parametrize("seed", range(5))
def test_streaming_search_against_whole_text(seed):
    draw = random.Random(seed)
    texts = {"".join(draw.choice("abc") for _ in range(draw.randint(1, 5))) for _ in range(25)}
    pieces = [(p, i + 1, -draw.randint(1, 9) * 1.0) for i, p in enumerate(sorted(texts))]
    model = S.PieceModel(pieces, None, 0, add_prefix=False)
    table = {p: (i, s) for p, i, s in pieces}
    for n in (0, 1, 30, 2000):
        text = "".join(draw.choice("abcd") for _ in range(n))
        assert [i for part in model.search(text) for i in part] == best(text, table, model.worst)


def test_search_commits_early():
    model = S.PieceModel([("a", 1, -1.0), ("ab", 2, -1.5), ("b", 3, -1.0)], None, 0, add_prefix=False)
    parts = list(model.search("ab" * 5000))
    assert len(parts) > 500 and max(map(len, parts)) < 50


def test_against_the_library():
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1  # the library's own Viterbi search over the same pieces
    for p in proto.pieces:
        p.score = max(p.score, -40000.0)  # its sums are of single precision
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    pieces = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
    own = S.PieceModel(pieces, [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], 0)
    draw = random.Random(4)
    texts = TEXTS[:4] + ["".join(draw.choice(" aeinrst,é½日") for _ in range(120)) for _ in range(200)]
    for t in texts:
        assert own.encode(t) == library.encode(t)


def test_round_trip(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "ids long, text string")
    made = docs.withColumn("e", S.encode(F.col("text"), path)).withColumn("d", S.decode(F.col("e"), path))
    for r in made.collect():
        assert r.d == (r.text or "").replace(S.BLANK, " ") and (bool(r.e) == bool(r.text))
    pieces = S.load(path)
    found = {r["ids"]: r for r in S.round_trip(docs, path, id_column="ids").collect()}
    for i, t in enumerate([*TEXTS, None]):
        assert found[i].exact and found[i].n_ids == len(pieces.encode(t))
    assert S.round_trip(docs.limit(0), path, id_column="ids").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_texts_side_by_side_against_whole_text(seed, monkeypatch):
    draw = random.Random(seed)
    marks = "abc" + S.BLANK * (seed % 2)
    texts = {"".join(draw.choice(marks) for _ in range(draw.randint(1, 5))) for _ in range(25)}
    pieces = [(p, i + 1, -draw.randint(1, 9) * 1.0) for i, p in enumerate(sorted(texts))]
    model = S.PieceModel(pieces, None, 0, add_prefix=False)
    table = {p: (i, s) for p, i, s in pieces}
    monkeypatch.setattr(S, "REMEMBERED", 20)
    monkeypatch.setattr(S, "_BLOCK", 7)
    monkeypatch.setattr(S, "_AT_ONCE", 5)
    given = ["".join(draw.choice("abcd ") for _ in range(draw.choice([1, 5, 90, 400]))) for _ in range(30)]
    given[3], given[8] = None, ""
    ids, ends = model.encode_many(given)
    for text, start, end in zip(given, ends.tolist(), ends[1:].tolist()):
        assert ids[start:end].tolist() == best((text or "").replace(" ", S.BLANK), table, model.worst)
    assert len(model.known) <= 20 + 7


def test_short_stretches_need_no_search_of_their_own(monkeypatch):
    model = S.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for t in TEXTS if max(map(len, t.split(" "))) < 64]
    wanted = [[i for part in model.search(S.BLANK + t.replace(" ", S.BLANK)) for i in part] if t else [] for t in texts]
    monkeypatch.setattr(S.PieceModel, "search", lambda self, text: pytest.fail("one by one"))
    model._forget()
    ids, ends = model.encode_many(texts)
    assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:])] == wanted
    assert model.decode_many(ids, ends) == [t.replace(S.BLANK, " ") for t in texts]
