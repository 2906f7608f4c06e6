import random

import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import language as L

ALPHABETS = {"aa": "abcdefg", "bb": "nopqrst", "cc": "äöüvwxy"}


def text(draw, letters, n):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    return [(lang, text(draw, letters, draw.choice([1, 5, 60, 2000]))) for lang, letters in ALPHABETS.items() for _ in range(60)]


@pytest.fixture(scope="module")
def model(spark, rows):
    return L.fit(spark.createDataFrame([*rows, (None, "abc"), ("aa", None), ("bb", "12 !")], "lang string, text string"))


def test_held_out_accuracy(model):
    draw = random.Random(9)
    for lang, letters in ALPHABETS.items():
        names, scores, rejected = model.classify([text(draw, letters, 20) for _ in range(30)])
        assert names == [lang] * 30
        assert ((0 <= scores) & (scores <= 1)).all() and not rejected.any()


def test_other_scripts_are_rejected(model):
    names, scores, rejected = model.classify([text(random.Random(1), "абвгдежз", 50)])
    assert rejected.all() and names[0] in ALPHABETS


def test_texts_without_letters(spark, model):
    texts = [(1, None), (2, ""), (3, "12 -- !?\n"), (4, "abcabc " * 30000)]
    docs = spark.createDataFrame(texts, "found long, text string")
    got = {r["found"]: r.p for r in docs.select("found", L.identify(F.col("text"), model).alias("p")).collect()}
    for i in (1, 2, 3):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[4].lang_pred == "aa" and not got[4].rejected


def test_nothing_labelled(spark):
    model = L.fit(spark.createDataFrame([(None, "abc")], "lang string, text string"))
    assert model.classify(["abc"])[0] == ["und"]


def test_several_clusters_and_more_languages_than_allowed(spark, model, rows):
    assert len(model.languages) > len(set(model.languages)) == 3
    with pytest.raises(ValueError):
        L.fit(spark.createDataFrame(rows, "lang string, text string"), most_languages=2)


def test_a_language_of_one_repeated_text_is_learned(spark, rows):
    """Copies neither hide a language nor swell its sample."""
    for n in range(3):
        copies = [("dd", text(random.Random(n), "hijklm", 40))] * 3000
        model = L.fit(spark.createDataFrame([*rows, *copies], "lang string, text string"), per_language=50)
        assert "dd" in model.languages
        assert model.classify([copies[0][1]])[0] == ["dd"]


def test_classify_against_brute_force(model):
    """Each text against each centroid, one component at a time."""
    draw = random.Random(3)
    texts = [text(draw, draw.choice(list(ALPHABETS.values())), draw.choice([1, 3, 30])) for _ in range(40)]
    names, scores, rejected = model.classify(texts)
    for t, name, score, out in zip(texts, names, scores, rejected):
        counts = [float(x) for x in L.gram_counts(t)]
        weighed = [float(x) for x in L._weigh(L.gram_counts(t)[None], model.idf)[0]]
        assert sum(w * w for w in weighed) == pytest.approx(1, abs=1e-4) and all((w != 0) == (c != 0) for w, c in zip(weighed, counts))
        cosines = [sum(w * float(c) for w, c in zip(weighed, centroid) if w) for centroid in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert cosines[model.languages.index(name) :] and score == pytest.approx(max(cosines), abs=1e-4)
        assert name == model.languages[best] and out == (score < model.limits[best])


def test_known_language_with_nulls_repeats_and_dotted_names(spark, model):
    rows = [(1, "abcabc defg", 5, "x"), (1, "abcabc defg", 5, "x"), (2, None, 6, None), (3, "", 7, "y"), (None, "nopq rst", 8, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, lang string")
    out = L.known_language(docs, model)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.where("text > ''").collect()))
    assert L.known_language(docs.limit(0), model).count() == 0
