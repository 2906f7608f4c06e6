import random

import pytest

import corpus_pipeline as C
from bazaarlens.llm.components import connected_components


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 300), (7, 3)]
    draw.shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "ve", "xo"]}

    def prose(lang, n):
        return " ".join("".join(draw.choice(syllables[lang]) for _ in range(draw.randint(2, 5))) for _ in range(n))

    rows = [(i, prose("ab"[i % 2] * 2, 150), "ab"[i % 2] * 2, "s") for i in range(40)]
    shared = prose("aa", 80)
    rows += [(100, rows[0][1], "aa", "s"), (101, prose("aa", 60) + " " + shared, "aa", "s"), (102, shared + " " + prose("aa", 60), "aa", "s")]
    rows += [(103, "где же это всё " * 30, None, "s"), (104, "12 34", None, "s"), (105, None, None, "s")]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder), {r[0]: r[1] for r in rows}


def test_stages(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    assert set(kept[0]) == set(texts) - {103, 104, 105}
    assert set(kept[1]) == set(kept[0]) - {100}
    assert set(kept[2]) == set(kept[1])
    changed = {i for i, r in kept[2].items() if r.text != texts[i]}
    assert changed == {102} and len(kept[2][102].text.split()) == 60
    assert all(r.n_chars == len(r.text) for r in kept[2].values())


def test_run_packs_all_that_is_kept(spark, corpus):
    folder, texts = corpus
    rows = C.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts) - {100, 103, 104, 105}
    assert all(r.offset + r.length <= 2048 for r in rows)
