"""Language ID by the nearest of several centroids per language, with distance-based rejection.

A text is a vector of hashed character n-grams (n = 1 to 3) over lower-cased letters, where each
run of other characters is one blank; weights are (1 + ln tf) * idf, normalised. The labelled
vectors of each language are clustered (spherical k-means), and a text gets the language of the
centroid with the largest cosine. It is rejected if its cosine is below the centroid's limit: a
share of the least that nearly all labelled texts of that cluster have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import column, slices
from bazaarlens.session import written

#: Dimensions of a vector; each centroid is that many floats.
DIMENSIONS = 1 << 13
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower case if it is a letter, else 0."""
    table = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def letter_codes(text: str | None) -> np.ndarray:
    """Lower-cased letters as code points, other runs as one 0, with a 0 at both ends."""
    if not text:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = points >= 1 << 16
    codes = _letters()[np.where(high, 0, points)]
    for i in np.flatnonzero(high).tolist():
        codes[i] = points[i] if chr(points[i]).isalpha() else 0
    if not codes.any():
        return np.zeros(0, np.uint64)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def gram_counts(text: str | None) -> np.ndarray:
    """How often each hashed n-gram occurs; all zero for a text without a letter."""
    one = letter_codes(text)
    if not len(one):
        return np.zeros(DIMENSIONS, np.float32)
    two = (one[:-1] << np.uint64(21)) | one[1:]
    three = (two[:-1] << np.uint64(21)) | one[2:]
    grams = np.concatenate([one[one != 0], two + np.uint64(1), three + np.uint64(2)])
    mixed = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
    return np.bincount(mixed.astype(np.int64), minlength=DIMENSIONS).astype(np.float32)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log(counts, out=np.full_like(counts, -1), where=counts > 0)
    weights = (weights + 1) * idf
    norm = np.linalg.norm(weights, axis=1, keepdims=True)
    return np.divide(weights, norm, out=np.zeros_like(weights), where=norm > 0)


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starting points; unit centroids, at most ``k``."""
    chosen = [int(np.argmax(vectors @ vectors.sum(axis=0)))]
    while len(chosen) < min(k, len(vectors)):
        near = (vectors @ vectors[chosen].T).max(axis=1)
        # A low quantile instead of the very farthest: outliers make no cluster.
        order = np.argsort(near, kind="stable")
        pick = int(order[len(order) // 10])
        if near[pick] > 1 - 1e-6:
            break
        chosen.append(pick)
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[own == i].sum(axis=0) for i in range(len(centroids))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = sums[norms[:, 0] > 0] / norms[norms[:, 0] > 0]
    return centroids


@dataclass
class LanguageModel:
    """Centroids of all languages: some times clusters per language times DIMENSIONS floats."""

    languages: list[str]
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray

    def classify(self, texts: list) -> tuple[list, np.ndarray, np.ndarray]:
        """Languages, cosines and whether each text is rejected."""
        names, scores, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for start in range(0, len(texts), 256):
            counts = np.stack([gram_counts(t) for t in texts[start : start + 256]])
            known = counts.any(axis=1)
            if not self.languages:
                names += [UNKNOWN] * len(counts)
                continue
            cosines = _weigh(counts, self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
            names += [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            scores[start : start + 256] = np.where(known, score, 0)
            rejected[start : start + 256] = ~known | (score < self.limits[best])
        return names, scores, rejected


def fit(
    labelled: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    *,
    per_language: int = 1000,
    clusters: int = 4,
    slack: float = 0.25,
    most_languages: int = 1000,
) -> LanguageModel:
    """Learn from about ``per_language`` different texts of each language.

    That bound is the only sampling: texts that hash below bound / number of different texts of the
    language, each once, so that copies neither hide a language nor swell its sample. A language
    of no more texts than the bound is learned from all of them.
    Rows with a null language or without a letter teach nothing; no labelled row gives a model
    that knows no language; more than ``most_languages`` is an error, for the model grows with
    them. A text's limit is ``slack`` times the cosine that 99 % of its
    cluster's labelled texts reach.
    """
    rows = labelled.select(column(text_column).alias("text"), column(lang_column).alias("lang")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    rows = rows.select("lang", "text", F.xxhash64("text").alias("hash"))
    counts = rows.select("lang", "hash").distinct().groupBy("lang").count().limit(most_languages + 1).collect()
    if not counts:
        return LanguageModel([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), np.ones(DIMENSIONS, np.float32))
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counts = F.broadcast(labelled.sparkSession.createDataFrame(counts, "lang string, n long"))
    share = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # the sample's texts at most
        for b in (b.slice(i, 256) for b in slices(batches, "text") for i in range(0, b.num_rows, 256)):
            keys = list(zip(b.column("lang").to_pylist(), b.column("hash").to_pylist()))
            first = {k: i for i, k in reversed(list(enumerate(keys))) if k not in seen}
            seen.update(first)
            b = b.take(pa.array(sorted(first.values()), pa.int64()))
            grams = [gram_counts(t) for t in b.column("text").to_pylist()]
            made = [g.clip(max=65535).astype("<u2").tobytes() if g.any() else None for g in grams]
            columns = [b.column("lang"), b.column("hash"), pa.array(made, pa.binary())]
            made = pa.RecordBatch.from_arrays(columns, ["lang", "hash", "grams"])
            yield made.filter(made.column("grams").is_valid())

    # One Python step per task: a filter on a UDF's result would work it out twice, in two workers.
    sample = written(
        rows.join(counts, "lang")
        .where(share * F.col("n") < per_language)
        .select("lang", "hash", "text")
        .mapInArrow(counted, "lang string, hash long, grams binary")
        .groupBy("lang", "hash")
        .agg(F.min("grams").alias("grams")),
        "languages",
    )

    def found_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, found = 0, np.zeros(DIMENSIONS, np.int64)
        for b in batches:
            for g in b["grams"]:
                n += 1
                found += np.frombuffer(g, "<u2") > 0
        yield pd.DataFrame({"dim": range(-1, DIMENSIONS), "n": [n, *found]})

    found = sample.select("grams").mapInPandas(found_in, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    numbers = {r.dim: r.n for r in found.collect()}  # one row per dimension
    total = numbers.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + numbers.get(i, 0))) + 1 for i in range(DIMENSIONS)], np.float32)

    def cluster(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        vectors = _weigh(np.stack([np.frombuffer(g, "<u2") for g in sorted(rows["grams"])]).astype(np.float32), idf)
        centroids = _clusters(vectors, clusters)
        cosines = vectors @ centroids.T
        own, best = cosines.argmax(axis=1), cosines.max(axis=1)
        limits = [slack * float(np.quantile(best[own == i], 0.01)) if (own == i).any() else 0.0 for i in range(len(centroids))]
        return pd.DataFrame(
            {"lang": key[0], "centroid": [c.astype("<f4").tobytes() for c in centroids], "limit": limits}
        )

    rows = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, limit double")
    model = sorted(tuple(r) for r in rows.collect())  # clusters per language
    centroids = np.array([np.frombuffer(c, "<f4") for _, c, _ in model], np.float32).reshape(-1, DIMENSIONS)
    return LanguageModel([n for n, _, _ in model], centroids, np.array([x for _, _, x in model]), idf)


def identify(text: Column, model: LanguageModel) -> Column:
    """(lang_pred, score, rejected) of a text.

    lang_pred is a learned language, or ``und`` if the text is null or has no letter, then with
    score 0. rejected is also true for texts that are too far from every centroid.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        names, scores, rejected = model.classify(texts.tolist())
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": scores, "rejected": rejected})

    return of(text)


def known_language(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that the model does not reject.

    Rows are judged in slices of some megabytes of text, whatever the lengths of the texts.
    """

    text = f"c{docs.columns.index(text_column)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            _, _, rejected = model.classify(b.column(text).to_pylist())
            yield b.filter(pa.array(~rejected))

    # mapInArrow takes no names with dots: columns go by their places.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
