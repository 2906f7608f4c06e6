"""Packing of documents into training sequences along a space-filling curve.

Each document is a hashed vector of its tokens, projected to a few dimensions; its cell's place on
a Hilbert curve is its sort key. Documents are dealt into ranges of it and sorted, so that neighbours on the
curve, which are alike, are packed next to each other: each range is one stream of tokens, cut
into full sequences. What is left at the end of a range is cut at powers of two.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import Remembered, column, slices

LENGTH = 2048
#: Buckets of a hashed vector, dimensions of the curve, bits of each.
BUCKETS, DIMENSIONS, BITS = 256, 4, 15
#: Pretokens that a worker remembers the ids of, and the longest of them.
REMEMBERED = 400_000
_LONG = 48


# --- the curve --------------------------------------------------------------------------------


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dimensions) (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


@lru_cache(1)
def _projection() -> tuple[np.ndarray, np.ndarray]:
    """Buckets of token ids (by their low 16 bits) and an orthonormal projection; fixed by the seed."""
    random = np.random.default_rng(20)
    buckets = random.permutation(np.repeat(np.arange(BUCKETS), 256))
    basis, _ = np.linalg.qr(random.normal(size=(BUCKETS, DIMENSIONS)))
    return buckets, basis


def curve_key(ids: list[np.ndarray]) -> np.ndarray:
    """The place on the curve of each document's ids; one fixed place for documents without any."""
    buckets, basis = _projection()
    vectors = np.zeros((len(ids), BUCKETS))
    for i, own in enumerate(ids):
        vectors[i] = np.bincount(buckets[own & 0xFFFF], minlength=BUCKETS)
    vectors = np.sqrt(vectors)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    cells = np.clip((unit @ basis + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64))


# --- tokens -----------------------------------------------------------------------------------


class Ids:
    """The ids that ``tokenizers`` gives for a byte-level BPE file, remembered by pretoken.

    The tokenizer splits a text into pretokens and encodes each by itself. For texts of the
    common Latin characters the same split is made with Python's ``re``, and only pretokens that
    the worker doesn't remember go to the tokenizer's model. Any other text, and one that has an
    added token, goes to the tokenizer whole, as do all texts if the file splits them by another
    pattern.
    """

    def __init__(self, path: str, remember: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # The pretoken pattern of this kind of vocabulary in the terms of ``re``, for
        # printable ASCII, tab, line ends, and Latin letters with and without accents (no number
        # forms, no other blanks); a text with any other character goes to the tokenizer.
        letters = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
        blanks = " \t\n\r"
        self.split = re.compile(
            f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{blanks}0-9{letters}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
        ).findall
        plain = "[^\\t\\n\\r -~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f]"
        self.other = re.compile("|".join([plain, *added])).search
        # Byte-level files spell a byte that has no visible character with one from 256 on.
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = (b for b in range(256) if b not in visible)
        self.spelling = {b: 256 + i for i, b in enumerate(hidden)}
        self.known = Remembered(self._pretoken, remember, _LONG)
        made = json.loads(self.tokenizer.to_str())
        standard = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        before = made["pre_tokenizer"] or {}
        # Whether the file splits by the pattern above and changes nothing before or after it.
        self.own_split = not made["normalizer"] and made["model"]["type"] == "BPE" and standard.items() <= before.items()

    def _pretoken(self, text: str) -> bytes:
        spelled = text.encode().decode("latin-1").translate(self.spelling)
        return np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], self.kind).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self._ids(t), self.kind) for t in texts]

    def _ids(self, text: str) -> bytes:
        if not self.own_split or self.other(text):
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, self.split(text)))


@lru_cache(2)
def tokenizer(path: str, remember: int = REMEMBERED) -> Ids:
    return Ids(path, remember)


# --- packing ----------------------------------------------------------------------------------


def tokenized(
    docs: DataFrame, vocabulary: str, end_id: int, bounds: np.ndarray | None = None, remember: int = REMEMBERED
) -> DataFrame:
    """(id, place, tie, tokens, width, share) of documents (id, text).

    tokens are the ids with ``end_id`` as little-endian bytes, ``width`` each (2 if the vocabulary
    allows it). share is the number of ``bounds``, pairs of place and tie, that are not above the
    document's own pair. A null text is empty.
    """
    bounds = np.zeros((0, 2), np.int64) if bounds is None else bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary, remember)
        end = np.array([end_id], own.kind)
        for b in slices(batches, "text"):
            ids = own.encode([t or "" for t in b.column("text").to_pylist()])
            place = curve_key(ids)
            tie = b.column("tie").to_numpy()
            low = np.searchsorted(bounds[:, 0], place, "left")
            same = np.searchsorted(bounds[:, 0], place, "right")
            share = [lo + int(np.searchsorted(bounds[lo:hi, 1], t, "right")) for lo, hi, t in zip(low, same, tie)]
            tokens = [np.concatenate([i, end]).tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    pa.array(place),
                    b.column("tie"),
                    pa.array(tokens, pa.binary()),
                    pa.array(np.full(len(ids), own.kind.itemsize, np.int32)),
                    pa.array(np.array(share, np.int32)),
                ],
                ["id", "place", "tie", "tokens", "width", "share"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    texts = docs.select("id", "text", F.xxhash64("id", "text").alias("tie"))
    return texts.mapInArrow(run, f"id {kind}, place long, tie long, tokens binary, width int, share int")


def _bounds(docs: DataFrame, vocabulary: str, shares: int, remember: int = REMEMBERED) -> np.ndarray:
    """Pairs (place, tie) that cut the curve into about equal ``shares``.

    They come from a sample of about 60 documents per share and only spread the work. The tie
    lets a bound fall between documents at one place, so that a group of copies is spread too
    unless they also share the id.
    """
    n = docs.count()
    if n < 2 or shares < 2:
        return np.zeros((0, 2), np.int64)
    sample = docs.sample(min(1.0, 60 * shares / n), seed=1)
    found = tokenized(sample, vocabulary, 0, None, remember).select("place", "tie").collect()
    if not found:
        return np.zeros((0, 2), np.int64)
    pairs = np.array(sorted({tuple(r) for r in found}), np.int64)
    return pairs[np.unique(np.arange(1, shares) * len(pairs) // shares)]


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    end_id: int = 1,
    length: int = LENGTH,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = True,
    remember: int = REMEMBERED,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Every token of every document is in exactly one piece; pieces fill sequences without a gap.
    All sequences of a range are full but the last few, whose lengths are powers of two, so that
    none needs padding. Repeated rows are documents of their own. Documents at one place
    are ordered by a hash of id and text, and a range may end between them, so that a large
    group of copies is spread. Sequence ids are unique, not consecutive. ``remember`` bounds the
    pretokens that a worker keeps the ids of: more are faster, some 400 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 32
        offset = 0
        tail: list = []  # pieces of the open sequence: [doc_id, start, ids, doc_tokens, offset]
        for b in batches:
            out = []
            width = b.column("width").to_numpy()
            for doc, raw, w in zip(b.column("id").to_pylist(), b.column("tokens"), width.tolist()):
                ids = np.frombuffer(raw.as_buffer(), f"<u{w}")
                start = 0
                while start < len(ids):
                    n = min(len(ids) - start, length - offset)
                    tail.append([doc, start, ids[start : start + n].astype("<u4"), len(ids), offset])
                    start, offset = start + n, offset + n
                    if offset == length:
                        out += [[*p, sequence] for p in tail]
                        tail, offset, sequence = [], 0, sequence + 1
            if out:
                yield made(out)
        if tail:
            yield made(powers(tail, offset, sequence))

    def powers(tail: list, left: int, sequence: int) -> list:
        """The last pieces, cut so that each of their sequences has a power of two of tokens."""
        out, room, offset = [], 1 << (left.bit_length() - 1), 0
        for doc, start, ids, total, _ in tail:
            while len(ids):
                n = min(len(ids), room - offset)
                out.append([doc, start, ids[:n], total, offset, sequence])
                start, ids, offset, left = start + n, ids[n:], offset + n, left - n
                if offset == room and left:
                    room, offset, sequence = 1 << (left.bit_length() - 1), 0, sequence + 1
        return out

    def made(rows: list) -> pa.RecordBatch:
        doc, start, ids, total, offset, sequence = zip(*rows)
        data = [i.tobytes() for i in ids]
        longs = [start, [len(i) for i in ids], [zlib.crc32(d) for d in data], total, sequence, offset]
        columns = [pa.array(doc, of_id), *[pa.array(x, pa.int64()) for x in longs]]
        return pa.RecordBatch.from_arrays(
            columns + [pa.array(data if with_ids else [None] * len(data), pa.binary())], names
        )

    texts = docs.select(column(id_column).alias("id"), column(text_column).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    of_id = {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = (
        tokenized(texts, vocabulary, end_id, _bounds(texts, vocabulary, shares, remember), remember)
        .repartitionById(shares, F.col("share"))
        .sortWithinPartitions("place", "tie", "id", "tokens")
        .mapInArrow(
            run,
            f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long,"
            " sequence_id long, offset long, ids binary",
        )
    )
    return (packed if with_ids else packed.drop("ids")).withColumnRenamed("id", id_column)
