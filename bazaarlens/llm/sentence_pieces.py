"""SentencePiece encoding and decoding with a streaming Viterbi search.

The best segmentation of a text is the one whose piece scores have the largest sum. The search
keeps a window of end positions, each with its best score and the start of its last piece. Only
ends within the longest piece's length of the front can still be extended; as soon as the paths
behind all of them meet on one boundary, the ids before it are final and the window is cut there.

Where no piece of the vocabulary can span a position (a blank that follows something else), all
paths meet for certain, so what lies between two such positions is a search of its own, and a
worker remembers a bounded number of them. The short ones among those it has not met are searched
side by side, one place of all of them at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import column, slices

BLANK = "▁"
#: Stretches that a worker remembers, and their characters; when either is passed it begins anew.
REMEMBERED, CHARACTERS = 600_000, 8_000_000
#: Longer stretches are searched one by one, so many characters of shorter ones at once.
_LONG, _AT_ONCE = 64, 1 << 18
#: Stretches looked up before the next ones are.
_BLOCK = 1 << 18
#: What an unknown character costs below the lowest score.
UNKNOWN_COST = 10.0


class _Numbered(dict):
    """Keys by the order in which they were first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PieceModel:
    """Pieces with scores, byte pieces for characters without one, and the marks of a text's start.

    ``pieces`` are (piece, id, score) of ordinary pieces, ``byte_ids`` the ids of the 256 byte
    pieces or None (then an unknown character is ``unknown``).
    """

    def __init__(self, pieces, byte_ids: list[int] | None, unknown: int, add_prefix: bool = True):
        self.byte_ids, self.unknown, self.add_prefix = byte_ids, unknown, add_prefix
        self.texts: dict[int, bytes] = {i: p.encode() for p, i, _ in pieces}
        if byte_ids:
            self.texts |= {i: bytes([b]) for b, i in enumerate(byte_ids)}
        # The bytes of each id; the last entry is of those that have none.
        self.table = pa.array([self.texts.get(i, b"") for i in range(max(self.texts, default=-1) + 2)], pa.large_binary())
        self.longest = max((len(p) for p, _, _ in pieces), default=1)
        self.worst = min((s for _, _, s in pieces), default=0.0) - UNKNOWN_COST
        # A trie of nodes (children by character, id or None, score).
        self.trie: list = [{}, None, 0.0]
        for piece, i, score in pieces:
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, [{}, None, 0.0])
            node[1:] = i, score
        self._flatten()
        spans = any(BLANK in p.lstrip(BLANK) for p, _, _ in pieces)
        self.stretches = re.compile(".+" if spans else f"{BLANK}*[^{BLANK}]+|{BLANK}+", re.S)
        self._forget()

    def _flatten(self) -> None:
        """The trie as arrays: children by node and character, and the piece that ends at a node."""
        nodes, keys = [self.trie], []
        for n, node in enumerate(nodes):  # goes on over those it adds
            for c, child in node[0].items():
                keys.append(n << 21 | ord(c))
                nodes.append(child)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(1) << 62)  # the last one fits nothing
        self.children = np.append(order + 1, 0)
        self.is_piece = np.array([i is not None for _, i, _ in nodes])
        self.ids = np.array([0 if i is None else i for _, i, _ in nodes], np.int64)
        self.gains = np.array([gain for _, _, gain in nodes])

    def _forget(self) -> None:
        self.known, self.characters = _Numbered(), 0
        # Of each stretch by its number: where its ids begin in known_ids, and how many it has.
        self.known_at, self.known_n, self.known_ids = (np.zeros(0, np.int64) for _ in range(3))

    def _spelled(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def search(self, text: str) -> Iterator[list[int]]:
        """The ids of the best segmentation, committed as soon as they are certain.

        Of equal sums the one whose last piece starts first wins.
        """
        trie, worst, n, longest = self.trie, self.worst, len(text), self.longest
        none = float("-inf")
        window = min(n, 4 * longest)
        base = 0  # the last boundary committed; entry i is of the end base + i
        score, start, last = [0.0] + [none] * (window + longest), [0] * (window + longest + 1), [0] * (window + longest + 1)
        for at in range(n):
            own = score[at - base]
            if own > none:
                node, end, single = trie[0], at, False
                while end < n and (found := node.get(text[end])) is not None:
                    node, i, gain = found
                    end += 1
                    if i is not None:
                        single = single or end == at + 1
                        to = end - base
                        if own + gain > score[to]:
                            score[to], start[to], last[to] = own + gain, at, i
                if not single and own + worst > score[at + 1 - base]:
                    to = at + 1 - base
                    score[to], start[to], last[to] = own + worst, at, -1
            front = at + 1
            if front - base >= window or front == n:
                # The paths behind the ends that can still be extended meet on one boundary or not.
                ends = {base + i for i in range(front - base, len(score)) if score[i] > none} if front < n else {n}
                while len(ends) > 1:
                    far = max(ends)
                    ends.discard(far)
                    ends.add(start[far - base])
                meet = ends.pop()
                if meet > base:
                    groups, end = [], meet
                    while end > base:
                        i = end - base
                        groups.append(self._spelled(text[start[i]]) if last[i] == -1 else (last[i],))
                        end = start[i]
                    yield [i for group in reversed(groups) for i in group]
                    cut = meet - base
                    score, start, last = score[cut:], start[cut:], last[cut:]
                    base, window = meet, min(n - meet, 4 * longest)
                else:
                    window += longest
                room = window + longest + 1 - len(score)
                score += [none] * room
                start += [0] * room
                last += [0] * room

    def search_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short texts, one text after another, and how many each has; as by ``search``."""
        sizes = np.array([len(t) for t in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(chars)) - first[row]
        room = sizes[row] - place
        # All pieces from all places: what is left goes one character further at a time.
        at, node, size = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        single, edges = np.zeros(len(chars), bool), []
        while len(at):
            key = node << 21 | chars[at + size]
            found = np.searchsorted(self.keys, key)
            fits = self.keys[found] == key
            at, node, size = at[fits], self.children[found[fits]], size + 1
            ends = self.is_piece[node]
            if size == 1:
                single[at[ends]] = True
            edges.append((at[ends], np.full(ends.sum(), size), self.ids[node[ends]], self.gains[node[ends]]))
            more = room[at] > size
            at, node = at[more], node[more]
        alone = np.flatnonzero(~single)
        edges.append((alone, np.ones(len(alone), np.int64), np.full(len(alone), -1), np.full(len(alone), self.worst)))
        at, size, ids, gain = (np.concatenate(x) for x in zip(*edges))
        order = np.argsort(place[at], kind="stable")
        at, size, ids, gain = at[order], size[order], ids[order], gain[order]
        # Each text has an end more than characters. Edges from one place of a text have different ends.
        start = at + row[at]
        end, begins = start + size, first + np.arange(len(texts))
        score, by = np.full(len(chars) + len(texts), -np.inf), np.zeros(len(chars) + len(texts), np.int64)
        score[begins] = 0.0
        stops = np.searchsorted(place[at], np.arange(sizes.max(initial=0) + 1))
        for low, high in zip(stops[:-1].tolist(), stops[1:].tolist()):
            total, to = score[start[low:high]] + gain[low:high], end[low:high]
            better = total > score[to]
            score[to[better]], by[to[better]] = total[better], low + np.flatnonzero(better)
        # Back from the ends, one piece of all texts at a time.
        rows, to, steps = np.arange(len(texts)), begins + sizes, []
        while len(rows):
            edge = by[to]
            steps.append((rows, edge))
            to = start[edge]
            on = to > begins[rows]
            rows, to = rows[on], to[on]
        counts = np.zeros(len(texts), np.int64)
        for n, (rows, _) in enumerate(steps, 1):
            counts[rows] = n
        ends = np.cumsum(counts)
        path = np.zeros(counts.sum(), np.int64)
        for n, (rows, edge) in enumerate(steps, 1):
            path[ends[rows] - n] = edge
        out = ids[path]
        unknown = np.flatnonzero(out == -1)
        if len(unknown):
            spelled = [self._spelled(chr(c)) for c in chars[at[path[unknown]]].tolist()]
            times = np.ones(len(out), np.int64)
            times[unknown] = [len(s) for s in spelled]
            out, after = np.repeat(out, times), np.cumsum(times)
            for n, s in zip(after[unknown].tolist(), spelled):
                out[n - len(s) : n] = s
            counts = np.add.reduceat(times, ends - counts)
        return out, counts

    def _learn(self, new: list[str]) -> None:
        """Remembers the ids of stretches, which have the next numbers."""
        short = [s for s in new if len(s) <= _LONG]
        ids, counts, low, size = [], [], 0, 0
        for high, s in enumerate(short, 1):
            size += len(s)
            if size >= _AT_ONCE or high == len(short):
                own, n = self.search_many(short[low:high])
                ids.append(own)
                counts.append(n)
                low, size = high, 0
        is_long = np.array([len(s) > _LONG for s in new])
        for s in new if is_long.any() else ():
            if len(s) > _LONG:
                own = np.fromiter(chain.from_iterable(self.search(s)), np.int64)
                ids.append(own)
                counts.append(np.array([len(own)]))
        n = np.concatenate(counts)
        places = np.concatenate([np.flatnonzero(~is_long), np.flatnonzero(is_long)])
        at, of = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        at[places], of[places] = len(self.known_ids) + np.cumsum(n) - n, n
        self.known_at, self.known_n = np.append(self.known_at, at), np.append(self.known_n, of)
        self.known_ids = np.concatenate([self.known_ids, *ids])
        self.characters += sum(map(len, new))

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one text after another, and where each begins and the last ends."""
        mark = BLANK if self.add_prefix else ""
        parts = [self.stretches.findall(mark + t.replace(" ", BLANK)) if t else [] for t in texts]
        every, ids, counts = list(chain.from_iterable(parts)), [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for low in range(0, len(every), _BLOCK):
            if len(self.known) > REMEMBERED or self.characters > CHARACTERS:
                self._forget()
            block, before = every[low : low + _BLOCK], len(self.known)
            numbers = np.fromiter(map(self.known.__getitem__, block), np.int64, len(block))
            if len(self.known) > before:
                self._learn(list(islice(reversed(self.known), len(self.known) - before))[::-1])
            at, n = self.known_at[numbers], self.known_n[numbers]
            ids.append(self.known_ids[np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)])
            counts.append(n)
        ends = np.cumsum(np.concatenate(counts))
        return np.concatenate(ids), ends[np.cumsum([0, *map(len, parts)])]

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids, one after another. Other ids (controls, unknown) have no text; broken
        bytes become U+FFFD."""
        none = len(self.table) - 1
        pieces = self.table.take(pa.array(np.where((ids >= 0) & (ids < none), ids, none)))
        _, places, joined = pieces.buffers()
        raw = memoryview(joined or b"")
        ends = np.frombuffer(places, np.int64)[pieces.offset :][offsets].tolist() if len(ids) else [0] * len(offsets)
        texts = [str(raw[a:b], "utf-8", "replace").replace(BLANK, " ") for a, b in zip(ends, ends[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts] if self.add_prefix else texts

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one."""
        return self.encode_many([text])[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids."""
        ids = np.array(ids, np.int64)
        return self.decode_many(ids, np.array([0, len(ids)]))[0]


@lru_cache(2)
def load(path: str) -> PieceModel:
    """The pieces and scores of a SentencePiece model file. Once per worker."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.vocab_size())
    special = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i) for i in ids]
    pieces = [(p.id_to_piece(i), i, p.get_score(i)) for i in ids if not special[i]]
    byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return PieceModel(pieces, byte_ids if p.is_byte(byte_ids[0]) else None, p.unk_id())


def encode(text: Column, model: str) -> Column:
    """The piece ids of a text as array<int>; ``model`` is a path that every executor can open."""

    @F.pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        ids, ends = load(model).encode_many(texts.tolist())
        return pd.Series(np.split(ids.astype(np.int32), ends[1:-1]), index=texts.index, dtype=object)

    return of(text)


def decode(ids: Column, model: str) -> Column:
    """The text of piece ids; null for null."""

    @F.pandas_udf("string")
    def of(arrays: pd.Series) -> pd.Series:
        own = load(model)
        return pd.Series([None if a is None else own.decode(a.tolist()) for a in arrays], dtype=object)

    return of(ids)


def round_trip(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_ids, ids_crc32, exact) of each text, encoded and decoded in slices of some megabytes.

    ids_crc32 is of the ids as little-endian unsigned 32-bit numbers. exact says whether decoding
    gives the text back, but for blank marks in it, which become blanks. A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for b in slices(batches, "text", 4 << 20):
            texts = b.column("text").to_pylist()
            ids, ends = own.encode_many(texts)
            exact = [d == (t or "").replace(BLANK, " ") for d, t in zip(own.decode_many(ids, ends), texts)]
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends.tolist(), ends[1:].tolist())]
            made = [pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.array(exact, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column("id"), *made], ["id", "n_ids", "ids_crc32", "exact"])

    texts = docs.select(column(id_column).alias("id"), column(text_column).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    made = texts.mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, exact boolean")
    return made.withColumnRenamed("id", id_column)
