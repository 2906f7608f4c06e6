"""Token counts by a linear longest-match automaton.

The pieces of a vocabulary form a trie. Where a word leaves the trie, a failure link says in which
node matching goes on and how many pieces the greedy longest match has popped by then, so each
byte is looked at once and no piece is built (Song et al., "Fast WordPiece Tokenization"). A word
is matched with a blank before it: pieces with a leading blank start words, others continue them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.llm.common import Remembered

#: Words that a Python worker remembers the count of, and the longest of them.
REMEMBERED = 150_000
_LONG = 64


class LongestMatch:
    """Counts greedy longest-match pieces. A word that can't be matched counts as one (unknown)."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: dict[int, int] = {}  # node << 8 | byte -> node
        final = [False]
        order: list[tuple[int, int, int]] = []  # node, parent, byte
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                child = self.next.get(key)
                if child is None:
                    child = self.next[key] = len(final)
                    final.append(False)
                    order.append((child, node, byte))
                node = child
            final[node] = bool(node)
        self.fail = [-1] * len(final)
        self.popped = [0] * len(final)
        #: Pieces of a word without the blank before it.
        self.counts = Remembered(lambda word: self.match(b" " + word), REMEMBERED, _LONG)
        # Parents are made before their children, but a failure link can lead to a shorter
        # node made later: go by depth.
        depth = [0] * len(final)
        for node, parent, _ in order:
            depth[node] = depth[parent] + 1
        for node, parent, byte in sorted(order, key=lambda x: depth[x[0]]):
            if final[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            at, n = self.fail[parent], self.popped[parent]
            while at >= 0 and (at << 8 | byte) not in self.next:
                n += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.next[at << 8 | byte], n

    def match(self, word: bytes) -> int:
        """Pieces of one word; 1 if it can't be matched."""
        step, fail, popped = self.next, self.fail, self.popped
        node, n = 0, 0
        for byte in word:
            while (to := step.get(node << 8 | byte)) is None:
                if fail[node] < 0:
                    return 1
                n += popped[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return 1
            n += popped[node]
            node = fail[node]
        return n


@lru_cache(2)
def automaton(path: str) -> LongestMatch:
    """The automaton of a file of base64 pieces, one to a line before a blank. Once per worker."""
    with open(path, "rb") as lines:
        return LongestMatch(base64.b64decode(line.split()[0]) for line in lines if line.strip())


def count_tokens(text: Column, vocabulary: str) -> Column:
    """(n_words, n_tokens) of a text; both 0 for a null or empty one.

    ``vocabulary`` is a path that every executor can open. Words are split at ASCII white space.
    """

    @F.pandas_udf("n_words long, n_tokens long")
    def of(texts: pd.Series) -> pd.DataFrame:
        count = automaton(vocabulary).counts.__getitem__
        rows = []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").split()
            rows.append((len(words), sum(map(count, words))))
        return pd.DataFrame(rows, columns=["n_words", "n_tokens"], dtype="int64")

    return of(text)
