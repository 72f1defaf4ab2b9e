"""Token counts by a linear longest-match automaton.

Greedy longest match cuts a space and a word, [^\\x20\\x09-\\x0D]+, into vocabulary pieces. The automaton is the vocabulary's trie with failure links:
where no piece continues a state, the link leads to the state of what is left after popping pieces, and the number of pieces popped is
precomputed. Each byte moves ahead once and each link shortens what is held, so a word of n bytes costs O(n) and no piece is ever built.
All 256 bytes must be pieces, so every word has pieces.

Defined cases: a null or empty text has no words and no pieces; a null id stays null; repeated rows are counted each; an empty table gives
an empty result; words of any length are counted whole; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.textops import chunks

_CACHE_WORDS, _CACHE_BYTES = 300_000, 64


class LongestMatch:
    """Counts greedy longest-match pieces of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.go: dict[int, int] = {}  # state << 8 | byte -> state
        token, parent, byte = [False], [0], [0]
        for piece in vocabulary:
            s = 0
            for b in piece:
                key = s << 8 | b
                nxt = self.go.get(key)
                if nxt is None:
                    nxt = self.go[key] = len(token)
                    token.append(False)
                    parent.append(s)
                    byte.append(b)
                s = nxt
            token[s] = True
        if not all(token[self.go.get(b, 0)] for b in range(256)):
            raise ValueError("every byte must be a piece")
        n = len(token)
        self.fail, self.pops, self.finish = [0] * n, [0] * n, [0] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for s in range(1, n):
            children[parent[s]].append(s)
        queue = deque(children[0])
        while queue:  # by length, so that links of shorter states are known
            s = queue.popleft()
            queue.extend(children[s])
            if token[s]:
                self.fail[s], self.pops[s] = 0, 1
            else:
                up = parent[s]
                z, popped = self.fail[up], self.pops[up]
                while (z << 8 | byte[s]) not in self.go:
                    popped += self.pops[z]
                    z = self.fail[z]
                self.fail[s], self.pops[s] = self.go[z << 8 | byte[s]], popped
            self.finish[s] = self.pops[s] + self.finish[self.fail[s]]

    def count(self, text: bytes) -> int:
        go, fail, pops, s, n = self.go, self.fail, self.pops, 0, 0
        for b in text:
            nxt = go.get(s << 8 | b)
            while nxt is None:
                n += pops[s]
                s = fail[s]
                nxt = go.get(s << 8 | b)
            s = nxt
        return n + self.finish[s]


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_matchers: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def matcher(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    """The automaton of a vocabulary file and a bounded cache of counts, one each in a worker."""
    if path not in _matchers:
        _matchers[path] = (LongestMatch(read_vocabulary(path)), {})
    return _matchers[path]


def count_pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_pieces, max_word_pieces: one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, cache = matcher(vocabulary)
        for batch in batches:
            for c in chunks(batch.column(1)):
                first, kind = c.words
                raw = c.data.tobytes()
                each = np.zeros(len(first), np.int64)
                for i, (a, b) in enumerate(zip(c.starts[first].tolist(), c.ends[first].tolist(), strict=True)):
                    word = raw[a:b]
                    n = cache.get(word)
                    if n is None:
                        n = match.count(b" " + word)
                        if len(cache) >= _CACHE_WORDS:
                            cache.clear()
                        if len(word) <= _CACHE_BYTES:
                            cache[word] = n
                    each[i] = n
                per_word = each[kind]
                total = np.concatenate([[0], np.cumsum(per_word)])
                most = np.zeros(c.last - c.first, np.int64)
                np.maximum.at(most, c.word_doc, per_word)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.last - c.first), pa.array(np.diff(c.word_offsets)), pa.array(np.diff(total[c.word_offsets])), pa.array(most)],
                    names=[id_col, "n_words", "n_pieces", "max_word_pieces"],
                )

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, n_pieces long, max_word_pieces long")
