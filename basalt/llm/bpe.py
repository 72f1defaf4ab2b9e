"""Byte-pair encoding and decoding by per-prefix dynamic programming.

The last token of a prefix's encoding is unique. An automaton over the vocabulary gives the tokens that a prefix ends with, longest first; the one that can
stand after the last token of what is left before it is stored, and back-pointers from the end then give the exact ids. Two tokens can stand side by side if
no merge, in the order in which merges are done, would have joined a suffix of the first with a prefix of the second; going back through both tokens' own
merges decides that, and pairs are remembered. So a piece of n bytes takes O(n) steps of the automaton and never a list of merges.

Texts are cut where the vocabulary's own pre-tokenizer cuts them. It never joins what stands before a single space with what comes after, so texts are read
as units, a word with a space before it or a piece of white space, and each worker remembers the ids of the units it meets often (two generations of
_CACHE units). Texts with white space outside ASCII are cut as a whole. Strings of added tokens in a text become their ids.

Vocabularies are byte-level ones of the tokenizers library: a token for each byte, a new token for each merge, no normalizer, no truncation or padding used.
Tokens that their own bytes don't encode to can't occur.

Defined cases: a null or empty text has no ids (an empty list), and decodes to an empty text; null ids decode to null; ids that the vocabulary lacks
decode to nothing; bytes that aren't UTF-8 decode to U+FFFD; ids of documents may be null or repeat, each row is encoded; texts of any length are encoded whole, in
spans; an empty table gives an empty result; encode() ignores other columns, decode() keeps them.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basalt.llm.packing import _byte_letters
from basalt.llm.textops import gather

_CACHE, _CACHE_BYTES, _PAIRS, _MOVES = 300_000, 48, 500_000, 1_000_000
_SPAN, _BLOCK = 1 << 20, 1 << 18
# a word with a space before it; white space up to the last one before a word; that last one
_UNIT = re.compile(rb" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]")
_SINGLE_SPACE = re.compile(rb"(?<=[^\t-\r ])(?= [^\t-\r ])")
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Latin letters, then ASCII punctuation without the apostrophe: two pieces
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ſ]+)([!-&(-/:-@\[-`{-~]*)")


class PrefixEncoder:
    """Ids of single pieces of bytes. Inside, tokens are numbered by rank: bytes, then merges in order."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        n = 256 + len(merges)
        self.n, rank = n, {bytes([b]): b for b in range(256)}
        self.left, self.right, self.pair = list(range(256)), list(range(256)), {}
        self.known: dict[int, bool] = {}
        for i, (a, b) in enumerate(merges, 256):
            if a not in rank or b not in rank or a + b in rank:
                raise ValueError("each merge must make a new token of two older ones")
            rank[a + b] = i
            self.left.append(rank[a])
            self.right.append(rank[b])
            self.pair[rank[a] * n + rank[b]] = i
        tokens = list(rank)
        self.id, self.size = [vocabulary[t] for t in tokens], [len(t) for t in tokens]
        alive = [True] * n  # whether a token's bytes encode to it
        for t in range(256, n):
            a, b = self.left[t], self.right[t]
            alive[t] = alive[a] and alive[b] and self._compatible(a, b, t)
        self._automaton(tokens, alive)

    def _automaton(self, tokens: list[bytes], alive: list[bool]) -> None:
        """go and fail move by a byte; ends is the longest token a state ends with, shorter the next one that a token ends with."""
        self.go: dict[int, int] = {}
        own, parent, byte, state_of = [-1], [0], [0], []
        for t, s in enumerate(tokens):
            state = 0
            for b in s:
                key = state << 8 | b
                if (nxt := self.go.get(key)) is None:
                    nxt = self.go[key] = len(own)
                    own.append(-1)
                    parent.append(state)
                    byte.append(b)
                state = nxt
            state_of.append(state)
            if alive[t]:
                own[state] = t
        n = len(own)
        children: list[list[int]] = [[] for _ in range(n)]
        for s in range(1, n):
            children[parent[s]].append(s)
        self.fail, self.ends, self.shorter = [0] * n, [-1] * n, [-1] * self.n
        queue = deque([0])
        while queue:  # by length, so that shorter suffixes are known
            s = queue.popleft()
            queue.extend(children[s])
            if parent[s]:
                f = self.fail[parent[s]]
                while f and (f << 8 | byte[s]) not in self.go:
                    f = self.fail[f]
                self.fail[s] = self.go[f << 8 | byte[s]]
            longest = self.ends[self.fail[s]] if s else -1
            if own[s] >= 0:
                self.shorter[own[s]] = longest
            self.ends[s] = own[s] if own[s] >= 0 else longest
        self.moves = dict(self.go)

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge older than limit joins a and b on their way to being whole."""
        pair, n = self.pair, self.n
        while True:
            if pair.get(a * n + b, limit) < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are when they stand side by side."""
        key = a * self.n + b
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= _PAIRS:
                self.known.clear()
            got = self.known[key] = self._compatible(a, b, self.n)
        return got

    def _move(self, state: int, b: int) -> int:
        """The state after a byte, by failure links; up to _MOVES of these are remembered."""
        at = state
        while (to := self.go.get(at << 8 | b)) is None:
            at = self.fail[at]
        if len(self.moves) >= _MOVES:
            self.moves = dict(self.go)
        self.moves[state << 8 | b] = to
        return to

    def ids(self, piece: bytes) -> list[int]:
        moves, ends, size, shorter, known, n = self.moves, self.ends, self.size, self.shorter, self.known, self.n
        last, state = [0], 0
        for i, b in enumerate(piece, 1):
            state = moves.get(state << 8 | b) or self._move(state, b)
            t = ends[state]
            while j := i - size[t]:
                ok = known.get(last[j] * n + t)
                if ok or ok is None and self.compatible(last[j], t):
                    break
                t = shorter[t]
            last.append(t)
        out, i = [], len(piece)
        while i:
            out.append(self.id[last[i]])
            i -= size[last[i]]
        return out[::-1]


class Vocabulary:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, self.byte_of = told["model"], {x: b for b, x in _byte_letters().items()}
        if model["type"] != "BPE" or told["normalizer"] or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        raw = {k: bytes(map(self.byte_of.__getitem__, k)) for k in model["vocab"]}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.encoder = PrefixEncoder({raw[k]: i for k, i in model["vocab"].items()}, [(raw[a], raw[b]) for a, b in merges])
        added = {x["content"].encode(): x["id"] for x in told["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in told["added_tokens"]):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.added = {k: np.array([i], "<i4").tobytes() for k, i in added.items()}
        self.added_pattern = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")") if added else None
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        pieces = [b""] * (1 + max([*model["vocab"].values(), *added.values()]))
        for k, i in [*((raw[k], i) for k, i in model["vocab"].items()), *added.items()]:
            pieces[i] = k
        pieces.append(b"")  # for ids that the vocabulary lacks
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _recall(self, unit: bytes, make) -> bytes:
        got = self.old.get(unit)
        if got is None:
            got = make(unit)
        if len(unit) <= _CACHE_BYTES:
            if len(self.young) >= _CACHE:
                self.old, self.young = self.young, {}
            self.young[unit] = got
        return got

    def _piece(self, piece: bytes) -> bytes:
        return np.array(self.encoder.ids(piece), "<i4").tobytes()

    def _unit(self, unit: bytes) -> bytes:
        text = unit.decode("utf-8", "replace")
        if m := _PLAIN.fullmatch(text):
            parts = [x.encode() for x in m.groups() if x]
            if len(parts) == 1:
                return self._piece(unit)
            return b"".join(self.young.get(x) or self._recall(x, self._piece) for x in parts)
        return b"".join(self._piece(bytes(map(self.byte_of.__getitem__, letters))) for letters, _ in self.cut(text))

    def _span(self, raw: bytes) -> bytes:
        units = _UNIT.findall(raw)
        got = list(map(self.young.get, units))
        if None in got:
            got = [g if g is not None else self.young.get(u) or self._recall(u, self._unit) for g, u in zip(got, units, strict=True)]
        return b"".join(got)

    def encode(self, text: str) -> bytes:
        """The text's ids, four bytes each."""
        out = []
        for part in self.added_pattern.split(text.encode()) if self.added_pattern else [text.encode()]:
            if part in self.added:
                out.append(self.added[part])
            elif not part.isascii() and _WIDE_SPACE.search(part.decode()):
                out.append(self._unit(part))
            else:
                at = 0
                while at < len(part):
                    to = _SINGLE_SPACE.search(part, at + _SPAN) if at + _SPAN < len(part) else None
                    end = to.start() if to else len(part)
                    out.append(self._span(part[at:end] if at or end < len(part) else part))
                    at = end
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        ids = np.where((ids >= 0) & (ids < len(self.size) - 1), ids, len(self.size) - 1)
        blocks = (ids[at : at + _BLOCK] for at in range(0, len(ids), _BLOCK))
        return b"".join(self.bytes[gather(self.start[x], self.size[x])].tobytes() for x in blocks).decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One of each in a worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            column, first = batch.column(1), 0
            while first < len(column):
                out, sizes, total = [], [], 0
                while first + len(sizes) < len(column) and total < _SPAN:
                    text = column[first + len(sizes)].as_py() or ""
                    out.append(vocab.encode(text))
                    sizes.append(len(out[-1]) // 4)
                    total += len(text)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(out), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)), lists], names=[id_col, "ids"])
                first += len(sizes)

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the text of their ids, in text_col, instead of ids_col."""
    kept = [c for c in rows.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            lists, first = batch.column(len(kept)), 0
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            while first < len(lists):
                last = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), _SPAN, "right")) + first)
                texts = [None if x is None else vocab.decode(x.to_numpy(zero_copy_only=False)) for x in (s.values for s in lists.slice(first, last - first))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, last - first) for i in range(len(kept))), pa.array(texts, pa.string())], names=[*kept, text_col])
                first = last

    schema = StructType([*(rows.schema[c] for c in kept), StructField(text_col, StringType())])
    return rows.select(*(F.col(f"`{c}`") for c in kept), F.col(ids_col)).mapInArrow(run, schema)


def id_digest(ids: str = "ids") -> Column:
    """SHA-256 of the ids as decimal numbers, joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
