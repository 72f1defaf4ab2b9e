"""Best-fit decreasing packing of token sequences.

Only lengths matter to the packer, and there are at most CAPACITY of them. So the driver runs best-fit decreasing on the histogram of
lengths: open bins with equal room are interchangeable and are kept as intervals of sequence numbers, a segment tree over the remaining
capacities finds the tightest open bin in logarithmic time, and equal documents that go to equal bins are placed together. The result is
exactly what one document after the other would give. It is a table of ranges whose size depends on CAPACITY alone, and each piece finds
its place in it by its rank among the pieces of its length. Ranks come from counts by task of a written table.

Defined cases: a null text counts as empty and packs as the end token alone; ids may be null or repeat, each row is packed; pieces of one length take their places by task and row;
an empty table
gives an empty result; documents over CAPACITY tokens are cut into full pieces and a last one that may be shorter; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.quality import give_back
from basalt.llm.store import staged
from basalt.llm.textops import Chunk, chunks, gather

CAPACITY, END = 2048, 0
_CACHE_WORDS = 300_000
_CHUNK = 1 << 22  # a chunk's different words are looked up once each, so larger ones have less to look up, but are held whole
_BLOCK = 1 << 16
_SHIFT = 50
# Latin letters that NFC leaves alone and whose lower case is one character; then ASCII punctuation without the apostrophe.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PARTS = "([A-Za-zÀ-ÖØ-öø-įĲ-ſ]*)([!-&(-/:-@\\[-`{-~]*)"
_PLAIN, _LINES = re.compile(_PARTS), re.compile(_PARTS + "(.*)\n")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes are themselves, others count up from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Generations:
    """A bounded cache: what isn't asked for while _CACHE_WORDS others are is forgotten."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value):
        if len(self.young) >= _CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class WordTokenizer:
    """Token ids of single words. The tokenizer's pattern and normaliser never cross ASCII white space, so a text's ids are its words' ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = str.maketrans({chr(b): x for b, x in _byte_letters().items()})
        self.words = Generations()
        self.parts = Generations()

    def _part(self, s: str) -> bytes:
        """The ids as 32-bit numbers: there are hundreds of thousands of parts in the cache, and a list of as many takes three times the memory."""
        got = self.parts.get(s)
        if got is None:
            raw = s if s.isascii() else s.encode().decode("latin-1").translate(self.letters)
            got = self.parts.put(s, array("I", [t.id for t in self.model.tokenize(raw)]).tobytes())
        return got

    def ids(self, word: bytes) -> list[int]:
        got = self.words.get(word)
        if got is None:
            got = self.words.put(word, self._cut(word))
        return got

    def lists(self, lines: str) -> list[list[int]]:
        """The ids of each word, as ids() has them; a word and \\n on each line."""
        return [array("I", x).tolist() for x in self.packed(lines)]

    def packed(self, lines: str) -> list[bytes]:
        """What lists() has, as 32-bit numbers. Parts are told by one expression for all, and words of plain letters share them."""
        known, out = self.parts.young.get, []
        for letters, marks, rest in _LINES.findall(lines):
            if rest:
                out.append(array("I", self.ids((letters + marks + rest).encode())).tobytes())
            elif letters:
                got = known(lower := letters.lower()) or self._part(lower)
                out.append(got + (known(marks) or self._part(marks)) if marks else got)
            else:
                out.append(known(marks) or self._part(marks))
        return out

    def _cut(self, word: bytes) -> list[int]:
        # one run of letters, then one of punctuation, is what the pattern would split
        core = word.rstrip(_MARKS)
        if core.isalpha():  # ASCII
            marks = word[len(core) :].decode()
            return array("I", self._part(core.lower().decode()) + (self._part(marks) if marks else b"")).tolist()
        text = word.decode("utf-8", "replace")
        if m := _PLAIN.fullmatch(text):
            letters, marks = m.groups()
            return array("I", (self._part(letters.lower()) if letters else b"") + (self._part(marks) if marks else b"")).tolist()
        return self.whole.encode(text, add_special_tokens=False).ids


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_ids(c: Chunk, tok: WordTokenizer) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a chunk with END after each text, and where each text's ids begin (one more for the end). Words are cut and copied _BLOCK at a time."""
    first, kind = c.words
    data, cut, sizes = np.append(c.data, np.uint8(10)), [], []
    for a in range(0, len(first), _BLOCK):
        at = first[a : a + _BLOCK]
        length = c.ends[at] - c.starts[at] + 1
        lines = data[gather(c.starts[at], length)]
        lines[np.cumsum(length) - 1] = 10
        packed = tok.packed(lines.tobytes().decode("utf-8", "replace"))
        sizes.append(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)
        cut.append(np.frombuffer(b"".join(packed), np.uint32))
    flat, each = np.concatenate([*cut, np.array([END], np.uint32)]), np.concatenate([*sizes, np.ones(1, np.int64)])
    begin = np.cumsum(each) - each
    units = np.insert(kind.astype(np.int32), c.word_offsets[1:], len(first))
    total = np.concatenate([[0], np.cumsum(each[units])])
    ids = np.empty(total[-1], np.uint32)
    for a in range(0, len(units), _BLOCK):
        some = units[a : a + _BLOCK]
        ids[total[a] : total[a + len(some)]] = flat[gather(begin[some], each[some])]
    return ids, total[c.word_offsets + np.arange(c.last - c.first + 1)]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ChunkedArray]]:
    """(first columns, texts) of consecutive batches, as many as have _CHUNK bytes of text together, one at least."""
    held, size = [], 0
    for batch in batches:
        text = batch.column(1).cast(pa.large_string())
        if held and size + text.nbytes > _CHUNK:
            yield pa.concat_arrays([a for a, _ in held]), pa.chunked_array([b for _, b in held])
            held, size = [], 0
        held.append((batch.column(0), text))
        size += text.nbytes
    if held:
        yield pa.concat_arrays([a for a, _ in held]), pa.chunked_array([b for _, b in held])


def pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, rank): rank counts the task's pieces of the same length."""

    def rows(keys: pa.Array, c: Chunk, seen: np.ndarray) -> pa.RecordBatch:
        ids, bounds = token_ids(c, tokenizer(vocabulary))
        size = np.diff(bounds)
        count = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), count)
        piece = gather(np.zeros(len(size), np.int64), count)
        start = piece * capacity
        length = np.minimum(capacity, size[row] - start)
        at = bounds[row] + start
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
        order = np.argsort(length, kind="stable")
        ordered = length[order]
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered)
        rank += seen[length]
        np.add.at(seen, length, 1)
        task = np.full(len(row), TaskContext.get().partitionId(), np.int32)
        return pa.RecordBatch.from_arrays(
            [keys.slice(c.first, c.last - c.first).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(task), pa.array(rank)],
            names=["id", "piece", "start", "length", "ids_crc32", "task", "rank"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for keys, texts in _together(batches):
            yield from map(partial(rows, keys, seen=seen), chunks(texts, _CHUNK))  # holds no chunk while the next is made
            give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


class SegmentTree:
    """Which capacities 0..n have open bins; tightest(r) is the smallest such capacity >= r, or -1, in logarithmic time."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = np.zeros(2 * self.size, bool)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, room: int) -> int:
        i = room + self.size
        if self.open[i]:
            return room
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, rank, each, sequence, offset): from rank on, each pieces of that length per bin go to the bins from sequence on."""
    tree, bins, out, opened = SegmentTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                # best fit opens a bin only when none fits; equal new ones are opened at once
                room, each = capacity, capacity // length
                number = -(-left // each)
                bins[room], opened = [(opened, number)], opened + number
                tree.set(room, True)
            each = room // length
            first, number = bins[room].pop()
            full = min(number, left // each)
            if full:
                out.append((length, rank, each, first, capacity - room))
                rest = room - each * length
                bins.setdefault(rest, []).append((first, full))
                tree.set(rest, True)
                left, rank, first, number = left - full * each, rank + full * each, first + full, number - full
            if left and number and left < each:
                out.append((length, rank, left, first, capacity - room))
                rest = room - left * length
                bins.setdefault(rest, []).append((first, 1))
                tree.set(rest, True)
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            if number:
                bins[room].append((first, number))
            if not bins[room]:
                tree.set(room, False)
    return np.array(out, np.int64).reshape(-1, 5)


def places(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces with these lengths and ranks."""
    keys = (table[:, 0] << _SHIFT) + table[:, 1]
    order = np.argsort(keys)
    row = table[order][np.searchsorted(keys[order], (length << _SHIFT) + rank, "right") - 1]
    inside = rank - row[:, 1]
    return row[:, 3] + inside // row[:, 2], row[:, 4] + inside % row[:, 2] * length


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece of each document."""
    cut = staged(pieces(docs, vocabulary, id_col=id_col, text_col=text_col, capacity=capacity), "pieces")
    counts = staged(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    shared = cut.sparkSession.sparkContext.broadcast(best_fit_decreasing(total, capacity))  # bounded by capacity alone
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = places(shared.value, batch.column("length").to_numpy(), rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return cut.join(base, ["task", "length"]).mapInArrow(place, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
