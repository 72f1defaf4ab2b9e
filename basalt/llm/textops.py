"""Word positions and hashes of whole Arrow string columns, in numpy, over bounded chunks.

Words are runs of bytes outside space and 0x09-0x0D. All of those are ASCII, so bytes of UTF-8 split as code points do."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 18

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_WORD_BASE = 0xD6E8FEB86659FD93
_LANE, _LONG = 8, 64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(_LANE + 1)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; the tables grow as needed."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        made = []
        for x in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, x, np.uint64)
            row[0] = 1
            made.append(np.cumprod(row, dtype=np.uint64))
        _powers[base] = tuple(made)
    return tuple(x[:n] for x in _powers[base])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(_LANE, np.uint8)]), 0, (1,))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: eight bytes after the other, every step mixed; XXH64 over _LONG bytes."""
    view, length = _lanes(data), ends - starts
    h = mix((view[starts] & _MASKS[np.minimum(length, _LANE)]) ^ (length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    at, more = _LANE, np.flatnonzero(length > _LANE)
    while len(more) and at < _LONG:
        lane = view[starts[more] + at] & _MASKS[np.minimum(length[more] - at, _LANE)]
        h[more] = mix(h[more] * np.uint64(0x9E3779B97F4A7C15) ^ lane)
        at += _LANE
        more = more[length[more] > at]
    for i in more.tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether data[a:a_end] and data[b:b_end] hold the same bytes."""
    view, length = _lanes(data), a_end - a
    same = length == b_end - b
    at, left = 0, np.flatnonzero(same & (a != b))
    while len(left) and at < _LONG:
        unlike = (view[a[left] + at] ^ view[b[left] + at]) & _MASKS[np.minimum(length[left] - at, _LANE)]
        same[left] = unlike == 0
        at += _LANE
        left = left[(unlike == 0) & (length[left] > at)]
    for i in left.tolist():
        same[i] = data[a[i] + at : a_end[i]].tobytes() == data[b[i] + at : b_end[i]].tobytes()
    return same


def kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, kind): spans first[k] all differ, and span i holds the bytes of span first[kind[i]]. Hashes only propose."""
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    kind = kind.ravel()
    of = first[kind]
    if not same_bytes(data, starts, ends, starts[of], ends[of]).all():
        seen: dict[bytes, int] = {}
        kind = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(kind, return_index=True)[1]
    return first, kind


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each values[start:end], from one running sum; for values that are hashes themselves, over short spans."""
    n = len(values)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Chunk:
    """Rows first..last of a column: their bytes, where each text begins (one more entry for the end), and their words."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        word = ~_SEPARATOR[self.data]
        n = len(word)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[inner] = False
        after[inner - 1] = False
        return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._words[0]

    @property
    def ends(self) -> np.ndarray:
        return self._words[1]

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Words of text i: word_offsets[i] to word_offsets[i + 1]."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, kind): the chunk's different words by their first places, and which of them each word is, byte by byte."""
        return kinds(self.data, self.starts, self.ends, self.word_hashes)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.word_offsets))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return byte_hashes(self.data, starts, ends)

    def windows(self, k: int) -> np.ndarray:
        """First words of all runs of k words that stay in one text."""
        ends = np.repeat(self.word_offsets[1:], np.diff(self.word_offsets))
        at = np.arange(len(self.starts))
        return at[at + k <= ends]

    def window_hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        return span_hashes(self.word_hashes, at, at + k, _WORD_BASE)

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(line, begin, end): all words with one space after each, and where each word stands in that line."""
        length = self.ends - self.starts
        line = np.append(self.data, np.uint8(32))[gather(self.starts, length + 1)]
        end = np.cumsum(length + 1) - 1
        line[end] = 32
        return line.tobytes(), end - length, end

    def per_text(self, mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """How many entries of mask are set in each text; bounds are offsets or word_offsets."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Pieces of about size bytes, at least one text each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield Chunk(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of the distinct places at."""
    step = np.zeros(n + 1, np.int64)
    step[at] += 1
    step[at + k] -= 1
    return np.cumsum(step[:n]) > 0


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all the ranges start..start+length, one after the other."""
    total = np.cumsum(lengths)
    out = np.arange(total[-1] if len(total) else 0)
    return out + np.repeat(starts - (total - lengths), lengths)
