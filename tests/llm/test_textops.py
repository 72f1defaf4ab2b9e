import random

import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import quality
from basalt.llm.textops import Chunk, byte_hashes, chunks, kinds, same_bytes


def chunk(texts):
    (c,) = chunks(pa.array(texts, pa.string()))
    return c


def test_words_are_told_apart_by_bytes(twins):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab\u00e9") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(400)]
    words += [twins[0], twins[1], twins[0], "a" * 5000, "a" * 5000 + "b", "a" * 5000]
    c = chunk([" ".join(words), "\t".join(words[::-1])])
    want = words + words[::-1]
    for hashes in (c.word_hashes, np.zeros(len(c.starts), np.uint64), c.word_hashes % np.uint64(3)):
        first, kind = kinds(c.data, c.starts, c.ends, hashes)
        assert [want[i] for i in first[kind].tolist()] == want and len(first) == len(set(want))


def test_hashes_depend_on_the_bytes_alone(twins):
    a, b = chunk(["x " + " ".join(twins) + " longer-than-eight-bytes"]), chunk(["longer-than-eight-bytes", " ".join(twins)])
    assert a.word_hashes[1] == b.word_hashes[1] and a.word_hashes[3] == b.word_hashes[0]
    assert len(set(a.word_hashes.tolist())) == 4
    assert len(byte_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
    data = np.frombuffer(b"abcabd" + b"q" * 100, np.uint8)
    at = np.array([0, 0, 6, 6]), np.array([3, 3, 56, 56]), np.array([3, 0, 56, 50]), np.array([6, 3, 106, 101])
    assert same_bytes(data, *at).tolist() == [False, True, True, False]


def test_repeated_windows_survive_equal_hashes(monkeypatch):
    rng = random.Random(5)
    text = " ".join(str(rng.randint(0, 2)) for _ in range(300))
    c = chunk([text, "only one two three four five six seven", text[:60]])
    at = c.windows(8)
    want = quality._repeated(c, at)
    monkeypatch.setattr(Chunk, "window_hashes", lambda self, at, k: np.zeros(len(at), np.uint64))
    assert want.any() and (quality._repeated(c, at) == want).all()


@pytest.mark.parametrize("size", [1, 64, 1 << 18])
def test_spaced_words(size):
    texts = ["a  bb\nccc ", None, "", " \u00e9 ", "x" * 70]
    for c in chunks(pa.array(texts, pa.string()), size):
        line, begin, end = c.spaced()
        got = [line[a:b] for a, b in zip(begin, end, strict=True)]
        assert got == [w for t in texts[c.first : c.last] for w in (t or "").encode().split()]
        assert line == b"".join(w + b" " for w in got)
