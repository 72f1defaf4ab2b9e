import random
from collections import Counter

import public_tokenizers
import pytest

from basalt.llm import wordpieces

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(text, pieces, longest):
    n = i = 0
    while i < len(text):
        j = min(len(text), i + longest)
        while text[i:j] not in pieces:
            j -= 1
        n, i = n + 1, j
    return n


def test_small_vocabularies():
    rng = random.Random(2)
    for _ in range(40):
        vocabulary = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(0, 12))}
        match = wordpieces.LongestMatch(vocabulary)
        for _ in range(60):
            text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
            assert match.count(text) == greedy(text, vocabulary, 6)
    with pytest.raises(ValueError, match="byte"):
        wordpieces.LongestMatch({b"a"})


def test_against_brute_force(spark, odd_docs, no_docs, sf, twins):
    unlike = spark.createDataFrame([(40, f"{twins[0]} {twins[1].upper()} {twins[1]}")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(unlike).union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60))
    pieces = set(wordpieces.read_vocabulary(PATH))
    longest = max(map(len, pieces))
    want = Counter()
    for r in docs.collect():
        each = [greedy(b" " + w, pieces, longest) for w in (r["text"] or "").encode().split()]
        want[r["doc_id"], len(each), sum(each), max(each, default=0)] += 1
    assert Counter(map(tuple, wordpieces.count_pieces(docs, PATH).collect())) == want
    assert wordpieces.count_pieces(no_docs, PATH).count() == 0
