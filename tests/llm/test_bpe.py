import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from basalt.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", " the", "A", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", " ", "​", "　", "1", "23", "²", "٣", "Ⅷ", "é", "é", "ª", "ß", "漢", "字", "\U0001f600", "'s", "'ll", "'", "’", "$$$", ".", "____", "aaaa", "<|endoftext|>", "<|end", "|>", "\x00", "﻿"]


def model(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def test_random_texts_encode_and_decode_as_the_library_does():
    rng, tok, vocab = random.Random(7), Tokenizer.from_file(PATH), bpe.Vocabulary(PATH)
    for _ in range(8000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        got = np.frombuffer(vocab.encode(text), "<i4")
        assert (got.tolist(), vocab.decode(got)) == model(tok, text), repr(text)


def merged(piece, merges, n):
    """Merges one after the other, the oldest first, from the left."""
    parts = [bytes([b]) for b in piece]
    rank = {(a, b): i for i, (a, b) in enumerate(merges)}
    while len(parts) > 1:
        best = min(((rank.get(p, n), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(n, 0))
        if best[0] == n:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_small_vocabularies_against_one_merge_after_the_other():
    rng = random.Random(3)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        merges, letters = [], [b"a", b"b", b"c"]
        pool = list(letters)
        for _ in range(rng.randint(1, 25)):
            a, b = rng.choice(pool), rng.choice(pool)
            if a + b not in pool:
                merges.append((a, b))
                pool.append(a + b)
        ids = {t: i for i, t in enumerate(tokens + [a + b for a, b in merges])}
        encoder = bpe.PrefixEncoder(ids, merges)
        for _ in range(60):
            piece = b"".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
            assert encoder.ids(piece) == [ids[p] for p in merged(piece, merges, len(merges))]


def test_vocabularies_must_make_new_tokens():
    ids = {bytes([b]): b for b in range(256)} | {b"aa": 256}
    with pytest.raises(ValueError, match="new token"):
        bpe.PrefixEncoder(ids, [(b"a", b"a"), (b"a", b"a")])


def test_whole_tables(spark, sf, odd_docs, no_docs, monkeypatch):
    extra = spark.createDataFrame([(30, "x" * 100_000 + " end"), (31, "word " * 90_000), (32, " \n" * 500 + "a\xa0 b　　c"), (33, "<|endoftext|><|endoftext|> a<|endoftext|>b")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(extra).union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    tok = Tokenizer.from_file(PATH)
    want = Counter((r["doc_id"], *map(str, model(tok, r["text"]))) for r in docs.collect())
    encoded = bpe.encode(docs, PATH).withColumnsRenamed({"doc_id": "text"})  # a clash with the column that decode() adds is the caller's to avoid
    got = bpe.decode(encoded, PATH, text_col="decoded").join(encoded.limit(0), "text", "left_anti")
    assert got.columns == ["text", "decoded"]
    pairs = bpe.encode(docs, PATH).select("doc_id", "ids", F.col("ids").alias("kept"))
    assert Counter((r["doc_id"], str(r["kept"]), r["text"]) for r in bpe.decode(pairs, PATH).collect()) == want
    assert bpe.encode(odd_docs, PATH).columns == ["doc_id", "ids"] and bpe.encode(no_docs, PATH).count() == 0
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0


def test_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [50256, 64, 99_999, -1, 65]), (4, [127, 128, 222])], "doc_id long, ids array<int>")
    tok = Tokenizer.from_file(PATH)
    want = {1: None, 2: "", 3: tok.decode([50256, 64, 65], skip_special_tokens=False), 4: tok.decode([127, 128, 222], skip_special_tokens=False)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(rows, PATH).collect()} == want


def test_spans_and_forgetting_change_nothing(monkeypatch):
    rng, tok = random.Random(1), Tokenizer.from_file(PATH)
    text = "".join(rng.choice(PARTS[:12] + PARTS[17:]) + rng.choice(["", " "]) for _ in range(4000))
    for name, value in (("_SPAN", 50), ("_CACHE", 20), ("_PAIRS", 30), ("_MOVES", 10), ("_BLOCK", 7)):
        monkeypatch.setattr(bpe, name, value)
    vocab = bpe.Vocabulary(PATH)
    got = np.frombuffer(vocab.encode(text), "<i4")
    assert (got.tolist(), vocab.decode(got)) == model(tok, text)


def test_query(spark, sf):
    tok, sha = Tokenizer.from_file(PATH), lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, text = model(tok, r["text"])
        want.add((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(text)))
    got = entry.queries()["op11_bpe_encoding"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and set(map(tuple, got.collect())) == want
