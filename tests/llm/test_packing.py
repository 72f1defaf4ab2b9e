import bisect
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from basalt.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def naive_bins(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return sorted(rooms)


def test_counts_give_what_one_by_one_gives():
    rng = random.Random(5)
    for capacity in (7, 20, 64):
        for _ in range(60):
            lengths = [rng.randint(1, rng.choice([3, capacity])) for _ in range(rng.randint(0, 120))]
            table = packing.best_fit_decreasing(Counter(lengths), capacity)
            ranks, seen = [], Counter()
            for n in lengths:
                ranks.append(seen[n])
                seen[n] += 1
            if not lengths:
                assert len(table) == 0
                continue
            sequence, offset = packing.places(table, np.array(lengths), np.array(ranks))
            used = {}
            for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths, strict=True)):
                assert used.get(s, 0) == o
                used[s] = o + n
            assert sorted(capacity - u for u in used.values()) == naive_bins(lengths, capacity)


def test_segment_tree():
    tree, model, rng = packing.SegmentTree(33), set(), random.Random(1)
    for _ in range(2000):
        c = rng.randint(0, 33)
        on = rng.random() < 0.4
        tree.set(c, on)
        (model.add if on else model.discard)(c)
        r = rng.randint(0, 33)
        assert tree.tightest(r) == min((x for x in model if x >= r), default=-1)


def test_pieces_and_ids(spark, odd_docs, no_docs, sf, twins):
    extra = spark.createDataFrame([(29, " ".join((*twins, twins[0]))), (30, "It's <|endoftext|> ŒUVRE naïve İstanbul é ﬁ 'tis x<|startoftext|>y 42% a b don't!?"), (31, "Σας ΣΑΣ ς 1/2 ½ ²")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(extra).union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    tok, want = Tokenizer.from_file(PATH), Counter()
    for r in docs.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[r["doc_id"], k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack(docs, PATH).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048 and len(used) == len(naive_bins([r["length"] for r in got], 2048))
    assert packing.pack(no_docs, PATH).count() == 0


def test_a_word_is_cut_once(monkeypatch):
    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    words = [w.encode() for w in ("plain", "Word,", "ÉTÉ.", "a-b", "x1")]
    first = [tok.ids(w) for w in words]
    assert first == [tok.whole.encode(w.decode(), add_special_tokens=False).ids for w in words]
    monkeypatch.setattr(tok, "_part", None)
    assert [tok.ids(w) for w in words] == first


def test_plain_words_are_cut_together(monkeypatch):
    tok = packing.WordTokenizer(PATH)
    words = ["plain", "Word,", "word", "ÉTÉ.", "été", "a-b", "x1", "...", "don't", "İx", "ﬁn", "a b", "\u0085", "中文!", "ét", "(so)", "?!x"]
    want = [tok.whole.encode(w, add_special_tokens=False).ids for w in words]
    odd, one = [], tok.ids
    monkeypatch.setattr(tok, "ids", lambda w: odd.append(w.decode()) or one(w))
    assert tok.lists("".join(w + "\n" for w in words)) == want
    assert not {"plain", "Word,", "word", "ÉTÉ.", "été", "..."} & set(odd)
    text = " ".join(words * 3)
    (c,) = packing.chunks(pa.array([text, None, "plain"]))
    ids, bounds = packing.token_ids(c, tok)
    assert ids[: bounds[1]].tolist() == [*(i for x in want * 3 for i in x), packing.END] and bounds.tolist()[1:] == [bounds[1], bounds[1] + 1, len(ids)]


def test_batches_meet_in_one_chunk(monkeypatch):
    monkeypatch.setattr(packing, "_CHUNK", 100)
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([i, None]), "text": ["x" * n, None]}) for i, n in enumerate((10, 20, 300, 5))]
    got = list(packing._together(iter(batches)))
    assert [k.to_pylist() for k, _ in got] == [[0, None, 1, None], [2, None], [3, None]]
    assert [[len(x or "") for x in t.to_pylist()] for _, t in got] == [[10, 0, 20, 0], [300, 0], [5, 0]]


def test_a_worker_holds_little():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=12)) for _ in range(60_000)]
    text = " ".join([*words, *words])
    tok = packing.WordTokenizer(PATH)
    (c,) = packing.chunks(pa.array([text]), len(text))
    tracemalloc.start()
    try:
        ids, _ = packing.token_ids(c, tok)
        del c
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(tok.parts.young) == len(set(words))
    assert held - ids.nbytes < 240 * len(words)  # a part and its ids
    assert peak < 28 * len(text)


def test_blocks_of_words_change_nothing(monkeypatch):
    texts = pa.array(["Some words, some MORE words; été x1", None, "", "words " * 30, "the last"])
    (c,) = packing.chunks(texts)
    want = [x.tolist() for x in packing.token_ids(c, packing.tokenizer(PATH))]
    monkeypatch.setattr(packing, "_BLOCK", 3)
    assert [x.tolist() for x in packing.token_ids(c, packing.tokenizer(PATH))] == want
    whole = Tokenizer.from_file(PATH)
    assert want[0] == [i for x in texts.to_pylist() for i in [*whole.encode(x or "", add_special_tokens=False).ids, packing.END]]
