import random
from collections import Counter

import pytest

from basalt.llm import substrings
from basalt.llm.store import new_dir


def slow(rows):
    """(id, words, removed words, kept text) of rows in order of id; rows alike in id and text are one."""
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    first, out = {}, {}
    for doc in order:
        words = doc[2].encode().split()
        gone = set()
        for at in range(len(words) - 19):
            key = tuple(words[at : at + 20])
            if first.setdefault(key, (doc, at)) != (doc, at):
                gone.update(range(at, at + 20))
        out[doc] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return Counter((r[0], *out[r[0] is not None, r[0] or 0, r[1] or ""]) for r in rows)


def result(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect())


def test_against_brute_force(spark, no_docs):
    rng = random.Random(4)
    word = lambda: "v%d" % rng.randint(0, 5000)
    passages = [[word() for _ in range(rng.randint(15, 60))] for _ in range(5)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "\t\x0b "]).join(words)))
    rows += [(None, rows[3][1]), (None, None), (70, ""), (71, " ".join(["same"] * 50)), (72, " ".join(["same"] * 19)), (73, rows[5][1]), (73, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 3, 5):
        assert result(substrings.remove_repeats(docs, batches=batches)) == slow(rows)
    assert substrings.remove_repeats(no_docs).count() == 0


def test_one_id_with_two_texts(spark):
    rng = random.Random(6)
    shared = " ".join("s%d" % i for i in range(30))
    rows = [(9, f"a {shared}"), (9, f"b {shared}"), (9, f"a {shared}"), (2, "x " * 10), (3, " ".join("r%d" % rng.randint(0, 9) for _ in range(40)))]
    got = result(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    nine = sorted((k[2], n) for k, n in got.items() if k[0] == 9)
    assert sum(n for _, n in nine) == 3 and sorted({k for k, _ in nine}) == [0, 30]


def test_odd_tables(odd_docs):
    got = substrings.remove_repeats(odd_docs)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_text", "removed"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    # the null id comes first, so its text stays and the same text under other ids goes
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows if r["n_words"] == 80 and r["doc_id"]) == [(1, 80), (1, 80), (2, 80)]
    assert [list(map(tuple, r["removed"])) for r in rows if r["doc_id"] == 2] == [[(0, 80)]]


def test_unlike_words_of_one_polynomial_hash(spark, twins):
    around = ["u%d" % i for i in range(22)]
    texts = [" ".join([*around[:11], w, *around[11:]]) for w in twins]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substrings.remove_repeats(docs)) == slow(rows)
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 23}


def test_forgotten_digests_and_small_chunks(spark, monkeypatch):
    rng = random.Random(8)
    base = ["w%d" % rng.randint(0, 300) for _ in range(400)]
    rows = [(i, " ".join(base[(a := rng.randint(0, 300)) : a + rng.randint(10, 100)])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow(rows)
    monkeypatch.setattr(substrings, "SEEN", 7)
    monkeypatch.setattr(substrings, "_CHUNK", 64)
    assert result(substrings.remove_repeats(docs, batches=2)) == want


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, part long, text string")


def places(repeats):
    """{id: first words of windows that are repeats}"""
    return {r["id"]: sorted({*r["places"], *(x for a, b in zip(r["known"][::2], r["known"][1::2]) for x in range(a, b))}) for r in repeats.collect()}


def test_runs_are_compacted_before_they_are_probed(spark):
    index = substrings.FingerprintIndex(spark, new_dir(spark, "index"), 4)
    text = " ".join("t%d" % i for i in range(40))
    assert places(index.add(batch(spark, (1, 0, text)))[1]) == {}
    got = [places(index.add(batch(spark, (i, 0, text if i % 2 else "other " * 3)))[1]) for i in range(2, 8)]
    assert got == [{i: list(range(21))} if i % 2 else {} for i in range(2, 8)]
    assert len(index.levels) > 1 and all(len(level) <= substrings.FANOUT for level in index.levels)
    assert len(index.segments) == 7
    with pytest.raises(ValueError, match="follow"):
        index.add(batch(spark, (3, 0, text)))
    index.drop_runs()
    assert index.levels == [[]]


def test_an_index_that_is_opened_again(spark):
    path = new_dir(spark, "index")
    text = " ".join("t%d" % i for i in range(30))
    first = substrings.FingerprintIndex(spark, path, 4)
    first.add(batch(spark, (1, 0, text), (2, 0, "other " * 25)))
    first.close()
    second = substrings.FingerprintIndex(spark, path)
    assert second.buckets == 4 and second.last == [2, 0]
    got = places(second.add(batch(spark, (3, 0, "x " + text), (4, 0, "new " * 19), (5, 0, "other " * 20)))[1])
    assert got == {3: list(range(1, 12)), 5: [0]}
    third = substrings.FingerprintIndex(spark, path)
    got = places(third.add(batch(spark, (6, 0, text), (7, 0, "other " * 21)))[1])
    assert got == {6: list(range(11)), 7: [0, 1]}
    for index in (second, third):
        index.close()


def test_only_segments_with_candidates_are_read(spark, monkeypatch):
    index = substrings.FingerprintIndex(spark, new_dir(spark, "index"), 4)
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abc"]
    for i, text in enumerate(texts):
        index.add(batch(spark, (2 * i, 0, text), (2 * i + 1, 0, "short text")))
    read, table = [], index.table
    monkeypatch.setattr(index, "table", lambda name: (read.append(name), table(name))[1])
    segment, repeats = index.add(batch(spark, (10, 0, " ".join("d%d" % i for i in range(40)))))
    assert places(repeats) == {}
    assert {x for x in read if x.startswith("segment")} == {segment}
    read.clear()
    segment, repeats = index.add(batch(spark, (11, 0, "x " + texts[1])))
    assert places(repeats) == {11: list(range(1, 22))}
    assert {x for x in read if x.startswith("segment")} == {segment, index.segments[1]}
    index.close()
