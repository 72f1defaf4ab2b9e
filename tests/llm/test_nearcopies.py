import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basalt.llm import nearcopies


def shingles_of(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def slow_components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(rng, words, n, tag):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"{tag}x{at}"
    return " ".join(words)


def test_pipeline_stage_against_brute_force(spark, odd_docs):
    rng = random.Random(5)
    base = [["w%d" % rng.randint(0, 500) for _ in range(200)] for _ in range(4)]
    rows = [(100 + i, edited(rng, base[i % 4], rng.randint(0, 12), f"e{i}")) for i in range(80)]
    rows += [(300, "a B c d"), (301, "A b C d"), (302, "a b c e")]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = docs.collect()
    sets = [shingles_of(r["text"]) for r in got]
    roots = slow_components(sets)
    linked = sum(sets[i] != sets[j] and similar(sets[i], sets[j]) for i in range(len(sets)) for j in range(i))
    assert linked > 50
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    members = {}
    for r, root in zip(got, roots, strict=True):
        members.setdefault(root, []).append(r["doc_id"])
    want = Counter(min((i is None, i) for i in ids)[1] for ids in members.values())
    assert Counter(r["doc_id"] for r in kept) == want


@pytest.mark.parametrize("stars, block, shingles", [(1, 1024, 500_000), (0, 1024, 500_000), (0, 7, 500_000), (1, 1024, 900), (2, 3, 900)])
def test_many_copies_and_unlike_pairs_in_one_band(spark, monkeypatch, stars, block, shingles):
    monkeypatch.setattr(nearcopies, "STARS", stars)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(nearcopies, "SPREAD", 1 + block % 10)
    rng = random.Random(6)
    base = ["v%d" % rng.randint(0, 5000) for _ in range(150)]
    rows = [(i, edited(rng, base, rng.choice([1, 2, 3, 6]), f"m{i}")) for i in range(60)]
    sets = [shingles_of(t) for _, t in rows]
    want = {i for i, root in enumerate(slow_components(sets)) if i == root}
    assert 1 < len(want) < 60
    kept = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == want


def test_similar_pairs_and_forests():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))).astype(np.uint64) for _ in range(40)]
    sets += [sets[3], np.append(sets[3], np.uint64(99)), np.arange(5000, dtype=np.uint64), np.arange(4800, dtype=np.uint64)]
    got = nearcopies.similar_pairs(sets)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i != j:
                x2, y2 = set(x.tolist()), set(y.tolist())
                assert got[i, j] == (5 * len(x2 & y2) >= 4 * len(x2 | y2))
    links = nearcopies.forest(got | got.T)
    assert len(links) == len(set(links)) < len(sets) and all(got[i, j] for i, j in links)


def test_signatures_of_similar_sets_agree():
    rng = np.random.default_rng(2)
    for _ in range(40):
        both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        sets = [np.unique(np.append(both, rng.integers(0, 1 << 63, 50, dtype=np.uint64))) for _ in range(2)]  # 0.8
        _, _, signs = nearcopies.sketches(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        x = signs[0] ^ signs[1]
        unlike = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(nearcopies._PAIRS_OF_BITS)).sum()
        assert unlike <= nearcopies.BANDS * nearcopies.ROWS - nearcopies.AGREE


def test_keeps_columns_and_empty_tables(odd_docs, no_docs):
    assert nearcopies.keep_one(odd_docs).columns == odd_docs.columns
    assert nearcopies.keep_one(no_docs).count() == 0


def test_fingerprints_link_without_bands(spark):
    rng = random.Random(9)
    base = [["u%d" % rng.randint(0, 5000) for _ in range(900)] for _ in range(3)]
    rows = [(i, edited(rng, base[i % 3], i // 6, f"q{i}")) for i in range(24)] + [(24, "z y x"), (25, "")]
    docs = nearcopies.in_files(spark.createDataFrame(rows, "doc_id long, text string"))
    slim = docs.select(*nearcopies.place(), F.col("doc_id").alias("id"), "text")
    sketched = nearcopies._sketched(slim)
    prints = {r["id"]: r["fp"] for r in sketched.collect()}
    c = next(nearcopies.chunks(pa.array([t for _, t in rows])))
    hashes, bounds = nearcopies.shingle_sets(c)
    for i in prints:
        own = hashes[bounds[i] : bounds[i + 1]].tolist()
        assert prints[i] % (1 << 64) == sum((2 * sum(h >> j & 1 for h in own) > len(own)) << j for j in range(64))
    classes = sketched.where("n > 0").select("id", "n", "h", "fp", F.filter("bands", lambda x: F.lit(False)).alias("bands"), "sig", F.struct("file", "row").alias("first"))
    want = {}
    for i in range(24):
        near = [j for j in range(24) if (prints[i] ^ prints[j]).bit_count() <= nearcopies.TAU]
        group = set(near).union(*(want.get(j, ()) for j in near))
        want |= dict.fromkeys(group, group)
    got = {r["node"]: r["root"] for r in nearcopies.components(classes, slim).collect()}
    of = {r["id"]: got.get(r["h"], r["h"]) for r in sketched.select("id", "h").collect()}
    assert max(map(len, want.values())) > 4
    sets = [shingles_of(t) for _, t in rows]
    assert all(similar(sets[i], sets[j]) for i in want for j in range(24) if (prints[i] ^ prints[j]).bit_count() <= nearcopies.TAU)
    for i in range(24):
        assert {j for j in range(26) if of[j] == of[i]} == want[i]
