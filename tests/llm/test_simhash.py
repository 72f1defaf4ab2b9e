import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from basalt.llm import components, simhash
from basalt.llm.components import connected_components


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def slow_components(ids, prints, tau=2):
    least = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if least[j] is not None and (prints[i] ^ prints[j]).bit_count() <= tau and (least[i] is None or least[j] < least[i]):
                    least[i], changed = least[j], True
    return least


def test_against_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(3)
    base = [" ".join("w%d" % rng.randint(0, 500) for _ in range(200)) for _ in range(4)]
    near = []
    for i in range(40):
        words = base[i % 4].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "new%d" % i
        near.append((100 + i, " ".join(words)))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = docs.collect()
    prints = [slow_print(r["text"]) for r in rows]
    want = Counter(zip([r["doc_id"] for r in rows], [f"{p:016x}" for p in prints], slow_components([r["doc_id"] for r in rows], prints), strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert len({c for _, _, c in want}) < len(want)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(set(slow_components(range(len(rows)), prints)))


def test_keep_one_keeps_columns(odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sum(r["doc_id"] in (1, 2) for r in kept.collect()) == 1


def test_plan_loses_no_pair():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for n in (1000, 10**7, 10**11):
        chosen = simhash.plan(sample, n)
        bits = [b for p, _ in chosen for b in p]
        assert len(bits) == len(set(bits))
        for a in sample[:60].tolist():
            flips = rng.choice(64, rng.integers(0, 3), replace=False)
            b = a
            for f in flips.tolist():
                b ^= 1 << f
            assert any(((a ^ b) & int(simhash._mask(p))).bit_count() <= t for p, t in chosen)


def test_allocation_by_dynamic_programming():
    costs = [[0, 5, 9], [0, 1, 9], [0, 7, 8]]
    cost, chosen = simhash.allocate(costs, -1)
    assert (cost, chosen) == (6, [0, 0, -1])


@pytest.mark.parametrize("limit", [4, 1024])
def test_large_groups_are_refined(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP", limit)
    rng = random.Random(2)
    center, prints = rng.getrandbits(64), set()
    for _ in range(120):
        p = center
        for b in rng.sample(range(64), rng.randint(0, 3)):
            p ^= 1 << b
        prints.add(p)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    rows = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.groups(rows).collect()}
    want = slow_components(signed, [p & (1 << 64) - 1 for p in signed])
    assert got == dict(zip(signed, want, strict=True))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3), (102, 100), (100, 102)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_what_is_flat_already_costs_no_round(spark, monkeypatch):
    rounds, step = [], components._to_minimum
    monkeypatch.setattr(components, "_to_minimum", lambda *a: rounds.append(1) or step(*a))
    stars = [(i, i % 3) for i in range(30)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(stars, "a long, b long")).collect()))
    assert got == dict(stars) and not rounds
    joined = spark.createDataFrame([*got.items(), (27, 28)], "a long, b long")  # a result with one link more
    assert dict(map(tuple, connected_components(joined).collect())) == {i: 2 if i % 3 == 2 else 0 for i in range(30)}
    assert len(rounds) == 4  # two rounds of two steps


def test_refined_groups_are_small():
    assert 2 ** simhash.unfixed_bits(7) <= simhash.GROUP and simhash.LEVELS >= 7
    assert simhash.unfixed_bits(9) < simhash.unfixed_bits(7)
