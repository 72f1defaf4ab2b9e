import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == [pytest.approx(187.5), pytest.approx(75), pytest.approx(37.5)]
    got = mixing.targets([1, 100, 100])
    assert got[0] == 3 and sum(got) == pytest.approx(201) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    rng = random.Random(0)
    for _ in range(50):
        sizes = [rng.randint(0, 1000) for _ in range(rng.randint(1, 9))]
        got = mixing.targets(sizes)
        assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes, strict=True))


def best_sum(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
    return max(sums)


def best_bits(lengths, counts, budget):
    """The same for larger numbers: bit s is set if the sum s can be made."""
    sums = 1
    for n, c in zip(lengths, counts, strict=True):
        for _ in range(c):
            sums = (sums | sums << n) & (1 << (budget + 1)) - 1
    return sums.bit_length() - 1


def worth(lengths, counts, take):
    assert all(0 <= k <= c for k, c in zip(take, counts, strict=True))
    return sum(n * k for n, k in zip(lengths, take, strict=True))


@pytest.mark.parametrize("margin, wider", [(8, (1, 8, 64)), (1, (1, 2)), (1, ())])
def test_fit_equals_brute_force(monkeypatch, margin, wider):
    monkeypatch.setattr(mixing, "MARGIN", margin)
    monkeypatch.setattr(mixing, "WIDER", wider)
    rng = random.Random(1)
    for _ in range(300):
        lengths = rng.sample(range(1, rng.choice([8, 30, 60])), rng.randint(1, 5))
        counts = [rng.randint(1, rng.choice([3, 40])) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget = rng.randint(0, total + 3)
        best = best_sum(lengths, counts, budget)
        assert worth(lengths, counts, mixing.fit(lengths, counts, budget)) == best
        if 0 < budget < total:
            assert worth(lengths, counts, mixing._near_vertex(lengths, counts, budget)) == best


def test_fit_of_hard_and_large_budgets():
    for lengths, counts, budget, best in (
        ([300, 20_000], [50, 1], 21_000, 20_900),
        ([5100, 5101, 6000], [1, 1, 1], 10_201, 10_201),
        ([300, 20_000], [10**9, 1], 10**11 + 1, 99_999_999_900),
        (list(range(1, 20_000, 7)), [10**4] * 2857, 10**11 + 3, 10**11 + 3),
    ):
        assert worth(lengths, counts, mixing.fit(lengths, counts, budget)) == best


def test_pivots_that_say_they_are_right_are(monkeypatch):
    monkeypatch.setattr(mixing, "_BLOCK", 2)
    rng, proven = random.Random(8), 0
    for _ in range(1500):
        lengths = rng.sample(range(1, rng.choice([8, 30, 60])), rng.randint(1, 5))
        counts = [rng.randint(1, rng.choice([3, 40])) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget = rng.randint(1, max(1, total - 1))
        for p in range(len(lengths)):
            missed, take, sure = mixing._by_remainders(p, lengths, counts, budget)
            assert worth(lengths, counts, take) == budget - missed <= budget
            if sure:
                assert budget - missed == best_sum(lengths, counts, budget)
            proven += sure
    assert proven > 3000


def two(lengths, counts, budget):
    """The best sum of two lengths, by trying every number of the second."""
    second = np.arange(counts[1] + 1, dtype=np.int64) * lengths[1]
    second = second[second <= budget]
    return int((second + np.minimum(counts[0], (budget - second) // lengths[0]) * lengths[0]).max())


@pytest.mark.parametrize(("lengths", "counts", "budget"), [([19_997, 20_000], [30_000, 30_000], 600_000_001), ([20_000, 1], [900_000, 3], 10**10 + 7), ([199_997, 200_000], [300_000, 300_000], 10**11 - 1), ([199_990, 200_000], [200_000, 400_000], 5 * 10**10 + 3), ([150_001, 200_000], [9, 500_000], 7 * 10**10 + 1), ([19_997, 20_000], [900, 1100], 20_000_011)])
def test_long_documents_fit_in_little_memory(lengths, counts, budget):
    tracemalloc.start()
    take = mixing.fit(lengths, counts, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert worth(lengths, counts, take) == two(lengths, counts, budget) and peak < 500 << 20


def test_many_long_lengths_fit_in_little_memory():
    rng = random.Random(2)
    lengths = rng.sample(range(100_000, 200_000), 400)
    counts = [rng.randint(1, 2000) for _ in lengths]
    budget = sum(n * c for n, c in zip(lengths, counts, strict=True)) * 5 // 7
    tracemalloc.start()
    take = mixing.fit(lengths, counts, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert worth(lengths, counts, take) == budget and peak < 500 << 20


def test_mix(spark, odd_docs, no_docs, sf):
    docs = odd_docs.select("doc_id", "text", "source").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    size = lambda t: len((t or "").encode().split())
    assert sorted(r["size"] for r in rows) == sorted(size(r["text"]) for r in docs.collect())
    # every source is as near to its target as its documents allow
    of = {}
    for r in docs.collect():
        of.setdefault(r["source"], Counter())[size(r["text"])] += 1
    names = sorted(of, key=lambda x: (x is None, x or ""))
    sizes = [sum(n * c for n, c in of[x].items()) for x in names]
    want = Counter()
    for x, total, target in zip(names, sizes, mixing.targets(sizes), strict=True):
        whole = min(3, int(target // total)) if total else 0
        lengths = sorted(n for n in of[x] if n)
        budget = math.floor(target - whole * total + 0.5)
        want[total, round(target, 6), whole * total + worth(lengths, [of[x][n] for n in lengths], mixing.fit(lengths, [of[x][n] for n in lengths], budget))] += 1
        if lengths:
            assert best_bits(lengths, [of[x][n] for n in lengths], budget) == worth(lengths, [of[x][n] for n in lengths], mixing.fit(lengths, [of[x][n] for n in lengths], budget))
    taken = Counter()
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert Counter((*k, v) for k, v in taken.items()) == want
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert mixing.mix(no_docs).count() == 0


def test_mixed_rows(odd_docs, no_docs):
    got = mixing.mixed(odd_docs)
    assert got.columns == odd_docs.columns
    want = sum(max(r["copies"], r["size"] == 0) for r in mixing.mix(odd_docs).collect())
    assert got.count() == want
    assert mixing.mixed(no_docs).count() == 0


def test_any_number_of_sources(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice([None, *(f"s{k}" for k in range(40)), "big", "big", "big"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = [sorted(map(tuple, mixing.mix(d).collect()), key=str) for d in (docs, odd_docs)]
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    many = [sorted(map(tuple, mixing.mix(d).collect()), key=str) for d in (docs, odd_docs)]
    assert few == many
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_ties_fall_by_text(spark):
    rows = [(7, f"w{i} x y", "a") for i in range(40)] + [(i, "p q r s", "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (Counter(map(tuple, mixing.mixed(d).collect())) for d in (docs, docs.orderBy(F.rand(3)).repartition(7)))
    assert first == again and len({t for _, t, s in first if s == "a"}) > 1


def test_rows_that_share_a_place(spark, tmp_path):
    texts = spark.createDataFrame([(i, "a b c " * (i + 1), "xyz"[i % 3]) for i in range(6)], "doc_id long, text string, source string")
    texts.write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    twice = docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    for table in (docs, twice, docs.join(twice.select("doc_id"), "doc_id"), docs.union(docs), spark.read.parquet(f"{tmp_path}/t", f"{tmp_path}/t")):
        want = sum(max(r["copies"], r["size"] == 0) for r in mixing.mix(table).collect())
        got = mixing.mixed(table)
        assert got.count() == want and got.columns == table.columns
