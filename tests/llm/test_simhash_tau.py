import random

import pytest

from basalt.llm import simhash


@pytest.mark.parametrize("levels", [12, 0])
def test_large_groups_lose_no_link_of_three_bits(spark, monkeypatch, levels):
    monkeypatch.setattr(simhash, "GROUP", 4)
    monkeypatch.setattr(simhash, "LEVELS", levels, raising=False)
    rng = random.Random(4)
    where = rng.sample(range(63), 16)
    prints = sorted({sum(1 << b for b in where if rng.random() < 0.5) for _ in range(60)})
    want = {p: p for p in prints}
    while True:
        new = {p: min(want[q] for q in prints if (p ^ q).bit_count() <= 3) for p in prints}
        if new == want:
            break
        want = new
    got = simhash.groups(spark.createDataFrame([(p,) for p in prints], "fp long"), 3).collect()
    assert {r["fp"]: r["root"] for r in got} == want
