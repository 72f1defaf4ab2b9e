import random

import pytest

CLASHING = "id long, h string, fp string, file string, row int, n int, size int, kept string, key string, _doc string"


def prose(rng, n, words=300):
    return " ".join("w%d" % rng.randint(0, words) for _ in range(n))


@pytest.fixture(scope="session")
def twins():
    """Two words of 1,024 bytes that every polynomial hash modulo 2**64 with an odd base takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    rng = random.Random(0)
    long = prose(rng, 30_000)
    same = prose(rng, 80)
    texts = [(1, same, "a"), (1, same, "a"), (2, same, "b"), (None, same, None), (3, None, "a"), (4, "", "b"), (5, " \t\n", None), (6, long, "a"), (7, "x" * 70_000, "b"), (8, "é ü 漢字 \U0001f600", "z"), (None, None, None), (9, prose(rng, 120), "a"), (9, prose(rng, 60), "a"), (10, "one", "b")]
    rows = [(*t, *([None] * 10)) for t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
