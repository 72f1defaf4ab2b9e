import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basalt.llm import rolling


def model(docs, windows=(1800, 86400)):
    groups = defaultdict(list)
    for r in docs:
        t = None if r["doc_id"] is None else 60 * ((r["doc_id"] + zlib.crc32(str(r["doc_id"]).encode()) % 1000) // 6)
        groups[r["source"]].append((t, None if r["text"] is None else len(r["text"]), r["lang"], r["doc_id"]))
    for rows in groups.values():
        for t, _, _, doc_id in rows:
            for w in windows:
                inside = [] if t is None else [x for x in rows if x[0] is not None and t - w <= x[0] < t]
                lengths = sorted(x[1] for x in inside if x[1] is not None)
                m = len(lengths)
                ends = (lengths[-(-m // 2) - 1], lengths[-(-99 * m // 100) - 1]) if m else (None, None)
                yield doc_id, w, t, len(inside), sum(lengths), len({x[2] for x in inside} - {None}), *ends


def test_heaps_match_a_sorted_list():
    rng = random.Random(6)
    for a, b in ((1, 2), (99, 100), (1, 1), (1, 100), (2, 3)):
        heaps, held = rolling.RankHeaps(a, b), Counter()
        for _ in range(3000):
            if held and rng.random() < 0.48:
                v = rng.choice(list(held))
                n = rng.randint(1, held[v])
                heaps.remove(v, n)
                held[v] -= n
                held += Counter()
            else:
                v, n = rng.randint(-20, 20) if rng.random() < 0.5 else rng.randint(0, 10**6), rng.choice([1, 1, 1, 5])
                heaps.add(v, n)
                held[v] += n
            if rng.random() < 0.5:
                every = sorted(held.elements())
                assert heaps.value() == (every[-(-a * len(every) // b) - 1] if every else None)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert Counter(map(tuple, rolling.document_windows(docs).collect())) == Counter(model(docs.collect()))


def test_odd_tables(spark, odd_docs, no_docs):
    rng = random.Random(9)
    many = [(rng.randint(-30_000, 30_000), rng.choice([None, "", "a", "é" * 5, "x" * rng.randint(1, 9)]), rng.choice(["s", "s", "s", None, "t"]), rng.choice([None, "en", "de", "fr"])) for _ in range(2500)]
    many += many[:300]  # repeated rows
    docs = spark.createDataFrame(many, "doc_id long, text string, source string, lang string")
    clash = odd_docs.withColumns({"lang": F.lit("en"), "time": F.lit(1), "value": F.lit("v"), "kind": F.lit(2), "bucket": F.lit(3), "window_s": F.lit(4), "event_s": F.lit(5)})
    both = docs.unionByName(clash, allowMissingColumns=True)
    got = rolling.document_windows(both)
    assert got.columns == ["doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars"]
    assert Counter(map(tuple, got.collect())) == Counter(model(both.collect()))
    assert rolling.document_windows(clash.limit(0)).count() == 0


@pytest.mark.parametrize("windows", [(1,), (60, 7, 3600)])
def test_other_windows_and_quantiles(spark, windows):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randint(-500, 500), rng.choice([None, rng.randint(-9, 9)]), rng.choice([None, "k", "l"])) for _ in range(600)]
    got = rolling.features(spark.createDataFrame(rows, "key string, time long, value long, kind string"), windows=windows, quantiles={"least": (1, 10**6), "most": (1, 1)})
    want = set()
    for key, t in {r[:2] for r in rows}:
        for w in windows:
            inside = [r for r in rows if r[0] == key and t - w <= r[1] < t]
            values = [r[2] for r in inside if r[2] is not None]
            want.add((key, t, w, len(inside), sum(values), len({r[3] for r in inside} - {None}), min(values, default=None), max(values, default=None)))
    assert set(map(tuple, got.collect())) == want


def test_one_key_is_split_by_time_and_texts_are_read_once(spark, sf):
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), (F.col("id") * 60).alias("time"), F.col("id").alias("value"), F.lit("en").alias("kind"))
    assert rolling.features(rows).where("window_s = 86400 and time >= 86400 and n_events <> 1440").isEmpty()
    plan = rolling.document_windows(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert sum("text" in x.split("ReadSchema")[1] for x in scans) == 1
