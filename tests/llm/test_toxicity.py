import math
from collections import Counter

import numpy as np

from basalt.llm import toxicity
from basalt.llm.logistic import Rows
from basalt.llm.textops import byte_hashes, mix


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) >= 0).all()
    truth = labels.where("doc_id % 2 = 1").select("doc_id", "toxic").withColumnRenamed("toxic", "label")
    held = toxicity.score(docs, model).join(truth, "doc_id").toPandas()
    bad, clean = held[held["label"] == 1], held[held["label"] == 0]
    assert bad["toxic"].mean() > 0.9 and clean["toxic"].mean() < 0.01
    assert bad["expected_severity"].mean() > 1.5 > 0.5 > clean["expected_severity"].mean()


def test_severity_follows_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 600)
    counts = [[(0, 1.0), *((j, 1.0) for j in range(1, g + 1))] for g in grade.tolist()]
    flat = [x for row in counts for x in row]
    rows = Rows(np.array([c for c, _ in flat]), np.array([v for _, v in flat]), np.concatenate([[0], np.cumsum([len(r) for r in counts])]), 8)
    model = toxicity.fit_ordinal(rows, grade)
    z = rows.dot(model.weights.astype(float))
    means = [z[grade == g].mean() for g in range(4)]
    assert means == sorted(means) and means[3] > means[0]


def test_odd_tables(spark, odd_docs, no_docs):
    none = toxicity.train(odd_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["expected_severity"] for r in toxicity.score(odd_docs, none).collect()} == {0.0}
    some = toxicity.train(odd_docs, spark.createDataFrame([(1, 0), (2, 1), (9, 1), (None, 1), (6, None)], "doc_id long, toxic int"))
    rows = toxicity.score(odd_docs, some).collect()
    assert len(rows) == odd_docs.count()
    assert len({r["p_toxic"] for r in rows if r["doc_id"] in (3, 4, 5)}) == 1
    assert toxicity.score(no_docs, some).count() == 0


def bucket(word, salt):
    h = byte_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
    return int(mix(h + np.uint64(salt))[0]) >> 64 - toxicity.BITS


def slow_score(text, weights, thresholds):
    """(expected severity, P(grade >= 1)) word by word, from a dict of weights."""
    counts, marks = Counter(), b".,;:!?\"'()[]{}*#$%&|<>-_"
    for word in (text or "").encode().split():
        word = word.lower()
        for _ in range(3):
            word = word[1:] if word[:1] and word[0] in marks else word
            word = word[:-1] if word[:1] and word[-1] in marks else word
        if word:
            counts[bucket(word, 0)] += 1
            for salt, n in enumerate(toxicity.PREFIXES, 1):
                if len(word) > n:
                    counts[bucket(word[:n], salt)] += 1
    z = sum(weights.get(b, 0.0) * math.log(1 + min(c, 3)) for b, c in counts.items())
    p = [1 / (1 + math.exp(t - z)) for t in thresholds]
    return sum(p), p[0]


def test_scores_against_brute_force(spark, odd_docs):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    weights = {int(i): float(model.weights[i]) for i in np.flatnonzero(model.weights)}
    both = docs.where("doc_id < 150").union(odd_docs.where("doc_id is null or doc_id <> 6").select("doc_id", "text"))
    want = Counter((r["doc_id"], *(round(x, 4) for x in slow_score(r["text"], weights, model.thresholds.tolist()))) for r in both.collect())
    got = Counter((r["doc_id"], round(r["expected_severity"], 4), round(r["p_toxic"], 4)) for r in toxicity.score(both, model).collect())
    assert got == want and len({x[1] for x in want}) > 20
