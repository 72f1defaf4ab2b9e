import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import quality, textops
from basalt.llm.logistic import calibrate, sigmoid

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def model_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_base_counts(spark, odd_docs, sf, twins):
    around = "a b c d e f g".split()
    unlike = "\n".join(" ".join([*around, w]) for w in twins)
    extra = spark.createDataFrame([(18, unlike, None), (19, f"{unlike}\n{unlike}", None), (20, "a b\na b\n a b\n\n\na b\r\nc", None), (21, "x y z p q r s t x y z p q r s t " * 3, None), (22, "# <b> | 5%", None)], "doc_id long, text string, source string")
    docs = odd_docs.select("doc_id", "text", "source").union(extra).union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source"))
    got = Counter((r["doc_id"], *(r[k] for k in quality.BASE_COLUMNS), r["base_failed"], r["kept"]) for r in quality.score(docs, quality.QualityModel(None)).collect())
    want = Counter()
    for r in docs.collect():
        counts = model_counts(r["text"])
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        want[(r["doc_id"], *counts, failed, not failed)] += 1
    assert got == want


ALL = (1 << 64) - 1


def spread(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & ALL
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & ALL
    return h ^ (h >> 33)


def word_hash(word):
    """Lane after lane of eight bytes, for words below the length from which another hash is used."""
    data = word.encode()
    assert len(data) <= textops._LONG
    lanes = [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data), 8)]
    h = spread(lanes[0] ^ (len(data) * 0xA0761D6478BD642F & ALL))
    for lane in lanes[1:]:
        h = spread(h * 0x9E3779B97F4A7C15 & ALL ^ lane)
    return h


def model_probability(text, model):
    """The mean weight of a text's n-grams, family by family, one by one."""
    words, z = [word_hash(w) for w in WORD.findall(text or "")], model.intercept
    points = [ord(x) for x in text or ""]
    for f, k in enumerate((1, 2, 3, 4)):
        weights = []
        if f < 2:
            for i in range(len(words) - k + 1):
                h = spread((sum(w * textops._WORD_BASE**j for j, w in enumerate(words[i : i + k])) + k * 0xA0761D6478BD642F) & ALL)
                weights.append(float(model.weights[(f << quality.BITS) + (h >> 64 - quality.BITS)]))
        else:
            for i in range(len(points) - k + 1):
                h = 0
                for x in points[i : i + k]:
                    h = (h ^ x) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 15
                weights.append(float(model.weights[(f << quality.BITS) + (h >> 32 - quality.BITS)]))
        z += sum(weights) / max(1, len(weights))
    return float(sigmoid(np.float64(model.scale * z + model.shift)))


def test_probability_and_verdict_match_a_model_gram_by_gram(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a"), (-4, "a b"), (-5, "\u00e9\u4e2d \U0001f600 " * 12), (-6, "word " * 40), (-6, "word " * 40), (None, "x y z " * 9)], "doc_id long, text string")
    some = docs.select("doc_id", "text").where(F.length("text") < 6000).union(extra)
    texts = Counter((r["doc_id"], r["text"]) for r in some.collect())
    got = quality.score(some, model).collect()
    assert got[0].__fields__ == ["doc_id", *quality.BASE_COLUMNS, "base_failed", "kept", "probability"]
    want = Counter()
    for (i, text), n in texts.items():
        want[i, round(model_probability(text, model), 9)] += n
    assert Counter((r["doc_id"], round(r["probability"], 9)) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"] and r["probability"] >= 0.5) for r in got) and {r["kept"] for r in got} == {True, False}


def test_a_probability_of_exactly_the_threshold_passes(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    one = next(r for r in quality.score(docs, model).collect() if not r["base_failed"])
    alone = docs.where(F.col("doc_id") == one["doc_id"])
    for threshold, kept in ((one["probability"], True), (float(np.nextafter(one["probability"], 2)), False)):
        assert [r["kept"] for r in quality.score(alone, model, threshold=threshold).collect()] == [kept]
        assert quality.keep_good(alone, model, threshold=threshold).count() == kept


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").toPandas()
    assert ((held["kept"]) == (held["quality"] == 1)).mean() > 0.95
    assert held[held["quality"] == 1]["kept"].mean() > 0.97


def test_empty_unlabelled_and_passing_columns(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    assert model.weights is None
    assert quality.score(no_docs, model).count() == 0
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 1, 2, 6, 9, 9]
    some = quality.train(odd_docs, spark.createDataFrame([(i, (i or 0) % 2) for i in (*range(1, 11), None)], "doc_id long, quality int"))
    assert quality.score(odd_docs, some).count() == odd_docs.count()


def test_calibration():
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < sigmoid(2 * z - 1)).astype(float)
    assert calibrate(z, y) == pytest.approx((2, -1), abs=0.25)
