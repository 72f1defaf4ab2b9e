"""The stages of the pipeline, one by one and together, against plain Python."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basalt.llm import mixing, nearcopies, quality, secrets
from tests.llm.test_nearcopies import shingles_of, slow_components
from tests.llm.test_secrets import slow_candidates, slow_features

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(map(str, df.collect()))


@pytest.fixture(scope="module")
def shapes(spark, odd_docs, tmp_path_factory):
    """One table as it may come: from files, exploded, joined, unioned, read twice."""
    path = str(tmp_path_factory.mktemp("docs") / "d")
    odd_docs.write.parquet(path)
    docs = spark.read.parquet(path)
    twice = docs.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("twice")
    return {"files": docs, "exploded": twice, "joined": docs.join(spark.createDataFrame([(i,) for i in (1, 2, 2, 6, 9)], "doc_id long"), "doc_id"), "unioned": docs.union(docs), "read twice": spark.read.parquet(path, path)}


@pytest.mark.parametrize("name", ["files", "exploded", "joined", "unioned", "read twice"])
def test_stages_on_odd_tables(spark, shapes, name):
    docs = shapes[name]
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    one = corpus_pipeline.near_dedup(spark, docs, SF)
    clean = corpus_pipeline.secret_scan(spark, docs, SF)
    mix = corpus_pipeline.source_mix(spark, docs, SF)
    assert good.columns == one.columns == clean.columns == mix.columns == docs.columns
    assert rows_of(clean) == rows_of(docs)
    assert not rows_of(good) - rows_of(docs) and not rows_of(one) - rows_of(docs)
    sets = [shingles_of(r["text"]) for r in docs.collect()]
    assert one.count() == len(set(slow_components(sets)))
    copies = mixing.mix(docs).collect()
    assert mix.count() == sum(max(r["copies"], r["size"] == 0) for r in copies)
    assert corpus_pipeline.pack(spark, docs, SF).where("piece = 0").count() == docs.count()


def test_stages_on_empty_tables(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0


def packed(docs):
    """(doc_id, piece, start, length, crc) of all documents, and how many sequences best-fit decreasing makes of them, one by one."""
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, rooms = Counter(), []
    for i, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            out[i, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    for n in sorted((x[3] for x in out.elements()), reverse=True):
        k = bisect.bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else 2048
        bisect.insort(rooms, room - n)
    return out, len(rooms)


def test_the_whole_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    verdicts = {(r["doc_id"]): r for r in quality.score(docs, model).collect()}
    good = []
    for r in rows:
        words = (r["text"] or "").encode().split()
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        assert verdicts[r["doc_id"]]["base_failed"] == failed
        if not failed and verdicts[r["doc_id"]]["probability"] >= quality.MIN_PROBABILITY:
            good.append(r)
    roots = slow_components([shingles_of(r["text"]) for r in good])
    first = {}
    for r, root in zip(good, roots, strict=True):
        first[root] = min(first.get(root, r["doc_id"]), r["doc_id"])
    one = [r for r in good if r["doc_id"] in set(first.values())]
    forest = secrets.train(spark)
    clean = {}
    for r in one:
        words, text, hits = r["text"].translate({c: " " for c in range(9, 14)}).split(" "), r["text"], []
        words = [w for w in words if w]
        for i, _, core in slow_candidates(text):
            x = slow_features(core, words[i], " ".join(words[max(0, i - 2) : i]), words[i + 1] if i + 1 < len(words) else "")
            if float(secrets_probability(forest, x)) >= 0.5:
                hits.append(core)
        for core in sorted(set(hits), key=lambda c: (-len(c), c)):
            text = text.replace(core, secrets.MASK)
        clean[r["doc_id"]] = (text, r["source"])
    size = {i: len(t.encode().split()) for i, (t, _) in clean.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    copies = Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert not set(copies) - set(clean) and all(n <= 3 for n in copies.values())
    names = sorted({s for _, s in clean.values()}, key=lambda x: (x is None, x or ""))
    of = {s: Counter(size[i] for i, (_, x) in clean.items() if x == s) for s in names}
    sizes = [sum(n * c for n, c in of[s].items()) for s in names]
    for s, total, target in zip(names, sizes, mixing.targets(sizes), strict=True):
        whole = min(3, int(target // total))
        sums = 1
        budget = int(target - whole * total + 0.5)
        for n, c in of[s].items():
            for _ in range(c):
                sums = (sums | sums << n) & (1 << (budget + 1)) - 1
        assert sum(size[i] * copies[i] for i, (_, x) in clean.items() if x == s) == whole * total + sums.bit_length() - 1
    want, sequences = packed([(i, clean[i][0]) for i, n in copies.items() for _ in range(n)])
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({r["sequence_id"] for r in got}) == sequences


def secrets_probability(forest, x):
    from basalt.llm.forest import predict

    return predict(forest, np.array([x], float))[0]
