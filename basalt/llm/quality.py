"""Quality rules: hashed word and character n-gram logistic regression over whole texts, calibrated, against fixed thresholds.

Training rows are the labelled documents with the smallest xxhash64(id), at most SAMPLE of them; that bound is the only
sample. Scoring runs in Arrow batches over every text. A text's score is the mean weight of its n-grams, family by family, so no
feature vector is built.

Defined cases: a null text counts as empty and has no words, so base rules reject it; a null id stays null; repeated rows get the
same verdict each; a probability of exactly the threshold passes; an empty table gives an empty result; without labels of both classes the base rules alone decide; columns of
other names pass through untouched, whatever they are called.
"""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.logistic import Rows, calibrate, fit_logistic, sigmoid
from basalt.llm.textops import Chunk, chunks, covered, kinds

SAMPLE = 1500
BITS = 15
FAMILIES = ("word1", "word2", "char3", "char4")
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
MIN_PROBABILITY = 0.5
SYMBOLS = b"#*$%&|<>"
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _families(c: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family, the bucket of each n-gram in text order, and where each text's n-grams begin."""
    out = []
    shift = np.uint64(64 - BITS)
    for k in (1, 2):
        at = c.windows(k)
        out.append(((c.window_hashes(at, k) >> shift).astype(np.int64), np.searchsorted(at, c.word_offsets)))
    points = np.frombuffer(c.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum((c.data & 0xC0) != 0x80, out=begins[1:])
    bounds = begins[c.offsets]
    for k in (3, 4):
        n = max(0, len(points) - k + 1)
        h = np.zeros(n, np.uint32)
        for j in range(k):
            h = (h ^ points[j : j + n]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        # n-grams that run into the next text don't count
        inside = np.arange(n) + k <= np.repeat(bounds[1:], np.diff(bounds))[:n]
        at = np.flatnonzero(inside)
        out.append(((h[at] >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(at, bounds)))
    return out


def features(c: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse row of each text: the share of each bucket in its family."""
    fams = _families(c)
    for i in range(c.last - c.first):
        cols, vals = [], []
        for f, (bucket, bounds) in enumerate(fams):
            got, count = np.unique(bucket[bounds[i] : bounds[i + 1]], return_counts=True)
            cols.append(got + (f << BITS))
            vals.append(count / max(1, count.sum()))
        yield np.concatenate(cols), np.concatenate(vals)


def base_rules(c: Chunk) -> dict[str, np.ndarray]:
    """Counts of each text that need no model."""
    data, words = c.data, c.word_offsets
    point = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int64)
    inside[c.starts] += 1
    np.subtract.at(inside, c.ends, 1)
    in_word = np.cumsum(inside[:-1]) > 0
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))

    at = c.windows(REPEAT_WINDOW)
    again = at[_repeated(c, at)]
    repeat = covered(len(c.starts), again, REPEAT_WINDOW)

    # lines: cut at \n and at each text's ends; a line counts if a word starts in it
    cuts = np.unique(np.concatenate([c.offsets[:-1], np.flatnonzero(data == 10) + 1, c.offsets[1:]]))
    begin, end = cuts[:-1], cuts[1:]
    doc = np.searchsorted(c.offsets, begin, "right") - 1
    stop = end - (data[end - 1] == 10) if len(end) else end
    has = np.searchsorted(c.starts, stop) > np.searchsorted(c.starts, begin)
    begin, stop, doc = begin[has], stop[has], doc[has]
    kind = kinds(data, begin, stop, c.spans(begin, stop))[1]
    order = np.lexsort((np.arange(len(kind)), kind, doc))
    same = np.zeros(len(kind), bool)
    same[order[1:]] = (kind[order[1:]] == kind[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    dup = np.bincount(doc[same], minlength=c.last - c.first)
    return {
        "n_words": np.diff(words),
        "word_chars": c.per_text(point & in_word, c.offsets),
        "n_symbols": c.per_text(symbol, c.offsets),
        "n_dup_lines": dup,
        "n_repeat_words": c.per_text(repeat, words),
    }


def _repeated(c: Chunk, at: np.ndarray) -> np.ndarray:
    """Which windows occur twice or more in their text. Hashes only propose; the words decide."""
    k, out = REPEAT_WINDOW, np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    doc, kind = c.word_doc[at], c.words[1]
    key = c.window_hashes(at, k) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    hit = np.flatnonzero(key[a] == key[b])
    a, b = a[hit], b[hit]
    true = doc[a] == doc[b]
    for j in range(k):
        true &= kind[at[a] + j] == kind[at[b] + j]
    if not true.all():  # different windows under one key: count the windows themselves
        rows = [(d, *kind[i : i + k].tolist()) for d, i in zip(doc.tolist(), at.tolist(), strict=True)]
        often = Counter(rows)
        return np.array([often[x] > 1 for x in rows])
    out[a] = True
    out[b] = True
    return out


@dataclass(frozen=True)
class QualityModel:
    """Weights by bucket (None: base rules only), intercept, calibration."""

    weights: np.ndarray | None
    intercept: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def probabilities(self, c: Chunk) -> np.ndarray:
        """Calibrated probability that each text is good."""
        n = c.last - c.first
        if self.weights is None:
            return np.ones(n)
        z = np.full(n, self.intercept)
        for f, (bucket, bounds) in enumerate(_families(c)):
            total = np.zeros(len(bucket) + 1)
            np.cumsum(self.weights[(f << BITS) + bucket], out=total[1:])
            z += (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(1, np.diff(bounds))
        return sigmoid(self.scale * z + self.shift)


def train_rows(rows: Rows, y: np.ndarray) -> QualityModel:
    """Fit on four fifths, calibrate on the others."""
    if len(y) < 10 or len(np.unique(y)) < 2:
        return QualityModel(None)
    held = np.arange(len(y)) % 5 == 4
    w, b = fit_logistic(rows, y, ~held, l2=1e-4, rounds=100)
    z = rows.dot(w) + b
    fold = held if len(np.unique(y[held])) == 2 else np.ones(len(y), bool)
    scale, shift = calibrate(z[fold], y[fold])
    return QualityModel(w.astype(np.float32), float(b), scale, shift)


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(id, text, label) of at most sample labelled documents, the smallest hashes of their ids first."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    have = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return have.join(F.broadcast(chosen), "_id")  # at most sample pairs of numbers


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Rows are turned into features on the executors; the driver gets at most sample sparse rows."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                got = list(features(c))
                part = batch.slice(c.first, c.last - c.first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([x for x, _ in got], pa.list_(pa.int32())), pa.array([x for _, x in got], pa.list_(pa.float32()))],
                    names=["id", "y", "columns", "values"],
                )

    chosen = sample_labelled(docs, labels, id_col, text_col, label_col, sample).select(F.col("_id").cast("long"), "_text", F.col("_y").cast("int"))
    got = chosen.mapInArrow(extract, "id long, y int, columns array<int>, values array<float>").toArrow().sort_by("id")
    if not got.num_rows:
        return QualityModel(None)
    rows, y = to_rows(got, len(FAMILIES) << BITS), got.column("y").to_numpy().astype(float)
    del got
    model = train_rows(rows, y)
    del rows
    give_back()
    return model


def give_back() -> None:
    """Return the memory of a training run to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def to_rows(table: pa.Table, width: int) -> Rows:
    lists, values = table.column("columns").combine_chunks(), table.column("values").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    return Rows(lists.flatten().to_numpy(), values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), width)


def verdicts(c: Chunk, model: QualityModel, threshold: float) -> dict[str, np.ndarray]:
    out = base_rules(c)
    failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    p = model.probabilities(c)
    return out | {"base_failed": failed, "probability": p, "kept": ~failed & (p >= threshold)}


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = MIN_PROBABILITY) -> DataFrame:
    """id, the base counts, base_failed, kept, probability: one row for each input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 4 << BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                got = verdicts(c, shared.value, threshold)
                ids = batch.column(0).slice(c.first, c.last - c.first)
                columns = [pa.array(got[k].astype(np.int64)) for k in BASE_COLUMNS]
                yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(got["base_failed"]), pa.array(got["kept"]), pa.array(got["probability"])], names=[id_col, *BASE_COLUMNS, "base_failed", "kept", "probability"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in BASE_COLUMNS) + ", base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = MIN_PROBABILITY) -> DataFrame:
    """The rows of docs that the rules keep, with exactly their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(place)):
                yield batch.slice(c.first, c.last - c.first).filter(pa.array(verdicts(c, shared.value, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)
