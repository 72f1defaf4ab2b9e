"""Toxicity: cumulative-link ordinal regression on sparse text features.

A text's features are its distinct lower-cased words and the first 4, 5 and 6 bytes of longer ones (word stems), hashed, with log(1 + count) as value, counts over 3 as 3. One weight vector is shared by all thresholds
theta_1 <= theta_2 <= ...: P(grade >= j) = sigmoid(w.x - theta_j), and the expected severity is the sum of those probabilities. An L1 penalty
sets the weights of ordinary words to zero, so a long clean text gathers nothing.

Labels hold one bit. Training grades are 0 for clean rows; a toxic row gets 1 to GRADES by how many of its words are indicators (words
whose smoothed log odds in toxic against clean rows pass INDICATOR): their stems count too; up to two is grade 1, up to six 2, more 3. Training rows are the
labelled documents with the smallest xxhash64(id), at most SAMPLE of them; scoring covers every whole text.

Defined cases: a null or empty text has no features and severity of the intercepts alone; a null id stays null; repeated rows get the same score
each; a probability of exactly the threshold is toxic; an empty table gives an empty result; without labels of both classes every severity is 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.logistic import Rows, sigmoid
from basalt.llm.quality import give_back, sample_labelled, to_rows
from basalt.llm.textops import Chunk, chunks, mix

SAMPLE, BITS, GRADES = 12000, 18, 3
PREFIXES = (4, 5, 6)
INDICATOR, THRESHOLD = 2.0, 0.5
VALUES = np.log1p(np.arange(4))
_TRIM = np.frombuffer(b".,;:!?\"'()[]{}*#$%&|<>-_", np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the distinct words and stems of each text, by text."""
    data = _LOWER[c.data]
    starts, ends = c.starts.copy(), c.ends.copy()
    edge = np.zeros(256, bool)
    edge[_TRIM] = True
    for _ in range(3):  # up to three marks at either end
        starts += (starts < ends) & edge[data[np.minimum(starts, len(data) - 1)]]
        ends -= (starts < ends) & edge[data[np.maximum(ends - 1, 0)]]
    some = starts < ends
    lowered = Chunk(c.first, c.last, data, c.offsets)
    starts, ends, doc = starts[some], ends[some], c.word_doc[some].astype(np.int64) << BITS
    key = []
    for salt, length in enumerate((None, *PREFIXES)):
        long = np.arange(len(starts)) if length is None else np.flatnonzero(ends - starts > length)
        stop = ends if length is None else starts + length
        h = mix(lowered.spans(starts[long], stop[long]) + np.uint64(salt))
        key.append(doc[long] | (h >> np.uint64(64 - BITS)).astype(np.int64))
    key = np.concatenate(key)
    found, count = np.unique(key, return_counts=True)
    return found >> BITS, found & ((1 << BITS) - 1), count


@dataclass(frozen=True)
class ToxicityModel:
    """Shared weights and ascending thresholds; weights None: severity 0."""

    weights: np.ndarray | None
    thresholds: np.ndarray

    def score(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity of each text, and P(grade >= 1)."""
        n = c.last - c.first
        if self.weights is None:
            return np.zeros(n), np.zeros(n)
        doc, bucket, count = features(c)
        z = np.bincount(doc, self.weights[bucket] * VALUES[np.minimum(count, 3)], n)
        p = sigmoid(z[:, None] - self.thresholds[None, :])
        return p.sum(axis=1), p[:, 0]


def indicator_buckets(x: Rows, toxic: np.ndarray) -> np.ndarray:
    """Which buckets stand much more often in toxic rows than in clean ones."""
    once = Rows(x.columns, np.ones(len(x.columns)), x.bounds, x.width)
    pos, neg = once.back(toxic > 0), once.back(toxic <= 0)
    n1, n0 = (toxic > 0).sum(), (toxic <= 0).sum()
    return (np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1)) > INDICATOR) & (pos >= 3)


def grades(x: Rows, toxic: np.ndarray) -> np.ndarray:
    """Training grades of the labelled rows."""
    marks = Rows(x.columns, np.ones(len(x.columns)), x.bounds, x.width).dot(indicator_buckets(x, toxic).astype(float))
    return np.where(toxic > 0, 1 + (marks > 2) + (marks > 6), 0)


def fit_ordinal(x: Rows, grade: np.ndarray, l1: float = 3e-4, rounds: int = 250) -> ToxicityModel:
    """Proximal gradient steps with momentum; thresholds are kept in order. Each class at or above grade 1 weighs as much as grade 0."""
    top = int(grade.max(initial=0))
    if top < 1 or not (grade == 0).any():
        return ToxicityModel(None, np.zeros(GRADES))
    weight = np.where(grade > 0, 0.5 / (grade > 0).sum(), 0.5 / (grade == 0).sum())
    above = grade[:, None] >= np.arange(1, GRADES + 1)[None, :]
    norm = x.squares()
    step = 4.0 / ((norm * weight).sum() * 1.0 + 1)
    w, theta = np.zeros(x.width), np.linspace(0.5, 1.5, GRADES)
    look, look_t = w, theta
    for i in range(rounds):
        g = weight[:, None] * (sigmoid(x.dot(look)[:, None] - look_t) - above)
        new = look - step * x.back(g.sum(axis=1))
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_t = np.maximum.accumulate(look_t + step * g.sum(axis=0))
        push = i / (i + 3)
        look, look_t = new + push * (new - w), new_t + push * (new_t - theta)
        w, theta = new, new_t
    return ToxicityModel(w.astype(np.float32), theta)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Features are made on the executors; the driver gets at most sample sparse rows."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                doc, bucket, count = features(c)
                bounds = np.searchsorted(doc, np.arange(c.last - c.first + 1)).astype(np.int32)
                cols = pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket.astype(np.int32)))
                vals = pa.ListArray.from_arrays(pa.array(bounds), pa.array(VALUES[np.minimum(count, 3)].astype(np.float32)))
                part = batch.slice(c.first, c.last - c.first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), cols, vals], names=["id", "y", "columns", "values"])

    chosen = sample_labelled(docs, labels, id_col, text_col, label_col, sample).select(F.col("_id").cast("long"), "_text", F.col("_y").cast("int"))
    got = chosen.mapInArrow(extract, "id long, y int, columns array<int>, values array<float>").toArrow().sort_by("id")
    if not got.num_rows:
        return ToxicityModel(None, np.zeros(GRADES))
    rows, toxic = to_rows(got, 1 << BITS), got.column("y").to_numpy()
    del got
    model = fit_ordinal(rows, grades(rows, toxic))
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, expected_severity, p_toxic, toxic: one row for each input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 1 << BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                severity, p = shared.value.score(c)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.last - c.first), pa.array(severity), pa.array(p), pa.array(p >= threshold)], names=[id_col, "expected_severity", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, expected_severity double, p_toxic double, toxic boolean")
