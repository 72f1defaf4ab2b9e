"""Reducers given as a function of two values.

The function takes two numpy arrays and combines them value by value; it must be associative and commutative, which check_laws() tests on given values. Rows of
a key are folded in pairs, whole arrays at a time: in each task before the exchange, so a task sends each of its keys once (or as often as it met _KEYS
others in between), then once more by key, streaming over sorted rows, so no key's rows are gathered.

Defined cases: null values count for nothing, a key without others gets null; a null key is a key; an empty table gives an empty result."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from basalt.session import width

_KEYS = 200_000


@dataclass(frozen=True)
class BinaryReducer:
    """combine(v1, v2) over int64 values, or float64 ones."""

    name: str
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
    floating: bool = False


def check_laws(reducer: BinaryReducer, values: Sequence, *, tolerance: float = 1e-9) -> None:
    """A ValueError with the first pair or triple of values that breaks commutativity or associativity."""
    kind, f = np.float64 if reducer.floating else np.int64, reducer.combine
    v = np.array(sorted(set(values)), kind)
    same = lambda x, y: (np.isclose(x, y, rtol=tolerance, atol=tolerance, equal_nan=True) if reducer.floating else x == y)
    a, b = (x.ravel() for x in np.meshgrid(v, v))
    for wrong in np.flatnonzero(~same(f(a, b), f(b, a)))[:1]:
        raise ValueError(f"{reducer.name} isn't commutative: {a[wrong]}, {b[wrong]}")
    a, b, c = (x.ravel() for x in np.meshgrid(v, v, v))
    for wrong in np.flatnonzero(~same(f(f(a, b), c), f(a, f(b, c))))[:1]:
        raise ValueError(f"{reducer.name} isn't associative: {a[wrong]}, {b[wrong]}, {c[wrong]}")


def fold(codes: np.ndarray, values: np.ndarray, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(different codes in ascending order, their combined values); neighbours are combined in rounds, half of them in each."""
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order]
    while len(codes) and (same := codes[1:] == codes[:-1]).any():
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        place = np.arange(len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes))))
        right = np.flatnonzero(place % 2 == 1)
        values = values.copy()
        values[right - 1] = combine(values[right - 1], values[right])
        keep = place % 2 == 0
        codes, values = codes[keep], values[keep]
    return codes, values


def _folded(keys: pa.Array, values: pa.Array, reducer: BinaryReducer) -> tuple[pa.Array, pa.Array]:
    """Each key once, in the order of first rows."""
    encoded = keys.dictionary_encode(null_encoding="encode")
    codes, known = encoded.indices.to_numpy(zero_copy_only=False), pc.is_valid(values).to_numpy(zero_copy_only=False)
    numbers = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    found, made = fold(codes[known], numbers[known], reducer.combine)
    out, has = np.zeros(len(encoded.dictionary), numbers.dtype), np.zeros(len(encoded.dictionary), bool)
    out[found], has[found] = made, True
    return encoded.dictionary, pa.array(out, values.type, mask=~has)


def reduce_by_key(kv: DataFrame, reducer: BinaryReducer) -> DataFrame:
    """(key, value): the values of each key of kv combined."""
    kind = DoubleType() if reducer.floating else LongType()
    rows = kv.select("key", F.col("value").cast(kind).alias("value"))
    schema = StructType([rows.schema["key"], StructField("value", kind)])
    record = lambda k, v: pa.RecordBatch.from_arrays([k, v], names=["key", "value"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.table(batch.columns, names=["key", "value"])  # whether columns may be null differs
            part = (pa.concat_tables([held, part]) if held is not None else part).combine_chunks()
            held = pa.table([*_folded(part["key"].combine_chunks(), part["value"].combine_chunks(), reducer)], names=["key", "value"])
            if len(held) > _KEYS:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last key may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.concat_tables([pa.table(b.columns, names=["key", "value"]) for b in (held, batch) if b is not None]).combine_chunks()
            keys, values = _folded(part["key"].combine_chunks(), part["value"].combine_chunks(), reducer)
            if len(keys) > 1:
                yield record(keys.slice(0, len(keys) - 1), values.slice(0, len(keys) - 1))
            held = record(keys.slice(len(keys) - 1), values.slice(len(keys) - 1))
        if held is not None:
            yield held

    sent = rows.mapInArrow(partial, schema)
    return sent.repartition(width(kv.sparkSession), "key").sortWithinPartitions("key").mapInArrow(final, schema)


GCD = BinaryReducer("gcd", np.gcd)
LOG_SUM = BinaryReducer("log_sum", np.logaddexp, floating=True)


def small_values(floating: bool = False) -> list:
    """Values to check laws on where the caller has none of its own."""
    return [x / 2 for x in range(-9, 10)] if floating else list(itertools.chain(range(-6, 7), (60, 2**40, -(2**40))))
