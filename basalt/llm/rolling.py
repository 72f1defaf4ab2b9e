"""Rolling window features of each key: counts, sums, exact quantiles and distinct categories of the rows before each moment.

Equal rows (key, time, value, category) are counted before they are sent anywhere. Time is cut into buckets as long as the longest window, and a row goes to
its own bucket and to those whose windows reach back to it, two in all; so a hot key is split by time, and a task holds the distinct rows of one key in two
windows' time, whatever the table's size. In a bucket two pointers sweep over the rows in order of time, one ahead of the window and one at its end. For
each quantile a pair of heaps holds the values up to the target rank and those above it; a value that leaves is only counted out, its tombstone is thrown away when it
comes to the top, and values move over as the target rank changes. Categories are counted in and out by reference counts.

All rows of a key at one time share their windows, so features are made once for each (key, time) and joined to the rows.

Defined cases: a null key is a key like others; a null value counts as a row without a value; a null category isn't counted as one; a row without a time
is in no window, and its own windows are empty (count and sum 0, no categories, null quantiles); rows that are alike each count; an empty table gives an empty
result; other columns are ignored; windows without values have null quantiles.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = (1800, 86400)
QUANTILES = {"median_chars": (1, 2), "high_chars": (99, 100)}


class RankHeaps:
    """The value of rank ceil(a * m / b) among m values that come and go."""

    def __init__(self, a: int, b: int):
        self.a, self.b, self.n_low, self.n_high = a, b, 0, 0
        self.low: list[int] = []  # negated: the largest comes first
        self.high: list[int] = []
        self.in_low: dict[int, int] = {}  # how often a value is there; 0 is a tombstone
        self.in_high: dict[int, int] = {}

    def add(self, value: int, n: int) -> None:
        self._bury()
        if self.low and value <= -self.low[0]:
            if value not in self.in_low:
                heapq.heappush(self.low, -value)
            self.in_low[value] = self.in_low.get(value, 0) + n
            self.n_low += n
        else:
            if value not in self.in_high:
                heapq.heappush(self.high, value)
            self.in_high[value] = self.in_high.get(value, 0) + n
            self.n_high += n

    def remove(self, value: int, n: int) -> None:
        above = min(n, self.in_high.get(value, 0))
        if above:
            self.in_high[value] -= above
            self.n_high -= above
        if n > above:
            self.in_low[value] -= n - above
            self.n_low -= n - above

    def _bury(self) -> None:
        while self.low and not self.in_low[-self.low[0]]:
            del self.in_low[-heapq.heappop(self.low)]
        while self.high and not self.in_high[self.high[0]]:
            del self.in_high[heapq.heappop(self.high)]

    def value(self) -> int | None:
        rank = -(-self.a * (self.n_low + self.n_high) // self.b)
        self._bury()
        while self.n_low != rank:
            if self.n_low < rank:
                value = self.high[0]
                n = min(self.in_high[value], rank - self.n_low)
                self.in_high[value] -= n
                if value not in self.in_low:
                    heapq.heappush(self.low, -value)
                self.in_low[value] = self.in_low.get(value, 0) + n
            else:
                value = -self.low[0]
                n = min(self.in_low[value], self.n_low - rank)
                self.in_low[value] -= n
                if value not in self.in_high:
                    heapq.heappush(self.high, value)
                self.in_high[value] = self.in_high.get(value, 0) + n
                n = -n
            self.n_low += n
            self.n_high -= n
            self._bury()
        return -self.low[0] if rank else None


def sweep(times: list[int], values: list[int | None], kinds: list[int], counts: list[int], moments: list[int], window: int, quantiles: list[tuple[int, int]]) -> list[tuple]:
    """(count, sum, categories, *quantiles) of the rows in [moment - window, moment) for each moment; times and moments ascend, kind -1 is none."""
    heaps, refs, out, n, total, head = [RankHeaps(*q) for q in quantiles], {}, [], 0, 0, 0
    if moments:
        head = int(np.searchsorted(times, moments[0] - window))
    tail = head
    for moment in moments:
        while head < len(times) and times[head] < moment:
            n += counts[head]
            if values[head] is not None:
                total += values[head] * counts[head]
                for h in heaps:
                    h.add(values[head], counts[head])
            if kinds[head] >= 0:
                refs[kinds[head]] = refs.get(kinds[head], 0) + counts[head]
            head += 1
        while tail < head and times[tail] < moment - window:
            n -= counts[tail]
            if values[tail] is not None:
                total -= values[tail] * counts[tail]
                for h in heaps:
                    h.remove(values[tail], counts[tail])
            if kinds[tail] >= 0:
                refs[kinds[tail]] -= counts[tail]
                if not refs[kinds[tail]]:
                    del refs[kinds[tail]]
            tail += 1
        out.append((n, total, len(refs), *(h.value() for h in heaps)))
    return out


def features(rows: DataFrame, *, windows: tuple[int, ...] = WINDOWS, quantiles: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(key, time, window_s, n_events, sum_value, n_kinds, *quantiles) for each different (key, time) of rows (key, time, value, kind).

    quantiles: name -> (a, b) for rank ceil(a * m / b) of m values, 0 < a <= b."""
    quantiles, span = QUANTILES if quantiles is None else quantiles, max(windows)
    names = ["n_events", "sum_value", "n_kinds", *quantiles]
    distinct = rows.where("time is not null").groupBy("key", "time", "value", "kind").agg(F.count("*").alias("n"))
    bucket = lambda t: f"({t} - pmod({t}, {span}L)) div {span}L"
    dealt = distinct.select("*", F.explode(F.sequence(F.expr(bucket("time")), F.expr(bucket(f"(time + {span}L)")))).alias("bucket"))
    key_type = rows.schema["key"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("time")
        times = group["time"].to_numpy()
        start = group["bucket"][0].as_py() * span
        moments = np.unique(times[times >= start])
        kinds = group["kind"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_pylist()
        values, counts, listed, wanted = group["value"].to_pylist(), group["n"].to_pylist(), times.tolist(), moments.tolist()
        made = [(w, t, *x) for w in windows for t, x in zip(wanted, sweep(listed, values, kinds, counts, wanted, w, list(quantiles.values())), strict=True)]
        columns = [pa.array(c, pa.int64()) for c in zip(*made, strict=True)] or [pa.array([], pa.int64())] * (2 + len(names))
        key = group["key"].combine_chunks().take(pa.array(np.zeros(len(made), np.int64)))
        return pa.table([key, *columns], names=["key", "window_s", "time", *names])

    got = dealt.groupBy("key", "bucket").applyInArrow(run, f"key {key_type}, window_s long, time long, " + ", ".join(f"`{n}` long" for n in names))
    return got.select("key", "time", "window_s", *(f"`{n}`" for n in names))


def event_time(doc_id: Column) -> Column:
    """60 * floor((id + the CRC-32 of its digits modulo 1000) / 6), in seconds."""
    at = doc_id.cast("long") + F.crc32(doc_id.cast("long").cast("string")) % 1000
    return ((at - F.pmod(at, F.lit(6))) * 10).cast("long")


def document_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(id, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars): one row for each document and window."""
    key, time = F.col(source_col).alias("key"), event_time(F.col(id_col)).alias("time")
    # only the aggregate reads texts
    made = features(docs.select(key, time, F.char_length(text_col).cast("long").alias("value"), F.col(lang_col).alias("kind")), windows=windows)
    asked = docs.select(F.col(id_col).alias("_id"), key, time, F.explode(F.array(*(F.lit(w).cast("long") for w in windows))).alias("window_s"))
    made = made.select(F.col("key").alias("_key"), F.col("time").alias("_time"), F.col("window_s").alias("_window"), *made.columns[3:])
    found = asked.where("time is not null").join(made, asked["key"].eqNullSafe(F.col("_key")) & (F.col("time") == F.col("_time")) & (F.col("window_s") == F.col("_window")))
    ends = ["median_chars", "high_chars"]
    head = [F.col("_id").alias(id_col), "window_s", F.col("time").alias("event_s")]
    timed = found.select(*head, "n_events", F.col("sum_value").alias("sum_chars"), F.col("n_kinds").alias("n_langs"), *ends)
    none = [F.lit(0).cast("long").alias(c) for c in ("n_events", "sum_chars", "n_langs")] + [F.lit(None).cast("long").alias(c) for c in ends]
    return timed.unionByName(asked.where("time is null").select(*head, *none))
