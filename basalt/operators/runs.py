"""The state of a loop as a log: each round adds a run of the rows that it changed.

Runs are bucketed by key. After round i, the last runs are merged into one of 2**k rounds, the largest power of two that divides i, if that is four or more; so
there are about log2(i) runs and a row is written again at most as often. Files of merged runs are deleted. A round's own rows stay readable by themselves until the next round ends. What a
round observed comes from the write itself, so no job is run to see whether anything changed. Counts of a write whose tasks were run again may be too high."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basalt.plans.metrics import seen_count
from basalt.session import scratch, width
from basalt.sources import bucketed, files


@dataclass
class Run:
    table: DataFrame
    path: str
    n_rows: int


class Runs:
    """A table (key, ...) in which later rows of a key count in place of earlier ones, as far as merge says: an aggregate of a column of one key's rows."""

    def __init__(self, spark: SparkSession, columns: list[str], *, merge: Callable[[str], Column] = F.min, buckets: int | None = None):
        self.spark, self.columns, self.merge = spark, columns, merge
        self.buckets, self.path = buckets or width(spark), scratch(spark, "runs")
        self.runs: list[Run] = []
        self.last: Run | None = None
        self.rounds = self.bytes_written = 0

    def _write(self, rows: DataFrame, name: str, *, dealt: bool) -> Run:
        seen, path = Observation(), f"{self.path}/{name}"
        table = bucketed.write(rows.observe(seen, F.count("*").alias("n")), path, "key", self.buckets, dealt=dealt)
        self.bytes_written += files.size(self.spark, path)
        return Run(table, path, seen_count(seen))

    def append(self, rows: DataFrame, *, dealt: bool = True) -> int:
        """Add a round's rows, each key once, and return how many there are. dealt: they are the result of an aggregate or join by key."""
        before, self.rounds = self.last, self.rounds + 1
        self.last = self._write(rows.select("key", *self.columns), f"round-{self.rounds}", dealt=dealt)
        self.runs.append(self.last)
        k = (self.rounds & -self.rounds).bit_length() - 1
        gone = []
        if k >= 2 and self.last.n_rows:
            n = k + 2  # the runs of 2**(k - 1), ... and 4 rounds, and four single ones
            gone, self.runs = self.runs[-n:], self.runs[:-n]
            self.runs.append(self._write(self._merged(gone, *self.columns), f"merged-{self.rounds}", dealt=True))
        # the round before was kept as the frontier even where it had been merged
        for path in {r.path for r in (*gone, *([before] if before else []))} - {r.path for r in (*self.runs, self.last)}:
            files.delete(self.spark, path)
        return self.last.n_rows

    def _merged(self, runs: list[Run], *columns: str) -> DataFrame:
        """One row for each key; unions of tables in the same buckets stay dealt, so nothing is moved."""
        rows = None
        for run in runs:
            # the filter keeps batches of columns out of the union: Spark 4.1 takes a union of batches for dealt too, but joins no partitions there
            part = run.table.select("key", *columns).where("key is not null")
            rows = part if rows is None else rows.union(part)
        return rows.groupBy("key").agg(*(self.merge(c).alias(c) for c in columns)) if columns else rows

    def without(self, rows: DataFrame) -> DataFrame:
        """rows whose key isn't in the table."""
        return rows.join(self._merged(self.runs), "key", "left_anti")

    def beside(self, rows: DataFrame, column: str) -> DataFrame:
        """rows with old, the table's value of column, null where it lacks the key."""
        return rows.join(self._merged(self.runs, column).withColumnRenamed(column, "old"), "key", "left")

    def table(self) -> DataFrame:
        """All rows, one for each key."""
        return self._merged(self.runs, *self.columns)
