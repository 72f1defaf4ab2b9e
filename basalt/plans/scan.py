"""Scan queries: columns of a table, predicates, and a key-value projection."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.reduce import match_counts, sort_reduce


@dataclass(frozen=True)
class ScanQuery:
    """A table, a predicate, a key and a value expression. Columns that none of them names are never read."""

    table: DataFrame
    key: Column
    value: Column
    predicate: Column | None = None

    def where(self, predicate: Column) -> ScanQuery:
        """The query with one more condition."""
        return replace(self, predicate=predicate if self.predicate is None else self.predicate & predicate)

    def rows(self) -> DataFrame:
        return self.table if self.predicate is None else self.table.where(self.predicate)

    def to_kv(self) -> DataFrame:
        """(key, value) of the rows that match."""
        return self.rows().select(self.key.alias("key"), self.value.alias("value"))

    def reduce(self, name: str = "add") -> DataFrame:
        """to_kv() reduced by key."""
        return sort_reduce(self.to_kv(), name)

    def counts(self) -> DataFrame:
        """One row: rows and matches."""
        return match_counts(self.table, F.lit(True) if self.predicate is None else self.predicate)
