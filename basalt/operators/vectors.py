"""Set algebra on sparse vectors: DataFrames (key, value) with distinct keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.reduce import sort_reduce


def _same_types(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = ("key",)) -> None:
    for c in columns:
        if a.schema[c].dataType != b.schema[c].dataType:
            raise ValueError(f"{c} has type {a.schema[c].dataType.simpleString()} on one side and {b.schema[c].dataType.simpleString()} on the other")


def _with_other(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.join(b.select("key", F.col("value").alias("other"), F.lit(True).alias("found")), "key", how)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose key isn't in b."""
    _same_types(a, b)
    return a.join(b.select("key"), "key", "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose key is in b."""
    _same_types(a, b)
    return a.join(b.select("key"), "key", "left_semi")


def union(a: DataFrame, b: DataFrame, reducer: str | None = None) -> DataFrame:
    """All keys; values of keys in both are reduced, or a's wins without a reducer."""
    _same_types(a, b, ("key", "value"))
    if reducer is None:
        both = _with_other(a.withColumn("mine", F.lit(True)), b, "full")
        return both.select("key", F.when(F.col("mine"), F.col("value")).otherwise(F.col("other")).alias("value"))
    return sort_reduce(a.select("key", "value").unionByName(b.select("key", "value")), reducer)


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """All keys; values of keys in both are summed."""
    return union(a, b, "add")


def apply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of a, with b's value where it has one."""
    _same_types(a, b, ("key", "value"))
    return _with_other(a, b, "left").select("key", F.when(F.col("found"), F.col("other")).otherwise(F.col("value")).alias("value"))


def not_converged(a: DataFrame, b: DataFrame, converged: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows of a that b lacks, or whose value hasn't converged against b's: converged(new, old)."""
    _same_types(a, b, ("key", "value"))
    done = F.coalesce(F.col("found"), F.lit(False)) & converged(F.col("value"), F.col("other"))
    return _with_other(a, b, "left").where(~done).select("key", "value")


def arith(a: DataFrame, degrees: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """f(value, degree) for each key; degree is null where degrees (key, degree) has none."""
    return a.join(degrees, "key", "left").select("key", f(F.col("value"), F.col("degree")).alias("value"))


def is_empty(a: DataFrame) -> bool:
    return a.isEmpty()


def of_rows(spark, rows: list[tuple[int, int]], kind: str = "bigint") -> DataFrame:
    """A vector from (key, value) pairs."""
    return spark.createDataFrame(rows, f"key bigint, value {kind}")
