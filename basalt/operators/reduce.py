"""Reduction of key-value streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.reducers import reducer


def sort_reduce(kv: DataFrame, name: str, *, order: Column | None = None) -> DataFrame:
    """(key, value) with one row for each key. Input order doesn't matter; the reduction is partial before the shuffle, final after."""
    return kv.groupBy("key").agg(reducer(name, F.col("value"), order).alias("value"))


def merge_reduce(a: DataFrame, b: DataFrame, name: str, *, order: Column | None = None) -> DataFrame:
    """Two streams reduced into one."""
    return sort_reduce(a.unionByName(b), name, order=order)


def unique_check(kv: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n rows, how many distinct keys, and how many rows repeat a key; by group if by is given."""
    counts = kv.groupBy(*(by or []), "key").agg(F.count("*").alias("c"))
    out = counts.groupBy(*(by or [])).agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"))
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "n_repeats": F.coalesce("n", F.lit(0)) - F.col("n_distinct")})


def match_counts(df: DataFrame, predicate: Column, by: list[str] | None = None) -> DataFrame:
    """Rows, and rows that match."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), F.count_if(predicate).alias("n_matches"))
