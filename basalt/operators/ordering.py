"""Sorting, merging of sorted lists, positions and order checks.

What would need a window over all rows is done in blocks; only the blocks' own rows, one for each, meet in one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.session import cut

BLOCK = 1 << 16


def sort_kv(kv: DataFrame, *, descending: bool = False) -> DataFrame:
    """Sorted by key, then value; a range-partitioned external sort."""
    return kv.orderBy(*(F.desc(c) if descending else F.asc(c) for c in ("key", "value")))


def sort_edges(edges: DataFrame, *, descending: bool = False) -> DataFrame:
    """Sorted by src, then dst."""
    return edges.orderBy(*(F.desc(c) if descending else F.asc(c) for c in ("src", "dst")))


def merge_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two edge lists as one sorted list; repeats stay."""
    return sort_edges(a.unionByName(b))


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """df sorted, with position, the row's place from 0. Rows are dealt by ranges; a count for each partition comes to the driver."""
    spark = df.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", place))
    base, before = [], 0
    for row in sorted(ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        base.append((row["_p"], before))
        before += row["n"]
    known = F.broadcast(spark.createDataFrame(base, "_p int, _base bigint"))  # one row for each partition
    return ranged.join(known, "_p").withColumn("position", F.col("_base") + F.col("_i")).drop("_p", "_i", "_base")


def sort_small(values: Column, *, descending: bool = False) -> Column:
    """An array's elements in order: the fixed-width sorting network."""
    return F.sort_array(values, asc=not descending)


def page_sort(df: DataFrame, position: str, key: str, *, page: int = 256, descending: bool = False) -> DataFrame:
    """df with page and rank: rows sorted by key inside each page of consecutive positions, equal keys by position."""
    pages = df.withColumn("page", F.expr(f"{position} div {page}"))
    order = Window.partitionBy("page").orderBy(F.desc(key) if descending else F.asc(key), position)
    return pages.withColumn("rank", F.row_number().over(order))


def running_total(df: DataFrame, key: str, value: str, into: str, *, block: int = BLOCK) -> DataFrame:
    """df with the sum of value over all smaller keys; key is a distinct long."""
    blocked = df.withColumn("_block", F.expr(f"{key} div {block}"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_total"))
    before = totals.select("_block", F.coalesce(F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return blocked.withColumn("_local", local).join(before, "_block").withColumn(into, F.col("_base") + F.col("_local")).drop("_block", "_local", "_base")


def order_report(df: DataFrame, position: str, key: str, *, block: int = BLOCK) -> DataFrame:
    """One row: n_rows, n_descents (key below the one before it) and n_ties (equal to it), in order of position."""
    blocked = df.select(F.col(position).alias("p"), F.col(key).alias("k"), F.expr(f"{position} div {block}").alias("b"))
    before = F.lag("k").over(Window.partitionBy("b").orderBy("p"))
    inside = blocked.withColumn("o", before)
    per = inside.groupBy("b").agg(
        F.count("*").alias("n"), F.count_if(F.col("k") < F.col("o")).alias("d"), F.count_if(F.col("k") == F.col("o")).alias("t"), F.min_by("k", "p").alias("first"), F.max_by("k", "p").alias("last")
    )
    edge = per.withColumn("o", F.lag("last").over(Window.orderBy("b")))
    return edge.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("d") + (F.col("first") < F.col("o")).cast("int").eqNullSafe(1).cast("int")), F.lit(0)).alias("n_descents"),
        F.coalesce(F.sum(F.col("t") + (F.col("first") == F.col("o")).cast("int").eqNullSafe(1).cast("int")), F.lit(0)).alias("n_ties"),
    )


def is_sorted(df: DataFrame, position: str, key: str, *, strict: bool = False) -> bool:
    """Whether keys ascend in order of position; strict allows no ties."""
    row = order_report(df, position, key).first()
    return row["n_descents"] == 0 and not (strict and row["n_ties"])
