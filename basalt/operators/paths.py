"""Many point-to-point searches at once.

Searches go from both ends, along the edges from the source and against them from the target, so that each side covers about half of the levels and frontiers stay far
from the whole graph. Frontiers are keyed by search and vertex, so all searches share each round, of the side whose frontiers are smaller; a search whose sides
meet, or of which one side has ended, leaves them. From where they met, the search goes on towards the target over the vertices that the other side found, each at
its known distance: those are the vertices of shortest paths, so a vertex's largest parent is the one that a search from the source alone gives. Paths are then
traced back by joins, a step of all searches in each round. State is a log of each round's changes (see runs.py).

Defined cases: a search whose target can't be reached has no rows; source and target may be one; sources and targets that aren't in the graph reach
nothing but themselves; two searches may ask the same; a repeated or null search id is an error; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from basalt.operators.adjacency import PROBE, Adjacency, adjacency
from basalt.operators.runs import Runs
from basalt.plans.metrics import seen_count
from basalt.session import scratch


def _key(search: str, vertex: str):
    return F.concat_ws(":", F.col(search), F.col(vertex))


def _spread(graph: Adjacency, front: DataFrame, left: Column, n: int) -> DataFrame:
    """(key, search, vertex, parent, left): the vertices that the n rows of a frontier (search, vertex, ...) have edges to, with the largest of its vertices and left."""
    keys = [r["vertex"] for r in front.select("vertex").distinct().collect()] if n <= PROBE else None
    value = F.struct("search", F.col("vertex").alias("parent"), left.alias("left"))
    sent = graph.messages(front.select(F.col("vertex").alias("key"), value.alias("value")), lambda v, arg: v, keys=keys, rows=n)
    each = [F.min("value.search").alias("search"), F.min("key").alias("vertex"), F.max("value.parent").alias("parent"), F.max("value.left").alias("left")]
    return sent.groupBy(F.concat_ws(":", "value.search", "key").alias("key")).agg(*each)


def shortest_paths(edges: DataFrame | Adjacency, searches: DataFrame, *, max_levels: int = 10_000) -> DataFrame:
    """(search, step, vertex) for searches (search, source, target): from the target's parent, step 0, back to the source, by largest parents."""
    graph = adjacency(edges)
    spark = graph.edges.sparkSession
    path = scratch(spark, "searches")
    searches.select(*(F.col(c).cast("bigint").alias(c) for c in ("search", "source", "target"))).write.parquet(f"{path}/asked")
    asked = spark.read.parquet(f"{path}/asked")
    if asked.where("search is null").count() or asked.count() != asked.select("search").distinct().count():
        raise ValueError("searches need ids of their own")
    whole = asked.where("source is not null and target is not null")
    ahead, behind = Runs(spark, ["search", "vertex", "parent", "left"]), Runs(spark, ["search", "vertex", "left"])
    none, zero = F.lit(None).cast("int"), F.lit(0)
    ahead.append(whole.select(_key("search", "source").alias("key"), "search", F.col("source").alias("vertex"), F.col("source").alias("parent"), none.alias("left")), dealt=False)
    behind.append(whole.select(_key("search", "target").alias("key"), "search", F.col("target").alias("vertex"), zero.alias("left")), dealt=False)
    against, far = None, 0
    for level in range(max_levels + 1):
        front, back = ahead.last.table, behind.last.table
        # the sides have the same levels in all searches, so they first meet in both last rounds, or not
        front.select("key", "search", "vertex").join(back.select("key", "left"), "key").select("search", "vertex", "left").write.parquet(f"{path}/met/level={level}")
        met = spark.read.schema("search bigint, vertex bigint, left int").parquet(f"{path}/met/level={level}")
        sizes = front.groupBy("search").agg(F.count("*").alias("n_ahead")).join(back.groupBy("search").agg(F.count("*").alias("n_behind")), "search")
        sizes.join(met, "search", "left_anti").write.parquet(f"{path}/open/level={level}")
        going = spark.read.schema("search bigint, n_ahead bigint, n_behind bigint").parquet(f"{path}/open/level={level}")
        n, n_ahead, n_behind = going.agg(F.count("*"), F.sum("n_ahead"), F.sum("n_behind")).first()
        if not n or level == max_levels:
            break
        if n_ahead <= n_behind:
            ahead.append(ahead.without(_spread(graph, front.join(going, "search", "left_semi"), none, n_ahead)))
        else:
            against, far = against or Adjacency.build(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), far + 1
            behind.append(behind.without(_spread(against, back.join(going, "search", "left_semi"), F.lit(far), n_behind)))
    known = behind.table().select("key", F.col("left").alias("known"))
    front = spark.read.schema("search bigint, vertex bigint, left int").parquet(f"{path}/met")
    n = front.count()
    for _ in range(far):
        n = ahead.append(_spread(graph, front.where("left > 0"), F.col("left") - 1, n).join(known, "key").where("left = known"))
        if not n:
            break
        front = ahead.last.table
    parents = ahead.table().select("key", "parent")
    now = whole.select("search", "source", F.col("target").alias("vertex"))
    for step in range(max_levels + 1):
        seen = Observation()
        found = now.withColumn("key", _key("search", "vertex")).join(parents, "key").select("search", "source", F.col("parent").alias("vertex"))
        found.observe(seen, F.count_if(F.expr("vertex <> source")).alias("n")).write.parquet(f"{path}/steps/step={step}")
        if not seen_count(seen):
            break
        now = spark.read.parquet(f"{path}/steps/step={step}").where("vertex <> source")
    return spark.read.schema("search bigint, source bigint, vertex bigint, step int").parquet(f"{path}/steps").select("search", "step", "vertex")
