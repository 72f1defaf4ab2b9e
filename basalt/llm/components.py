"""Connected components by alternating large-star and small-star steps, with written tables between rounds.

No vertex's neighbours are gathered in one task: minima are partly aggregated before the shuffle, and the join back on a vertex can be
split when it is a hub."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.store import staged


def _rows(links: DataFrame, *rows: Column) -> DataFrame:
    """The structs that each link gives, null for none, as rows. A union would read the links once for each."""
    return links.select(F.explode(F.array(*rows)).alias("r")).where("r is not null").select("r.*")


def _pair(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _to_minimum(links: DataFrame, keep: str) -> DataFrame:
    """Each (u, v) becomes (v, the smallest of u and its neighbours), where keep holds; and u itself, once for each of its links to its smallest neighbour."""
    least = links.groupBy("u").agg(F.min("v").alias("near")).select("u", "near", F.least("u", "near").alias("m"))
    return _rows(links.join(least, "u"), F.when(F.expr(keep), _pair("v", "m")), F.when(F.col("v") == F.col("near"), _pair("u", "m"))).where("u <> v")


def _flat(now: DataFrame) -> bool:
    """Whether each u has one v and no v is a u as well: then v < u in each row makes each v the smallest of its component."""
    end = lambda x, up: F.struct(F.col(x).alias("x"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = _rows(now, end("u", 1), end("v", 0)).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up + down > 1 and up > 0").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node that can be reached.

    Loops, repeated edges and either direction are fine; a row with a null end counts for nothing; no edges give no rows. What is a component's star already costs no round,
    so a result may be given back with further edges."""
    now = staged(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _flat(now):
        large = _to_minimum(_rows(now, _pair("u", "v"), _pair("v", "u")), "v > u").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = staged(_to_minimum(large, "v <> m").distinct(), "edges")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
