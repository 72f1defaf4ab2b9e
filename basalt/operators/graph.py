"""Vertex-centric graphs: supersteps, programs and the loops around them.

Edges are a DataFrame (src, dst[, weight]) or a stored adjacency index of them (see adjacency.py); loops build one where they are given a DataFrame. Edges and
state lie in buckets by key, so a round moves the frontier's hubs and the messages only. State is a log of each round's changes (see runs.py), and what a round
observed while it was written ends the loop. Rounds whose frontier is small read the buckets of its vertices only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions.reducers import reducer
from basalt.operators import vectors
from basalt.operators.adjacency import PROBE, Adjacency, adjacency
from basalt.operators.ordering import positions, running_total
from basalt.operators.paths import shortest_paths
from basalt.operators.runs import Runs
from basalt.plans.metrics import seen_count
from basalt.session import scratch
from basalt.sources import bucketed, files

DAMPING, PAGE_BYTES = 0.85, 8192


@dataclass(frozen=True)
class GraphProgram:
    """edge(value, argument) makes a message, reduce names how messages of a vertex meet, converged(new, old) ends a vertex's work."""

    edge: Callable[[Column, Column], Column]
    reduce: str
    converged: Callable[[Column, Column], Column] = field(default=lambda new, old: F.lit(True))


BFS = GraphProgram(lambda v, arg: v, "min")
SSSP = GraphProgram(lambda v, arg: v + arg, "min", lambda new, old: new >= old)
PAGERANK = GraphProgram(lambda v, outdeg: v / outdeg, "add")
CONTRIBUTION = GraphProgram(lambda v, arg: v, "add")
NULL = GraphProgram(lambda v, arg: F.lit(0).cast("bigint"), "min")


def update(visited: DataFrame, found: DataFrame) -> DataFrame:
    """visited (key, value) with the values of found, and its new keys: the update program's step on the visited list."""
    return vectors.union(found, visited)


def prepare(edges: DataFrame) -> DataFrame:
    """Distinct edges without self loops."""
    return edges.where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(key, degree): out-degree of each source."""
    return edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("degree"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: n_edges and max_id."""
    return edges.agg(F.count("*").alias("n_edges"), F.max(F.greatest("src", "dst")).alias("max_id"))


def isolated(edges: DataFrame) -> DataFrame:
    """One row: how many ids up to the last source have no out-edge."""
    return edges.select("src").distinct().agg((F.coalesce(F.max("src") + 1, F.lit(0)) - F.count("*")).alias("n_isolated"))


def csr(edges: DataFrame, *, width: int = 8) -> DataFrame:
    """(id, degree, offset, neighbours) of every id from 0 to the last source; offset counts bytes of width for each neighbour before."""
    spark = edges.sparkSession
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))  # a vertex's own adjacency
    last = edges.agg(F.max("src")).first()[0]
    ids = spark.range(0 if last is None else last + 1)
    rows = ids.join(lists, "id", "left").select("id", F.coalesce(F.size("neighbours"), F.lit(0)).cast("bigint").alias("degree"), F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))
    return running_total(rows, "id", "degree", "before").select("id", "degree", (F.col("before") * width).alias("offset"), "neighbours")


def csr_index(edges: DataFrame) -> DataFrame:
    """(id, degree, first) of every id from 0 to the last source; first is the place of its first neighbour in csr_column()."""
    edges = edges.where("src >= 0").select("src", "dst")
    last = edges.agg(F.max("src")).first()[0]
    ids = edges.sparkSession.range(0 if last is None else last + 1)
    counted = ids.join(degrees(edges).withColumnRenamed("key", "id"), "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))
    return running_total(counted, "id", "degree", "first").select("id", "degree", "first")


def csr_column(edges: DataFrame) -> DataFrame:
    """(position, src, dst) sorted by src and dst. Positions are dealt by ranges of both, so a hub lies in several partitions and its neighbours are never one row."""
    return positions(edges.where("src >= 0").select("src", "dst"), F.col("src"), F.col("dst")).select("position", "src", "dst")


def pages_touched(index: DataFrame, frontier: DataFrame, *, page: int = PAGE_BYTES, width: int = 8) -> DataFrame:
    """One row: how many pages of adjacency data the frontier's vertices lie on."""
    active = index.join(frontier.select(F.col("key").alias("id")), "id", "left_semi").where("degree > 0")
    spans = F.sequence(F.expr(f"offset div {page}"), F.expr(f"(offset + degree * {width} - 1) div {page}"))
    return active.select(F.explode(spans).alias("p")).agg(F.count_distinct("p").alias("n_pages"))


def neighbours(edges: DataFrame | Adjacency, key: int) -> DataFrame:
    """Out-neighbours of one vertex; an index reads that vertex's buckets only."""
    return (edges.neighbours(key) if isinstance(edges, Adjacency) else edges.where(F.col("src") == key)).select("dst")


def superstep(frontier: DataFrame, edges: DataFrame | Adjacency, program: GraphProgram, *, argument: str = "weight") -> DataFrame:
    """(key, value): messages along the out-edges of the frontier (key, value), reduced by destination.

    argument is weight (1 where edges have none) or outdegree; an index holds degrees, else they are counted."""
    if isinstance(edges, Adjacency):
        sent = edges.messages(frontier, program.edge, argument=argument)
    else:
        if argument == "outdegree":
            out = edges.join(degrees(edges).select(F.col("key").alias("src"), F.col("degree").alias("arg")), "src")
        else:
            out = edges.withColumn("arg", F.col("weight") if "weight" in edges.columns else F.lit(1).cast("bigint"))
        sent = frontier.join(out, frontier["key"] == out["src"]).select(F.col("dst").alias("key"), program.edge(F.col("value"), F.col("arg")).alias("value"))
    return sent.groupBy("key").agg(reducer(program.reduce, F.col("value")).alias("value"))


@dataclass(frozen=True)
class Round:
    """What one superstep of a loop did: out-edges read, vertices that got messages, vertices that changed."""

    number: int
    edges: int
    messages: int
    changed: int


def rounds_table(spark: SparkSession, rounds: list[Round]) -> DataFrame:
    """(round, edges, messages, changed) of a loop's trace."""
    return spark.createDataFrame([(r.number, r.edges, r.messages, r.changed) for r in rounds], "round int, edges bigint, messages bigint, changed bigint")


def _loop(graph: Adjacency, state: Runs, program: GraphProgram, value: Callable[[DataFrame], DataFrame], changes: Callable[[DataFrame, int], DataFrame], most: int, trace: list[Round] | None, stop: Callable[[DataFrame], bool] | None = None) -> Runs:
    """Rounds from the state's last run on until nothing changes: value makes the frontier (key, value), changes says what of the reduced messages is new."""
    for number in range(1, most + 1):
        front = state.last
        if stop and stop(front.table):
            break
        keys = [r["key"] for r in front.table.select("key").collect()] if front.n_rows <= PROBE else None
        read, reduced = Observation(), Observation()
        sent = graph.messages(value(front.table), program.edge, keys=keys, rows=front.n_rows).observe(read, F.count("*").alias("n"))
        found = sent.groupBy("key").agg(reducer(program.reduce, F.col("value")).alias("value")).observe(reduced, F.count("*").alias("n"))
        changed = state.append(changes(found, number))
        if trace is not None:
            trace.append(Round(number, seen_count(read), seen_count(reduced), changed))
        if not changed:
            break
    return state


def _begin(spark: SparkSession, schema: str, *row: int) -> Runs:
    first = spark.createDataFrame([row], schema)
    state = Runs(spark, first.columns[1:])
    state.append(first, dealt=False)
    return state


def bfs(edges: DataFrame | Adjacency, source: int, *, parents: str = "min", until: int | None = None, max_levels: int = 10_000, trace: list[Round] | None = None) -> DataFrame:
    """(key, level, parent) of the vertices reached; of several parents the smallest or largest counts. The source is its own parent. trace gets each round."""
    graph = adjacency(edges)
    state = _begin(graph.edges.sparkSession, "key bigint, level int, parent bigint", source, 0, source)
    step = GraphProgram(lambda v, arg: v, parents)
    new = lambda found, level: state.without(found).select("key", F.lit(level).alias("level"), F.col("value").alias("parent"))
    stop = None if until is None else lambda front: not front.where(F.col("key") == until).isEmpty()
    return _loop(graph, state, step, lambda front: front.select("key", F.col("key").alias("value")), new, max_levels, trace, stop).table()


def level_statistics(reached: DataFrame) -> DataFrame:
    """(level, n) of a bfs() result."""
    return reached.groupBy("level").agg(F.count("*").alias("n"))


def level_report(edges: DataFrame, source: int, *, page: int = PAGE_BYTES, bytes_each: int = 8) -> DataFrame:
    """(level, frontier, visited, pages) of a search from source: new vertices, all so far, and pages of adjacency data that the level's vertices lie on."""
    edges = edges.select("src", "dst")
    reached = bfs(edges, source)
    index = csr(edges, width=bytes_each).where("degree > 0").select(F.col("id").alias("key"), "degree", "offset")
    spans = F.sequence(F.expr(f"offset div {page}"), F.expr(f"(offset + degree * {bytes_each} - 1) div {page}"))
    pages = reached.join(index, "key").select("level", F.explode(spans).alias("p")).groupBy("level").agg(F.count_distinct("p").alias("pages"))
    # one row for each level meets in the window
    so_far = F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    levels = level_statistics(reached).select("level", F.col("n").alias("frontier"), so_far.alias("visited"))
    return levels.join(pages, "level", "left").select("level", "frontier", "visited", F.coalesce("pages", F.lit(0)).alias("pages"))


def shortest_path(edges: DataFrame | Adjacency, source: int, target: int) -> DataFrame:
    """(step, vertex) from the target's parent back to the source, by largest parents; no rows if there is no path, the source alone if both are one."""
    graph = adjacency(edges)
    asked = graph.edges.sparkSession.createDataFrame([(0, source, target)], "search bigint, source bigint, target bigint")
    return shortest_paths(graph, asked).select("step", "vertex")


def sssp(edges: DataFrame | Adjacency, source: int, *, max_rounds: int = 10_000, trace: list[Round] | None = None) -> DataFrame:
    """(key, value): least sums of weights from source, weights not negative; 1 each where edges have none. trace gets each round."""
    graph = adjacency(edges)
    state = _begin(graph.edges.sparkSession, "key bigint, value bigint", source, 0)

    def new(found: DataFrame, _: int) -> DataFrame:
        return state.beside(found, "value").where(F.col("old").isNull() | ~SSSP.converged(F.col("value"), F.col("old")))

    return _loop(graph, state, SSSP, lambda front: front, new, max_rounds, trace).table()


def contribution_init(edges: DataFrame, n: int) -> DataFrame:
    """(key, value) of ids 0 to n - 1: 1 / outdegree, 0.01 without out-edges."""
    ids = edges.sparkSession.range(n).select(F.col("id").alias("key"), F.lit(0.0).alias("value"))
    return vectors.arith(ids, degrees(edges), lambda v, d: F.when(d.isNull(), F.lit(0.01)).otherwise(1 / d))


def contribution_step(vector: DataFrame, edges: DataFrame) -> DataFrame:
    """One pass-through sum step, then value * 0.85 + 0.15 / outdegree, or + 0.0015 without out-edges."""
    got = superstep(vector, edges, CONTRIBUTION)
    return vectors.arith(got, degrees(edges), lambda v, d: v * DAMPING + F.when(d.isNull(), F.lit(0.0015)).otherwise(0.15 / d))


def pagerank(edges: DataFrame | Adjacency, rounds: int = 10, *, damping: float = DAMPING) -> DataFrame:
    """(key, value): rank = 1 - damping + damping * sum(rank / outdegree) for every vertex of the edges, from 1 each."""
    graph = adjacency(edges)
    n, path = graph.buckets, scratch(graph.edges.sparkSession, "ranks")
    ends = graph.degrees.select("key", "degree").union(graph.edges.select("dst", F.lit(None).cast("bigint"))).groupBy("key").agg(F.max("degree").alias("degree"))
    start = bucketed.write(ends, f"{path}/0", "key", n, dealt=True)
    ranks = start.select("key", F.lit(1.0).alias("value"), "degree")
    kept = None
    for i in range(1, rounds + 1):
        # a vertex's share is the same for all its edges, so they needn't carry its degree
        shares = ranks.where("degree is not null").select("key", PAGERANK.edge(F.col("value"), F.col("degree")).alias("value"))
        sent = graph.messages(shares, CONTRIBUTION.edge, rows=graph.n_sources).groupBy("key").agg(F.sum("value").alias("s"))
        ranks = start.join(sent, "key", "left").select("key", (F.coalesce("s", F.lit(0.0)) * damping + (1 - damping)).alias("value"), "degree")
        if i % 4 == 0 and i < rounds:
            ranks, done, kept = bucketed.write(ranks, f"{path}/{i}", "key", n, dealt=True), kept, f"{path}/{i}"
            if done:
                files.delete(graph.edges.sparkSession, done)
    return ranks.select("key", "value")
