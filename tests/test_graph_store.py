"""The stored adjacency index, split hubs, and the loops' log of changes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from basalt.operators import graph
from basalt.operators.adjacency import Adjacency
from basalt.operators.runs import Runs
from basalt.sources import bucketed, files


def pairs(df):
    return sorted(map(tuple, df.collect()))


def plan(spark, df):
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def some_edges(spark, n=3000, ids=200, hub=3000):
    rng = random.Random(8)
    rows = {(rng.randrange(-5, ids), rng.randrange(ids)) for _ in range(n)} | {(7, 10_000 + i) for i in range(hub)}
    return rows, spark.createDataFrame([(*r, 1 + sum(r) % 5) for r in rows], "src bigint, dst bigint, weight bigint")


def test_build_open_and_look_up(spark, tmp_path):
    rows, edges = some_edges(spark)
    path = f"file://{tmp_path}/index"
    built = Adjacency.build(edges.union(spark.createDataFrame([(None, 1, 1), (1, None, 1)], edges.schema)), path, buckets=8)
    assert (built.n_edges, built.n_sources) == (len(rows), len({s for s, _ in rows})) and built.n_hubs >= 1
    index = Adjacency.open(spark, path)
    for keys in ((7,), (3, 7, -2), (999_999,), ()):
        assert pairs(index.neighbours(*keys).select("src", "dst")) == sorted(r for r in rows if r[0] in keys)
    assert pairs(graph.neighbours(index, 3)) == sorted((t,) for s, t in rows if s == 3)
    assert {(r["key"], r["degree"]) for r in index.degrees.collect()} == {(s, sum(1 for x in rows if x[0] == s)) for s, _ in rows}
    with pytest.raises(FileExistsError):
        Adjacency.build(edges, path)
    with pytest.raises(ValueError, match="slot or degree"):
        Adjacency.build(edges.withColumn("slot", F.lit(1)))
    empty = Adjacency.build(edges.limit(0))
    assert (empty.n_edges, empty.neighbours(1).count()) == (0, 0) and pairs(graph.bfs(empty, 5)) == [(5, 0, 5)]


def test_unfinished_builds_cannot_be_opened(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    Adjacency.build(some_edges(spark)[1], path)
    files.delete(spark, f"{path}/manifest.json")
    with pytest.raises(FileNotFoundError):
        Adjacency.open(spark, path)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("basalt_")]  # nothing is left in the catalog


def test_lookups_read_few_buckets_and_joins_move_no_edges(spark):
    _, edges = some_edges(spark)
    index = Adjacency.build(edges, buckets=8)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't say which buckets it reads
    try:
        told = re.search(r"SelectedBucketsCount: (\d+) out of 8", plan(spark, index.neighbours(3, 4)))
        assert int(told[1]) <= 2
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        front = bucketed.write(spark.range(50).selectExpr("id as key", "id as value"), index.path + "-front", "key", 8)
        text = plan(spark, index.messages(front, graph.SSSP.edge))
        assert len(re.findall("Exchange hashpartitioning", text)) == 1 and "REPARTITION_BY_NUM" in text  # the rows of hubs, to their further slots
        assert "SortMergeJoin" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        files.delete(spark, index.path + "-front")


def test_a_star_is_dealt_evenly(spark):
    star = spark.range(1, 1_000_001).selectExpr("0L as src", "id as dst")
    index = Adjacency.build(star, buckets=8)
    each = [r["count"] for r in index.edges.groupBy(F.input_file_name()).count().collect()]
    assert index.n_hubs == 1 and len(each) == 8 and max(each) <= 2 * sorted(each)[4] and sum(each) == 1_000_000
    reached = graph.bfs(index, 0)
    assert reached.count() == 1_000_001 and reached.where("key > 0 and (level <> 1 or parent <> 0)").isEmpty()


def test_loops_with_and_without_an_index(spark):
    rows, edges = some_edges(spark)
    index = Adjacency.build(edges, buckets=4)
    near = {}
    for s, t in rows:
        near.setdefault(s, []).append(t)
    level, order = {7: 0}, [7]
    for s in order:
        for t in near.get(s, []):
            if t not in level:
                level[t] = level[s] + 1
                order.append(t)
    dist, todo = {7: 0}, [7]
    while todo:
        s = todo.pop()
        for t in near.get(s, []):
            far = dist[s] + 1 + (s + t) % 5
            if far < dist.get(t, 10**9):
                dist[t] = far
                todo.append(t)
    trace = []
    assert {r["key"]: r["level"] for r in graph.bfs(index, 7, trace=trace).collect()} == level
    assert [r.changed for r in trace] == [list(level.values()).count(i + 1) for i in range(len(trace))]
    assert [r.edges for r in trace] == [sum(len(near.get(v, [])) for v, at in level.items() if at == i) for i in range(len(trace))]
    assert dict(pairs(graph.sssp(index, 7))) == dict(pairs(graph.sssp(edges, 7))) == dist
    ones = edges.select(F.col("src").alias("key")).distinct().withColumn("value", F.lit(1.0))
    for argument in ("weight", "outdegree"):
        a, b = (dict(pairs(graph.superstep(ones, e, graph.PAGERANK, argument=argument))) for e in (index, edges))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    a, b = dict(pairs(graph.pagerank(index, 6))), dict(pairs(graph.pagerank(edges.drop("weight"), 6)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_runs_match_a_dictionary(spark):
    rng, model, state = random.Random(1), {}, Runs(spark, ["value"], buckets=4)
    for _ in range(13):
        rows = {rng.randrange(300): rng.randrange(1000) for _ in range(rng.choice([3, 100, 200]))}
        df = spark.createDataFrame(list(rows.items()), "key bigint, value bigint").groupBy("key").agg(F.min("value").alias("value"))
        if state.runs:
            assert pairs(state.without(df).select("key")) == sorted((k,) for k in rows if k not in model)
            df = state.beside(df, "value").where("old is null or value < old")
        changed = {k: v for k, v in rows.items() if k not in model or v < model[k]}
        model.update(changed)
        assert state.append(df) == len(changed)
        assert pairs(state.table()) == sorted(model.items()) and state.table().count() == len(model)
        assert pairs(state.last.table) == sorted(changed.items())
    # three binary digits of 13, and the frontier
    assert len(state.runs) == 3 and len(files.listed(spark, state.path)) == 3


def test_two_hundred_rounds_write_bytes_in_proportion(spark):
    state, at = Runs(spark, ["value"], buckets=1), {}
    for i in range(1, 201):
        state.append(spark.range(i * 500, i * 500 + 500).selectExpr("id as key", "id as value"), dealt=False)
        at[i] = state.bytes_written
    assert at[200] < 2.4 * at[100] and len(state.runs) <= 9
    assert state.table().count() == 100_000


def test_repeats_are_dropped_as_the_index_is_built(spark):
    """Vertex 7 is a hub by its rows, most of them repeats of one edge."""
    rows, edges = some_edges(spark)
    repeated = edges.union(edges).union(spark.range(5000).selectExpr("7L", "10000L", "1 + 10007L % 5"))
    index = Adjacency.build(repeated, distinct=True)
    assert index.n_hubs >= 1 and index.n_edges == len(rows) and index.n_sources == len({s for s, _ in rows})
    assert pairs(index.edges.select("src", "dst")) == sorted(rows) and not files.exists(spark, f"{index.path}/rows")
    assert pairs(index.neighbours(7).select("dst")) == sorted((t,) for s, t in rows if s == 7)
    assert dict(pairs(index.degrees)) == {s: sum(1 for x in rows if x[0] == s) for s, _ in rows}
    assert dict(pairs(graph.sssp(index, 7))) == dict(pairs(graph.sssp(edges, 7)))


def test_ranks_need_no_degree_at_an_edge(spark):
    rows, edges = some_edges(spark, hub=1500)
    index = Adjacency.build(edges.drop("weight"))
    assert index.edges.columns == ["slot", "src", "dst"]
    out, rank = {}, {v: 1.0 for r in rows for v in r}
    for s, _ in rows:
        out[s] = out.get(s, 0) + 1
    for _ in range(5):
        got = dict.fromkeys(rank, 0.0)
        for s, t in rows:
            got[t] += rank[s] / out[s]
        rank = {v: 0.15 + 0.85 * x for v, x in got.items()}
    found = dict(pairs(graph.pagerank(index, 5)))
    assert found.keys() == rank.keys() and all(abs(found[k] - rank[k]) < 1e-9 for k in rank)


def test_edges_are_not_sorted_to_meet_a_frontier_of_known_size(spark):
    rows, edges = some_edges(spark, hub=0)
    index = Adjacency.build(edges, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        front = bucketed.write(spark.range(50).selectExpr("id as key", "id as value"), index.path + "-front", "key", 4)
        sent = index.messages(front, graph.SSSP.edge, rows=50)
        text = plan(spark, sent)
        assert "ShuffledHashJoin" in text and "Sort" not in text.replace("SortMergeJoin", "") and "Exchange" not in text
        assert pairs(sent) == sorted((t, s + 1 + (s + t) % 5) for s, t in rows if 0 <= s < 50)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        files.delete(spark, index.path + "-front")
