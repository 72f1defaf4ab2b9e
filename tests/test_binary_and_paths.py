"""Reducers of two values, and many searches at once."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.functions import binary
from basalt.operators import graph, paths
from basalt.operators.adjacency import Adjacency
from basalt.operators.runs import Runs


def test_binary_reducers_match_a_model(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", *map(str, range(30))]), rng.choice([None, *range(1, 200)])) for _ in range(3000)] + [("none", None)]
    model = {}
    for k, v in rows:
        model.setdefault(k, []).extend([] if v is None else [6 * v])
    kv = spark.createDataFrame(rows, "key string, value int").withColumn("value", F.col("value") * 6)
    for parts in (1, 7):
        assert {r["key"]: r["value"] for r in binary.reduce_by_key(kv.repartition(parts), binary.GCD).collect()} == {k: math.gcd(*v) if v else None for k, v in model.items()}
    monkeypatch.setattr(binary, "_KEYS", 5)
    got = binary.reduce_by_key(kv, binary.GCD).collect()
    assert len(got) == len(model) and binary.reduce_by_key(kv.limit(0), binary.GCD).count() == 0
    one = binary.reduce_by_key(spark.range(50_000).selectExpr("0L as key", "cast(id % 3 as double) as value"), binary.LOG_SUM).first()
    assert abs(one["value"] - math.log(sum(math.exp(i % 3) for i in range(50_000)))) < 1e-9


def test_a_task_sends_each_key_once(spark):
    kv = spark.range(40_000).selectExpr("id % 100 as key", "id as value").repartition(4)
    df = binary.reduce_by_key(kv, binary.GCD)
    df.write.format("noop").mode("overwrite").save()
    sent = spark.createDataFrame(kv.rdd.mapPartitions(lambda rows: [len({r["key"] for r in rows})]).map(lambda n: (n,)), "n long").agg(F.sum("n")).first()[0]
    assert sent == 400  # what the exchange may hold at most
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") >= 2 and text.index("Exchange") < text.rindex("MapInArrow")


def test_laws_are_checked():
    binary.check_laws(binary.GCD, binary.small_values())
    binary.check_laws(binary.LOG_SUM, binary.small_values(floating=True))
    with pytest.raises(ValueError, match="commutative"):
        binary.check_laws(binary.BinaryReducer("minus", np.subtract), [1, 2, 3])
    with pytest.raises(ValueError, match="associative"):
        binary.check_laws(binary.BinaryReducer("mean", lambda a, b: (a + b) / 2, floating=True), [1, 2, 4])


def test_many_searches_match_one_after_the_other(spark):
    rng = random.Random(6)
    rows = {(rng.randrange(60), rng.randrange(60)) for _ in range(110)}
    index = Adjacency.build(spark.createDataFrame(list(rows), "src bigint, dst bigint"), buckets=4)
    asked = [(i, rng.randrange(62), rng.randrange(62)) for i in range(12)] + [(20, 5, 5), (21, 5, 5), (22, None, 1), (23, 1, None)]
    got = {}
    for r in paths.shortest_paths(index, spark.createDataFrame(asked, "search bigint, source bigint, target bigint")).collect():
        got.setdefault(r["search"], []).append((r["step"], r["vertex"]))
    near = {}
    for s, t in sorted(rows):
        near.setdefault(s, []).append(t)
    for search, source, target in asked:
        level, parent, order = {source: 0}, {source: source}, [source]
        for s in order:
            for t in near.get(s, []):
                if t not in level:
                    level[t] = level[s] + 1
                    order.append(t)
                if level[t] == level[s] + 1:
                    parent[t] = max(parent.get(t, -1), s)
        want, at = [], target
        while source is not None and at in parent:
            want.append((len(want), parent[at]))
            at = parent[at]
            if at == source:
                break
        assert sorted(got.get(search, [])) == want, (search, source, target)
    one = [tuple(r) for r in graph.shortest_path(index, asked[0][1], asked[0][2]).collect()]
    assert sorted(got.get(0, [])) == sorted(one)
    empty = paths.shortest_paths(index, spark.createDataFrame([], "search bigint, source bigint, target bigint"))
    assert empty.count() == 0
    with pytest.raises(ValueError, match="ids of their own"):
        paths.shortest_paths(index, spark.createDataFrame([(1, 2, 3), (1, 3, 4)], "search bigint, source bigint, target bigint"))


def test_searches_meet_in_the_middle(spark, monkeypatch):
    """A source with a wide tree of 37,448 vertices ahead: the search finds a leaf from both ends, without the tree."""
    tree = spark.range(1, 37_449).selectExpr("(id - 1) div 8 as src", "id as dst")
    asked = spark.createDataFrame([(1, 0, 37_448), (2, 0, 99_999), (3, 37_448, 0), (4, 5, 5), (5, 0, None)], "search bigint, source bigint, target bigint")
    rows, append = [], Runs.append
    monkeypatch.setattr(Runs, "append", lambda self, *a, **k: rows.append(append(self, *a, **k)) or rows[-1])
    got = sorted(map(tuple, paths.shortest_paths(tree, asked).collect()))
    want = [(1, 0, 4680), (1, 1, 584), (1, 2, 72), (1, 3, 8), (1, 4, 0), (4, 0, 5)]
    assert got == want and sum(rows) < 200
