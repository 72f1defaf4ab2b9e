"""Small cases of the core engine: hand-made inputs, plain-Python models, round trips."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basalt.functions import predicates as P
from basalt.functions.encoding import encode
from basalt.functions.reducers import reducer, register
from basalt.operators import generate, graph, ordering, reduce, vectors
from basalt.plans.metrics import counted
from basalt.plans.q14 import fixed_point
from basalt.plans.scan import ScanQuery
from basalt.sources import columns, edges as edge_files
from basalt.sources.tables import register as register_views
from basalt.streaming import continuous

STRINGS = ["hello world", "123456789012345678901234567890", "hello world         0123456789", "234jk00982jjsmc", "5     9999990001j +-/hello32as", "o23hrulKJhlSKJDfnlskjdflskdjli"]


def pairs(df):
    return sorted(map(tuple, df.collect()))


def strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "s string")


def test_substrings(spark):
    assert strings(spark, *STRINGS).where(P.contains(F.col("s"), "hello")).count() == 3
    assert strings(spark, "abcdefPROMOx").where(P.contains(F.col("s"), "PROMO\0\0\0")).count() == 1
    for exact in (False, True):
        got = strings(spark, "PRxMO", "PRMO", "PR%MO", "a_b").where(P.contains(F.col("s"), "PR\0MO", exact_bytes=exact))
        assert pairs(got) == [("PR%MO",), ("PRxMO",)]
    assert strings(spark, "axb", "a_b").where(P.contains(F.col("s"), "\0_b")).count() == 1
    accent = strings(spark, "1é2")  # two bytes, one character
    assert accent.where(P.contains(F.col("s"), "1\0" + "2")).count() == 1
    assert accent.where(P.contains(F.col("s"), "1\0" + "2", exact_bytes=True)).count() == 0
    assert accent.where(P.contains(F.col("s"), "1\0\0" + "2", exact_bytes=True)).count() == 1


def test_wildcards_match_a_byte_model(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    for pattern in ("ab", "a\0b", "a\0\0c", "b\0a\0c"):
        body = pattern.rstrip("\0")
        model = sum(any(all(p in ("\0", c) for p, c in zip(body, w[i : i + len(body)], strict=True)) for i in range(len(w) - len(body) + 1)) for w in words)
        assert strings(spark, *words).where(P.contains(F.col("s"), pattern)).count() == model


@pytest.mark.parametrize(("word", "want"), [(0b110, [10, 19]), (0b001, [5, 20, 25]), (0b100, [20, 25]), (0b011, [5, 10, 19])])
def test_combiner_words(spark, word, want):
    df = spark.createDataFrame([(v,) for v in (5, 10, 19, 20, 25)], "v int")
    assert [v for (v,) in pairs(df.where(P.thresholds(F.col("v"), 10, 20, word)))] == want


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select("id", F.col("id").cast("string").alias("s")).write.parquet(f"{tmp_path}/t")
    plan = spark.read.parquet(f"{tmp_path}/t").where(P.in_range(F.col("id"), 2, 5) & P.contains(F.col("s"), "3")).select("id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert all(x in plan for x in ("GreaterThanOrEqual(id,2)", "LessThan(id,5)", "StringContains(s,3)"))


def test_fixed_point_wraps(spark):
    row = "cast('1995-09-02' as timestamp_ntz) l_shipdate, 1L l_partkey, 1.0D l_extendedprice, 0.05D l_discount"
    assert fixed_point(spark.sql(f"select {row}")).to_kv().first()["value"] == 4294966896


def test_reduce_edge_cases(spark):
    kv = lambda rows: spark.createDataFrame(rows, "key bigint, value bigint")
    assert pairs(reduce.sort_reduce(kv([(1, 2), (1, 3)]), "add")) == [(1, 5)]
    assert pairs(reduce.sort_reduce(kv([(1, 2), (2, 3)]), "min")) == [(1, 2), (2, 3)]
    assert pairs(reduce.sort_reduce(kv([]), "add")) == []
    assert reduce.unique_check(kv([(1, 1), (1, 2), (3, 1)])).first().asDict() == {"n": 3, "n_distinct": 2, "n_repeats": 1}
    assert reduce.unique_check(kv([])).first()["n"] == 0
    with pytest.raises(ValueError, match="order"):
        reducer("first", F.col("value"))
    with pytest.raises(ValueError, match="unknown"):
        reducer("median", F.col("value"))
    register("spread", lambda v, o: F.max(v) - F.min(v))
    assert pairs(reduce.sort_reduce(kv([(1, 2), (1, 9)]), "spread")) == [(1, 7)]


def test_reducers_ignore_order(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 5), rng.randint(-9, 9)) for _ in range(300)]
    for name in ("add", "min", "max", "count"):
        results = []
        for _ in range(2):
            rng.shuffle(rows)
            df = spark.createDataFrame(rows, "key bigint, value bigint").repartition(3)
            results.append(pairs(reduce.sort_reduce(df, name)))
        assert results[0] == results[1]


def test_vectors_match_dicts(spark):
    rng = random.Random(2)
    cases = [({1: 1, 2: 5, 3: 9}, {2: 4, 3: 10, 4: 1}), ({}, {1: 1}), ({1: 1}, {}), ({1: 2, 2: 3}, {1: 2, 2: 3})]
    cases.append(({rng.randint(0, 40): rng.randint(0, 9) for _ in range(30)}, {rng.randint(0, 40): rng.randint(0, 9) for _ in range(30)}))
    for a, b in cases:
        x, y = vectors.of_rows(spark, list(a.items())), vectors.of_rows(spark, list(b.items()))
        items = lambda d: sorted(d.items())
        assert pairs(vectors.diff(x, y)) == items({k: v for k, v in a.items() if k not in b})
        assert pairs(vectors.intersect(x, y)) == items({k: v for k, v in a.items() if k in b})
        assert pairs(vectors.union(x, y)) == items(b | a)
        assert pairs(vectors.union(x, y, "min")) == items({k: min(d[k] for d in (a, b) if k in d) for k in a | b})
        assert pairs(vectors.add(x, y)) == items({k: a.get(k, 0) + b.get(k, 0) for k in a | b})
        assert pairs(vectors.apply(x, y)) == items({k: b.get(k, v) for k, v in a.items()})
        assert pairs(vectors.not_converged(x, y, lambda new, old: new >= old)) == items({k: v for k, v in a.items() if k not in b or v < b[k]})
        assert vectors.is_empty(x) == (not a)
    with pytest.raises(ValueError, match="type"):
        vectors.diff(vectors.of_rows(spark, [(1, 1)]), spark.createDataFrame([("1", 1)], "key string, value bigint"))


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "src bigint, dst bigint")


def test_edge_preparation(spark):
    e = graph.prepare(edges(spark, (0, 0), (0, 3), (0, 3), (2, 1), (2, 9)))
    assert pairs(e) == [(0, 3), (2, 1), (2, 9)]
    rows = {r["id"]: (r["degree"], r["offset"], r["neighbours"]) for r in graph.csr(e).collect()}
    assert rows == {0: (1, 0, [3]), 1: (0, 8, []), 2: (2, 8, [1, 9])}
    assert graph.isolated(e).first()["n_isolated"] == 1
    assert graph.stats(e).first().asDict() == {"n_edges": 3, "max_id": 9}
    assert graph.pages_touched(graph.csr(e), vectors.of_rows(spark, [(0, 0), (2, 0)])).first()["n_pages"] == 1
    assert graph.csr(edges(spark)).count() == 0


def test_shortest_distances_end_on_cycles(spark):
    e = edges(spark, (0, 1), (0, 2), (1, 3), (2, 3), (3, 0))
    assert pairs(graph.sssp(e, 0)) == [(0, 0), (1, 1), (2, 1), (3, 2)]
    weighted = e.withColumn("weight", F.when(F.col("dst") == 2, 5).otherwise(1).cast("bigint"))
    assert pairs(graph.sssp(weighted, 0)) == [(0, 0), (1, 1), (2, 5), (3, 2)]
    assert {r["key"]: r["parent"] for r in graph.bfs(e, 0).collect()} == {0: 0, 1: 0, 2: 0, 3: 1}
    assert pairs(graph.superstep(vectors.of_rows(spark, [(9, 1)]), e, graph.BFS)) == []


def test_shortest_path(spark):
    e = edges(spark, (0, 1), (0, 2), (1, 3), (2, 3), (3, 4))
    assert pairs(graph.shortest_path(e, 0, 4)) == [(0, 3), (1, 2), (2, 0)]
    assert pairs(graph.shortest_path(e, 0, 0)) == [(0, 0)]
    assert pairs(graph.shortest_path(e, 4, 0)) == []


def test_bfs_matches_plain_search(spark):
    e = graph.prepare(generate.rmat(spark, 7, 3, seed=4))
    near = {}
    for s, t in e.collect():
        near.setdefault(s, []).append(t)
    level, frontier = {0: 0}, [0]
    while frontier:
        frontier = [t for s in frontier for t in near.get(s, []) if level.setdefault(t, level[s] + 1) == level[s] + 1 and t not in frontier]
        frontier = list(dict.fromkeys(frontier))
        frontier = [t for t in frontier if level[t] == max(level.values())]
    assert {r["key"]: r["level"] for r in graph.bfs(e, 0).collect()} == level


def test_order_checks(spark):
    rows = lambda *ks: spark.createDataFrame(list(enumerate(ks)), "p bigint, k bigint")
    for block in (2, 1 << 16):
        assert ordering.order_report(rows(1, 2, 2, 1, 5), "p", "k", block=block).first().asDict() == {"n_rows": 5, "n_descents": 1, "n_ties": 1}
    assert ordering.is_sorted(rows(1, 2, 3), "p", "k", strict=True)
    assert ordering.is_sorted(rows(1, 1, 3), "p", "k") and not ordering.is_sorted(rows(1, 1, 3), "p", "k", strict=True)
    assert not ordering.is_sorted(rows(1, 3, 2), "p", "k")
    assert ordering.is_sorted(rows(), "p", "k")
    assert [r["k"] for r in ordering.page_sort(rows(3, 1, 2, 9, 8), "p", "k", page=3).orderBy("page", "rank").collect()] == [1, 2, 3, 8, 9]
    assert [r["value"] for r in ordering.sort_kv(vectors.of_rows(spark, [(1, 5), (1, 7), (2, 1)]), descending=True).collect()] == [1, 7, 5]


def test_column_encode(spark):
    lines = spark.createDataFrame([(x,) for x in ("0x10|300|abc|1995-09-01|" + "s" * 300, "-017|-5|12||", "9|7|3|bad|x\n")], "line string")
    got = columns.column_encode(lines, "|", {"a": (0, "8"), "b": (1, "1"), "c": (2, "4"), "d": (3, "D"), "e": (4, "V"), "f": (9, "V")}).collect()
    assert [(r["a"], r["b"], r["c"], str(r["d"]), r["e"], r["f"]) for r in got] == [(16, None, None, "1995-09-01", "s" * 300, None), (-15, -5, 12, "None", "", None), (9, 7, 3, "None", "x", None)]
    assert columns.rejects(lines, "|", {"b": (1, "1"), "c": (2, "4")}).first().asDict() == {"b": 1, "c": 1}
    with pytest.raises(ValueError, match="unknown type"):
        encode(F.col("x"), "Z")


def test_edge_files(spark, tmp_path):
    e = edges(spark, (1, 2), (1, 2), (30000000000, 4))
    edge_files.write_text(e, f"{tmp_path}/text")
    assert pairs(edge_files.read_text(spark, f"{tmp_path}/text")) == pairs(e)
    edge_files.write_text(e, f"{tmp_path}/once", dedup=True)
    assert edge_files.read_text(spark, f"{tmp_path}/once").count() == 2
    assert edge_files.parse_text(spark.createDataFrame([("x y",), ("1 2",), ("",)], "line string")).count() == 1
    seen_edges, seen = edge_files.observed(e)
    seen_edges.count()
    assert seen.get == {"n_edges": 3, "max_id": 30000000000}


def test_generators(spark):
    r = generate.rmat(spark, 6, 4, seed=5)
    assert r.count() == 4 << 6 and r.where("src < 0 or src >= 64 or dst < 0 or dst >= 64").isEmpty()
    assert pairs(r) != pairs(generate.rmat(spark, 6, 4, seed=6))
    b = Counter(map(tuple, generate.barabasi_albert(spark, 6, 3, seed=1).collect()))
    assert all(b[t, s] == n and s != t for (s, t), n in b.items()) and {v for e in b for v in e} == set(range(64))


def attached(n, edge_factor, uniform, seed):
    """Vertex by vertex over a list of ends that grows, with the same draws."""
    ends, made = [0, 1, 1, 2, 2, 0], {(1, 0), (2, 0), (2, 1)}
    for v in range(3, n):
        known = len(ends)
        for j in range(edge_factor):
            digest = hashlib.md5(f"{(v - 3) * edge_factor + j}:{seed}".encode()).hexdigest()
            drawn = int(digest[4:19], 16)
            u = drawn % v if int(digest[:4], 16) < int(uniform * 65536) else ends[drawn % known]
            made.add((v, u))
            ends += (v, u)
    return made


@pytest.mark.parametrize("edge_factor, uniform", [(1, 0.0), (3, 0.1), (8, 1.0)])
def test_attachment_matches_a_growing_list(spark, edge_factor, uniform):
    want = attached(300, edge_factor, uniform, 5)
    ids = spark.range(300).orderBy(F.desc("id")).repartition(7).withColumn("v", F.lit("clash"))
    e = generate.attach(ids, edge_factor, uniform=uniform, seed=5)
    assert Counter(map(tuple, e.collect())) == Counter([*want, *((u, v) for v, u in want)])
    assert "Exchange" not in generate.attach(spark.range(9), 2)._jdf.queryExecution().executedPlan().toString()


def test_attachment_of_odd_vertices(spark):
    of = lambda *ids: Counter(map(tuple, generate.attach(spark.createDataFrame([(i,) for i in ids], "id bigint"), 2, seed=1).collect()))
    assert of() == of(0) == of(None, -4) == Counter()
    assert of(0, 1) == of(1) == Counter([(0, 1), (1, 0)]) and of(7, 7) == of(7) + of(7)


def test_attachment_prefers_degree(spark):
    old = lambda uniform: generate.attach(spark.range(4000), 2, uniform=uniform, seed=2).groupBy("src").count().agg(F.max("count")).first()[0]
    assert old(0.0) > 3 * old(1.0)


def test_csr_in_columns(spark):
    e = spark.range(30_000).select(F.lit(2).cast("bigint").alias("src"), F.col("id").alias("dst")).union(edges(spark, (0, 3), (5, 1), (5, 0)))
    index, column = graph.csr_index(e), graph.csr_column(e)
    assert [tuple(r) for r in index.orderBy("id").collect()] == [(0, 1, 0), (1, 0, 1), (2, 30_000, 1), (3, 0, 30_001), (4, 0, 30_001), (5, 2, 30_001)]
    at = {r["position"]: (r["src"], r["dst"]) for r in column.collect()}
    assert [at[i] for i in range(30_003)] == sorted(map(tuple, e.collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # or these few rows would be put together again
    try:
        dealt = graph.csr_column(e).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) > 3 and max(r[1] for r in dealt) < 20_000  # the hub is split
    assert graph.csr_index(edges(spark)).count() == graph.csr_column(edges(spark)).count() == 0


def test_scan_query_and_metrics(spark):
    t = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 9.0)], "k bigint, x double")
    q = ScanQuery(t, F.col("k"), F.col("x") * 2).where(F.col("x") < 5).where(F.col("x") > 2)
    assert pairs(q.to_kv()) == [(1, 6.0)] and pairs(q.reduce()) == [(1, 6.0)]
    assert q.counts().first().asDict() == {"n_rows": 3, "n_matches": 1}
    df, seen = counted(t, "t", most=F.max("x"))
    df.count()
    assert seen.get == {"n_rows": 3, "most": 9.0}


def test_views(spark):
    register_views(spark, "/root/testdata/sf0.001", ("region",))
    assert spark.sql("select count(*) from region").first()[0] == 5


def test_streams(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(1, n)], "k bigint, v bigint").selectExpr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,v,0) ts", "k", "v")
    for n in (3, 4):
        columns.append(rows(n), f"{tmp_path}/in")
    stream = continuous.read_appends(spark, f"{tmp_path}/in", rows(1).schema)
    continuous.start(continuous.reduce_stream(stream, F.col("k"), F.col("v")), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert max(r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == 7
    columns.append(rows(50), f"{tmp_path}/in")
    continuous.start(continuous.reduce_stream(stream, F.col("k"), F.col("v")), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert max(r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == 57
    windows = continuous.windowed_reduce(stream, "ts", F.col("k"), F.col("v"), size="10 minutes", late="0 minutes")
    continuous.start(windows, f"{tmp_path}/out2", f"{tmp_path}/state2", mode="append").awaitTermination()
    # the watermark, at minute 50, has closed the first window; a later event closes the sixth
    assert [r["value"] for r in spark.read.parquet(f"{tmp_path}/out2").collect()] == [7]
    columns.append(rows(1000), f"{tmp_path}/in")
    continuous.start(windows, f"{tmp_path}/out2", f"{tmp_path}/state2", mode="append").awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(f"{tmp_path}/out2").collect()) == [7, 50]


def test_sorts_are_in_order(spark):
    rng = random.Random(9)
    kv = [(rng.randint(-50, 50), rng.randint(0, 9)) for _ in range(500)]
    df = spark.createDataFrame(kv, "key bigint, value bigint").repartition(7)
    for down in (False, True):
        assert list(map(tuple, ordering.sort_kv(df, descending=down).collect())) == sorted(kv, reverse=down)
        e = df.toDF("src", "dst")
        assert list(map(tuple, ordering.sort_edges(e, descending=down).collect())) == sorted(kv, reverse=down)
    merged = ordering.merge_edges(e.where("dst < 5"), e.where("dst >= 5")).collect()
    assert list(map(tuple, merged)) == sorted(kv)
    placed = ordering.positions(df, F.desc("key"), F.asc("value")).collect()
    assert [tuple(r)[:2] for r in sorted(placed, key=lambda r: r["position"])] == sorted(kv, key=lambda x: (-x[0], x[1]))
    assert sorted(r["position"] for r in placed) == list(range(500))
    assert ordering.positions(df.limit(0), F.asc("key")).count() == 0


def test_known_graph(spark):
    """The survey's fixture: edges of first lines only, with known levels and distances."""
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").where("l_linenumber = 1")
    e = graph.prepare(lines.selectExpr("l_partkey as src", "l_orderkey % 2000 as dst"))
    assert e.count() == 8578
    levels = Counter(r["level"] for r in graph.bfs(e, 0).collect())
    assert [levels[i] for i in range(9)] == [1, 5, 19, 82, 314, 800, 637, 111, 9]
    far = [r["value"] for r in graph.sssp(e.withColumn("weight", 1 + (F.col("src") + F.col("dst")) % 7), 0).collect()]
    assert (len(far), sum(far), max(far)) == (1978, 27639, 28)
