"""Every query of the core engine, with its SQL twin for an independent check."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import binary
from basalt.functions.predicates import BOTH, NEGATE_LEFT, NEGATE_RIGHT, WILDCARD, at_least, contains, contains_pair, in_range, outside, thresholds
from basalt.operators import generate, graph, ordering, paths, reduce, stored_order, vectors
from basalt.operators.adjacency import Adjacency
from basalt.plans import q14
from basalt.sources import binary_edges, columns, edges as edge_files, ingest
from basalt.sources.tables import table
from basalt.session import scratch
from basalt.streaming import continuous, merged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- scans and predicates

_SHIP = "l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'"
_day = lambda s: F.lit(s).cast("timestamp_ntz")


@query(f"SELECT l_orderkey, l_partkey, l_extendedprice, l_discount FROM lineitem WHERE {_SHIP}")
def scan_range_filter(spark, d):
    return table(spark, d, "lineitem").where(in_range(F.col("l_shipdate"), _day(q14.FROM), _day(q14.TO))).select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")


@query("SELECT event_id, user_id FROM events WHERE user_id >= 50")
def filter_ge(spark, d):
    return table(spark, d, "events").where(at_least(F.col("user_id"), 50)).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE NOT (user_id >= 50)")
def filter_lt_negated(spark, d):
    return table(spark, d, "events").where(~at_least(F.col("user_id"), 50)).select("event_id", "user_id")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 10 OR l_quantity >= 40")
def filter_or_outside(spark, d):
    return table(spark, d, "lineitem").where(outside(F.col("l_quantity"), 10.0, 40.0)).select("l_orderkey", "l_quantity")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity >= 40")
def filter_both_thresholds(spark, d):
    return table(spark, d, "lineitem").where(thresholds(F.col("l_quantity"), 10.0, 40.0, BOTH)).select("l_orderkey", "l_quantity")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 10 OR l_quantity < 40")
def filter_either_negated(spark, d):
    return table(spark, d, "lineitem").where(thresholds(F.col("l_quantity"), 10.0, 40.0, NEGATE_LEFT | NEGATE_RIGHT)).select("l_orderkey", "l_quantity")


@query(f"SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (WHERE {_SHIP}) AS n_matches FROM lineitem GROUP BY l_returnflag")
def filter_match_counts(spark, d):
    return reduce.match_counts(table(spark, d, "lineitem"), in_range(F.col("l_shipdate"), _day(q14.FROM), _day(q14.TO)), ["l_returnflag"])


@query("SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'PROMO')")
def substr_contains(spark, d):
    return table(spark, d, "part").where(contains(F.col("p_type"), "PROMO")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_type, p_name FROM part WHERE contains(p_type, 'PROMO') AND NOT contains(p_name, '1')")
def substr_pair_and_not(spark, d):
    part = table(spark, d, "part")
    return part.where(contains(F.col("p_type"), "PROMO") & ~contains(F.col("p_name"), "1")).select("p_partkey", "p_type", "p_name")


@query("SELECT doc_id FROM documents WHERE contains(text, 'the') AND NOT contains(text, 'tion')")
def substr_pair_one_text(spark, d):
    return table(spark, d, "documents").where(contains_pair(F.col("text"), "the", "tion", BOTH | NEGATE_RIGHT)).select("doc_id")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%PR_MO%'")
def substr_wildcard(spark, d):
    return table(spark, d, "part").where(contains(F.col("p_type"), f"PR{WILDCARD}MO{WILDCARD * 3}")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '(?s)B.and')")
def substr_wildcard_bytes(spark, d):
    return table(spark, d, "part").where(contains(F.col("p_brand"), f"B{WILDCARD}and", exact_bytes=True)).select("p_partkey", "p_brand")


# --- key-value projection and reduction


@query(f"SELECT l_partkey AS key, round(l_extendedprice * (1 - l_discount), 4) AS value FROM lineitem WHERE {_SHIP}")
def q14_kv_project(spark, d):
    return q14.revenue(table(spark, d, "lineitem")).to_kv().withColumn("value", F.round("value", 4))


@query(f"SELECT l_partkey AS key, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem WHERE {_SHIP} GROUP BY l_partkey")
def q14_sort_reduce(spark, d):
    # prices and discounts have two decimals, so four are exact and no sum lies on a tie
    return q14.revenue(table(spark, d, "lineitem")).reduce("add").withColumn("value", F.round("value", 4))


@query(
    f"""SELECT l_partkey AS key, CAST(sum((CAST(round(l_extendedprice * 100) AS BIGINT) * ((1 - CAST(round(l_discount * 100) AS BIGINT)) & 4294967295)) & 4294967295) AS BIGINT) AS value
    FROM lineitem WHERE {_SHIP} GROUP BY l_partkey"""
)
def q14_fixedpoint(spark, d):
    return q14.fixed_point(table(spark, d, "lineitem")).reduce("add")


@query(
    f"""SELECT round(100 * sum(CASE WHEN contains(p_type, 'PROMO') THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo_revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {_SHIP}"""
)
def q14_promo_share(spark, d):
    return q14.promo_share(table(spark, d, "lineitem"), table(spark, d, "part")).withColumn("promo_revenue", F.round("promo_revenue", 4))


def _events_kv(spark, d, value="value"):
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.expr(value).alias("value"), "event_id")


def _reduce_query(name: str, sql: str, value: str = "value", digits: int | None = None) -> None:
    def run(spark, d):
        out = reduce.sort_reduce(_events_kv(spark, d, value), name, order=F.col("event_id"))
        return out if digits is None else out.withColumn("value", F.round("value", digits))

    run.__name__ = f"reduce_{name}"
    query(f"SELECT user_id AS key, {sql} AS value FROM events GROUP BY user_id")(run)


_reduce_query("add", "round(sum(value), 4)", digits=4)
_reduce_query("min", "min(value)")
_reduce_query("max", "max(value)")
_reduce_query("multiply", "round(product(1 + value / 100000), 4)", "1 + value / 100000", 4)
_reduce_query("first", "arg_min(value, event_id)")
_reduce_query("last", "arg_max(value, event_id)")
_reduce_query("count", "count(value)")


@query("SELECT user_id AS key, max(value) AS value FROM (SELECT * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * FROM events WHERE event_id % 2 = 1) GROUP BY user_id")
def merge_reduce(spark, d):
    kv = _events_kv(spark, d)
    halves = [kv.where(F.col("event_id") % 2 == i).select("key", "value") for i in (0, 1)]
    return reduce.merge_reduce(*halves, "max")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, count(DISTINCT user_id) AS n_distinct, count(*) - count(DISTINCT user_id) AS n_repeats FROM events GROUP BY event_type")
def unique_check(spark, d):
    return reduce.unique_check(table(spark, d, "events").select("event_type", F.col("user_id").alias("key")), ["event_type"])


# --- ordering


@query("SELECT user_id AS key, event_id AS value FROM events ORDER BY key, value")
def sort_key_value(spark, d):
    return ordering.sort_kv(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value")))


@query("SELECT user_id AS key, event_id AS value, row_number() OVER (ORDER BY user_id, event_id) - 1 AS position FROM events")
def sort_positions(spark, d):
    kv = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"))
    return ordering.positions(kv, F.asc("key"), F.asc("value"))


@query("SELECT user_id AS key, event_id AS value, row_number() OVER (ORDER BY user_id DESC, event_id DESC) - 1 AS position FROM events")
def sort_positions_descending(spark, d):
    kv = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"))
    return ordering.positions(kv, F.desc("key"), F.desc("value"))


@query("SELECT event_id, event_id // 256 AS page, row_number() OVER (PARTITION BY event_id // 256 ORDER BY user_id DESC, event_id) AS rank FROM events")
def page_sort_descending(spark, d):
    return ordering.page_sort(table(spark, d, "events").select("event_id", "user_id"), "event_id", "user_id", descending=True).select("event_id", "page", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT event_id, event_id // 256 AS page, row_number() OVER (PARTITION BY event_id // 256 ORDER BY user_id, event_id) AS rank FROM events")
def page_sort_256(spark, d):
    return ordering.page_sort(table(spark, d, "events").select("event_id", "user_id"), "event_id", "user_id").select("event_id", "page", F.col("rank").cast("bigint").alias("rank"))


@query(
    """SELECT page, [x for x in list_sort(list(user_id)) if true][1] AS least, list_sort(list(user_id))[-1] AS most
    FROM (SELECT event_id // 8 AS page, user_id FROM events) GROUP BY page"""
)
def sort_network_8(spark, d):
    pages = table(spark, d, "events").groupBy(F.expr("event_id div 8").alias("page")).agg(ordering.sort_small(F.collect_list("user_id")).alias("x"))
    return pages.select("page", F.element_at("x", 1).alias("least"), F.element_at("x", -1).alias("most"))


_LAG = "SELECT '{c}' AS name, count(*) AS n_rows, count(*) FILTER (WHERE k < o) AS n_descents, count(*) FILTER (WHERE k = o) AS n_ties FROM (SELECT {c} AS k, lag({c}) OVER (ORDER BY event_id) AS o FROM events)"


@query(" UNION ALL ".join(_LAG.format(c=c) for c in ("ts", "user_id", "value", "event_id")))
def is_sorted_report(spark, d):
    events, out = table(spark, d, "events"), None
    for c in ("ts", "user_id", "value", "event_id"):
        row = ordering.order_report(events, "event_id", c, block=1024).select(F.lit(c).alias("name"), "n_rows", "n_descents", "n_ties")
        out = row if out is None else out.union(row)
    return out


@query(
    " UNION ALL ".join(_LAG.format(c=c) for c in ("ts", "user_id", "value"))
    + " UNION ALL SELECT 'sorted by ' || c, n, 0, n - k FROM (SELECT 'user_id' AS c, count(*) AS n, count(DISTINCT user_id) AS k FROM events UNION ALL SELECT 'value, event_id', count(*), count(*) FROM events)"
)
def stored_order_report(spark, d):
    """The events as their file has them, and sorted copies."""
    events = table(spark, d, "events")
    out = [stored_order.report(events, c).select(F.lit(c).alias("name"), "*") for c in ("ts", "user_id", "value")]
    for keys in (["user_id"], ["value", "event_id"]):
        path = scratch(spark, "sorted")
        events.select(*keys).orderBy(*keys).write.parquet(path)
        out.append(stored_order.report(spark.read.parquet(path), *keys).select(F.lit("sorted by " + ", ".join(keys)).alias("name"), "*"))
    return functools.reduce(DataFrame.union, out)


@query("SELECT l_partkey AS key, list_reduce(list(l_orderkey), lambda a, b: gcd(a, b)) AS value FROM lineitem GROUP BY l_partkey")
def reduce_gcd(spark, d):
    """A reducer that Spark lacks, given as a function of two values."""
    binary.check_laws(binary.GCD, binary.small_values())
    return binary.reduce_by_key(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("value")), binary.GCD)


@query("SELECT user_id AS key, round(ln(sum(exp(value / 100))), 6) AS value FROM events GROUP BY user_id")
def reduce_log_sum(spark, d):
    """Sums of exponentials, kept as logarithms."""
    kv = table(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("value") / 100).alias("value"))
    return binary.reduce_by_key(kv, binary.LOG_SUM).withColumn("value", F.round("value", 6))


# --- graphs

_E1 = """e AS (SELECT DISTINCT l_partkey AS src, l_orderkey % (SELECT count(*) FROM part) AS dst FROM lineitem WHERE l_partkey <> l_orderkey % (SELECT count(*) FROM part))"""
_LEVELS = f"WITH RECURSIVE {_E1}, r(key, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, level + 1 FROM r JOIN e ON src = key WHERE level < 16), l AS (SELECT key, min(level) AS level FROM r GROUP BY key)"
_DEGREE = "d AS (SELECT src, count(*) AS n FROM e GROUP BY src)"


def _raw_edges(spark, d):
    n = table(spark, d, "part").agg(F.count("*").alias("n_ids"))
    lines = table(spark, d, "lineitem").join(F.broadcast(n))  # one row
    return lines.select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") % F.col("n_ids")).alias("dst"))


def _edges(spark, d):
    return graph.prepare(_raw_edges(spark, d))


def _weight(edges):
    return edges.withColumn("weight", 1 + (F.col("src") + F.col("dst")) % 7)


def _weighted(spark, d):
    return _weight(_edges(spark, d))


def _index(spark, d, more=lambda edges: edges):
    """An index of _edges, whose repeats it drops as it is built."""
    return Adjacency.build(more(_raw_edges(spark, d).where("src <> dst")), distinct=True)


@query(f"WITH {_E1} SELECT src, dst FROM e")
def edges_prepare(spark, d):
    return _edges(spark, d)


@query(f"WITH {_E1} SELECT src, dst FROM e ORDER BY src, dst")
def sort_edges(spark, d):
    return ordering.sort_edges(_edges(spark, d))


@query(f"WITH {_E1} SELECT src, dst FROM e WHERE src % 2 = 0 UNION ALL SELECT dst, src FROM e WHERE src % 2 = 1")
def merge_edges(spark, d):
    e = _edges(spark, d)
    return ordering.merge_edges(e.where("src % 2 = 0"), e.where("src % 2 = 1").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(f"WITH {_E1} SELECT src AS key, count(*) AS degree FROM e GROUP BY src")
def edges_degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query(f"WITH {_E1} SELECT count(*) AS n_edges, max(greatest(src, dst)) AS max_id FROM e")
def edges_stats(spark, d):
    return graph.stats(_edges(spark, d))


@query(f"WITH {_E1} SELECT max(src) + 1 - count(DISTINCT src) AS n_isolated FROM e")
def edges_isolated(spark, d):
    return graph.isolated(_edges(spark, d))


@query(
    f"""WITH {_E1}, i AS (SELECT id FROM (SELECT unnest(range(0, (SELECT max(src) + 1 FROM e))) AS id)),
    g AS (SELECT id, count(dst) AS degree, coalesce(string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst), '') AS neighbours FROM i LEFT JOIN e ON src = id GROUP BY id)
    SELECT id, degree, CAST(8 * (sum(degree) OVER (ORDER BY id) - degree) AS BIGINT) AS "offset", neighbours FROM g"""
)
def edges_csr(spark, d):
    return graph.csr(_edges(spark, d)).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query(f"WITH {_E1} SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS BIGINT) AS position, src, dst FROM e")
def edges_csr_column(spark, d):
    """The adjacency column, a row for each place, so that a hub's list is no one row."""
    return graph.csr_column(_edges(spark, d))


@query(
    f"""WITH {_E1}, g AS (SELECT id, count(dst) AS degree FROM (SELECT unnest(range(0, (SELECT max(src) + 1 FROM e))) AS id) LEFT JOIN e ON src = id GROUP BY id)
    SELECT id, degree, CAST(sum(degree) OVER (ORDER BY id) - degree AS BIGINT) AS first FROM g"""
)
def edges_csr_index(spark, d):
    return graph.csr_index(_edges(spark, d))


@query(f"WITH {_E1} SELECT src, dst FROM e")
def edges_text_roundtrip(spark, d):
    path = scratch(spark, "text")
    edge_files.write_text(_edges(spark, d), path, dedup=True)
    return edge_files.read_text(spark, path)


@query(f"WITH {_E1} SELECT dst FROM e WHERE src = 7")
def edges_of_vertex(spark, d):
    return graph.neighbours(_edges(spark, d), 7)


@query(f"WITH {_E1} SELECT src, dst FROM e WHERE src % 17 = 5 AND src < 17 * 20")
def adjacency_lookup(spark, d):
    """Twenty vertices of an index that was built, and opened again by its path."""
    path = Adjacency.build(_edges(spark, d), scratch(spark, "adjacency")).path
    return Adjacency.open(spark, path).neighbours(*range(5, 17 * 20, 17))


@query("WITH e AS (SELECT DISTINCT vendor_id AS src, sale_id AS dst FROM sale_lines WHERE vendor_id IS NOT NULL AND sale_id IS NOT NULL) SELECT dst AS key, min(src + 1) AS value FROM e GROUP BY dst")
def superstep_hubs(spark, d):
    """Vendors' sales: a few vendors have a large part of all edges."""
    edges = table(spark, d, "sale_lines").select(F.col("vendor_id").alias("src"), F.col("sale_id").alias("dst")).distinct()
    index = Adjacency.build(edges)
    return graph.superstep(index.degrees.select("key", F.col("key").alias("value")), index, graph.SSSP)


@query(
    f"""{_LEVELS}, o AS (SELECT l.level + 1 AS round, e.dst FROM l JOIN e ON e.src = l.key), c AS (SELECT level AS round, count(*) AS changed FROM l GROUP BY level),
    m AS (SELECT round, count(*) AS edges, count(DISTINCT dst) AS messages FROM o GROUP BY round)
    SELECT CAST(c.round + 1 AS INTEGER) AS round, coalesce(m.edges, 0) AS edges, coalesce(m.messages, 0) AS messages, coalesce(n.changed, 0) AS changed FROM c LEFT JOIN m ON m.round = c.round + 1 LEFT JOIN c n ON n.round = c.round + 1"""
)
def bfs_rounds(spark, d):
    """What each superstep read, sent and changed, as its own write observed it."""
    trace: list[graph.Round] = []
    graph.bfs(_index(spark, d), 0, trace=trace)
    return graph.rounds_table(spark, trace)


@query(f"WITH {_E1} SELECT DISTINCT dst AS key, CAST(0 AS BIGINT) AS value FROM e")
def superstep_null(spark, d):
    edges = _edges(spark, d)
    return graph.superstep(edges.select(F.col("src").alias("key")).distinct().withColumn("value", F.col("key")), edges, graph.NULL)


@query(f"WITH {_E1} SELECT dst AS key, min(src + 1 + (src + dst) % 7) AS value FROM e GROUP BY dst")
def superstep_min(spark, d):
    edges = _weighted(spark, d)
    seeds = edges.select(F.col("src").alias("key")).distinct().withColumn("value", F.col("key"))
    return graph.superstep(seeds, edges, graph.SSSP)


@query(f"WITH {_E1}, {_DEGREE} SELECT dst AS key, round(sum(1.0::DOUBLE / n), 6) AS value FROM e JOIN d USING (src) GROUP BY dst")
def superstep_outdeg(spark, d):
    e = _edges(spark, d)
    ones = e.select(F.col("src").alias("key")).distinct().withColumn("value", F.lit(1.0))
    return graph.superstep(ones, e, graph.PAGERANK, argument="outdegree").withColumn("value", F.round("value", 6))


@query(f"{_LEVELS} SELECT key, level FROM l")
def bfs_levels(spark, d):
    return graph.bfs(_index(spark, d), 0).select("key", "level")


@query(f"{_LEVELS} SELECT level, count(*) AS n FROM l GROUP BY level")
def bfs_level_counts(spark, d):
    return graph.level_statistics(graph.bfs(_index(spark, d), 0))


@query(
    f"""{_LEVELS}, n AS (SELECT level, count(*) AS frontier FROM l GROUP BY level), g AS (SELECT id, count(dst) AS degree FROM (SELECT unnest(range(0, (SELECT max(src) + 1 FROM e))) AS id) LEFT JOIN e ON src = id GROUP BY id),
    o AS (SELECT id, degree, 8 * (sum(degree) OVER (ORDER BY id) - degree) AS "offset" FROM g),
    p AS (SELECT level, unnest(range(CAST("offset" // 8192 AS BIGINT), CAST(("offset" + 8 * degree - 1) // 8192 + 1 AS BIGINT))) AS p FROM l JOIN o ON id = key WHERE degree > 0)
    SELECT level, frontier, CAST(sum(frontier) OVER (ORDER BY level) AS BIGINT) AS visited, (SELECT count(DISTINCT p) FROM p WHERE p.level = n.level) AS pages FROM n"""
)
def bfs_level_report(spark, d):
    return graph.level_report(_edges(spark, d), 0)


@query(f"{_LEVELS} SELECT l.key, CASE WHEN l.level = 0 THEN l.key ELSE (SELECT min(p.key) FROM l p JOIN e ON e.src = p.key WHERE e.dst = l.key AND p.level = l.level - 1) END AS parent FROM l")
def bfs_parents(spark, d):
    return graph.bfs(_index(spark, d), 0).select("key", "parent")


@query(
    f"""{_LEVELS}, q AS (SELECT c.key, CASE WHEN c.level = 0 THEN c.key ELSE max(p.key) END AS parent FROM l c LEFT JOIN e ON e.dst = c.key LEFT JOIN l p ON p.key = e.src AND p.level = c.level - 1 GROUP BY c.key, c.level),
    s(step, vertex) AS (SELECT 0, parent FROM q WHERE key = 1001 UNION ALL SELECT step + 1, parent FROM s JOIN q ON key = vertex WHERE vertex <> 0) SELECT step, vertex FROM s"""
)
def shortest_path(spark, d):
    return graph.shortest_path(_index(spark, d), 0, 1001)


_SEARCHES = "q(search, source, target) AS (SELECT i, (i * 37) % n, (i * 101 + 5) % n FROM (SELECT unnest(range(30)) AS i), (SELECT count(*) AS n FROM part))"


@query(
    f"""WITH RECURSIVE {_E1}, {_SEARCHES}, r(search, key, level) AS (SELECT search, source, 0 FROM q UNION SELECT search, dst, level + 1 FROM r JOIN e ON src = key WHERE level < 8),
    l AS (SELECT search, key, min(level) AS level FROM r GROUP BY search, key),
    b AS (SELECT c.search, c.key, CASE WHEN c.level = 0 THEN c.key ELSE max(p.key) END AS parent FROM l c LEFT JOIN e ON e.dst = c.key LEFT JOIN l p ON p.key = e.src AND p.search = c.search AND p.level = c.level - 1 GROUP BY c.search, c.key, c.level),
    s(search, step, vertex, source) AS (SELECT q.search, 0, parent, source FROM b JOIN q ON q.search = b.search AND key = target UNION ALL SELECT s.search, step + 1, parent, source FROM s JOIN b ON b.search = s.search AND key = vertex WHERE vertex <> source)
    SELECT search, step, vertex FROM s"""
)
def shortest_paths_30(spark, d):
    """Thirty searches in one loop."""
    n = table(spark, d, "part").count()
    asked = spark.range(30).select(F.col("id").alias("search"), (F.col("id") * 37 % n).alias("source"), ((F.col("id") * 101 + 5) % n).alias("target"))
    return paths.shortest_paths(_index(spark, d), asked)


@query(f"{_LEVELS} SELECT key, CAST(level AS BIGINT) AS value FROM l")
def sssp_hops(spark, d):
    return graph.sssp(_index(spark, d), 0)


@query(
    f"""WITH RECURSIVE {_E1}, r(key, value) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT dst, value + 1 + (src + dst) % 7 FROM r JOIN e ON src = key WHERE value < 45)
    SELECT key, min(value) AS value FROM r GROUP BY key"""
)
def sssp_weighted(spark, d):
    return graph.sssp(_index(spark, d, _weight), 0)


@query(f"WITH {_E1}, {_DEGREE} SELECT id AS key, round(coalesce(1.0::DOUBLE / n, 0.01), 6) AS value FROM (SELECT unnest(range(0, (SELECT count(*) FROM part))) AS id) LEFT JOIN d ON src = id")
def pagerank_init(spark, d):
    return graph.contribution_init(_edges(spark, d), table(spark, d, "part").count()).withColumn("value", F.round("value", 6))


@query(
    f"""WITH {_E1}, {_DEGREE}, v AS (SELECT id, coalesce(1.0::DOUBLE / n, 0.01) AS x FROM (SELECT unnest(range(0, (SELECT count(*) FROM part))) AS id) LEFT JOIN d ON src = id),
    s AS (SELECT dst, sum(x) AS x FROM v JOIN e ON src = id GROUP BY dst) SELECT dst AS key, round(0.85 * x + coalesce(0.15 / n, 0.0015), 6) AS value FROM s LEFT JOIN d ON src = dst"""
)
def pagerank_contrib_step(spark, d):
    e = _edges(spark, d)
    return graph.contribution_step(graph.contribution_init(e, table(spark, d, "part").count()), e).withColumn("value", F.round("value", 6))


_ROUND = "v{i} AS (SELECT id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(s, 0) AS x FROM n LEFT JOIN (SELECT dst, sum(x / d.n) AS s FROM v{j} JOIN e ON src = id JOIN d USING (src) GROUP BY dst) ON dst = id)"


@query(f"WITH {_E1}, {_DEGREE}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), v0 AS (SELECT id, 1.0::DOUBLE AS x FROM n), " + ", ".join(_ROUND.format(i=i, j=i - 1) for i in range(1, 11)) + " SELECT id AS key, round(x, 6) AS value FROM v10")
def pagerank_10(spark, d):
    return graph.pagerank(_index(spark, d), 10).withColumn("value", F.round("value", 6))


_RMAT = "[CAST('0x' || substr(md5(id || ':' || (i // 10) || ':1'), 3 * (i % 10) + 1, 3) AS INTEGER) % 1024 for i in range(20)]"
_bits = lambda on: " + ".join(f"CASE WHEN {on.replace('x', f'r[{i + 1}]')} THEN {1 << 19 - i} ELSE 0 END" for i in range(20))


@query(f"SELECT CAST({_bits('(x >= 583 AND x < 777) OR x >= 971')} AS BIGINT) AS src, CAST({_bits('x >= 777')} AS BIGINT) AS dst FROM (SELECT {_RMAT} AS r FROM (SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem))")
def rmat_edges(spark, d):
    """An edge for each order line."""
    ids = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return generate.rmat_of(ids, 20, seed=1)


_ATTACHED = """WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS v FROM customer), s AS (SELECT v, (v - 3) * 8 + j AS slot FROM v, (SELECT unnest(range(8)) AS j) WHERE v >= 3),
    h AS (SELECT v, slot, CAST('0x' || substr(md5(slot || ':1'), 1, 4) AS BIGINT) < 6553 AS coin, CAST('0x' || substr(md5(slot || ':1'), 5, 15) AS BIGINT) AS drawn FROM s),
    t AS (SELECT slot, CASE WHEN coin THEN drawn % v END AS u, CASE WHEN NOT coin THEN drawn % (6 + 16 * (v - 3)) END AS place FROM h),
    r(v, slot) AS (SELECT v, slot FROM s UNION ALL SELECT r.v, (place - 6) // 2 FROM r JOIN t USING (slot) WHERE place >= 6 AND place % 2 = 1),
    c AS (SELECT DISTINCT v, coalesce(u, CASE WHEN place < 6 THEN [0, 1, 1, 2, 2, 0][place + 1] ELSE 3 + (place - 6) // 16 END) AS u FROM r JOIN t USING (slot) WHERE u IS NOT NULL OR place < 6 OR place % 2 = 0
        UNION ALL SELECT v, unnest(range(v)) FROM v WHERE v < 3),
    a AS (SELECT CAST(v AS BIGINT) AS src, CAST(u AS BIGINT) AS dst FROM c UNION ALL SELECT u, v FROM c)"""


def _attached(spark, d):
    """Customers in order of their keys as vertices."""
    return generate.attach(ordering.positions(table(spark, d, "customer").select("c_custkey"), F.col("c_custkey")), id_col="position", seed=1)


@query(f"{_ATTACHED} SELECT src, dst FROM a")
def ba_edges(spark, d):
    return _attached(spark, d)


@query(
    f"""{_ATTACHED}, g AS (SELECT src, dst, count(*) AS n FROM a GROUP BY src, dst) SELECT count(DISTINCT g.src) AS n_vertices, count(*) FILTER (WHERE g.src = g.dst) AS n_loops, count(*) FILTER (WHERE g.n > 1) AS n_repeats,
    count(*) FILTER (WHERE b.src IS NULL) AS n_one_way, (SELECT max(k) <= 8 FROM (SELECT count(*) AS k FROM g WHERE dst < src AND src >= 3 GROUP BY src)) AS new_vertices_have_at_most_eight_older FROM g LEFT JOIN g b ON b.src = g.dst AND b.dst = g.src"""
)
def ba_check(spark, d):
    """Properties of the preferential-attachment graph."""
    e = _attached(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))
    back = e.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.lit(True).alias("back"))
    older = e.where("dst < src and src >= 3").groupBy("src").agg(F.count("*").alias("c")).agg((F.max("c") <= 8).alias("new_vertices_have_at_most_eight_older"))
    return e.join(back, ["src", "dst"], "left").agg(F.count_distinct("src").alias("n_vertices"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops"), F.count_if(F.col("n") > 1).alias("n_repeats"), F.count_if(F.col("back").isNull()).alias("n_one_way")).join(F.broadcast(older))


@query(f"WITH {_E1} SELECT src, dst FROM e")
def edges_binary_roundtrip(spark, d):
    """Written as files by several tasks, in two writes, and read in byte ranges of 64 KB."""
    path, edges = scratch(spark, "binary"), _edges(spark, d)
    for part in ("src % 3 = 0", "src % 3 <> 0"):
        binary_edges.write(edges.where(part), path, width=4)
    return binary_edges.read(spark, path, width=4, split_bytes=1 << 16)


@query(f"WITH {_E1} SELECT count(*) AS n_edges, max(greatest(src, dst)) AS max_id FROM e")
def edges_binary_stats(spark, d):
    """What the manifest of a write says."""
    path = scratch(spark, "binary")
    binary_edges.write(_edges(spark, d), path)
    told = binary_edges.stats(path)
    return spark.createDataFrame([(told["n_edges"], told["max_id"])], "n_edges bigint, max_id bigint")


# --- vectors

_V = "a AS (SELECT o_custkey AS key, count(*) AS value FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey AS key, count(*) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"


def _vectors(spark, d):
    orders = table(spark, d, "orders")
    return [reduce.sort_reduce(orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key"), F.lit(1).alias("value")), "count") for s in "PO"]


@query(f"WITH {_V} SELECT * FROM a WHERE key NOT IN (SELECT key FROM b)")
def vec_diff(spark, d):
    return vectors.diff(*_vectors(spark, d))


@query(f"WITH {_V} SELECT * FROM a WHERE key IN (SELECT key FROM b)")
def vec_intersect(spark, d):
    return vectors.intersect(*_vectors(spark, d))


@query(f"WITH {_V} SELECT key, min(value) AS value FROM (FROM a UNION ALL FROM b) GROUP BY key")
def vec_union_min(spark, d):
    return vectors.union(*_vectors(spark, d), "min")


@query(f"WITH {_V} SELECT key, coalesce(a.value, b.value) AS value FROM a FULL JOIN b USING (key)")
def vec_union_left(spark, d):
    return vectors.union(*_vectors(spark, d))


@query(f"WITH {_V} SELECT key, CAST(sum(value) AS BIGINT) AS value FROM (FROM a UNION ALL FROM b) GROUP BY key")
def vec_add(spark, d):
    return vectors.add(*_vectors(spark, d))


@query(f"WITH {_V} SELECT key, coalesce(b.value, a.value) AS value FROM a LEFT JOIN b USING (key)")
def vec_apply(spark, d):
    return vectors.apply(*_vectors(spark, d))


@query(f"WITH {_V} SELECT key, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (key)")
def update_visited(spark, d):
    return graph.update(*_vectors(spark, d))


@query(f"WITH {_V} SELECT a.key, a.value FROM a LEFT JOIN b USING (key) WHERE b.key IS NULL OR NOT (a.value >= b.value)")
def vec_converged(spark, d):
    return vectors.not_converged(*_vectors(spark, d), lambda new, old: new >= old)


# --- typed ingest


@query("SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def encode_columns(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    lines = table(spark, d, "orders").select(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", day).alias("line"))
    return columns.column_encode(lines, "|", {"o_orderkey": (0, "8"), "o_custkey": (1, "4"), "o_orderstatus": (2, "V"), "o_orderdate": (3, "D")})


@query("SELECT CAST(0 AS BIGINT) AS key, count(*) FILTER (WHERE o_custkey > 127) AS small FROM orders")
def encode_rejects(spark, d):
    lines = table(spark, d, "orders").select(F.concat_ws("|", "o_orderkey", "o_custkey").alias("line"))
    return columns.rejects(lines, "|", {"key": (0, "8"), "small": (1, "1")})


def _ingested(spark, d):
    """Orders as text files, some with a letter in a number and some cut short."""
    path, day = scratch(spark, "lines"), F.date_format("o_orderdate", "yyyy-MM-dd")
    customer = F.concat(F.when(F.col("o_custkey") % 11 == 0, "x").otherwise(""), F.col("o_custkey"))
    rest = F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("|"), F.col("o_orderstatus"), F.lit("|"), day))
    table(spark, d, "orders").select(F.concat(F.col("o_orderkey"), F.lit("|"), customer, rest).alias("line")).write.text(path)
    return ingest.ingest(spark, path, scratch(spark, "ingested"), "|", {"o_orderkey": (0, "8"), "o_custkey": (1, "4"), "o_orderstatus": (2, "V"), "o_orderdate": (3, "D")})


@query("SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_custkey % 11 <> 0 AND o_orderkey % 7 <> 0")
def ingest_accepted(spark, d):
    return _ingested(spark, d).accepted


@query(
    """SELECT o_orderkey || '|' || CASE WHEN o_custkey % 11 = 0 THEN 'x' ELSE '' END || o_custkey || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '|' || o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m-%d') END AS line,
    CASE WHEN o_custkey % 11 = 0 AND o_orderkey % 7 = 0 THEN 'o_custkey,o_orderstatus,o_orderdate' WHEN o_custkey % 11 = 0 THEN 'o_custkey' ELSE 'o_orderstatus,o_orderdate' END AS at_fault
    FROM orders WHERE o_custkey % 11 = 0 OR o_orderkey % 7 = 0"""
)
def ingest_rejected(spark, d):
    return _ingested(spark, d).rejected.select("line", F.array_join("at_fault", ",").alias("at_fault"))


@query("SELECT count(*) FILTER (WHERE o_custkey % 11 <> 0 AND o_orderkey % 7 <> 0) AS n_accepted, count(*) FILTER (WHERE o_custkey % 11 = 0 OR o_orderkey % 7 = 0) AS n_rejected FROM orders")
def ingest_counts(spark, d):
    """As the one pass observed them."""
    got = _ingested(spark, d)
    return spark.createDataFrame([(got.n_accepted, got.n_rejected)], "n_accepted bigint, n_rejected bigint")


# --- appends, metrics, streams


@query("SELECT event_id, user_id, value FROM events")
def append_roundtrip(spark, d):
    events, path = table(spark, d, "events").select("event_id", "user_id", "value"), scratch(spark, "appended")
    for i in range(2):
        columns.append(events.where(F.col("event_id") % 2 == i), path)
    return spark.read.schema(events.schema).parquet(path)


@query(f"WITH {_E1} SELECT count(*) AS n_edges, max(greatest(src, dst)) AS max_id FROM e")
def observed_metrics(spark, d):
    edges, seen = edge_files.observed(_edges(spark, d))
    edges.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n_edges"], seen.get["max_id"])], "n_edges bigint, max_id bigint")


def _append(spark, d, path, i):
    """A third of the events, as four files."""
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    columns.append(events.where(F.col("event_id") % 3 == i).repartition(4), path)
    return events.schema


def _streamed(spark, d):
    """The events as a stream over three appends, in three micro-batches at least."""
    path = scratch(spark, "events")
    schema = [_append(spark, d, path, i) for i in range(3)][0]
    return continuous.read_appends(spark, path, schema, files_per_trigger=4)


def _last_rounds(spark, reduced, keys):
    """Each key's value of the last round that changed it."""
    path = scratch(spark, "rounds")
    continuous.start(reduced, path, scratch(spark, "state")).awaitTermination()
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by("value", "round").alias("value"))


@query("SELECT user_id AS key, round(sum(value), 4) AS value FROM events GROUP BY user_id")
def stream_reduce(spark, d):
    reduced = continuous.reduce_stream(_streamed(spark, d), F.col("user_id"), F.col("value"))
    return _last_rounds(spark, reduced, ["key"]).withColumn("value", F.round("value", 4))


@query("SELECT user_id AS key, round(sum(value), 4) AS value FROM events GROUP BY user_id")
def stream_merge(spark, d):
    """Events appended while no query runs, merged in six micro-batches with a restart between them, the last one replayed."""
    path, state = scratch(spark, "events"), scratch(spark, "state")
    current = merged.MergedTable(spark, scratch(spark, "merged"))
    for i in range(3):
        stream = continuous.read_appends(spark, path, _append(spark, d, path, i), files_per_trigger=2)
        merged.start(stream.select(F.col("user_id").alias("key"), "value"), current, state).awaitTermination()
    current.merge(table(spark, d, "events").select(F.col("user_id").alias("key"), "value"), current.manifest()["batch"])
    return current.table().withColumn("value", F.round("value", 4))


@query("SELECT user_id AS key, max(value) AS value FROM events GROUP BY user_id")
def stream_merge_max(spark, d):
    """Another reducer over the same appends."""
    current = merged.MergedTable(spark, scratch(spark, "merged"), "max")
    merged.start(_streamed(spark, d).select(F.col("user_id").alias("key"), "value"), current, scratch(spark, "state")).awaitTermination()
    return current.table()


@query("SELECT date_trunc('hour', ts) AS start, user_id % 10 AS key, max(value) AS value FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    windows = continuous.windowed_reduce(_streamed(spark, d), "ts", F.col("user_id") % 10, F.col("value"), size="1 hour", late="36500 days", name="max")
    return _last_rounds(spark, windows, ["start", "key"]).withColumn("start", F.col("start").cast("timestamp_ntz"))
