"""Merkle manifest of a dataset: a hash tree over each source's rows, one over the sources, and a proof for each row.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests count as hex text. A row's leaf is H of its fields, each '-' if null, else the number of its
UTF-8 bytes, ':' and its value. While more than one node remains, every FANOUT consecutive ones become their H (the last run may be shorter, even one).

The tree is reduced by superblocks: rows are sorted by range, so no source is one group, and counted by range to give each its index; FANOUT ** LEVELS
consecutive nodes form a bucket, and one call collapses LEVELS levels of it. Bucket roots are the nodes of the next, recursive reduction, each a table of 1 / 256 of
the rows before. Proofs then come down the same way: a bucket's nodes meet the one proof that its root has (by cogrouping, so it isn't copied for each
node), and a node's proof is its own within the bucket, the lower one, with the root's, the upper one, after it. No proofs are stored but those of bucket roots.

What isn't grouped by bucket are counts by range and source. A task holds one bucket.

Defined cases: null sources are one source, first; a null id comes first within its source, rows with equal ids are ordered by leaf, and rows that are alike by their places in
the files; a lone leaf is its source's subroot, without siblings in it; a lone source's subroot is the root; the proof of a lone row is H of nothing;
changed copies of rows are folded with the original siblings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.store import in_files, place, staged

FANOUT, LEVELS = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<at:int,siblings:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """H of the fields of a row."""
    told = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told), 256)


def collapse(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes and what they become, level by level."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def siblings(tree: list[list[str]], i: int, fanout: int = FANOUT) -> Iterator[tuple[int, str]]:
    """(place in its run, the run's others) of node i and of those above it, below the top."""
    for nodes in tree[:-1]:
        first = i - i % fanout
        yield i - first, "".join(nodes[first:i]) + "".join(nodes[i + 1 : first + fanout])
        i //= fanout


def fold(node: str, path: list[tuple[int, str]]) -> str:
    """The root that a node and its siblings give."""
    for at, others in path:
        node = digest(others[: 64 * at], node, others[64 * at :])
    return node


def _bucket(column: str) -> Column:
    return F.expr(f"{column} div {FANOUT**LEVELS}L")


def _levels(size: int) -> int:
    """How many levels to collapse in a bucket of a group of so many nodes."""
    n = 0
    while size > 1 and n < LEVELS:
        size, n = -(-size // FANOUT), n + 1
    return n


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows, written, with i, the place in its group by order, from 0, and size, the group's number of rows.

    Rows are dealt by range and counted by range and group; only those counts meet by group."""
    by = [F.asc_nulls_first(c) for c in (group, *order)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = staged(dealt, "ordered").withColumn("_task", F.shiftright("_at", 33))
    counts = dealt.groupBy("_task", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_task")
    counts = counts.select(F.col("_task").alias("_t"), F.col(group).alias("_g"), "_first", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("size"))
    found = dealt.join(counts, (F.col("_task") == F.col("_t")) & F.col(group).eqNullSafe(F.col("_g")))
    return found.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("i"), "size")


def reduce_levels(nodes: DataFrame) -> list[DataFrame]:
    """nodes (g, i, size, node) and the tables of bucket roots above them; in the last each group has one node, its root."""
    tables, kind = [nodes], nodes.schema["g"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        size = group["size"][0].as_py()
        root = collapse(group["node"].to_pylist(), _levels(size))[-1]
        return pa.table([group["g"].slice(0, 1), pa.array([group["b"][0].as_py()]), pa.array([-(-size // FANOUT**LEVELS)]), pa.array(root)], names=["g", "i", "size", "node"])

    while (most := tables[-1].agg(F.max("size")).first()[0]) and most > 1:
        dealt = tables[-1].select("g", "i", "size", "node", _bucket("i").alias("b"))
        tables.append(staged(dealt.groupBy("g", "b").applyInArrow(run, f"g {kind}, i long, size long, node string"), "nodes"))
    return tables


def _descend(nodes: DataFrame, above: DataFrame, schema: str, emit: Callable[[dict, str, list[tuple[int, str]]], tuple]) -> DataFrame:
    """emit(row, subroot, path) for each of nodes, where above (g, i, subroot, path) has the paths of their buckets' roots."""
    columns = nodes.columns

    def run(group: pa.Table, tops: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        rows, top = group.to_pylist(), tops.to_pylist()
        upper = [(x["at"], x["siblings"]) for x in top[0]["path"]] if rows else []
        tree = collapse([r["node"] for r in rows], _levels(rows[0]["size"])) if rows else []
        made = [emit(r, top[0]["subroot"], [*siblings(tree, k), *upper]) for k, r in enumerate(rows)]
        return pa.Table.from_pylist([dict(zip(names, x, strict=True)) for x in made], kinds)

    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    told = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), _PATH: pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())]))}
    kinds = pa.schema([(n, told[k]) for n, k in zip(names, kinds, strict=True)])
    dealt = nodes.select(*columns, _bucket("i").alias("b")).groupBy("g", "b")
    return dealt.cogroup(above.select("g", F.col("i").alias("b"), "subroot", "path").groupBy("g", "b")).applyInArrow(run, schema)


def _told(path: list[tuple[int, str]]) -> list[dict]:
    return [{"at": a, "siblings": s} for a, s in path]


def _paths(tables: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(g, i, subroot, path) of the first table's bucket roots, from roots (g, subroot, path) of whole groups."""
    above = roots.select("g", F.lit(0).cast("long").alias("i"), "subroot", "path")
    for nodes in tables[-2:0:-1]:
        above = staged(_descend(nodes, above, f"g string, i long, subroot string, path {_PATH}", lambda r, s, p: (r["g"], r["i"], s, _told(p))), "paths")
    return above


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", changed: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) for each row; proof lists (at, siblings) from the leaf's run up to the root's.

    changed: fields as they are in a copy that may have been tampered with, where `when` holds; folded_root comes from that copy, and is verified if it equals the root."""
    docs = in_files(docs)
    now = leaf([F.col(f) for f in fields])
    copy = leaf([(changed or {}).get(f, F.col(f)) for f in fields])
    hit = F.coalesce(when, F.lit(False)) if when is not None else F.lit(bool(changed))
    rows = docs.select(F.col(source_col).cast("string").alias("g"), F.col(id_col).cast("long").alias("id"), now.alias("node"), F.when(hit, copy).alias("copy"), *place())
    leaves = staged(numbered(rows, "g", "id", "node", "file", "row").select("g", "i", "size", "id", "node", "copy"), "leaves")
    tables = reduce_levels(leaves.select("g", "i", "size", "node"))
    roots = tables[-1].select(F.lit("").alias("all"), F.col("g").alias("name"), "node")
    sources = staged(numbered(roots, "all", "name").select(F.col("all").alias("g"), "name", "i", "size", "node"), "sources")
    top = reduce_levels(sources.select("g", "i", "size", "node"))
    first = top[-1].select("node").first()
    root = first["node"] if first else ""
    above = _paths(top, docs.sparkSession.createDataFrame([("", root, [])], f"g string, subroot string, path {_PATH}"))
    tops = _descend(sources, above, f"g string, subroot string, path {_PATH}", lambda r, _, p: (r["name"], r["node"], _told(p)))
    above = _paths(tables, staged(tops, "tops"))

    def emit(r: dict, subroot: str, path: list[tuple[int, str]]) -> tuple:
        got = fold(r["copy"] or r["node"], path)
        return r["id"], r["node"], subroot, root, _told(path), got, got == root

    return _descend(leaves, above, f"{id_col} long, leaf string, subroot string, root string, proof {_PATH}, folded_root string, verified boolean", emit)


def tampered(*, id_col: str = "doc_id", text_col: str = "text", every: int = 5) -> tuple[dict[str, Column], Column]:
    """A copy whose rows with ids of a CRC-32 divisible by every have their text's A-Z in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    return {text_col: F.translate(F.col(text_col), upper, upper.lower())}, F.crc32(F.col(id_col).cast("long").cast("string")) % every == 0
