"""A stored adjacency index: built once, opened later, probed by vertex or joined with a frontier.

Edges lie in buckets by slot, sorted by it. A vertex's slot is its id. A hub, a vertex with more than _LEAST edges and a _PIECES-th of a bucket's mean share
of all edges, is split: its edges are dealt by a hash of their destination over pieces, the first in the vertex's own slot and each further one in a slot of its own, so
no bucket gets a hub as a whole. There are fewer than _PIECES times buckets hubs and about as many pieces, whatever the graph's size, so the list of
hubs may be broadcast. Slots of pieces are hashes and may meet ids by chance; the source is compared too.

A frontier dealt by key joins without being moved: plain vertices' slots are their keys. Only the rows of hubs are sent to their further slots.

Layout below the path: edges/ (slot, src, dst, other columns), degrees/ (key, degree), hubs/ (key, pieces), and manifest.json, written last; a
build that didn't finish has none and can't be opened.

Defined cases: edges without a source or destination are left out; repeated edges are kept, those of one pair in one piece, unless build() is asked for distinct ones;
an empty table gives an index without vertices; columns slot and degree of the input are an error, others are kept."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basalt.session import scratch, width
from basalt.sources import bucketed, files

FORMAT, PROBE = 2, 64
_PIECES, _LEAST, _MOST_SLOTS, _HASHED = 64, 1000, 4096, 200_000


def _slot(key: Column, piece: Column) -> Column:
    return F.when(piece == 0, key).otherwise(F.xxhash64(key, piece))


def _count(edges: DataFrame, path: str) -> tuple[DataFrame, int, int]:
    """(key, degree) of edges, written to path, and how many sources and edges there are."""
    edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("degree")).write.mode("overwrite").parquet(path)
    degrees = edges.sparkSession.read.parquet(path)
    return degrees, *degrees.agg(F.count("*"), F.coalesce(F.sum("degree"), F.lit(0))).first()


@dataclass(frozen=True)
class Adjacency:
    edges: DataFrame
    degrees: DataFrame
    hubs: DataFrame
    buckets: int
    n_edges: int
    n_sources: int
    n_hubs: int
    path: str

    @staticmethod
    def build(edges: DataFrame, path: str | None = None, *, buckets: int | None = None, distinct: bool = False) -> Adjacency:
        """Write edges (src, dst, ...) to a new path, a scratch one if None. They are read twice: to count each source's, then to be dealt.

        distinct keeps one of equal rows. They meet in the bucket that they are dealt to, so no exchange is made for it. Only rows of hubs, which are found by all
        rows then, are made distinct before as well, or the repeats of one edge would lie in one bucket; they are read once more."""
        spark = edges.sparkSession
        path, buckets = path or scratch(spark, "adjacency"), buckets or width(spark)
        if {"slot", "degree"} & set(edges.columns):
            raise ValueError("edges may not have columns slot or degree")
        if files.exists(spark, f"{path}/manifest.json"):
            raise FileExistsError(f"{path} holds an adjacency index already")
        edges = edges.where("src is not null and dst is not null")
        counted, n_sources, n_edges = _count(edges, f"{path}/{'rows' if distinct else 'degrees'}")
        piece = max(_LEAST, -(-n_edges // (_PIECES * buckets)))
        pieces = F.ceil(F.col("degree") / piece).cast("bigint")
        counted.where(F.col("degree") > piece).select("key", pieces.alias("pieces")).coalesce(1).write.mode("overwrite").parquet(f"{path}/hubs")
        hubs = spark.read.parquet(f"{path}/hubs")
        n_hubs = hubs.count()
        kept = [c for c in edges.columns if c not in ("src", "dst")]
        if n_hubs:
            known = edges.join(F.broadcast(hubs.withColumnRenamed("key", "src")), "src", "left")
            if distinct:
                known = known.where("pieces is null").union(known.where("pieces is not null").distinct())
            at = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("pieces")), F.lit(0).cast("bigint"))
            stored = known.select(_slot(F.col("src"), at).alias("slot"), "src", "dst", *kept)
        else:
            stored = edges.select(F.col("src").alias("slot"), "src", "dst", *kept)
        if distinct:
            stored = stored.repartition(buckets, "slot").distinct()
        table = bucketed.write(stored, f"{path}/edges", "slot", buckets, dealt=distinct)
        if distinct:
            _, n_sources, n_edges = _count(table, f"{path}/degrees")
            files.delete(spark, f"{path}/rows")
        told = {"format": FORMAT, "buckets": buckets, "schema": stored.schema.jsonValue(), "n_edges": n_edges, "n_sources": n_sources, "n_hubs": n_hubs}
        files.write_text(spark, f"{path}/manifest.json", json.dumps(told, indent=1))
        return Adjacency.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Adjacency:
        """The index that build() left at path, in this session or another."""
        if not files.exists(spark, f"{path}/manifest.json"):
            raise FileNotFoundError(f"{path} holds no adjacency index, or one whose build didn't finish")
        told = json.loads(files.read_text(spark, f"{path}/manifest.json"))
        if told["format"] != FORMAT:
            raise ValueError(f"{path} has format {told['format']}; this reads {FORMAT}")
        schema = StructType.fromJson(told["schema"])
        edges = bucketed.open_table(spark, f"{path}/edges", schema, "slot", told["buckets"])
        return Adjacency(edges, spark.read.parquet(f"{path}/degrees"), spark.read.parquet(f"{path}/hubs"), told["buckets"], told["n_edges"], told["n_sources"], told["n_hubs"], path)

    def _of(self, keys: Sequence[int]) -> DataFrame | None:
        """The edges of a few vertices, from their buckets only; None where hubs among them have too many pieces for a list."""
        own = {r["key"]: r["pieces"] for r in self.hubs.where(F.col("key").isin(list(keys))).collect()} if self.n_hubs and keys else {}
        if len(keys) + sum(own.values()) > _MOST_SLOTS:
            return None
        if not keys:
            return self.edges.limit(0)
        ids = [f"{int(k)}L" for k in keys]
        pieces = [f"xxhash64({int(k)}L, {p}L)" for k, n in own.items() for p in range(1, n)]
        return self.edges.where(f"slot IN ({', '.join(ids + pieces)}) AND src IN ({', '.join(ids)})")

    def neighbours(self, *keys: int) -> DataFrame:
        """(src, dst, ...) of the out-edges of some vertices; ids that aren't there have none."""
        found = self._of(keys)
        return (self.edges.where(F.col("src").isin(list(keys))) if found is None else found).drop("slot")

    def messages(
        self, frontier: DataFrame, edge: Callable[[Column, Column], Column], *, argument: str = "weight", keys: Sequence[int] | None = None, rows: int | None = None
    ) -> DataFrame:
        """(key, value): edge(value, argument) for each out-edge of the frontier (key, value), by destination and not reduced yet.

        argument is weight (1 where edges have none) or outdegree. keys: the frontier's keys where they are few and known, so that only their buckets are read.
        rows: how many rows the frontier has, where known. Up to _HASHED for each bucket are hashed, so that the edges needn't be sorted to meet them; else both sides are."""
        edges = self._of(keys) if keys is not None else None
        edges = self.edges if edges is None else edges
        if argument == "outdegree":  # the same for all edges of a vertex
            frontier = frontier.join(self.degrees, "key").select("key", edge(F.col("value"), F.col("degree")).alias("value"))
        # origin is the key once more, but not by the same name or expression, or the union below wouldn't count as dealt by slot
        sent = frontier.select(F.col("key").alias("slot"), "value", F.expr("key ^ 0L").alias("origin"))
        if self.n_hubs:
            hubs = frontier.select("key", "value").join(F.broadcast(self.hubs), "key")  # fewer than _PIECES * buckets
            rest = hubs.select("key", "value", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pieces") - 1)).alias("piece"))
            sent = sent.union(rest.select(_slot(F.col("key"), F.col("piece")).alias("slot"), "value", F.col("key").alias("origin")).repartition(self.buckets, "slot"))
        if rows is not None and rows <= _HASHED * self.buckets:
            sent = sent.hint("shuffle_hash")
        # not an equality, or it would be a second join key, by which the buckets aren't dealt
        met = sent.join(edges, "slot").where("(origin ^ src) = 0")
        weight = F.col("weight") if "weight" in self.edges.columns else F.lit(1).cast("bigint")
        value = F.col("value") if argument == "outdegree" else edge(F.col("value"), weight)
        return met.select(F.col("dst").alias("key"), value.alias("value"))


def adjacency(edges: DataFrame | Adjacency) -> Adjacency:
    """edges themselves where they are an index, else one built in the shared folder."""
    return edges if isinstance(edges, Adjacency) else Adjacency.build(edges)
