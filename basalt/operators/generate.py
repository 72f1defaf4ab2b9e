"""Graph generators with seeds, as maps over rows: one row for each edge (R-MAT) or vertex (preferential attachment), and nothing is shuffled.

Every draw is a digest of the row's number and the seed, so a task that is run again makes the same edges, and so does any number of partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Cut points of the quadrant probabilities .57, .19, .19, .05 in 1024ths.
CUTS = (583, 777, 971)
# The ends of the edges of a clique of three.
CLIQUE = (0, 1, 1, 2, 2, 0)
PER_HASH = 10
COIN = 1 << 16
_STEPS = (8, 64)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def rmat_of(ids: DataFrame, scale: int, *, id_col: str = "id", seed: int = 0) -> DataFrame:
    """An edge (src, dst) over 2**scale vertices for each row: equal ids make equal edges, a null id counts as a value of its own."""
    a, b, c = CUTS
    # an MD5 digest has 32 hexadecimal digits: three of them for each of PER_HASH draws
    hashes = F.transform(F.sequence(F.lit(0), F.lit((scale - 1) // PER_HASH)), lambda j: F.md5(F.concat_ws(":", F.col(id_col), j, F.lit(seed))))
    draw = lambda h, i: F.conv(F.substring(F.get(h, F.lit(i // PER_HASH)), 3 * (i % PER_HASH) + 1, 3), 16, 10).cast("int") % 1024

    def edge(draws: Column) -> Column:
        bit = lambda on: F.aggregate(draws, F.lit(0).cast("bigint"), lambda n, r: n * 2 + on(r).cast("bigint"))
        return F.struct(bit(lambda r: ((r >= a) & (r < b)) | (r >= c)).alias("src"), bit(lambda r: r >= b).alias("dst"))

    made = _once(hashes, lambda h: _once(F.array(*(draw(h, i) for i in range(scale))), edge))
    # a generator's result is used as it is, where a column would be computed for each of its fields
    return ids.select(F.inline(F.array(made)))


def rmat(spark: SparkSession, scale: int, edge_factor: int = 1, *, seed: int = 0) -> DataFrame:
    """edge_factor * 2**scale edges (src, dst) over 2**scale vertices. Repeats and self loops stay, as graph.prepare() removes them."""
    return rmat_of(spark.range(edge_factor << scale), scale, seed=seed)


def _target(slot: Column, vertex: Column, edge_factor: int, uniform: float, seed: int) -> Column:
    """The older vertex that an edge slot of vertex takes.

    Slots number the edges of vertices from 3 on, edge_factor each. The list of ends holds the clique's, then vertex and target of each slot in order. A slot draws any
    older vertex, or a place in the list before its own vertex's slots: each vertex lies there as often as its degree. Where the place holds another slot's target, that
    slot's draw is made again from its digest, and so on; the vertex falls with each step, so it ends, after about two steps on average."""
    long = lambda n: F.lit(n).cast("bigint")
    owner = lambda s: _div(s, edge_factor) + 3

    def state(slot: Column, found: Column | None) -> Column:
        return F.struct(slot.alias("slot"), (long(None) if found is None else found).alias("found"))

    def follow(s: Column, digest: Column) -> Column:
        coin, drawn = F.conv(F.substring(digest, 1, 4), 16, 10).cast("bigint"), F.conv(F.substring(digest, 5, 15), 16, 10).cast("bigint")

        def at(place: Column) -> Column:
            other = F.shiftright(place - len(CLIQUE), 1)
            inside = state(s, F.element_at(F.array(*map(long, CLIQUE)), (F.least(place, long(len(CLIQUE) - 1)) + 1).cast("int")))
            return F.when(place < len(CLIQUE), inside).when(place % 2 == 0, state(s, owner(other))).otherwise(state(other, None))

        return F.when(coin < int(uniform * COIN), state(s, drawn % owner(s))).otherwise(_once(drawn % (len(CLIQUE) + 2 * edge_factor * (owner(s) - 3)), at))

    def step(x: Column, _: Column) -> Column:
        return F.when(x["found"].isNotNull(), x).otherwise(_once(F.md5(F.concat_ws(":", x["slot"], F.lit(seed))), lambda d: follow(x["slot"], d)))

    def steps(n: Column) -> Callable[[Column], Column]:
        return lambda x: F.when(x["found"].isNotNull(), x).otherwise(F.aggregate(F.sequence(long(1), n), x, step))

    done = state(slot, None)
    for n in (*map(long, _STEPS), vertex):  # no slot needs more steps than its vertex's number
        done = _once(done, steps(n))
    return done["found"]


def attach(vertices: DataFrame, edge_factor: int = 8, *, id_col: str = "id", uniform: float = 0.1, seed: int = 0) -> DataFrame:
    """Preferential attachment of a table's vertices, numbered from 0 in their order: edges (src, dst), each in both directions.

    0, 1 and 2 make a clique; each later vertex takes edge_factor older ones, any of them with probability uniform, else by degree, where an older one taken twice by
    the same vertex counts twice but makes one edge. A vertex's edges follow from its number alone, so rows may come in any order and partitions. Null and negative
    ids are left out, a repeated id makes its edges again, an empty table gives none."""
    v = F.col("v")
    slots = F.transform(F.sequence(F.lit(0), F.lit(edge_factor - 1)), lambda j: _target((v - 3) * edge_factor + j, v, edge_factor, uniform, seed))
    older = F.when(v < 3, F.sequence(F.lit(0).cast("bigint"), F.greatest(v - 1, F.lit(0).cast("bigint")))).otherwise(F.array_distinct(slots))
    made = vertices.select(F.col(id_col).cast("bigint").alias("v")).where("v >= 1").select("v", F.explode(older).alias("u"))
    ways = F.array(F.struct(v.alias("src"), F.col("u").alias("dst")), F.struct(F.col("u").alias("src"), v.alias("dst")))
    return made.select(F.inline(ways))


def barabasi_albert(spark: SparkSession, scale: int, edge_factor: int = 8, *, uniform: float = 0.1, seed: int = 0) -> DataFrame:
    """Preferential attachment over 2**scale vertices, each edge in both directions."""
    return attach(spark.range(1 << scale), edge_factor, uniform=uniform, seed=seed)
