"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are the words [^\\x20\\x09-\\x0D]+ of a text, those over PIECE characters cut into pieces. Every K consecutive tokens give a hash as the window
rolls over them; of each WINDOW consecutive hashes the smallest is kept, of equal ones the rightmost, once for neighbouring windows. So any
run of K + WINDOW - 1 tokens that two texts share gives them a common hash. While it is compared, an entry is one long: 40 bits of hash above BITS bits
that count positions down, so that array_min breaks ties to the right by itself; texts of more tokens than that compare structs of the same hash and the
position. The fingerprint string is the entries in order: ten hexadecimal digits of hash and six that count positions down, or, in texts
with a position beyond 2**BITS, ten of hash and eight of position.

Defined cases: a null text counts as empty and has the empty fingerprint; a text of fewer than K tokens has one hash of all its tokens, one of fewer
than WINDOW hashes keeps their minimum; two empty fingerprints have likeness 1, an empty and another 0. In the order of documents null ids come
first, rows of one id follow by a hash of their text, and rows alike in both are one document; each of them gets a row. The next document
of the last is the first, of a lone one itself. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.store import staged

K, WINDOW, PIECE = 3, 8, 24
CELLS, BITS = 1024, 24
_LOW = (1 << BITS) - 1
_NO_ID = -(1 << 63)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def entries(text: Column, k: int = K, window: int = WINDOW, most: int = 1 << BITS) -> Column:
    """array<struct<hash, at>>: the winnowed hashes of a text and their positions; most: the tokens of a text whose entries are compared as longs."""
    tokens = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))

    def grams(h: Column, entry: Callable[[Column, Column], Column]) -> Column:
        gram = F.transform(h, lambda x, i: entry(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))), i.cast("long")))
        return F.slice(gram, F.lit(1), F.greatest(F.size(h) - (k - 1), F.least(F.size(h), F.lit(1))))

    def least(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(p) - (window - 1), F.lit(1)))
        return F.transform(starts, lambda s: F.array_min(F.slice(p, s, F.lit(window))))

    def once(m: Column) -> Column:
        return F.filter(m, lambda x, i: x.isNotNull() & ((i == 0) | (x != F.get(m, i - 1))))

    def short(h: Column) -> Column:
        packed = grams(h, lambda x, i: x.bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.lit(_LOW) - i))
        kept = bound(bound(packed, least), once)
        return F.transform(kept, lambda x: F.struct(F.shiftrightunsigned(x, BITS).alias("hash"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).alias("at")))

    def long(h: Column) -> Column:
        # signed, as the longs are compared
        wide = grams(h, lambda x, i: F.struct(F.shiftright(x, BITS).alias("hash"), (-i).alias("back")))
        kept = bound(bound(wide, least), once)
        return F.transform(kept, lambda x: F.struct(x["hash"].bitwiseAND(F.lit((1 << 64 - BITS) - 1)).alias("hash"), (-x["back"]).alias("at")))

    return bound(hashes, lambda h: F.when(F.size(h) <= most, short(h)).otherwise(long(h)))


def fingerprint(kept: Column) -> Column:
    """The entries as a string."""
    six = F.transform(kept, lambda x: F.lower(F.lpad(F.hex(F.shiftleft(x["hash"], BITS).bitwiseOR(F.lit(_LOW) - x["at"])), 16, "0")))
    eight = F.transform(kept, lambda x: F.lower(F.concat(F.lpad(F.hex(x["hash"]), 10, "0"), F.lpad(F.hex(x["at"]), 8, "0"))))
    return F.array_join(F.when(F.exists(kept, lambda x: x["at"] > _LOW), eight).otherwise(six), "")


def hashes(kept: Column) -> Column:
    """The distinct hashes of entries, positions aside."""
    return F.array_distinct(F.transform(kept, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes."""
    sizes = bound(F.struct(a.alias("a"), b.alias("b")), lambda p: F.struct(F.size(F.array_intersect(p["a"], p["b"])).alias("both"), F.size(F.array_union(p["a"], p["b"])).alias("any")))
    return bound(sizes, lambda s: F.when(s["any"] == 0, F.lit(1.0)).otherwise(s["both"] / s["any"]))


def next_documents(keys: DataFrame) -> DataFrame:
    """(id, h, next_id, next_h) of distinct documents (id, h), neither null, in their order.

    Ids are dealt into at most CELLS ranges by approximate quantiles; only the ranges' first keys, CELLS at most, come to the driver."""
    spark = keys.sparkSession
    cuts = keys.agg(F.percentile_approx("id", [i / CELLS for i in range(1, CELLS)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    cell = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    celled = keys.withColumn("cell", cell)
    key = F.struct("id", "h")
    firsts = [(r["cell"], r["k"]["id"], r["k"]["h"]) for r in celled.groupBy("cell").agg(F.min(key).alias("k")).orderBy("cell").collect()]
    after = [(c, *firsts[(i + 1) % len(firsts)][1:]) for i, (c, *_) in enumerate(firsts)]
    follow = spark.createDataFrame(after, "cell int, after_id long, after_h long")
    led = celled.withColumn("n", F.lead(key).over(Window.partitionBy("cell").orderBy("id", "h")))
    joined = led.join(F.broadcast(follow), "cell")  # at most CELLS rows
    inside = F.col("n").isNotNull()
    return joined.select("id", "h", F.when(inside, F.col("n.id")).otherwise(F.col("after_id")).alias("next_id"), F.when(inside, F.col("n.h")).otherwise(F.col("after_h")).alias("next_h"))


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # keys are never null, so that joins on them keep the partitioning; a null id is the smallest id, and the lowest bit of h says so
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    h = F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(F.when(F.col(id_col).isNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    rows = docs.select(own.alias("id"), h.alias("h"), text.alias("text"))
    counted = staged(rows.select("id", "h", F.length("text").alias("n")).groupBy("id", "h").agg(F.max("n").alias("n"), F.count("*").alias("same")), "keys")
    order = next_documents(counted.select("id", "h"))
    chain = staged(order.join(counted, ["id", "h"]).select("id", "h", "next_id", "next_h", F.floor(F.col("n") / 2).cast("int").alias("half")), "order")

    # both uses below read one exchange of the texts
    dealt = rows.repartition("id", "h")
    other = dealt.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("text").alias("o_text"))
    sent = other.join(chain, ["next_id", "next_h"]).select("id", "h", "half", F.expr("left(o_text, half)").alias("head"), hashes(entries(F.col("o_text"))).alias("next_hashes"))
    if (counted.agg(F.max("same")).first()[0] or 1) > 1:
        sent = sent.dropDuplicates(["id", "h"])
    both = dealt.join(sent, ["id", "h"])
    made = both.select("id", "h", "text", "next_hashes", F.expr("concat(left(text, length(text) - half), head)").alias("edited"))
    kept = made.select("id", "h", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "next_hashes", entries(F.col("text")).alias("kept"), entries(F.col("edited")).alias("edited_kept"))
    return kept.select(
        F.when(F.col("h").bitwiseAND(F.lit(1)) == 0, F.col("id")).alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("kept")).alias("fingerprint"),
        fingerprint(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(hashes(F.col("kept")), hashes(F.col("edited_kept"))).alias("near_edited"),
        likeness(hashes(F.col("kept")), F.col("next_hashes")).alias("near_next"),
    )
