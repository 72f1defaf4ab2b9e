"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, by SimHash and, for what its 64 bits can't tell, MinHash.

First SimHash: each set's 64-bit fingerprint is probed by the generalised pigeonhole principle with thresholds by dynamic programming (simhash.links()), and
classes whose fingerprints differ in at most TAU bits are linked where their whole sets are similar. A fingerprint can't reach every link: at 0.8 two differ in
about 10 bits, and no pigeonhole plan goes that far. So, second, what is in different components after that meets once more by bands: BANDS keys, each of ROWS
minima of the set under random orders. A pair at similarity s shares none with probability
(1 - s ** ROWS) ** BANDS: 6e-5 at 0.8, 1e-10 at 0.9. Two bits of each minimum are a document's signature; a pair at 0.8 agrees in 163 of those 192
places on average, and in less than AGREE with probability 1e-7. Pairs that agree in less are passed by inside the join on the band, before they
are rows. Each link of either kind is verified on the whole sets of shingle hashes (64 bits).

Equal sets are one class. In each of STARS rounds a class is compared with one other that shares a band with it, the one of the smallest hash in that band and over
its bands, so a large group of near copies becomes one component without its pairs; the first round's links and the fingerprints' are put together before components are found. Then the members of each band that holds more than one component
meet in blocks of about BLOCK classes and BLOCK_SHINGLES shingles; a larger band's blocks meet two by two. A block's signatures tell which of its pairs agree. Where
those are no more than its members they are verified as pairs, else its members' texts meet in the block once and it gives a spanning forest of
its similar pairs. So no band's pairs become rows, and in the end every pair that shares a band and agrees was compared or is in one component.

Defined cases: words and case as in simhash; a text of fewer words is one shingle; a null text counts as empty; texts without words are copies of
each other; a null id comes last in its component; rows with equal ids are separate documents; an empty table gives an empty result; other
columns, whatever they are called, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.components import connected_components
from basalt.llm.simhash import _LOWER, links as near_prints
from basalt.llm.store import in_files, place, staged
from basalt.llm.textops import _WORD_BASE, Chunk, chunks, mix, span_hashes

SHINGLE, TAU, BANDS, ROWS, STARS = 5, 3, 32, 6, 1
AGREE, BLOCK, BLOCK_SHINGLES, SPREAD = 136, 1024, 500_000, 128
_SIGNS = BANDS * ROWS // 32
_PAIRS_OF_BITS = 0x5555555555555555
_LOWER_BYTES = np.frombuffer(_LOWER, np.uint8)
_SALTS = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether both / (a + b - both) >= 0.8, in whole numbers."""
    return 5 * both >= 4 * (a + b - both)


def shingle_sets(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i's distinct shingles, ascending, are hashes[bounds[i]:bounds[i + 1]]."""
    c = Chunk(c.first, c.last, _LOWER_BYTES[c.data], c.offsets)
    words = np.diff(c.word_offsets)
    short = (words > 0) & (words < SHINGLE)
    at = np.concatenate([c.windows(SHINGLE), c.word_offsets[:-1][short]])
    length = np.concatenate([np.full(len(at) - short.sum(), SHINGLE), words[short]])
    hashes, doc = span_hashes(c.word_hashes, at, at + length, _WORD_BASE), c.word_doc[at]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(c.last - c.first + 1))


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a hash of each whole set, its BANDS keys, its signature)."""
    n, some = len(bounds) - 1, np.flatnonzero(np.diff(bounds))
    whole, keys, signs = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64), np.zeros((n, _SIGNS), np.uint64)
    if not len(some):
        return whole, keys, signs
    starts = bounds[:-1][some]
    whole[some] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts) + np.diff(bounds)[some].astype(np.uint64))
    for band in range(BANDS):
        key = np.full(len(some), band + 1, np.uint64)
        for j in range(band * ROWS, band * ROWS + ROWS):
            x = (hashes ^ _SALTS[0, j]) * (_SALTS[1, j] | np.uint64(1))
            x ^= x >> np.uint64(32)
            least = np.minimum.reduceat(x * np.uint64(0x9E3779B97F4A7C15), starts)
            key = mix(key ^ least)
            signs[some, j // 32] |= (mix(least) >> np.uint64(62)) << np.uint64(2 * (j % 32))
        keys[some, band] = key
    return whole, keys, signs


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The SimHash of each set: a bit is 1 if set in over half of its hashes; 0 of an empty set."""
    out, some = np.zeros(len(bounds) - 1, np.uint64), np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    starts, size, half = bounds[:-1][some], np.diff(bounds)[some].astype(np.uint64), np.uint64(32)
    for j in range(32):
        two = np.add.reduceat((hashes >> np.uint64(j)) & np.uint64((1 << 32) + 1), starts)  # the counts of bits j and j + 32
        for bit, count in ((j, two & np.uint64(0xFFFFFFFF)), (j + 32, two >> half)):
            out[some] |= (2 * count > size).astype(np.uint64) << np.uint64(bit)
    return out


def _sketched(slim: DataFrame) -> DataFrame:
    """(id, file, row, n, h, fp, bands, sig) of slim (file, row, id, text): how many shingles, a hash of their set, its fingerprint, keys (none without words), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(3)):
                hashes, bounds = shingle_sets(c)
                n = np.diff(bounds)
                whole, keys, signs = sketches(hashes, bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)), pa.array(keys[n > 0].ravel().view(np.int64)))
                sig = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(signs[:, j]).view(np.int64)) for j in range(_SIGNS)], names=[f"s{j}" for j in range(_SIGNS)])
                rest = [batch.column(j).slice(c.first, c.last - c.first) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n.astype(np.int32)), pa.array(whole.view(np.int64)), pa.array(fingerprints(hashes, bounds).view(np.int64)), lists, sig], names=["file", "row", "id", "n", "h", "fp", "bands", "sig"])

    long = F.lit(0).cast("long")
    sig = F.struct(*(long.alias(f"s{j}") for j in range(_SIGNS)))
    kind = slim.select("file", "row", "id", F.lit(0).alias("n"), long.alias("h"), long.alias("fp"), F.array(long).alias("bands"), sig.alias("sig")).schema
    return slim.select("file", "row", "id", "text").mapInArrow(run, kind)


def _likely() -> Column:
    """Whether a row's two classes can be similar, by their sizes and signatures."""
    unlike = F.lit(0)
    for j in range(_SIGNS):
        x = F.col(f"sig.s{j}").bitwiseXOR(F.col(f"other_sig.s{j}"))
        unlike = unlike + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_PAIRS_OF_BITS)))
    return F.expr("5 * least(n, other_n) >= 4 * greatest(n, other_n)") & (unlike <= 32 * _SIGNS - AGREE)


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The shingle set of each text."""
    out = []
    for c in chunks(column):
        hashes, bounds = shingle_sets(c)
        out += [hashes[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return out


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose texts (h, text) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [_sets(part.column(column)) for column in (2, 3)]
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)], np.int64)
                good = similar(both, *(np.array([len(x) for x in s], np.int64) for s in sets))
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = texts.select(F.col("h").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("h").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of classes whose fingerprints differ in at most TAU bits; enough of them that all such classes would be connected."""
    some = classes.where("n > 0").select("fp", "h")
    prints = staged(some.groupBy("fp").agg(F.min("h").alias("first")), "prints")
    same = some.join(prints, "fp").where("h <> first").select(F.col("first").alias("a"), F.col("h").alias("b"))
    near = near_prints(prints.select("fp"), TAU).distinct()
    for end in ("a", "b"):
        near = near.join(prints.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")), end)
    return same.union(near.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))


def agreeing(members: dict[str, np.ndarray], cross: bool) -> np.ndarray:
    """Which pairs i < j of a block's members can be similar and are in two components; cross: and in two blocks."""
    m = len(members["h"])
    out = np.zeros((m, m), bool)
    for i in range(m - 1):
        rest = slice(i + 1, m)
        unlike = np.zeros(m - 1 - i, np.int64)
        for j in range(_SIGNS):
            x = members[f"s{j}"][rest] ^ members[f"s{j}"][i]
            unlike += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(_PAIRS_OF_BITS))
        n, other = members["n"][rest], members["n"][i]
        out[i, rest] = (unlike <= 32 * _SIGNS - AGREE) & (5 * np.minimum(n, other) >= 4 * np.maximum(n, other)) & (members["root"][rest] != members["root"][i])
        if cross:
            out[i, rest] &= members["block"][rest] != members["block"][i]
    return out


def similar_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets are similar, by the shingles that two or more of them hold."""
    m, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    kinds, which, often = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often > 1)
    column = np.full(len(kinds), -1)
    column[shared] = np.arange(len(shared))
    of, column = np.repeat(np.arange(m), sizes), column[which.ravel()]
    of, column = of[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((m, m))
    for at in range(0, len(shared), 2048):
        a, b = np.searchsorted(column, [at, at + 2048])
        held = np.zeros((m, 2048), np.float32)
        held[of[a:b], column[a:b] - at] = 1
        both += held @ held.T
    return similar(both.astype(np.int64), sizes[:, None], sizes[None, :])


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that connect whatever the symmetric matrix connects."""
    out, rest, todo = [], np.arange(len(linked)), []
    while len(rest):
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        i = todo.pop()
        near = linked[i, rest]
        found, rest = rest[near], rest[~near]
        todo.extend(found.tolist())
        out += [(int(i), j) for j in found.tolist()]
    return out


def _spread(facts: DataFrame) -> DataFrame:
    """One row for each salt of each key (key, parts, ...), so that a large band meets what is known of it in many places."""
    return facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _blocks(unsettled: DataFrame) -> DataFrame:
    """(key, lo, hi, a, b): pairs (a, b) of blocks with few that agree, and members a of the other blocks lo, hi, with no b."""
    sizes = _spread(unsettled.groupBy("key", "parts").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    dealt = unsettled.join(sizes, ["key", "salt"]).withColumn("block", F.pmod(F.xxhash64("h"), "blocks").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("h", "n", "root", "block", "sig.*")
    groups = dealt.groupBy("key", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi")).agg(F.collect_list(member).alias("members"))  # about BLOCK of each of the two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "lo": [], "hi": [], "a": [], "b": []}
            key, lo, hi = (batch.column(k).to_pylist() for k in range(3))
            offsets, flat = batch.column(3).offsets.to_numpy(), batch.column(3).values
            fields = {f.name: flat.field(f.name).to_numpy() for f in flat.type}
            fields = {k: v.view(np.uint64) if k.startswith("s") else v for k, v in fields.items()}
            for r in range(batch.num_rows):
                members = {k: v[offsets[r] : offsets[r + 1]] for k, v in fields.items()}
                pairs = agreeing(members, lo[r] != hi[r])
                if pairs.sum() <= len(pairs):
                    i, j = np.nonzero(pairs)
                    a, b = members["h"][i].tolist(), members["h"][j].tolist()
                else:
                    a = members["h"][pairs.any(axis=0) | pairs.any(axis=1)].tolist()
                    b = [None] * len(a)
                for name, values in zip(out, ([key[r]] * len(a), [lo[r]] * len(a), [hi[r]] * len(a), a, b), strict=True):
                    out[name] += values
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return groups.mapInArrow(run, "key long, lo int, hi int, a long, b long")


def _in_blocks(dense: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of each block's similar pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                members = batch.column(0).slice(r, 1).flatten()
                h = members.field("h").to_numpy()
                links = forest(similar_pairs(_sets(members.field("text"))))
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for i, _ in links], pa.int64()), pa.array([h[j] for _, j in links], pa.int64())], names=["a", "b"])

    met = dense.select("key", "lo", "hi", F.col("a").alias("h")).join(texts, "h").groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("h", "text")).alias("members"))
    return met.select("members").mapInArrow(run, "a long, b long")


def components(classes: DataFrame, slim: DataFrame) -> DataFrame:
    """(node, root) for each class that has near copies; classes (h, n, fp, bands, sig, first), slim (file, row, text)."""
    printed = staged(_by_fingerprint(classes), "printed")
    keyed = classes.where("n > 0").select("h", "n", "sig", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / SPREAD).cast("int")
    members = staged(keyed.join(shared, "key").withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64("h"), "parts").cast("int")).drop("size"), "members")
    asked = members.select("h").union(printed.select("a")).union(printed.select("b")).distinct()
    spots = classes.join(asked, "h", "left_semi").select("h", F.col("first.file").alias("file"), F.col("first.row").alias("row"))
    texts = staged(slim.join(spots, ["file", "row"]).select("h", "text"), "texts")
    links, nodes = staged(_verified(printed, texts), "links"), None
    if not STARS:
        nodes = staged(connected_components(links), "nodes")
    for star in range(STARS + 1):
        rooted = members.withColumn("root", F.col("h")) if nodes is None else staged(members.join(nodes, members.h == nodes.node, "left").select("key", "parts", "salt", "h", "n", "sig", F.coalesce("root", "h").alias("root")), "rooted")
        unlike = rooted.groupBy("key", "parts").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
        unsettled = staged(rooted.join(_spread(unlike), ["key", "salt"], "left_semi"), "unsettled")
        if unsettled.isEmpty():
            break
        if star < STARS:
            by = F.xxhash64("h", F.lit(star)).alias("by")
            middle = _spread(unsettled.groupBy("key", "parts").agg(F.min(F.struct(by, "h", "n", "sig", "root")).alias("m")))
            middle = middle.select("key", "salt", F.col("m.by").alias("by"), F.col("m.h").alias("other"), *(F.col(f"m.{c}").alias(f"other_{c}") for c in ("n", "sig", "root")))
            near = unsettled.join(middle, (unsettled.key == middle.key) & (unsettled.salt == middle.salt) & (F.col("root") != F.col("other_root")) & _likely())
            best = near.groupBy("h").agg(F.min(F.struct("by", "other")).alias("m")).select(F.col("h").alias("a"), F.col("m.other").alias("b"))
            good = staged(_verified(best, texts), "links")
        else:
            found = staged(_blocks(unsettled), "found")
            pairs = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            good = staged(_verified(pairs, texts), "links").union(staged(_in_blocks(found.where("b is null"), texts), "links"))
        nodes = staged(connected_components(links.union(good)), "nodes")
        links = nodes.select(F.col("node").alias("a"), F.col("root").alias("b"))  # they connect what all links so far do
    return nodes if nodes is not None else staged(connected_components(links), "nodes")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component the row with the smallest id stays (of rows with equal ids, one)."""
    docs, at = in_files(docs), place()
    slim = docs.select(*at, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "file", "row")).alias("first")
    classes = staged(staged(_sketched(slim), "sketches").groupBy("h", "n").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    nodes = components(classes, slim)
    best = classes.join(nodes, classes.h == nodes.node, "left").groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("first").alias("first"))
    chosen = best.select(F.col("first.file").alias("_f"), F.col("first.row").alias("_r"))
    whole = docs.select(at[0].alias("_f"), at[1].alias("_r"), F.struct(*docs.columns).alias("_doc"))
    return whole.join(chosen, ["_f", "_r"], "left_semi").select("_doc.*")
