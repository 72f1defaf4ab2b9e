"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are put into partitions of correlated bits. Thresholds t_i >= -1 with sum(t_i) = tau - m + 1 lose no pair within
tau bits: if each partition i differed in more than t_i bits, the pair would differ in more than tau. Dynamic programming chooses the
thresholds whose estimated probes and candidates cost least. Every fingerprint is probed on all its keys, and candidates are verified on
all 64 bits. The sample only chooses the plan; whatever it chooses, the links found are the same.

Equal fingerprints are one class with its smallest id as representative, so copies are never paired. A key shared by more than GROUP
classes is refined by pigeonhole on another split of all bits into tau + 1 parts, up to LEVELS times; smaller groups give a spanning forest of
their links. All members of a refined group agree in the parts that led to it, so it holds at most 2 ** f of them, f being the bits in none of
those parts. With tau = 2 every choice of one part a level covers 54 bits after 7 levels (unfixed_bits() walks them all), so no group over 2 ** 10 = GROUP
is left, however many fingerprints there are. With a larger tau some may be; links() then compares those in a join, pair by pair, and with tau = 2 it
raises an error instead.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like any other; a bit that is set in exactly half the hashes is 0; rows with equal ids each
get a row; a null id gets a fingerprint, and a component if a row that it links to has an id; an empty table gives an empty result; other
columns, whatever they are called, are kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.components import connected_components
from basalt.llm.store import in_files, place, staged
from basalt.llm.textops import chunks, mix

SEED, SHINGLE, TAU = 42, 3, 2
SAMPLE, GROUP, LEVELS = 2048, 1024, 12
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_BLOCK = 1 << 16


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Majority of the bits of XXH64(shingle, seed 42) over all k-word shingles, repeats included; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - k + 1)
    last = ends[min(k, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts[at : min(n, at + _BLOCK)].tolist(), last[at : at + _BLOCK].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The other columns of docs, and fp: the text's fingerprint as a signed long."""
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(len(others))):
                got = np.array([fingerprint(c.text(i)) for i in range(c.last - c.first)], np.uint64)
                rest = [batch.column(j).slice(c.first, c.last - c.first) for j in range(len(others))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(got.view(np.int64))], names=[*others, "fp"])

    return docs.select(*others, text_col).mapInArrow(run, docs.select(*others, F.lit(0).cast("long").alias("fp")).schema)


def correlated_partitions(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about 64 / m bits, each grown around a bit by the strongest correlation with the group."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0)) + 1e-9
    corr = np.abs((bits / norm).T @ (bits / norm))
    free, out = set(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _volume(width: int, t: int) -> int:
    return sum(comb(width, i) for i in range(t + 1))


def estimated_cost(sample: np.ndarray, bits: list[int], t: int, n: int) -> float:
    """Keys that n fingerprints emit, plus candidate pairs that share one, for threshold t in this partition."""
    if t < 0:
        return 0.0
    part = sample & _mask(bits)
    near = sum(int((np.bitwise_count(part[i + 1 :] ^ part[i]) <= t).sum()) for i in range(len(part)))
    pairs = max(1, len(part) * (len(part) - 1) // 2)
    share = max(near / pairs if near > 2 else 0.0, _volume(len(bits), t) / 2.0 ** len(bits))
    return 8.0 * n * comb(len(bits), t) + share * n * n / 2


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds -1, 0, 1, ... (costs[i][t + 1]) that sum to total at the least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for j, c in enumerate(row):
                key = used + j - 1
                if key not in new or cost + c < new[key][0]:
                    new[key] = (cost + c, [*chosen, j - 1])
        best = new
    return best[total]


def plan(sample: np.ndarray, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe."""
    options = []
    for m in range(2, tau + 3):
        parts = correlated_partitions(sample, m)
        cost, chosen = allocate([[estimated_cost(sample, p, t, n) for t in range(-1, tau + 1)] for p in parts], tau - m + 1)
        options.append((cost, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def _keys(fp: np.ndarray, masks: list[np.uint64]) -> np.ndarray:
    """One key for each fingerprint and mask: equal where all the mask's bits are equal."""
    salts = mix(np.arange(1, len(masks) + 1, dtype=np.uint64))
    return mix((fp[:, None] & np.array(masks, np.uint64)) ^ salts)


def _splits(level: int, tau: int = TAU) -> list[np.uint64]:
    """tau + 1 masks that share out all 64 bits, another way at each level."""
    order = np.random.Generator(np.random.PCG64(level)).permutation(64).tolist()
    return [_mask(order[j :: tau + 1]) for j in range(tau + 1)]


def unfixed_bits(levels: int, tau: int = TAU) -> int:
    """The most bits that one part of each of the first levels' splits leaves out."""
    left = {(1 << 64) - 1}
    for level in range(1, levels + 1):
        left = {x & ~int(m) for x in left for m in _splits(level, tau)}
    return max(x.bit_count() for x in left)


def group_links(fp: np.ndarray, bounds: np.ndarray, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within tau bits inside each group bounds[i]:bounds[i + 1]."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    sizes = np.diff(bounds)
    small = np.repeat(sizes <= 8, sizes)
    end = np.repeat(bounds[1:], sizes)
    at = np.arange(len(fp))
    for d in range(1, int(min(8, sizes.max(initial=0)))):
        i = at[small & (at + d < end)]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= tau]
        a.append(fp[i])
        b.append(fp[i + d])
    for g in np.flatnonzero(sizes > 8):
        f = fp[bounds[g] : bounds[g + 1]]
        rest, todo = np.arange(len(f)), []
        while len(rest):
            if not todo:
                todo, rest = [rest[0]], rest[1:]
            i = todo.pop()
            near = np.bitwise_count(f[rest] ^ f[i]) <= tau
            found, rest = rest[near], rest[~near]
            todo.extend(found)
            a.append(np.full(len(found), f[i]))
            b.append(f[found])
    return np.concatenate(a), np.concatenate(b)


def links(classes: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints fp that differ in at most tau bits; enough of them that every such pair is connected."""
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    masks = [_mask([b for b in bits if b not in off]) for bits, t in plan(sample, n, tau) for off in combinations(bits, t)]

    def emit(masks: list[np.uint64], refine: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    fp = part.column("fp").to_numpy().view(np.uint64)
                    key = _keys(fp, masks)
                    if refine:
                        key = mix(key ^ part.column("key").to_numpy().view(np.uint64)[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp.view(np.int64), len(masks)))],
                        names=["key", "fp"],
                    )

        return run

    def shared(keyed: DataFrame) -> DataFrame:
        counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        return staged(keyed.join(counts, "key"), "candidates")

    kind = "key long, fp long"
    found = shared(classes.mapInArrow(emit(masks, False), kind))
    ready, level = found.where(F.col("n") <= GROUP), 0
    while (most := found.agg(F.max("n")).first()[0] or 0) > GROUP and level < LEVELS:
        level += 1
        found = shared(found.where(F.col("n") > GROUP).mapInArrow(emit(_splits(level, tau), True), kind))
        ready = ready.union(found.where(F.col("n") <= GROUP))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.column(0).slice(at, 256)
                sizes = np.diff(rows.offsets.to_numpy())
                a, b = group_links(rows.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(sizes)]), tau)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    groups = ready.groupBy("key").agg(F.collect_list("fp").alias("members")).select("members")  # at most GROUP members
    out = groups.mapInArrow(compare, "a long, b long")
    if most > GROUP and tau <= 2:
        raise RuntimeError(f"a group of {most} fingerprints agrees in 54 bits")
    if most > GROUP:
        rest = found.where(F.col("n") > GROUP)
        pairs = rest.select("key", F.col("fp").alias("a")).join(rest.select("key", F.col("fp").alias("b")), "key")
        out = out.union(pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau)).select("a", "b"))
    return out


def groups(classes: DataFrame, tau: int = TAU) -> DataFrame:
    """classes (fp, ...) with root, the smallest fingerprint reachable from fp over links."""
    nodes = connected_components(links(classes.select("fp"), tau))
    return classes.join(nodes, classes.fp == nodes.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for each row of docs; component_id is the smallest id reachable over links."""
    prints = staged(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))), "fingerprints")
    grouped = groups(staged(prints.groupBy("fp").agg(F.min("id").alias("id")), "classes"), tau)
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays (of rows with equal ids, one)."""
    docs, at = in_files(docs), place()
    slim = docs.select(*at, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = staged(fingerprints(slim), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "file", "row")).alias("first")
    best = groups(staged(prints.groupBy("fp").agg(first), "classes"), tau).groupBy("root").agg(F.min("first").alias("first"))
    chosen = best.select(F.col("first.file").alias("_f"), F.col("first.row").alias("_r"))
    whole = docs.select(at[0].alias("_f"), at[1].alias("_r"), F.struct(*docs.columns).alias("_doc"))
    return whole.join(chosen, ["_f", "_r"], "left_semi").select("_doc.*")
