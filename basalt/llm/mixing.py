"""Mixing sources to target weights by subset-sum budget fitting.

Sources in order of their code points, null last, weigh 5, 2, 1, repeating. They share all words; a target stops at CAP times its source's
size and the excess is shared again by weight. A source's documents are taken whole floor(target / size) times. The budget that remains is
fitted by length: documents are counted by exact length, and bounded-knapsack dynamic programming finds how many of each length come nearest
to the budget without passing it. Which documents of a length are taken follows a seeded hash of their ids and texts.

fit() keeps to tables of CELLS sums. So that documents of all lengths are taken, a proportional part of each count is set aside first, and the program fills the rest,
MARGIN times the longest document; a rest that is filled to the last word can't be beaten. If it can't be filled, the rest grows eightfold, three times at most. Budgets
of up to CELLS words are then solved whole. For larger ones one length is the pivot: whatever the others make, the pivot's documents fill all but a
remainder modulo its length. So the program finds, for each remainder, the least number of the other documents to add or give back that makes it, in memory
that follows the pivot's length alone; as least numbers stay below that length (of more documents, some would make no difference), the pivot has enough
documents to go along where it has about twice as many as the longest length has words, and often with far fewer, which is checked on the answer. That is exact. Only where no length can
be such a pivot, the sums around the longest-first choice are tried: by the proximity theorem of Eisenbrand and Weismantel (one constraint, coefficients up to d) a
best solution is within 2 d + 1 documents of it. Beyond CELLS sums that is left out, and the best that a pivot found is taken, which then may not be the largest sum.

Up to MAX_SOURCES sources are weighed on the driver; more of them by rounds of aggregates, with the same result.

Defined cases: a null text has size 0; null sources are one source, last; null or repeated ids are documents like others; rows that are alike in id,
source and text are interchangeable in mix(), and mixed() takes them by their places in the files; documents of size 0 take 0 words and stay once in
mixed(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.store import in_files, place, staged

WEIGHTS, CAP, SEED = (5.0, 2.0, 1.0), 3, 42
MAX_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"
MARGIN, WIDER = 8, (1, 8, 64)
_SALT_BITS, _SOURCE_SALTS = 10, 16
CELLS, PIVOTS, _BLOCK = 1 << 24, 6, 128


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> list[float]:
    """Targets of sources in order: shares of the total by weight, none above cap times its size."""
    total, free = float(sum(sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    left = total
    while free:
        share = sum(weights[i % len(weights)] for i in free)
        over = {i for i in free if left * weights[i % len(weights)] / share > cap * sizes[i]}
        for i in sorted(over or free):
            out[i] = float(cap * sizes[i]) if over else left * weights[i % len(weights)] / share
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def _reach(lengths: list[int], counts: list[int], limit: int, *, whole: bool = False) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(step, steps): steps[j - 1] = (i, k) adds k of length i; step[s] is the first step after which the sum s can be made, 0 for 0, -1 if none.

    It ends as soon as limit can be made, unless whole."""
    step, steps = np.full(limit + 1, -1, np.int32), []
    step[0] = 0
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        for k in _binary(min(counts[i], limit // lengths[i])):
            if not whole and step[limit] >= 0:
                return step, steps
            by = k * lengths[i]
            steps.append((i, k))
            step[by:][(step[: limit + 1 - by] >= 0) & (step[by:] < 0)] = len(steps)
    return step, steps


def _binary(n: int) -> Iterator[int]:
    """Numbers whose partial sums make everything from 0 to n, and no more."""
    part = 1
    while n:
        yield (k := min(part, n))
        n, part = n - k, 2 * part


def _used(step: np.ndarray, steps: list[tuple[int, int]], lengths: list[int], total: int) -> list[int]:
    """How many of each length make that total."""
    out = [0] * len(lengths)
    while total:
        i, k = steps[step[total] - 1]
        out[i] += k
        total -= k * lengths[i]
    return out


def _last(step: np.ndarray) -> int:
    return int(np.flatnonzero(step >= 0)[-1])


def _set_aside(lengths: list[int], counts: list[int], budget: int, rest: int) -> list[int]:
    """About the same share of each count, then the longest, until rest or a little more is left of the budget."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    take = [c * (budget - rest) // total for c in counts]
    left = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        more = max(0, min(counts[i] - take[i], (left - rest) // lengths[i]))
        take[i] += more
        left -= more * lengths[i]
    return take


def _filled(lengths: list[int], counts: list[int], take: list[int], budget: int) -> tuple[int, list[int]]:
    """(what is left of the budget, how many of each) once the best sum of the others is added to take."""
    rest = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    step, steps = _reach(lengths, [c - k for c, k in zip(counts, take, strict=True)], rest)
    best = _last(step)
    return rest - best, [k + x for k, x in zip(take, _used(step, steps, lengths, best), strict=True)]


def _near_vertex(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """The best take, among those within 2 d + 2 documents of the longest-first one; d is the longest length."""
    far, gap, take = 2 * max(lengths) + 2, budget, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        take[i] = min(counts[i], gap // lengths[i])
        gap -= take[i] * lengths[i]
        if take[i] < counts[i]:
            break
    limit = far * max(lengths)
    back, back_steps = _reach(lengths, [min(k, far) for k in take], limit, whole=True)
    more, more_steps = _reach(lengths, [min(c - k, far) for c, k in zip(counts, take, strict=True)], limit + gap, whole=True)
    most = np.maximum.accumulate(np.where(more >= 0, np.arange(len(more)), -1))
    given = np.flatnonzero(back >= 0)
    r = int(given[np.argmax(most[gap + given] - given)])
    minus, plus = _used(back, back_steps, lengths, r), _used(more, more_steps, lengths, int(most[gap + r]))
    return [k - x + y for k, x, y in zip(take, minus, plus, strict=True)]


def _changes(others: list[int], lengths: list[int], base: list[int], counts: list[int], modulus: int) -> list[tuple[int, int, int]]:
    """(length's place, documents added or, below 0, given back, what that adds modulo modulus), each to be used once or not."""
    out = []
    for i in others:
        for sign, room in ((1, counts[i] - base[i]), (-1, base[i])):
            out += [(i, sign * k, sign * k * lengths[i] % modulus) for k in _binary(min(room, modulus))]
    return out


def _cheaper(least: np.ndarray, change: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least numbers of documents once a change may be used, and for which remainders it is."""
    tried = np.roll(least, change[2]) + abs(change[1])
    used = tried < least
    return np.where(used, tried, least), used


def _by_remainders(p: int, lengths: list[int], counts: list[int], budget: int) -> tuple[int, list[int], bool]:
    """(words missed, how many of each, whether nothing better exists) with length p as the pivot."""
    others, size = [i for i in range(len(lengths)) if i != p], lengths[p]
    total = sum(lengths[i] * counts[i] for i in others)
    low, high = max(0, budget - size * counts[p]), min(total, budget)
    base, gap = [0] * len(lengths), (low + high) // 2
    for i in others:
        base[i] = counts[i] * ((low + high) // 2) // total if total else 0
        gap -= base[i] * lengths[i]
    for i in others:
        more = min(counts[i] - base[i], max(0, gap) // lengths[i])
        base[i], gap = base[i] + more, gap - more * lengths[i]
    made = sum(lengths[i] * base[i] for i in others)
    far = np.iinfo(np.int32).max // 4
    least = np.full(size, far, np.int32)
    least[0] = 0
    changes, kept, wanted = _changes(others, lengths, base, counts, size), [], (budget - made) % size
    block = max(_BLOCK, isqrt(len(changes)))
    for at in range(0, len(changes), block):
        if least[wanted] < far and int(least[wanted]) * max(lengths) < min(made - low, budget - made):
            changes = changes[:at]
            break
        kept.append(least)
        for change in changes[at : at + block]:
            least, _ = _cheaper(least, change)
    missed = (wanted - np.arange(size)) % size
    at = int(np.argmin(np.where(least < far, missed, size)))
    left, take = int(missed[at]), list(base)
    for number in range(len(kept) - 1, -1, -1):  # blocks are run again for their choices, so that few are held
        least, part, marks = kept[number], changes[number * block : (number + 1) * block], []
        for change in part:
            least, used = _cheaper(least, change)
            marks.append(used)
        for change, used in zip(reversed(part), reversed(marks), strict=True):
            if used[at]:
                take[change[0]] += change[1]
                at = (at - change[2]) % size
    made = sum(lengths[i] * take[i] for i in others)
    take[p] = (budget - made - left) // size
    if 0 <= take[p] <= counts[p]:
        return left, take, True
    take = list(base)
    take[p] = max(0, min(counts[p], (budget - sum(lengths[i] * base[i] for i in others)) // size))
    missed = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    return missed, take, missed == left


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length (at least 1) to take so that their sum is the largest that isn't above budget."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    unit = gcd(*lengths)
    lengths, budget = [n // unit for n in lengths], budget // unit
    longest = max(lengths)
    for wider in WIDER:
        rest = MARGIN * wider * longest
        if rest >= budget or rest > CELLS:
            break
        missed, take = _filled(lengths, counts, _set_aside(lengths, counts, budget, rest), budget)
        if not missed:
            return take
    if budget <= CELLS:
        return _filled(lengths, counts, [0] * len(lengths), budget)[1]
    best: tuple[int, list[int]] | None = None
    for p in sorted(range(len(lengths)), key=lambda i: (-counts[i], lengths[i]))[:PIVOTS]:
        missed, take, proven = _by_remainders(p, lengths, counts, budget)
        if proven:
            return take
        if best is None or missed < best[0]:
            best = missed, take
    if (2 * longest + 2) * longest <= CELLS:
        return _near_vertex(lengths, counts, budget)
    return best[1]


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken, copies) for each row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), _size(text_col).alias("size"), _hash(id_col, text_col, seed).alias("h"))
    return _mix(rows, weights, cap).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))


def _size(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _named(sized: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """sized with s (the source's place), source_size, target, whole and budget instead of source."""
    spark = sized.sparkSession
    found = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    if found.count() <= MAX_SOURCES:
        rows = sorted(found.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        aims = targets([r["source_size"] for r in rows], weights, cap)
        weighed = spark.createDataFrame([(i, r["source"], r["source_size"], aim) for i, (r, aim) in enumerate(zip(rows, aims, strict=True))], "s long, source string, source_size long, target double")
        sources = F.broadcast(_planned(weighed, cap))  # at most MAX_SOURCES rows
        return sized.join(sources, sized.source.eqNullSafe(sources.source)).drop("source")
    sources = _planned(_weighed(found, weights, cap), cap)
    # a source may hold a third of all rows: they meet it in _SOURCE_SALTS places
    spread = sources.withColumn("salt", F.explode(F.array(*map(F.lit, range(_SOURCE_SALTS))))).withColumnRenamed("source", "name")
    salted = sized.withColumn("salt", F.pmod("h", F.lit(_SOURCE_SALTS)).cast("int"))
    return salted.join(spread, (salted.salt == spread.salt) & salted.source.eqNullSafe(spread["name"])).drop("salt", "name", "source")


def _planned(weighed: DataFrame, cap: int) -> DataFrame:
    """weighed with whole, how often all documents are taken, and budget, the words beyond that."""
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")).cast("int"))).otherwise(F.lit(0))
    return weighed.withColumn("whole", whole).withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))


def _weighed(found: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """(s, source, source_size, target) of any number of sources: places by a range sort, targets by rounds of aggregates.

    What comes to the driver is a count for each partition, and for each weight a count and a sum in each round."""
    spark, kinds = found.sparkSession, len(weights)
    order = F.asc_nulls_last("source")
    placed = found.repartitionByRange(order).sortWithinPartitions(order).select("source", "source_size", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    placed = staged(placed, "ordered-sources")
    first, before = [], 0
    for r in sorted(placed.groupBy("p").agg(F.count("*").alias("n")).collect()):
        first.append((r["p"], before))
        before += r["n"]
    numbered = placed.join(F.broadcast(spark.createDataFrame(first, "p int, before long")), "p").select((F.col("before") + F.col("i")).alias("s"), "source", "source_size")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % kinds + 1).cast("int"))
    rows = staged(numbered.withColumn("w", weight), "weighed-sources")
    every = rows.agg(F.sum("source_size").alias("words")).first()["words"]
    of = {r["w"]: r["n"] for r in rows.groupBy("w").agg(F.count("*").alias("n")).collect()}
    left, share, over, known = float(every), sum(w * n for w, n in of.items()), F.lit(False), 0
    while share:
        over = F.lit(left) * F.col("w") / F.lit(share) > F.lit(cap) * F.col("source_size")
        at = rows.where(over).groupBy("w").agg(F.count("*").alias("n"), F.sum("source_size").alias("words")).collect()
        if sum(r["n"] for r in at) == known:
            break
        known = sum(r["n"] for r in at)
        left, share = float(every - cap * sum(r["words"] for r in at)), sum(w * n for w, n in of.items()) - sum(r["w"] * r["n"] for r in at)
    free = F.lit(left) * F.col("w") / F.lit(share) if share else F.lit(0.0)
    return rows.select("s", "source", "source_size", F.when(over, (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(free).alias("target"))


def _mix(rows: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    named = _named(staged(rows, "sizes"), weights, cap)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, budget, lengths in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                lengths.sort(key=lambda x: x["size"])
                extra = fit([x["size"] for x in lengths], [x["n"] for x in lengths], budget)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(extra), pa.int64()), pa.array([x["size"] for x in lengths], pa.int64()), pa.array(extra, pa.int64())], names=["s", "size", "extra"])

    # one entry for each exact length of a source, whatever the number of documents
    histogram = named.where("size > 0 and budget > 0").groupBy("s", "size", "budget").agg(F.count("*").alias("n"))
    lists = histogram.groupBy("s", "budget").agg(F.collect_list(F.struct("size", "n")).alias("lengths"))
    chosen = lists.mapInArrow(choose, "s long, size long, extra long").where("extra > 0")

    # rank within (source, length), dealt over hash ranges so that a hot pair of them is not one group
    salted = named.withColumn("salt", F.shiftrightunsigned("h", 64 - _SALT_BITS))
    by = ["s", "size", "salt"]
    earlier = Window.partitionBy("s", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    kept = [c for c in ("file", "row") if c in rows.columns]
    ranked = salted.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("h", "id", *kept)))
    out = ranked.join(base, by).join(chosen, ["s", "size"], "left")
    extra = F.when(F.col("base") + F.col("at") <= F.coalesce("extra", F.lit(0)), 1).otherwise(0)
    return out.select(*kept, "id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0).cast("long").alias("copies"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, with exactly their columns.

    A row is told from others like it by its place in its file, so docs should come from Parquet; other tables are written first."""
    docs, at = in_files(docs), place()
    slim = docs.select(*at, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), _size(text_col).alias("size"), _hash(id_col, text_col, seed).alias("h"))
    taken = _mix(slim, weights, cap).where("copies > 0 or size = 0").select(F.col("file").alias("_f"), F.col("row").alias("_r"), F.greatest("copies", F.lit(1)).cast("int").alias("_n"))
    whole = docs.select(at[0].alias("_f"), at[1].alias("_r"), F.struct(*docs.columns).alias("_doc"))
    return whole.join(taken, ["_f", "_r"]).select(F.explode(F.array_repeat("_doc", F.col("_n"))).alias("_doc")).select("_doc.*")

