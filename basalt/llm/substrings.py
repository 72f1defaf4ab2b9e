"""Substring dedup with a log-structured fingerprint index.

A window of WINDOW words holds WINDOW - GRAM + 1 runs of GRAM words; the run with the smallest hash (of equal ones the rightmost) is its anchor. Which
run that is depends on the window's words alone, so equal windows have equal anchors: two windows whose anchors' hashes differ are different, and an
index of anchor hashes, a fifth of the words or fewer in practice, misses no repeat. The index is a folder that driver and executors share. It holds

  * runs: immutable tables of anchor hashes, bucketed and sorted by hash, one row for each hash of a document, marked if the document has it at more places;
  * segments: the documents of each batch, bucketed by their key, against which repeats are verified;
  * manifests: numbered JSON files, each a whole list of runs and of segments with their first and last keys; the last one
    counts, so a batch that fails half-way leaves the index as it was.

add() first compacts levels that hold FANOUT runs, each into one run of the next level, then writes the new batch as a segment and a run and merge-joins
that run, without a shuffle, with itself and with every older run. Rows of either side whose hash is shared are candidates. They are verified before
add() returns: the documents that have candidates, old and new (only segments in whose range of keys candidates lie are read), form the windows
under their shared anchors, and a window is known by the 128-bit BLAKE2b digest of its words. A task that meets a digest again after an earlier place knows that window for a repeat and sends it on as part of a span, with no more
comparison; it remembers SEEN digests or more. So a passage that a third of all documents hold arrives once for each task. A window function over what
is left tells the first of all. Words covered by a window that is not the first go.

Defined cases: a null text counts as empty; null ids come first in the order (before all but the smallest long); rows of one id with other texts follow by a
SHA-256 of their text; rows alike in id and text are one document, each with the same result; texts shorter than WINDOW words stay whole; equal windows
in one document count from the second on; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import atexit
import gc
import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.llm.store import delete, listed, new_dir, read_text, staged, write_text
from basalt.llm.textops import Chunk, chunks, covered, gather, mix

WINDOW, GRAM, FANOUT, BATCHES = 20, 8, 2, 3
BUCKET_CHARS, MIN_BUCKETS, MAX_BUCKETS = 25_000_000, 8, 50_000
SEEN = 100_000
_CHUNK = 1 << 19
_NO_ID = -(1 << 63)
_KEYS = ("id", "part")


def anchors(c: Chunk, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of all windows, the place of each one's anchor, hash of the run of words at each place)."""
    at = c.windows(window)
    hashes = np.zeros(len(c.starts), np.uint64)
    grams = c.windows(gram)
    hashes[grams] = c.window_hashes(grams, gram)
    best, where = hashes[at], at.copy()
    for j in range(1, window - gram + 1):
        h = hashes[at + j]
        less = h <= best
        best[less] = h[less]
        where[less] = at[less] + j
    return at, where, hashes


def _release(spark: SparkSession) -> None:
    """Let the driver forget finished shuffles, so that executors delete their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _anchor_rows(rows: DataFrame) -> DataFrame:
    """(h, id, part, at, many): each distinct anchor hash of each document at its first place; many if it has more places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in chunks(batch.column(2)):
                _, where, hashes = anchors(c)
                place = np.unique(where)
                doc = c.word_doc[place]
                order = np.lexsort((place, hashes[place], doc))
                place, doc = place[order], doc[order]
                first = np.ones(len(place), bool)
                first[1:] = (doc[1:] != doc[:-1]) | (hashes[place[1:]] != hashes[place[:-1]])
                many = np.append(~first[1:], False)[first]
                place, doc = place[first], doc[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[place].view(np.int64)), pa.array(ids[c.first + doc]), pa.array(parts[c.first + doc]), pa.array((place - c.word_offsets[doc]).astype(np.int32)), pa.array(many)],
                    names=["h", "id", "part", "at", "many"],
                )

    return rows.select("id", "part", "text").mapInArrow(run, "h long, id long, part long, at int, many boolean")


class _Seen:
    """The smallest place met of each digest; digests that don't come again while SEEN others do are forgotten."""

    def __init__(self) -> None:
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def repeats(self, digest: bytes, place: tuple) -> bool:
        """Whether a smaller place was met; else place is now the smallest."""
        got = self.young.get(digest) or self.old.get(digest)
        if got is not None and got < place:
            self.young[digest] = got
            return True
        self.young[digest] = place
        if len(self.young) >= SEEN:
            self.old, self.young = self.young, {}
        return False


def _windows(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(d1, d2, id, part, at, known): windows under shared anchors by digest; known lists [first, end) of windows that are known to be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            ids, parts, shared = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for c in chunks(batch.column(2), _CHUNK):
                at, where, hashes = anchors(c)
                # a document lists one place for each shared hash; its other places with that hash count too
                mine = shared.slice(c.first, c.last - c.first)
                sizes = np.diff(mine.offsets.to_numpy())
                listed = mine.flatten().to_numpy() + np.repeat(c.word_offsets[:-1], sizes)
                salt = mix(np.arange(c.last - c.first, dtype=np.uint64))
                keys = mix(hashes ^ salt[c.word_doc])
                at = at[np.isin(keys[where], keys[listed])]
                doc = c.word_doc[at]
                i, p, place = ids[c.first + doc], parts[c.first + doc], at - c.word_offsets[doc]
                line, begin, end = c.spaced()
                bounds = zip(begin[at].tolist(), end[at + WINDOW - 1].tolist(), i.tolist(), p.tolist(), place.tolist(), strict=True)
                again, digests = np.zeros(len(at), bool), []
                for j, (a, b, *mark) in enumerate(bounds):
                    digest = hashlib.blake2b(line[a:b], digest_size=16).digest()
                    if seen.repeats(digest, tuple(mark)):
                        again[j] = True
                    else:
                        digests.append(digest)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield _rows(halves[:, 0], halves[:, 1], i[~again], p[~again], place[~again], None)
                if again.any():
                    first, stop = _ranges(doc[again], place[again])
                    owner = doc[again][first]
                    pairs = np.stack([place[again][first], place[again][stop - 1] + 1], axis=1)
                    new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                    lists = pa.ListArray.from_arrays(pa.array((2 * np.append(new, len(owner))).astype(np.int32)), pa.array(pairs.ravel().astype(np.int32)))
                    who = c.first + owner[new]
                    # dealt by their own document: nothing is left to compare
                    yield _rows(mix(ids[who].view(np.uint64) ^ mix(parts[who].view(np.uint64))).view(np.int64), np.zeros(len(who), np.int64), ids[who], parts[who], None, lists)

    lists = candidates.groupBy(*_KEYS).agg(F.collect_set("at").alias("shared"))  # at most a document's own places
    joined = texts.join(lists, list(_KEYS)).select("id", "part", "text", "shared")
    return joined.mapInArrow(run, "d1 long, d2 long, id long, part long, at int, known array<int>")


def _ranges(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[first, stop) of the entries whose places follow each other in one document."""
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    return np.append(0, cut), np.append(cut, len(doc))


def _rows(d1, d2, i, p, at, known) -> pa.RecordBatch:
    n = len(d1)
    at = pa.nulls(n, pa.int32()) if at is None else pa.array(at.astype(np.int32))
    known = pa.nulls(n, pa.list_(pa.int32())) if known is None else known
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(d1)), pa.array(np.ascontiguousarray(d2)), pa.array(i), pa.array(p), at, known], names=["d1", "d2", "id", "part", "at", "known"])


class FingerprintIndex:
    """An index below path: opened where it exists, else begun with so many buckets.

    Its tables are registered in a database of its own, which close() drops; their files stay until drop()."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = MIN_BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.database = f"basalt_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.path}/database'")
        atexit.register(self.close)
        manifests = sorted(x for x in listed(spark, self.path) if x.startswith("manifest-"))
        self.version = len(manifests)
        if manifests:
            state = json.loads(read_text(spark, f"{self.path}/{manifests[-1]}"))
            self.version = int(manifests[-1][9:18])
        else:
            state = {"buckets": buckets, "levels": [[]], "segments": [], "ends": {}, "last": None}
        self.buckets, self.levels, self.segments, self.ends, self.last = (state[k] for k in ("buckets", "levels", "segments", "ends", "last"))
        for name in (x for level in self.levels for x in level):
            self._register(name, "h long, id long, part long, at int, many boolean", ("h",))
        for name in self.segments:
            self._register(name, "id long, part long, text string", _KEYS)

    def _register(self, name: str, schema: str, by: tuple[str, ...]) -> None:
        keys = ", ".join(by)
        self.spark.sql(f"CREATE TABLE {self.database}.{name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def _write(self, rows: DataFrame, kind: str, by: tuple[str, ...]) -> str:
        name = f"{kind}_{uuid.uuid4().hex[:12]}"
        dealt = rows.repartition(self.buckets, *by).write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}")
        dealt.bucketBy(self.buckets, *by).sortBy(*by).saveAsTable(f"{self.database}.{name}")
        return name

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    def _save(self) -> None:
        """The index as it is now is the next manifest."""
        self.version += 1
        state = {"buckets": self.buckets, "levels": self.levels, "segments": self.segments, "ends": self.ends, "last": self.last}
        write_text(self.spark, f"{self.path}/manifest-{self.version:09d}", json.dumps(state))

    def add(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Add documents (id, part, text), distinct and all after the earlier ones: the name of their segment, and (id, part, known, places) of their repeats.

        A document's places are first words of windows that stand earlier too, in this batch or any before; known lists [first, end) of more of them."""
        self._compact()
        older = [x for level in self.levels for x in level]
        segment = self._write(rows, "segment", _KEYS)
        key = F.struct("id", "part")
        ends = self.table(segment).agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
        if ends["low"] and self.last and tuple(self.last) >= tuple(ends["low"]):
            raise ValueError("a batch must follow all earlier ones in the order of its keys")
        made = self._write(_anchor_rows(self.table(segment)), "run", ("h",))
        _release(self.spark)
        candidates = self._candidates(self.table(made), older)
        repeats = self._verified(segment, candidates)
        self.levels[0].append(made)
        self.segments.append(segment)
        if ends["low"]:
            self.ends[segment], self.last = [list(ends["low"]), list(ends["high"])], list(ends["high"])
        self._save()
        _release(self.spark)
        return segment, repeats

    def _candidates(self, new: DataFrame, older: list[str]) -> list[DataFrame]:
        """(id, part, at) of the rows whose hash is shared now: of the new run, then of the older ones."""
        hashes = new.groupBy("h").agg(F.count("*").alias("n"))
        mine = new.where("many").select(*_KEYS, "at").union(new.join(hashes.where("n > 1").select("h"), "h", "left_semi").select(*_KEYS, "at"))
        theirs = None
        for run in map(self.table, older):
            mine = mine.union(new.join(run.select("h"), "h", "left_semi").select(*_KEYS, "at"))
            hit = run.join(hashes.select("h"), "h", "left_semi").select(*_KEYS, "at")
            theirs = hit if theirs is None else theirs.union(hit)
        return [staged(x, "candidates") for x in (mine, theirs) if x is not None]

    def _verified(self, segment: str, candidates: list[DataFrame]) -> DataFrame:
        found = _windows(self.table(segment), candidates[0]).withColumn("new", F.lit(True))
        for name, low, high in self._named(candidates[1]) if len(candidates) > 1 else []:
            texts = self.table(name).where(F.col("id").between(low, high))  # segments are sorted by id, so row groups outside aren't read
            found = found.union(_windows(texts, candidates[1]).where("known is null").withColumn("new", F.lit(False)))
        first = F.min(F.struct("id", "part", "at")).over(Window.partitionBy("d1", "d2", F.isnotnull("known")))
        later = found.withColumn("first", first).where(F.col("new") & (F.col("known").isNotNull() | (F.col("first") != F.struct("id", "part", "at"))))
        lists = later.groupBy(*_KEYS).agg(F.flatten(F.collect_list("known")).alias("known"), F.collect_list("at").alias("places"))  # at most a document's own windows
        out = staged(lists, "repeats")
        for x in candidates:
            delete(self.spark, x.inputFiles()[0].rpartition("/")[0])
        return out

    def _named(self, candidates: DataFrame) -> list[tuple[str, int, int]]:
        """(segment, least, largest id) of the segments that hold candidates; segments follow each other in the order of keys."""
        if not self.ends:
            return []
        key, columns = F.struct("id", "part"), []
        for i, (low, high) in enumerate(self.ends.values()):
            inside = key.between(_key(low), _key(high))
            columns += [F.min(F.when(inside, F.col("id"))).alias(f"low{i}"), F.max(F.when(inside, F.col("id"))).alias(f"high{i}")]
        seen = candidates.agg(*columns).first()
        return [(name, seen[f"low{i}"], seen[f"high{i}"]) for i, name in enumerate(self.ends) if seen[f"low{i}"] is not None]

    def _compact(self) -> None:
        """Merge the runs of each full level into one run of the next."""
        done = []
        for level in range(len(self.levels) + 1):
            if level >= len(self.levels) or len(self.levels[level]) < FANOUT:
                continue
            full, self.levels[level] = self.levels[level], []
            rows = self.table(full[0])
            for name in full[1:]:
                rows = rows.union(self.table(name))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(rows, "run", ("h",)))
            done += full
        if done:
            self._save()
            self._drop(done)
            _release(self.spark)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{name}")
            delete(self.spark, f"{self.path}/{name}")

    def drop_runs(self) -> None:
        """Delete all runs; the segments stay. The index can't be added to any more."""
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]

    def close(self) -> None:
        """Take the tables out of the catalog; the files stay."""
        try:
            self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def _key(pair: list[int]) -> Column:
    return F.struct(*(F.lit(x).cast("long").alias(name) for x, name in zip(pair, _KEYS, strict=True)))


def _without(texts: DataFrame, repeats: DataFrame) -> DataFrame:
    """(id, part, n_words, n_removed, kept_text, removed): removed lists [first, end) words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                docs = c.last - c.first
                known, places = (batch.column(k).slice(c.first, docs) for k in (3, 4))
                at = places.flatten().to_numpy() + np.repeat(c.word_offsets[:-1], np.diff(places.offsets.to_numpy()))
                spans = (known.flatten().to_numpy() + np.repeat(c.word_offsets[:-1], np.diff(known.offsets.to_numpy()))).reshape(-1, 2)
                at = np.unique(np.concatenate([at, gather(spans[:, 0], spans[:, 1] - spans[:, 0])]))
                gone = covered(len(c.starts), at, WINDOW)
                keep = ~gone
                starts, length = c.starts[keep], (c.ends - c.starts)[keep]
                spaced = np.append(c.data, np.uint8(32))[gather(starts, length + 1)]
                ends = np.cumsum(length + 1)
                spaced[ends - 1] = 32
                raw = spaced.tobytes()
                per = c.per_text(keep, c.word_offsets)
                last = np.cumsum(per)
                bounds = np.concatenate([[0], ends])
                texts = [raw[bounds[b - n] : max(bounds[b - n], bounds[b] - 1)].decode("utf-8", "replace") for b, n in zip(last.tolist(), per.tolist(), strict=True)]
                edge = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1] & (c.word_doc[1:] == c.word_doc[:-1])]))
                stop = np.flatnonzero(gone & ~np.concatenate([gone[1:] & (c.word_doc[1:] == c.word_doc[:-1]), [False]])) + 1
                doc = c.word_doc[edge]
                flat = np.stack([edge - c.word_offsets[doc], stop - c.word_offsets[doc]], axis=1).ravel()
                pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2, dtype=np.int32)), pa.array(flat))
                removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)), pairs)
                part = batch.slice(c.first, docs)
                words = np.diff(c.word_offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words), pa.array(words - per), pa.array(texts, pa.string()), removed], names=["id", "part", "n_words", "n_removed", "kept_text", "removed"])

    none = F.array().cast("array<int>")
    joined = texts.join(repeats, list(_KEYS), "left").select("id", "part", "text", F.coalesce("known", none).alias("known"), F.coalesce("places", none).alias("places"))
    return joined.mapInArrow(run, "id long, part long, n_words long, n_removed long, kept_text string, removed array<array<long>>")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """id, n_words, n_removed, kept_text, removed for each row of docs. The documents are added to an index in batches of ascending ids."""
    spark = docs.sparkSession
    rows, copies = _keyed(docs.select(F.col(id_col).cast("long").alias("given"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    facts = rows.agg(F.sum(F.length("text")).alias("chars"), F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000).alias("cuts")).first()
    buckets = max(MIN_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_BUCKETS, (facts["chars"] or 0) // BUCKET_CHARS))
    index = FingerprintIndex(spark, new_dir(spark, "index"), buckets)
    cuts, out = sorted(set(facts["cuts"] or [])), None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = rows if low is None else rows.where(F.col("id") > low)
        segment, repeats = index.add(batch if high is None else batch.where(F.col("id") <= high))
        done = _without(index.table(segment), repeats)
        out = done if out is None else out.union(done)
    index.drop_runs()
    if copies is not None:
        out = out.join(copies, list(_KEYS), "left").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1).cast("long"))))).drop("n", "_n")
    return out.select(F.when(F.col("part").bitwiseAND(F.lit(1)) == 0, F.col("id")).alias(id_col), "n_words", "n_removed", "kept_text", "removed")


def _text_key(text: str) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _keyed(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, part, text), distinct documents with keys that are never null, and (id, part, n) where rows stand for more.

    A null id is the smallest long, with an odd part; part tells the different texts of one id."""
    part = F.when(F.col("given").isNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = rows.select(F.coalesce("given", F.lit(_NO_ID)).alias("id"), part.alias("part"), "text")
    prints = rows.select(*_KEYS, _text_key("text").alias("k"))
    often = staged(prints.groupBy(*_KEYS).agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n")).where("n > 1"), "repeated-ids")
    if often.isEmpty():
        return rows, None
    unlike = often.where("a <> b").select(*_KEYS, F.lit(True).alias("unlike"))
    parted = rows.join(unlike, list(_KEYS), "left").select("id", F.when(F.col("unlike"), F.col("part") + 2 * _text_key("text")).otherwise(F.col("part")).alias("part"), "text")
    once = parted.groupBy(*_KEYS).agg(F.min("text").alias("text"), F.count("*").alias("n"))
    kept = staged(once, "documents")
    return kept.select(*_KEYS, "text"), kept.where("n > 1").select(*_KEYS, "n")
