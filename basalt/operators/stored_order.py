"""Whether files are sorted, as they lie.

Each task goes once over its ranges of files and sums each up: rows, first and last key, descents and ties between neighbours. These summaries are
associative; they are joined within each file in the order of ranges, then over files in the order of their paths. No row is moved, only a summary for each range.

Keys compare by the columns in order, null before all else; NaN is above all other numbers, and equal to itself.

Defined cases: no files or no rows give zeros; empty files in between are passed over; rows read from anything but files are an error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _less(a: pa.Array, b: pa.Array) -> pa.Array:
    """a < b with null first and NaN last."""
    less = pc.fill_null(pc.less(a, b), False)
    if pa.types.is_floating(a.type):
        nan = lambda x: pc.fill_null(pc.is_nan(x), False)
        less = pc.or_(less, pc.and_(pc.and_(pc.invert(nan(a)), pc.is_valid(a)), nan(b)))
    return pc.or_(less, pc.and_(pc.is_null(a), pc.is_valid(b)))


def _compare(before: list[pa.Array], after: list[pa.Array]) -> tuple[int, int]:
    """(descents, ties) of the rows after against those before."""
    descends = pa.array(np.zeros(len(after[0]), bool))
    same = pc.invert(descends)
    for a, b in zip(before, after, strict=True):
        up, down = _less(a, b), _less(b, a)
        descends = pc.or_(descends, pc.and_(same, down))
        same = pc.and_(same, pc.invert(pc.or_(up, down)))
    return pc.sum(descends).as_py() or 0, pc.sum(same).as_py() or 0


def ranges(rows: DataFrame, *keys: str) -> DataFrame:
    """(file, start, n, first, last, descents, ties) of each range of a file that a task read; first and last are structs of the keys."""
    picked = rows.select("_metadata.file_path", "_metadata.file_block_start", *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    ends = StructType([StructField(f"k{i}", rows.schema[k].dataType) for i, k in enumerate(keys)])
    schema = StructType([StructField("file", StringType()), StructField("start", LongType()), StructField("n", LongType()), StructField("first", ends), StructField("last", ends), StructField("descents", LongType()), StructField("ties", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, told, last = None, None, None

        def done() -> pa.RecordBatch:
            names = [f"k{i}" for i in range(len(keys))]
            ends = [pa.StructArray.from_arrays(x, names=names) for x in (told[1], last)]
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([told[0]], pa.int64()), *ends, pa.array([told[2]], pa.int64()), pa.array([told[3]], pa.int64())], names=schema.names)

        for batch in batches:
            whole = pa.Table.from_batches([batch])
            begin = 0
            while begin < len(whole):
                here = (whole[0][begin].as_py(), whole[1][begin].as_py())
                other = pc.or_(pc.not_equal(whole[0].slice(begin), here[0]), pc.not_equal(whole[1].slice(begin), here[1]))
                end = pc.index(other, True).as_py()
                end = len(whole) if end < 0 else begin + end
                columns = [c.slice(begin, end - begin).combine_chunks() for c in whole.columns[2:]]
                if here != at:
                    if told:
                        yield done()
                    at, told, last = here, [0, [c.slice(0, 1) for c in columns], 0, 0], None
                before = [pa.concat_arrays([x, c.slice(0, len(c) - 1)]) for x, c in zip(last, columns, strict=True)] if last else [c.slice(0, len(c) - 1) for c in columns]
                descents, ties = _compare(before, columns if last else [c.slice(1) for c in columns])
                told[0], told[2], told[3] = told[0] + end - begin, told[2] + descents, told[3] + ties
                last, begin = [c.slice(len(c) - 1) for c in columns], end
        if told:
            yield done()

    return picked.mapInArrow(run, schema)


def _joined(parts: DataFrame, by: list[str], *order: str) -> DataFrame:
    """Summaries of consecutive parts as one for each by."""
    before = F.lag("last").over(Window.partitionBy(*by).orderBy(*order))
    met = parts.withColumn("before", before)
    n = len(parts.schema["first"].dataType)

    def compared(a: str, b: str) -> tuple[Column, Column]:
        """(less, same) where there is something before."""
        out, same = F.lit(False), F.lit(True)
        for i in range(n):
            x, y = F.col(f"{a}.k{i}"), F.col(f"{b}.k{i}")
            less = (x.isNull() & y.isNotNull()) | F.coalesce(x < y, F.lit(False))
            out, same = out | (same & less), same & x.eqNullSafe(y)
        return F.col("before").isNotNull() & out, F.col("before").isNotNull() & same

    down, tie = compared("first", "before")
    place = F.struct(*order)
    return met.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min_by("first", place).alias("first"), F.max_by("last", place).alias("last"),
        F.sum(F.col("descents") + down.cast("bigint")).alias("descents"), F.sum(F.col("ties") + tie.cast("bigint")).alias("ties"),
    )


def by_file(rows: DataFrame, *keys: str) -> DataFrame:
    """(file, n_rows, n_descents, n_ties): each file by itself."""
    return _joined(ranges(rows, *keys), ["file"], "start").select("file", F.col("n").alias("n_rows"), F.col("descents").alias("n_descents"), F.col("ties").alias("n_ties"))


def report(rows: DataFrame, *keys: str) -> DataFrame:
    """One row (n_rows, n_descents, n_ties) for all files one after the other; a row for each file meets in one window."""
    files = _joined(ranges(rows, *keys), ["file"], "start")
    every = _joined(files.withColumn("all", F.lit(0)), ["all"], "file").select("n", "descents", "ties")
    none = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return every.agg(none("n").alias("n_rows"), none("descents").alias("n_descents"), none("ties").alias("n_ties"))


def is_sorted(rows: DataFrame, *keys: str, strict: bool = False) -> bool:
    """Whether keys ascend over all files; strict allows no ties."""
    row = report(rows, *keys).first()
    return row["n_descents"] == 0 and not (strict and row["n_ties"])
