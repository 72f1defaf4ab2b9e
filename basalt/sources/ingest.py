"""Delimited text files to typed columns, with a table of the lines that were rejected, in one pass.

A line is rejected where a column's field is missing or doesn't parse as its type. One job writes both tables, told apart by a partition column, so the input is read
once: accepted rows with their typed columns, rejected lines as they are with their file, place and the columns at fault. A line's place is its number, from 0, in the
range of the file that one task read, and the byte at which that range starts; files that are read in one range have line numbers.

Defined cases: an empty line lacks its fields, so it is rejected; lines may be longer than any field; delimiters are taken literally; closing line ends go; an empty
folder gives two empty tables; columns are named by the caller and may be called anything."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from basalt.functions.encoding import encode
from basalt.plans.metrics import seen_count
from basalt.sources.columns import split_fields


@dataclass(frozen=True)
class Ingested:
    """accepted has the columns; rejected has (file, start, number, line, at_fault). n_lines is the sum of the two counts."""

    accepted: DataFrame
    rejected: DataFrame
    n_accepted: int
    n_rejected: int


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, start, number) of text files."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, 0
        for batch in batches:
            file, start = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
            change = np.flatnonzero((np.diff(file.indices.to_numpy()) != 0) | (np.diff(start) != 0)) + 1
            number = np.arange(len(start))
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(start)], strict=True):
                here = (batch.column(1)[a].as_py(), int(start[a])) if b > a else at
                seen = seen if here == at else 0
                at = here
                number[a:b] += seen - a
                seen += b - a
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(number)], names=["line", "file", "start", "number"])

    return lines.mapInArrow(run, "line string, file string, start bigint, number bigint")


def ingest(spark: SparkSession, path: str, into: str, delimiter: str, columns: dict[str, tuple[int, str]]) -> Ingested:
    """Read the files at path, write both tables below into, and return them; columns: name -> (index of the field, type code)."""
    lines = numbered_lines(spark, path)
    fields = split_fields(lines, delimiter)
    found = {name: F.get(fields, index) for name, (index, _) in columns.items()}
    values = {name: encode(found[name], code) for name, (_, code) in columns.items()}
    fault = F.array_compact(F.array(*(F.when(values[n].isNull(), F.lit(n)) for n in columns)))
    told = lines.select(*(values[n].alias(f"v{i}") for i, n in enumerate(columns)), "file", "start", "number", "line", fault.alias("at_fault"))
    bad, keep = F.size("at_fault") > 0, lambda c: F.when(F.size("at_fault") > 0, F.col(c)).alias(c)
    seen = Observation()
    rows = told.select(*(F.when(~bad, F.col(f"v{i}")).alias(f"v{i}") for i in range(len(columns))), *map(keep, ("file", "start", "number", "line", "at_fault")), bad.alias("rejected"))
    rows.observe(seen, F.count("*").alias("n"), F.count_if("rejected").alias("bad")).write.mode("errorifexists").partitionBy("rejected").parquet(into)
    n, n_bad = seen_count(seen), seen_count(seen, "bad")
    schema = StructType([*(f for f in rows.schema if f.name != "rejected"), StructField("rejected", rows.schema["rejected"].dataType)])
    stored = spark.read.schema(schema).parquet(into)
    accepted = stored.where("not rejected").select(*(F.col(f"v{i}").alias(n) for i, n in enumerate(columns)))
    return Ingested(accepted, stored.where("rejected").select("file", "start", "number", "line", "at_fault"), n - n_bad, n_bad)
