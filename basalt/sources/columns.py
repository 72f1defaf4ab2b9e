"""Delimited text to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.encoding import encode, rejected


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of text files."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def split_fields(lines: DataFrame, delimiter: str) -> Column:
    """Fields by position; empty ones stay in place, and a closing line end goes."""
    return F.split(F.regexp_replace("line", r"[\r\n]+$", ""), F.concat(F.lit("\\Q"), F.lit(delimiter), F.lit("\\E")), -1)


def column_encode(lines: DataFrame, delimiter: str, columns: dict[str, tuple[int, str]]) -> DataFrame:
    """Typed columns name -> (index, type code) of delimited lines. Fields that don't parse are null."""
    fields = split_fields(lines, delimiter)
    return lines.select(*(encode(F.get(fields, index), code).alias(name) for name, (index, code) in columns.items()))


def rejects(lines: DataFrame, delimiter: str, columns: dict[str, tuple[int, str]]) -> DataFrame:
    """One row: for each column, how many fields were there but didn't parse."""
    fields = split_fields(lines, delimiter)
    return lines.agg(*(F.count_if(rejected(F.get(fields, index), code)).alias(name) for name, (index, code) in columns.items()))


def append(df: DataFrame, path: str) -> None:
    """Add rows to a column table; readers see whole appends only."""
    df.write.mode("append").parquet(path)
