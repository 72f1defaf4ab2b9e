"""Edge lists as text; binary files are in binary_edges.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def parse_text(lines: DataFrame) -> DataFrame:
    """(src, dst) of lines 'from<spaces or tabs>to'; lines that don't parse are left out."""
    pair = F.split(F.trim("line"), "[ \\t]+")
    return lines.select(F.get(pair, F.lit(0)).try_cast("bigint").alias("src"), F.get(pair, F.lit(1)).try_cast("bigint").alias("dst")).where("src is not null and dst is not null")


def format_text(edges: DataFrame, *, dedup: bool = False) -> DataFrame:
    """(line): both ids right-aligned in ten places, with a tab between."""
    rows = edges.select("src", "dst").distinct() if dedup else edges
    return rows.select(F.format_string("%10d\t%10d", F.col("src").cast("bigint"), F.col("dst").cast("bigint")).alias("line"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_text(spark.read.text(path).withColumnRenamed("value", "line"))


def write_text(edges: DataFrame, path: str, *, dedup: bool = False) -> None:
    format_text(edges, dedup=dedup).write.mode("overwrite").text(path)


def observed(edges: DataFrame, name: str = "edges") -> tuple[DataFrame, Observation]:
    """edges, and an observation that holds n_edges and max_id once an action has run."""
    seen = Observation(name)
    return edges.observe(seen, F.count("*").alias("n_edges"), F.max(F.greatest("src", "dst")).alias("max_id")), seen
