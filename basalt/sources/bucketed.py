"""Tables below a path, dealt into buckets by one column and sorted by it.

Joins and aggregates by that column read them where they lie, and filters on it read only the buckets (and row groups) that can hold the values. Spark knows
buckets from its catalog only, so an entry is made while a table is written or opened and dropped again at once; the DataFrame keeps what it needs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from basalt.session import width


def write(df: DataFrame, path: str, by: str, buckets: int, *, dealt: bool = False) -> DataFrame:
    """Write df to a new path and open it. dealt: df is dealt by that column already, into as many partitions as the session has for exchanges."""
    if not dealt or buckets != width(df.sparkSession):
        df = df.repartition(buckets, by)
    name = f"basalt_{uuid.uuid4().hex}"
    try:
        df.write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
        return df.sparkSession.table(name)
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def open_table(spark: SparkSession, path: str, schema: StructType, by: str, buckets: int) -> DataFrame:
    """A table that write() left at path."""
    name = f"basalt_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    try:
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {buckets} BUCKETS LOCATION '{path}'")
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
