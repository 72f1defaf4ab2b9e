"""Continuous sort-reduce over an append-only folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from basalt.functions.reducers import reducer


def read_appends(spark: SparkSession, path: str, schema: StructType, *, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def reduce_stream(stream: DataFrame, key: Column, value: Column, name: str = "add") -> DataFrame:
    """(key, value) kept up to date: the reducer's state lives in the state store, one row for each key."""
    return stream.select(key.alias("key"), value.alias("value")).groupBy("key").agg(reducer(name, F.col("value")).alias("value"))


def windowed_reduce(stream: DataFrame, time: str, key: Column, value: Column, *, size: str, late: str, name: str = "add") -> DataFrame:
    """(start, key, value) by tumbling windows; windows close once the watermark has passed them."""
    marked = stream.withWatermark(time, late)
    grouped = marked.groupBy(F.window(time, size).alias("w"), key.alias("key")).agg(reducer(name, value).alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "key", "value")


def start(reduced: DataFrame, path: str, checkpoint: str, *, mode: str = "update") -> StreamingQuery:
    """Write each round's changed keys below path/round=n; a round that is run again replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/round={n}")

    return reduced.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
