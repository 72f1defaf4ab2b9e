"""Tables written to the folder that driver and executors share.

Lineage is cut with written Parquet, never with local checkpoints, so a lost executor costs only the tasks it ran."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder is set only where it is unset, as in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="basalt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_root(spark)}/basalt-{uuid.uuid4().hex[:12]}/{name}"
    _made.append((spark, path.rpartition("/")[0]))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path with the cluster's own file system, whichever that is."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    fs, p = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written under another name, then renamed."""
    fs, p = _file_system(spark, path)
    draft = p.suffix(".draft-" + uuid.uuid4().hex[:8])
    stream = fs.create(draft)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if not fs.rename(draft, p):
        raise OSError(f"{path} exists already")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, with its schema kept."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_files(docs: DataFrame) -> DataFrame:
    """docs itself where each row has a place of its own in the files it is read from, else a written copy.

    Only scans of distinct files, perhaps projected and filtered, count: joins, unions and generators repeat their rows' places."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    bare = "_metadata" not in docs.columns and plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
    if bare:
        roots = plan.relation().location().rootPaths()
        bare = roots.distinct().size() == roots.size()
    if bare:
        try:
            docs.select("_metadata.row_index", "_metadata.file_path").schema  # noqa: B018
        except AnalysisException:  # of another format than Parquet
            bare = False
    return docs if bare else staged(docs, "rows")


def place() -> list[Column]:
    """What tells a row of in_files() from all others, even from its copies."""
    return [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return
