"""Session helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []
ARROW_ROWS, _ARROW = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that they can import it wherever they run.

    Where the session leaves the rows of an Arrow batch at Spark's default, they are lowered: texts are long, and a batch is held whole."""
    if spark.conf.get(_ARROW) == "10000":
        spark.conf.set(_ARROW, ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="basalt-code-"), "basalt_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where that is unset and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="basalt-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's Python ends."""
    folder = f"{shared_root(spark)}/basalt-{uuid.uuid4().hex[:12]}"
    _made.append((spark, folder))
    return f"{folder}/{name}"


@atexit.register
def _clean() -> None:
    from basalt.sources import files

    for spark, folder in _made:
        try:
            files.delete(spark, folder)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder. How it is dealt over partitions stays known."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """The number of partitions that exchanges have here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
