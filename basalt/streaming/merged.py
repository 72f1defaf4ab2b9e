"""A reduced table (key, value) kept current by a stream, without a state store.

Each micro-batch is reduced by key and written as a run; a manifest then names the runs that make the table, and the batch they reach to. Manifests are numbered and
never replaced, so a reader sees whole batches only, two writers can't both go on from one manifest, and a batch that is run again after a failure is passed over. Runs
are merged as soon as the newest ones hold as many rows as the one before them, so a row is written again a logarithmic number of times. Runs are bucketed by key, so
reading and merging can leave rows where they lie.

Files that the last KEEP manifests don't name are deleted, with older manifests; readers that are slower than that find their files gone and start again.

Defined cases: a null key is a key; null values count for nothing, as in the reducer; an empty batch moves the manifest only; a table without batches is
empty; rows that are repeated in the stream count each."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from basalt.functions.reducers import reducer
from basalt.session import width
from basalt.sources import bucketed, files

KEEP = 3
#: How partial results of a reducer are reduced further.
MERGES = {"add": "add", "multiply": "multiply", "min": "min", "max": "max", "count": "add"}


class MergedTable:
    def __init__(self, spark: SparkSession, path: str, name: str = "add", *, buckets: int | None = None):
        if name not in MERGES:
            raise ValueError(f"partial results of {name!r} can't be merged; one of {', '.join(MERGES)}")
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets or width(spark)

    def _versions(self) -> list[int]:
        return sorted(int(x[9:-5]) for x in files.listed(self.spark, self.path) if x.startswith("manifest-") and x.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        return json.loads(files.read_text(self.spark, f"{self.path}/manifest-{version}.json"))

    def manifest(self) -> dict:
        """version, batch (the last one merged, -1 if none) and runs, oldest first."""
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else {"version": 0, "batch": -1, "reducer": self.name, "buckets": self.buckets, "schema": None, "runs": []}

    def _open(self, told: dict, run: dict) -> DataFrame:
        return bucketed.open_table(self.spark, f"{self.path}/{run['name']}", StructType.fromJson(told["schema"]), "key", told["buckets"])

    def _write(self, rows: DataFrame, buckets: int) -> dict:
        name = f"run-{uuid.uuid4().hex[:12]}"
        n = bucketed.write(rows, f"{self.path}/{name}", "key", buckets).count()
        return {"name": name, "n": n}

    def _reduced(self, told: dict, runs: list[DataFrame]) -> DataFrame:
        rows = None
        for run in runs:
            # keys are distinct in a run; the aggregate keeps batches of columns out of the union (see runs.py)
            part = run.groupBy("key").agg(F.first("value").alias("value"))
            rows = part if rows is None else rows.unionByName(part)
        return rows.groupBy("key").agg(reducer(MERGES[told["reducer"]], F.col("value")).alias("value"))

    def merge(self, batch: DataFrame, batch_id: int) -> bool:
        """Add the rows (key, value) of a micro-batch; False where it is merged already."""
        told = self.manifest()
        if batch_id <= told["batch"]:
            return False
        if told["reducer"] != self.name:
            raise ValueError(f"{self.path} holds results of {told['reducer']!r}")
        rows = batch.groupBy("key").agg(reducer(self.name, F.col("value")).alias("value"))
        if told["schema"] is None:
            told["schema"] = rows.schema.jsonValue()
        new = self._write(rows, told["buckets"])
        runs = told["runs"] + ([new] if new["n"] else [])
        take = 1
        while take < len(runs) and new["n"] and sum(r["n"] for r in runs[-take:]) >= runs[-take - 1]["n"]:
            take += 1
        if take > 1:
            runs = [*runs[:-take], self._write(self._reduced(told, [self._open(told, r) for r in runs[-take:]]), told["buckets"])]
        told |= {"version": told["version"] + 1, "batch": batch_id, "runs": runs}
        files.write_text(self.spark, f"{self.path}/manifest-{told['version']}.json", json.dumps(told, indent=1))
        self._vacuum()
        return True

    def _vacuum(self) -> None:
        versions = self._versions()
        kept = {r["name"] for v in versions[-KEEP:] for r in self._manifest(v)["runs"]}
        for name in files.listed(self.spark, self.path):
            if name.startswith("run-") and name not in kept:
                files.delete(self.spark, f"{self.path}/{name}")
        for v in versions[:-KEEP]:
            files.delete(self.spark, f"{self.path}/manifest-{v}.json")

    def table(self) -> DataFrame | None:
        """(key, value) as of the last batch; None before there is one."""
        told = self.manifest()
        if not told["schema"]:
            return None
        if not told["runs"]:
            return self.spark.createDataFrame([], StructType.fromJson(told["schema"]))
        return self._reduced(told, [self._open(told, r) for r in told["runs"]])


def start(stream: DataFrame, table: MergedTable, checkpoint: str) -> StreamingQuery:
    """Merge what there is of a stream (key, value), batch by batch; started again on one checkpoint it goes on where it ended."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: table.merge(batch, n) and None).start()
