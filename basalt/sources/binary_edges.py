"""Binary edge files as a Spark data source: little-endian unsigned pairs (from, to) of 4 or 8 bytes each.

    spark.read.format("binary_edges").option("width", 4).load(path)
    edges.write.format("binary_edges").mode("append").save(path)

Reading cuts files into byte ranges of whole pairs (option split_bytes), so a large file is read by many tasks. Each task of a write leaves a file in the
job's own temporary folder; committing moves them beside the others and replaces the manifest, which lists the files with their edges and largest id. So readers see
whole writes only, and a failed job leaves no part behind. A folder without a manifest is read as it lies.

Paths are local ones or URIs of the stores that pyarrow knows. Ids that are null, negative or too wide are an error, and so is a torn last pair. An empty
table writes a manifest without files; overwriting replaces all files; columns besides src and dst are an error."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "src bigint, dst bigint"
SPLIT_BYTES = 64 << 20
_MANIFEST, _PIECE = "_manifest.json", 100_000


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def _manifest(fs: pafs.FileSystem, root: str) -> dict | None:
    name = f"{root}/{_MANIFEST}"
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(name) as f:
        return json.loads(f.read())


@dataclass
class Range(InputPartition):
    name: str
    start: int
    size: int


@dataclass
class Part(WriterCommitMessage):
    name: str
    n_edges: int
    max_id: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, width: int, split_bytes: int):
        self.path, self.width, self.split_bytes = path, width, split_bytes

    def partitions(self) -> list[Range]:
        fs, root = _store(self.path)
        told = _manifest(fs, root)
        if told is not None:
            if told["width"] != self.width:
                raise ValueError(f"{self.path} holds ids of {told['width']} bytes, not {self.width}")
            found = fs.get_file_info([f"{root}/{x['name']}" for x in told["files"]])
        elif fs.get_file_info(root).type == pafs.FileType.File:
            found = [fs.get_file_info(root)]
        else:
            found = [x for x in fs.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.File and x.base_name[0] not in "._"]
        pair, out = 2 * self.width, []
        step = max(1, self.split_bytes // pair) * pair
        for x in sorted(found, key=lambda x: x.path):
            if x.type == pafs.FileType.NotFound:
                raise FileNotFoundError(x.path)
            if x.size % pair:
                raise ValueError(f"{x.path} ends within a pair")
            out += [Range(x.path, at, min(step, x.size - at)) for at in range(0, x.size, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has a byte
            return
        fs, _ = _store(self.path)
        kind, left = np.dtype(f"<u{self.width}"), partition.size
        with fs.open_input_file(partition.name) as f:
            f.seek(partition.start)
            while left:
                raw = f.read(min(left, _PIECE * 2 * self.width))
                if not raw:
                    raise EOFError(partition.name)
                left -= len(raw)
                ids = np.frombuffer(raw, kind).reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=["src", "dst"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, overwrite: bool):
        self.path, self.width, self.overwrite, self.job = path, width, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, root = _store(self.path)
        folder, name = f"{root}/_temporary-{self.job}", f"part-{self.job}-{uuid.uuid4().hex[:12]}.bin"
        kind, n, most = np.dtype(f"<u{self.width}"), 0, -1
        fs.create_dir(folder)
        with fs.open_output_stream(f"{folder}/{name}") as f:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if batch.column(0).null_count or batch.column(1).null_count:
                    raise ValueError("an id is null")
                ids = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
                if ids.min() < 0 or self.width == 4 and ids.max() >= 1 << 32:
                    raise ValueError(f"an id doesn't fit {self.width} unsigned bytes")
                f.write(ids.astype(kind).tobytes())
                n, most = n + len(ids), max(most, int(ids.max()))
        return Part(name, n, most)

    def commit(self, messages: list[Part | None]) -> None:
        fs, root = _store(self.path)
        fs.create_dir(root)
        told = _manifest(fs, root) or {"width": self.width, "files": []}
        if told["width"] != self.width and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} holds ids of {told['width']} bytes, not {self.width}")
        old, new = told["files"], [m for m in messages if m and m.n_edges]
        for m in new:
            fs.move(f"{root}/_temporary-{self.job}/{m.name}", f"{root}/{m.name}")
        listed = ([] if self.overwrite else old) + [{"name": m.name, "n_edges": m.n_edges, "max_id": m.max_id} for m in new]
        draft = f"{root}/_draft-{self.job}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"width": self.width, "files": listed}, indent=1).encode())
        fs.move(draft, f"{root}/{_MANIFEST}")
        self.abort(messages)
        for x in old if self.overwrite else []:
            fs.delete_file(f"{root}/{x['name']}")

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = _store(self.path)
        folder = f"{root}/_temporary-{self.job}"
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class BinaryEdges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_edges"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        path, width = self.options.get("path"), int(self.options.get("width", 8))
        if not path or width not in (4, 8):
            raise ValueError("binary edges need a path and a width of 4 or 8")
        return path, width

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._options(), int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if [(f.name, f.dataType.simpleString()) for f in schema] != [("src", "bigint"), ("dst", "bigint")]:
            raise ValueError(f"binary edges have the columns {SCHEMA}")
        return _Writer(*self._options(), overwrite)


def read(spark: SparkSession, path: str, *, width: int = 8, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(src, dst) of the files at path."""
    spark.dataSource.register(BinaryEdges)
    return spark.read.format("binary_edges").option("width", width).option("split_bytes", split_bytes).load(path)


def write(edges: DataFrame, path: str, *, width: int = 8, mode: str = "append") -> None:
    """Write (src, dst), in the order of the rows of each partition."""
    edges.sparkSession.dataSource.register(BinaryEdges)
    rows = edges.selectExpr("cast(src as bigint) as src", "cast(dst as bigint) as dst")
    rows.write.format("binary_edges").option("width", width).mode(mode).save(path)


def stats(path: str) -> dict:
    """n_files, n_edges and max_id (-1 without edges) as the manifest has them."""
    told = _manifest(*_store(path))
    if told is None:
        raise FileNotFoundError(f"{path} has no manifest")
    return {"n_files": len(told["files"]), "n_edges": sum(x["n_edges"] for x in told["files"]), "max_id": max([x["max_id"] for x in told["files"]], default=-1)}
