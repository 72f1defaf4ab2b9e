"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

The reader cuts files into byte ranges. A task scans its range for gzip magic, decodes a candidate's first bytes and takes it only if they are WARC
headers with a type, an id and a length; the whole member must then decode, pass gzip's checksum and hold the stated length. A task owns the
records that start inside its range, and follows the last one past the range's end. Magic bytes inside compressed data fail these tests.

A record's payload may itself be an archive, stored as it is, and a range that starts inside it would find its members. So ranges are scanned twice. The
first scan only notes from where to where members follow each other. As a file begins with a record, the place where the first range's last member ends is
known to be outside of all others; so is, range by range, the end of the last member that starts at or after the place before. The second scan
reads each range from its place on. What is noted of a file is as long as the file has ranges, and one task strings it together.

Files are opened with pyarrow's file systems, so archives may lie in any store that those read (local, HDFS, S3, ...). A task writes under a name
of its own attempt and renames when it is done, so a lost executor leaves no half-written archive in place.

Defined cases: a null payload counts as empty; a null id is written as such and reads back null; rows with equal ids and payloads are all
responses when theirs is the largest id, so none refers to itself; a payload whose rows all have null ids has only responses; null urls
become empty; an empty table writes no records and reads back empty; other columns are ignored. A damaged member is passed over. A record of any
length is held whole by the one task that reads it, its payload at most 2 GB (a column's value).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.store import staged

MIN_REVISIT, SPLIT_BYTES, DATE = 1000, 8 << 20, "1970-01-01T00:00:00Z"
MAX_BROADCAST_ROWS, HOT_SHARE = 20_000, 1000
MAGIC = b"\x1f\x8b\x08"
_PIECE = 1 << 18
_URN = "urn:page:"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system, and the path in it; file:/x and file:///x are the same."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def with_types(pages: DataFrame, *, id_col: str, payload_col: str, url_col: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(id, url, payload, refers_to): refers_to is set for revisits. Equal payloads are those of equal SHA-256."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("same", F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256)))
    groups = keyed.where("same is not null").groupBy("same").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = staged(groups, "copies")
    facts = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).first()
    if facts["groups"] <= MAX_BROADCAST_ROWS:
        return _referring(keyed, F.broadcast(groups))  # its size was just counted
    # fewer than HOT_SHARE groups can hold more than 1 / HOT_SHARE of all copies; the others are joined by a shuffle, in which no key is hot
    limit = facts["rows"] // HOT_SHARE
    hot = F.broadcast(groups.where(F.col("n") > limit))
    marked = keyed.join(hot.select(F.col("same").alias("hot"), F.col("first").alias("hot_first")), F.col("same") == F.col("hot"), "left")
    done = marked.where("same is null or hot is not null").select("id", "url", "payload", _refers("hot_first"))
    rest = marked.where("same is not null and hot is null").select("id", "url", "payload", "same")
    return done.union(_referring(rest, groups.where(F.col("n") <= limit)))


def _refers(first: str) -> Column:
    return F.when(~F.col("id").eqNullSafe(F.col(first)), F.col(first)).alias("refers_to")


def _referring(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    return keyed.join(groups.select("same", "first"), "same", "left").select("id", "url", "payload", _refers("first"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> int:
    """Write archives below path, one file for each task, and return how many records they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _open(path)
        fs.create_dir(base, recursive=True)
        own = f"{base}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        n = 0
        with fs.open_output_stream(own) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    page, url, payload, refers = (batch.column(j)[i] for j in range(4))
                    out.write(record(page.as_py(), url.as_py(), payload.as_py().encode(), refers.as_py()))
                    n += 1
        if n:
            fs.move(own, f"{base}/part-{task.partitionId():06d}.warc.gz")
        else:
            fs.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    typed = with_types(pages, id_col=id_col, payload_col=payload_col, url_col=url_col)
    return typed.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _headers(data: bytes) -> dict[str, str] | None:
    """Header fields of a record, names in lower case, or None if these aren't whole WARC headers."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields if {"warc-type", "warc-record-id", "content-length"} <= fields.keys() and fields["content-length"].isdigit() else None


def decode_member(read, at: int, *, keep: bool = True) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, where the member ends) of the record at this offset, or None if there is none. read(offset, size) gives bytes; without keep no block."""
    z, data, pos, fields, start, length = zlib.decompressobj(31), bytearray(), at, None, 0, 0
    step = 4096
    try:
        while not z.eof:
            piece = read(pos, step)
            if not piece:
                return None
            pos += len(piece)
            more = z.decompress(piece)
            length += len(more)
            if fields is None or keep:
                data += more
            if fields is None:
                if not data.startswith(b"WARC/1."[: len(data)]):
                    return None
                if (start := data.find(b"\r\n\r\n") + 4) > 3 and (fields := _headers(bytes(data[:start]))) is None:
                    return None
            step = _PIECE
    except zlib.error:
        return None
    if fields is None or length < start + int(fields["content-length"]):
        return None
    return fields, bytes(data[start : start + int(fields["content-length"])]) if keep else b"", pos - len(z.unused_data)


def records_in(read, start: int, end: int, *, keep: bool = True) -> Iterator[tuple[int, dict[str, str], bytes, int]]:
    """(offset, headers, block, where it ends) of the records that start in [start, end), each after the one before."""
    at = start
    while at < end:
        # magic may straddle the end of a piece, or of the range
        piece = read(at, min(_PIECE, end - at) + len(MAGIC) - 1)
        found = piece.find(MAGIC)
        if found < 0:
            at += _PIECE
            continue
        at += found
        if at >= end:
            return
        got = decode_member(read, at, keep=keep)
        if got is None:
            at += 1
            continue
        yield at, *got
        at = got[2]


def chains(read, start: int, end: int) -> list[int]:
    """[from, to, from, to, ...]: where members that start in [start, end) follow each other."""
    out: list[int] = []
    for at, _, _, stop in records_in(read, start, end, keep=False):
        if out and out[-1] == at:
            out[-1] = stop
        else:
            out += [at, stop]
    return out


def entries(ranges: list[tuple[int, int, list[int]]]) -> list[tuple[int, int]]:
    """(place to read from, end) of a file's ranges (start, end, chains), in order; ranges without a record of their own are left out."""
    out, free = [], 0
    for start, end, found in sorted(ranges):
        begin = max(start, free)
        mine = [stop for at, stop in zip(found[::2], found[1::2], strict=True) if at >= begin]
        if mine:
            out.append((begin, end))
            free = mine[-1]
    return out


def _reader(uri: str):
    """(the open file, read(offset, size)) of a path."""
    fs, name = _open(uri)
    f = fs.open_input_file(name)

    def at(offset: int, size: int) -> bytes:
        f.seek(offset)
        return f.read(size)

    return f, at


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(_URN)
    return int(digits) if re.fullmatch(r"-?\d+", digits) else None


def read(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of all records below path.

    A revisit has the digest of its own header and no payload; its payload_bytes is what its HTTP header states."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes))).alias("start"), "length")
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("stop"))
    tasks = max(1, min(ranges.count(), 20_000))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, stop in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                f, at = _reader(uri)
                with f:
                    found = chains(at, start, stop)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([start]), pa.array([stop]), pa.array([found], pa.list_(pa.int64()))], names=["path", "start", "stop", "found"])

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, noted in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                got = entries([(x["start"], x["stop"], x["found"]) for x in noted])
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(got), pa.string()), pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["path", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, stop in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                f, at = _reader(uri)
                with f:
                    rows, held = [], 0
                    for _, head, block, _ in records_in(at, start, stop):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        stated = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
                        kind = head["warc-type"]
                        digest = base64.b32decode(head.get("warc-payload-digest", "").removeprefix("sha1:") or "").hex() if kind == "revisit" else hashlib.sha1(payload).hexdigest()
                        size = int(stated[1]) if kind == "revisit" and stated else len(payload)
                        rows.append((_number(head["warc-record-id"]), head.get("warc-target-uri"), kind, _number(head.get("warc-refers-to")), size, digest, None if kind == "revisit" else payload))
                        held += len(block)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    scanned = ranges.repartition(tasks).mapInArrow(scan, "path string, start long, stop long, found array<long>")
    noted = scanned.groupBy("path").agg(F.collect_list(F.struct("start", "stop", "found")).alias("noted"))  # one entry for each range of a file
    whole = staged(noted.mapInArrow(string, "path string, start long, stop long"), "ranges")
    return whole.repartition(tasks).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
