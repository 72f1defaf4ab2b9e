import hashlib
import random
import zlib

import duckdb

from basalt.llm import queries, warc
from basalt.llm.store import new_dir


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, first long, same string").select("page_id", "url", "html", "payload", "first", "same")


def test_round_trip(spark):
    rng = random.Random(1)
    big = "é<p>" * 400
    texts = [(1, "http://a/\r\nx y", big), (5, None, big), (3, "http://c", big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (None, "u", big), (11, "u", "x" * 3_000_000), (12, "u", "\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08" * 99), (13, "u", "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(90_000))), (5, None, big)]
    path = new_dir(spark, "warc")
    df = pages(spark, [(*t, "p", 1, "s") for t in texts]).repartition(3)
    assert warc.write(df, path) == len(texts)
    for split in (997, 65_536, 1 << 23):
        got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"]) for r in warc.read(spark, path, split_bytes=split).collect()), key=str)
        want = []
        for i, _, t in texts:
            raw = (t or "").encode()
            revisit = t == big and i != 5
            want.append((i, "revisit" if revisit else "response", 5 if revisit else None, len(raw), hashlib.sha1(raw).hexdigest(), None if revisit else bytearray(raw)))
        assert got == sorted(want, key=str)


def test_false_magic_is_rejected():
    inner = warc.record(99, "x", b"inner", None)
    data = b"junk" + warc.MAGIC + b"\0" * 20 + warc.record(1, "a", b"one", None) + b"\x1f\x8b" + warc.record(2, "b", inner[: len(inner) // 2] * 3, None)
    read = lambda at, n: data[at : at + n]
    found = [(at, h["warc-record-id"]) for at, h, *_ in warc.records_in(read, 0, len(data))]
    assert [i for _, i in found] == ["<urn:page:1>", "<urn:page:2>"]
    for size in (1, 7, 64):
        pieces = [x for s in range(0, len(data), size) for x in warc.records_in(read, s, min(len(data), s + size))]
        assert [at for at, *_ in pieces] == [at for at, _ in found]


def test_damaged_members_are_passed_over():
    whole = [warc.record(i, "u", b"payload %d" % i * 50, None) for i in range(3)]
    broken = bytearray(whole[1])
    broken[len(broken) // 2] ^= 0xFF
    data = whole[0] + bytes(broken) + whole[2]
    assert [h["warc-record-id"] for _, h, *_ in warc.records_in(lambda at, n: data[at : at + n], 0, len(data))] == ["<urn:page:0>", "<urn:page:2>"]


def test_query_on_copies_equals_sql(spark, tmp_path):
    big, small = "b" * 1500, "s" * 999
    rows = [(i, "u", [big, big + "c", small, None][i % 4] if i % 3 else f"{big}{i}") for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries.op4_warc(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.sql(queries.OP4_SQL).fetchall())
    assert {r[3] for r in got} == {"response", "revisit"}


def stored(block, page):
    """A record whose deflate data is the block as it is."""
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def test_archives_inside_archives(spark, tmp_path):
    rng = random.Random(4)
    noise = lambda n: rng.randbytes(n)
    nest = b"".join(warc.record(100 + i, "u", noise(300), None) for i in range(60))
    deep = stored(b"HTTP/1.1 200 OK\r\n\r\n" + nest[:20_000], 50)
    members = [warc.record(1, "a", noise(2000), None), stored(b"HTTP/1.1 200 OK\r\n\r\n" + nest, 2), stored(b"HTTP/1.1 200 OK\r\n\r\n" + deep * 2, 3), warc.record(4, "b", b"end", None)]
    data = b"".join(members)
    (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "y.warc.gz").write_bytes(warc.record(9, "c", noise(5000), None))
    assert len(warc.chains(lambda at, n: data[at : at + n], len(members[0]) + 500, len(data))) > 2  # phantoms are there
    for size in (700, 4096, 33_333, 1 << 23):
        got = warc.read(spark, str(tmp_path), split_bytes=size).collect()
        assert sorted(r["page_id"] for r in got) == [1, 2, 3, 4, 9]
        assert {r["page_id"]: bytes(r["payload"]) for r in got}[2] == nest


def test_empty(spark):
    path = new_dir(spark, "warc")
    df = pages(spark, []).repartition(1)
    assert warc.write(df, path) == 0
    assert warc.read(spark, path).count() == 0 and warc.read(spark, path).columns[0] == "page_id"


def test_many_repeated_payloads_without_a_hot_task(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_BROADCAST_ROWS", 100)
    monkeypatch.setattr(warc, "HOT_SHARE", 10)
    hot = "h" * 1200
    df = spark.range(90_000).selectExpr(
        "CASE WHEN id = 5 THEN NULL ELSE id END page_id",
        "'u' url",
        f"CASE WHEN id % 3 = 0 THEN '{hot}' WHEN id % 3 = 1 THEN 'small' ELSE rpad(CAST(id % 30000 AS STRING), 1100, ' ') END html",
    )
    typed = warc.with_types(df, id_col="page_id", payload_col="html", url_col="url")
    rows = typed.selectExpr("id", "length(payload) n", "refers_to", "spark_partition_id() p").collect()
    assert len(rows) == 90_000
    for r in rows:
        if r["n"] == 1200:
            want = 89_997 if r["id"] != 89_997 else None
        elif r["n"] == 5:
            want = None
        else:
            last = 60_000 + (5 if r["id"] is None else r["id"]) % 30_000
            want = None if r["id"] == last else last
        assert r["refers_to"] == want
    assert len({r["p"] for r in rows if r["n"] == 1200}) > 1  # the hot payload stays where it lies
