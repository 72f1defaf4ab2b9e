"""Files in and out: binary edges, delimited text, order as stored."""

import os
import random

import pytest
from pyspark.sql import functions as F

from basalt.operators import ordering, stored_order
from basalt.sources import binary_edges, ingest


def pairs(df):
    return sorted(map(tuple, df.collect()))


def edges(spark, *rows):
    return spark.createDataFrame(rows, "src bigint, dst bigint")


def test_ranges_of_foreign_files(spark, tmp_path):
    e = [(i, i * 3 % 97) for i in range(1000)]
    for width in (4, 8):
        folder = tmp_path / f"w{width}"
        folder.mkdir()
        (folder / "edges.bin").write_bytes(b"".join(a.to_bytes(width, "little") + b.to_bytes(width, "little") for a, b in e))
        (folder / "_notes").write_text("not edges")
        for split in (1, 64, 1000, 1 << 20):
            got = binary_edges.read(spark, f"{folder}", width=width, split_bytes=split if split > 1 else 500)
            assert pairs(got) == sorted(e)
        assert binary_edges.read(spark, f"file://{folder}", width=width, split_bytes=1000).rdd.getNumPartitions() >= 3
        assert pairs(binary_edges.read(spark, f"{folder}/edges.bin", width=width)) == sorted(e)
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "x").write_bytes(b"1" * 20)
    with pytest.raises(Exception, match="ends within a pair"):
        binary_edges.read(spark, f"{tmp_path}/torn", width=8).collect()


def test_writes_append_overwrite_and_keep_a_manifest(spark, tmp_path):
    rng, path = random.Random(2), f"{tmp_path}/edges"
    first, second = ([(rng.randrange(1 << 40), rng.randrange(1 << 62)) for _ in range(n)] for n in (2500, 10))
    binary_edges.write(edges(spark, *first).repartition(5), path)
    assert pairs(binary_edges.read(spark, path, split_bytes=4096)) == sorted(first)
    binary_edges.write(edges(spark, *second), path)
    assert pairs(binary_edges.read(spark, path)) == sorted(first + second)
    assert binary_edges.stats(path)["n_edges"] == 2510 and binary_edges.stats(path)["max_id"] == max(max(x) for x in first + second)
    with pytest.raises(Exception, match="holds ids of 8 bytes"):
        binary_edges.write(edges(spark, (1, 2)), path, width=4)
    assert pairs(binary_edges.read(spark, path)) == sorted(first + second)
    binary_edges.write(edges(spark, (1, 2)), path, width=4, mode="overwrite")
    assert pairs(binary_edges.read(spark, path, width=4)) == [(1, 2)] and binary_edges.stats(path)["n_files"] == 1
    binary_edges.write(edges(spark, (1, 2)).limit(0), path, width=4, mode="overwrite")
    assert pairs(binary_edges.read(spark, path, width=4)) == [] and binary_edges.stats(path) == {"n_files": 0, "n_edges": 0, "max_id": -1}
    assert [p.name for p in (tmp_path / "edges").iterdir() if not p.name.startswith((".", "_manifest"))] == []


@pytest.mark.parametrize(("bad", "message"), [("if(id = 777, null, id)", "null"), ("if(id = 777, -1, id)", "fit"), ("if(id = 777, 4294967296, id)", "fit"), ("raise_error('no')", "no")])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad, message):
    path = f"{tmp_path}/edges"
    binary_edges.write(edges(spark, (5, 6)), path, width=4)
    before = sorted(p.name for p in (tmp_path / "edges").iterdir())
    with pytest.raises(Exception, match=message):
        binary_edges.write(spark.range(1000).repartition(4).selectExpr(f"cast({bad} as bigint) as src", "id as dst"), path, width=4)
    assert sorted(p.name for p in (tmp_path / "edges").iterdir()) == before
    assert pairs(binary_edges.read(spark, path, width=4)) == [(5, 6)]


def test_other_columns_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="columns"):
        spark.dataSource.register(binary_edges.BinaryEdges)
        spark.range(3).withColumn("x", F.lit(1)).write.format("binary_edges").mode("append").save(f"{tmp_path}/e")


def test_ingest_keeps_what_it_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = [f"{i}|{i * 2}|name {i}|1995-01-{1 + i % 28:02d}" for i in range(500)]
    lines = {"a.txt": [*good[:200], "x|1|n|1995-01-01", "", "7|8"], "b.txt": ["9|300000000000|n|not a day", *good[200:]], "c.txt": []}
    for name, rows in lines.items():
        (tmp_path / "in" / name).write_text("".join(r + ("\r\n" if i % 2 else "\n") for i, r in enumerate(rows)))
    columns = {"line": (0, "8"), "v1": (1, "4"), "rejected": (2, "V"), "day": (3, "D")}
    got = ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", "|", columns)
    assert got.accepted.columns == list(columns) and (got.n_accepted, got.n_rejected) == (500, 4)
    assert sorted((r["line"], r["v1"], r["rejected"], str(r["day"])) for r in got.accepted.collect()) == sorted((int(a), int(b), c, d) for a, b, c, d in (g.split("|") for g in good))
    rejected = {(r["file"].rsplit("/", 1)[1], r["start"], r["number"]): (r["line"], r["at_fault"]) for r in got.rejected.collect()}
    assert rejected == {
        ("a.txt", 0, 200): ("x|1|n|1995-01-01", ["line"]),
        ("a.txt", 0, 201): ("", ["line", "v1", "rejected", "day"]),
        ("a.txt", 0, 202): ("7|8", ["rejected", "day"]),
        ("b.txt", 0, 0): ("9|300000000000|n|not a day", ["v1", "day"]),
    }
    (tmp_path / "none").mkdir()
    none = ingest.ingest(spark, f"{tmp_path}/none", f"{tmp_path}/out2", "|", columns)
    assert (none.n_accepted, none.n_rejected, none.accepted.count(), none.rejected.count()) == (0, 0, 0, 0)


def test_lines_are_numbered_in_each_range(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("".join(f"{k} {i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = ingest.numbered_lines(spark, f"{tmp_path}/in").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    of = {}
    for r in rows:
        of.setdefault((r["file"], r["start"]), []).append((r["number"], int(r["line"].split()[1])))
    assert len(of) > 6 and all([n for n, _ in sorted(x)] == list(range(len(x))) for x in of.values())
    assert all(b[0][1] + i == v for b in map(sorted, of.values()) for i, (_, v) in enumerate(b))


def test_stored_order(spark, tmp_path):
    rng = random.Random(5)
    values = [None, float("nan"), -1.0, 0.0, 2.5, 7.0]
    rank = lambda x: (0, 0) if x is None else (2, 0) if x != x else (1, x)
    for trial, sort in enumerate([True, False, True]):
        rows = [(rng.choice(values), rng.choice([None, *range(6)])) for _ in range(700)]
        key = lambda r: (rank(r[0]), rank(r[1]))
        rows = sorted(rows, key=key) if sort else rows
        path, order = f"{tmp_path}/{trial}", []
        for k in range(0, 700, 100):
            spark.createDataFrame(rows[k : k + 100], "a double, b bigint").coalesce(1).write.mode("append").parquet(path)
        names = sorted(p for p in os.listdir(path) if p.startswith("part"))
        for name in names:
            order.append([(None if x["a"] is None else x["a"], x["b"]) for x in spark.read.parquet(f"{path}/{name}").collect()])
        flat = [r for part in order for r in part]
        want = lambda x: (len(x), sum(key(b) < key(a) for a, b in zip(x, x[1:], strict=False)), sum(key(b) == key(a) for a, b in zip(x, x[1:], strict=False)))
        df = spark.read.parquet(path)
        assert tuple(stored_order.report(df, "a", "b").first()) == want(flat)
        assert {(r["file"].rsplit("/", 1)[1], *list(r)[1:]) for r in stored_order.by_file(df, "a", "b").collect()} == {(n, *want(o)) for n, o in zip(names, order, strict=True)}
        text = stored_order.report(df, "a", "b")._jdf.queryExecution().executedPlan().toString()
        assert text.index("Exchange") < text.index("MapInArrow")  # rows are summed up before anything is moved
    assert stored_order.is_sorted(spark.read.schema("a double, b bigint").parquet(path).where("a = 2.5 and b = 1"), "a", "b")
    assert tuple(stored_order.report(df.where("b > 100"), "a", "b").first()) == (0, 0, 0)


def test_sorted_tables_lie_sorted(spark, tmp_path):
    df = spark.range(5000).selectExpr("cast(hash(id) as bigint) as src", "id as dst")
    ordering.sort_edges(df).write.parquet(f"{tmp_path}/sorted")
    df.write.parquet(f"{tmp_path}/other")
    assert stored_order.is_sorted(spark.read.parquet(f"{tmp_path}/sorted"), "src", "dst", strict=True)
    assert not stored_order.is_sorted(spark.read.parquet(f"{tmp_path}/other"), "src", "dst")
