"""The reduced table that a stream keeps current."""

import random

import pytest
from pyspark.sql import functions as F

from basalt.sources import columns, files
from basalt.streaming import continuous, merged

MODELS = {"add": sum, "min": min, "max": max, "count": len}


@pytest.mark.parametrize("name", MODELS)
def test_batches_match_a_model(spark, tmp_path, name):
    rng, seen, table = random.Random(3), {}, merged.MergedTable(spark, f"{tmp_path}/t", name, buckets=3)
    assert table.table() is None
    for i in range(7):
        rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(100)])) for _ in range(rng.choice([0, 5, 200]))] if i != 3 else []
        for k, v in rows:
            seen.setdefault(k, [])
            seen[k] += [] if v is None else [v]
        batch = spark.createDataFrame(rows, "key bigint, value bigint").repartition(3)
        assert table.merge(batch, i) and not table.merge(batch, i)  # a batch that is run again changes nothing
        none = 0 if name == "count" else None
        want = {k: MODELS[name](v) if v else none for k, v in seen.items()}
        got = table.table().collect()
        assert {r["key"]: r["value"] for r in got} == want and len(got) == len(want)
    told = table.manifest()
    assert told["batch"] == 6 and len(told["runs"]) <= 4
    names = [x for x in files.listed(spark, f"{tmp_path}/t") if not x.startswith(".")]
    assert sum(x.startswith("manifest-") for x in names) == merged.KEEP
    with pytest.raises(ValueError, match="holds results"):
        merged.MergedTable(spark, f"{tmp_path}/t", "multiply").merge(batch, 99)


def test_two_writers_cannot_both_go_on(spark, tmp_path, monkeypatch):
    a, b = (merged.MergedTable(spark, f"{tmp_path}/t") for _ in range(2))
    batch = spark.createDataFrame([(1, 5)], "key bigint, value bigint")
    a.merge(batch, 0)
    old = b.manifest()
    a.merge(batch, 1)
    monkeypatch.setattr(b, "manifest", lambda: dict(old))
    with pytest.raises(FileExistsError):
        b.merge(batch, 1)
    assert [tuple(r) for r in a.table().collect()] == [(1, 10)]


def test_a_failure_between_run_and_manifest_is_made_good(spark, tmp_path, monkeypatch):
    for i in range(3):
        columns.append(spark.createDataFrame([(k, 10**i) for k in range(5)], "key bigint, value bigint").coalesce(1), f"{tmp_path}/in")
    table = merged.MergedTable(spark, f"{tmp_path}/t")
    stream = lambda: continuous.read_appends(spark, f"{tmp_path}/in", spark.createDataFrame([], "key bigint, value bigint").schema, files_per_trigger=1)
    write, calls = files.write_text, []

    def failing(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("lost")
        write(*args)

    monkeypatch.setattr(files, "write_text", failing)
    with pytest.raises(Exception, match="lost"):
        merged.start(stream(), table, f"{tmp_path}/state").awaitTermination()
    assert {r["value"] for r in table.table().collect()} == {1}
    merged.start(stream(), table, f"{tmp_path}/state").awaitTermination()
    assert {r["value"] for r in table.table().collect()} == {111} and table.manifest()["batch"] == 2
    assert table.table().where(F.col("key") == 3).count() == 1


def test_unmergeable_reducers_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="can't be merged"):
        merged.MergedTable(spark, f"{tmp_path}/t", "first")
