import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.stats import forecast
from tidemark.streaming import estimates, events, late, merge

UTC = dt.UTC
DAY0 = dt.datetime(2020, 1, 1, tzinfo=UTC)


@pytest.fixture
def store(spark):
    spark.conf.set(*estimates.STORE)
    yield
    spark.conf.unset(estimates.STORE[0])


def _series(n=120):
    rng = random.Random(4)
    return [(k, DAY0 + dt.timedelta(days=i), rng.gauss(5, 1), rng.gauss(0, 2) if i % 11 else None) for k in "ab" for i in range(n) if rng.random() > 0.1]


SCHEMA = "k string, ts timestamp, y double, x double"
CLOSING = [(k, dt.datetime(2100, 1, 1, tzinfo=UTC), None, None) for k in "ab"]


def test_forecasts_are_the_batch_s_whatever_the_order(spark, store, tmp_path):
    rows, rng = _series(), random.Random(8)
    # Each file has the days of 30 days and some of the 30 before, in any order.
    files = [[r for r in rows if ((r[1] - DAY0).days // 30 + (r[1].day % 4 == 0)) == i] for i in range(6)]
    for i, part in enumerate([*filter(None, files), CLOSING]):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = events.read_folder(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    models = {"mean": (), "x": ("x",)}
    out = estimates.reestimated(stream, "y", models, ["k"], "ts", "61 days", start="2020-02-01", least=10, bucket_ms=7 * 86_400_000)
    events.run_to_parquet(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {(r.k, r.ts.date(), r.model): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date("ts"))
    want = forecast.expanding_forecasts(batch, "y", models, ["k"], "day", "2020-02-01", least=10).collect()
    assert len(got) == len(want) > 200
    for r in want:
        g = got[(r.k, r.day, r.model)]
        assert (g.train_n, g.train_start.date(), g.train_end.date()) == (r.train_n, r.train_start, r.train_end)
        assert g.forecast == pytest.approx(r.forecast, rel=1e-9) and g.error == pytest.approx(r.error, abs=1e-9)
    assert len(os.listdir(f"{tmp_path}/checkpoint/commits")) >= 6  # it did come in many batches


def test_rows_of_one_moment_do_not_see_each_other(spark, store, tmp_path):
    rows = [("a", DAY0 + dt.timedelta(days=i // 2), float(i), 1.0) for i in range(8)] + CLOSING[:1]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = events.read_folder(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)
    out = estimates.reestimated(stream, "y", {"mean": (), "flat": ("x",)}, ["k"], "ts", "0 seconds", least=1)
    events.run_to_parquet(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = sorted((r.ts, r.actual, r.forecast, r.train_n) for r in spark.read.parquet(f"{tmp_path}/out").where("model = 'mean'").collect())
    assert [g[1:] for g in got] == [(2.0, 0.5, 2), (3.0, 0.5, 2), (4.0, 1.5, 4), (5.0, 1.5, 4), (6.0, 2.5, 6), (7.0, 2.5, 6)]
    # A variable without spread has no slope: no forecast, and no error.
    assert all(r.forecast is None for r in spark.read.parquet(f"{tmp_path}/out").where("model = 'flat'").collect())


def _bytes(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.startswith("part-")}


def test_a_merge_writes_the_touched_buckets_only(spark, tmp_path):
    table = f"file://{tmp_path}/table"
    base = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("o"), F.md5(F.col("id").cast("string")).alias("v"))
    assert merge.merge(base, table, "k", "o", buckets=32)["touched"] == 32
    before = _bytes(f"{tmp_path}/table/data")
    small = spark.createDataFrame([(7, 2, "new"), (7, 0, "older"), (7, 3, "newest"), (30_000, 1, "added")], "k long, o long, v string")
    did = merge.merge(small, table, "k", "o")
    written = {f: n for f, n in _bytes(f"{tmp_path}/table/data").items() if f not in before}
    assert did["touched"] <= 2 and sum(written.values()) < sum(before.values()) / 8
    got = {r.k: r.v for r in merge.read(spark, table).where("k in (7, 30000, 8)").collect()}
    assert got[7] == "newest" and got[30_000] == "added" and len(got) == 3 and merge.read(spark, table).count() == 20_001
    # The same batch again, an older row, and an empty batch change nothing.
    for again in (small, spark.createDataFrame([(7, 1, "old")], "k long, o long, v string"), small.limit(0)):
        merge.merge(again, table, "k", "o")
    assert merge.read(spark, table).count() == 20_001 and merge.read(spark, table).where("k = 7").first().v == "newest"
    assert merge.swept(spark, table) > 0 and merge.read(spark, table).count() == 20_001
    with pytest.raises(ValueError, match="bucket"):
        merge.merge(small.withColumn("bucket", F.lit(1)), table, "k", "o")


def test_a_batch_that_dies_before_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    table = f"file://{tmp_path}/table"
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, o long, v string")
    merge.merge(rows, table, "k", "o", buckets=4)
    put = merge._put
    monkeypatch.setattr(merge, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    new = spark.createDataFrame([(1, 2, "c")], "k long, o long, v string")
    with pytest.raises(RuntimeError):
        merge.merge(new, table, "k", "o")
    assert sorted(r.v for r in merge.read(spark, table).collect()) == ["a", "b"]
    monkeypatch.setattr(merge, "_put", put)
    merge.merge(new, table, "k", "o")
    assert sorted(r.v for r in merge.read(spark, table).collect()) == ["b", "c"]


def test_late_rows_are_kept_beside_the_stream(spark, tmp_path):
    at = lambda d: DAY0 + dt.timedelta(days=d)
    for i, days in enumerate([[0, 5, 10], [7, 2, 12, None], [11, 9.5, 1]]):
        rows = [(100 * i + j, None if d is None else at(d)) for j, d in enumerate(days)]
        spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "id long, ts timestamp"
    run = lambda: late.split_stream(events.read_folder(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, files_per_trigger=1), "ts", "3 days", f"file://{tmp_path}/out", f"{tmp_path}/checkpoint")
    run()
    # Marks: none, then day 10 less 3, then day 12 less 3.
    behind = {r.id: r.late_seconds for r in late.late(spark, f"file://{tmp_path}/out").collect()}
    assert behind == {101: 5 * 86_400.0, 103: None, 202: 8 * 86_400.0}
    assert sorted(r.id for r in late.on_time(spark, f"file://{tmp_path}/out").collect()) == [0, 1, 2, 100, 102, 200, 201]
    run()  # nothing new: nothing changes
    assert late.on_time(spark, f"file://{tmp_path}/out").count() + late.late(spark, f"file://{tmp_path}/out").count() == 10
    assert late.watermark(spark, f"file://{tmp_path}/out", 1, "3 days").date() == at(7).date()
