import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tables, warehouse


@pytest.fixture
def stored(spark, tmp_path):
    day = F.date_add(F.lit("2020-01-15").cast("date"), F.col("id").cast("int") * 5)
    df = spark.range(100).select("id", F.when(F.col("id") % 33 != 32, day).alias("day"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").cast("double").alias("value"))
    warehouse.save(df, f"file://{tmp_path}/table", "day")
    warehouse.register_source(spark)
    return df, f"file://{tmp_path}/table", str(tmp_path)


def _load(spark, stored, **options):
    _, at, root = stored
    reader = spark.read.format("warehouse").option("date", "day").option("trace", f"file://{root}/trace")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(at)


def _opened(stored):
    names = os.listdir(f"{stored[2]}/trace") if os.path.isdir(f"{stored[2]}/trace") else []
    for n in names:
        os.remove(f"{stored[2]}/trace/{n}")
    return sorted({n[:10] if n[0] == "2" else n[:4] for n in names})


@pytest.mark.parametrize(
    ("condition", "ranges"),
    [
        ("day between date'2020-02-10' and date'2020-03-05'", ["2020-02-01", "2020-03-01"]),
        ("day = date'2020-04-04'", ["2020-04-01"]),
        ("day in (date'2020-01-20', date'2021-01-09')", ["2020-01-01", "2021-01-01"]),
        ("day > date'2021-04-01' and kind = '1' and value >= 90", ["2021-04-01", "2021-05-01"]),
        ("day is null", ["none"]),
        ("day < date'2019-01-01'", []),
        ("kind in ('0', '2') and day <= date'2020-01-31'", ["2020-01-01"]),
        ("not (kind = '1') and day < date'2020-02-01' and day is not null", ["2020-01-01"]),
    ],
)
def test_filters_choose_the_ranges(spark, stored, condition, ranges):
    got = _load(spark, stored).where(condition)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(map(tuple, stored[0].where(condition).collect()), key=str)
    opened = _opened(stored)
    assert set(opened) <= set(ranges) and all(r in opened for r in ranges)


def test_the_plan_shows_what_is_pushed(spark, stored):
    got = _load(spark, stored, columns="value,day").where("day >= date'2021-05-01' and value < 99")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == ["value", "day"] and "BatchScan" in plan
    text = got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(day,2021-05-01)" in text and "LessThan(value,99.0)" in text
    assert got.count() == stored[0].where("day >= date'2021-05-01' and value < 99").count()


def test_everything_without_filters_and_errors(spark, stored):
    assert sorted(r.id for r in _load(spark, stored).collect()) == list(range(100))
    with pytest.raises(Exception, match="has no"):
        _load(spark, stored, columns="nothing").collect()
    with pytest.raises(Exception, match="no ranges by week"):
        _load(spark, stored, by="week").collect()


def test_moments(spark, tmp_path):
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(days=20 * i, hours=5)) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz")
    warehouse.save(df, f"file://{tmp_path}/t", "at")
    warehouse.register_source(spark)
    got = spark.read.format("warehouse").option("date", "at").option("trace", f"file://{tmp_path}/trace").load(f"file://{tmp_path}/t").where("at >= timestamp_ntz'2020-02-10 06:00:00'")
    assert sorted(map(tuple, got.collect())) == rows[3:] and "2020-01" not in str(os.listdir(f"{tmp_path}/trace"))


def test_extractions_in_one_session_do_not_mix(spark):
    """Two extractions planned before either runs keep their own tables."""
    def posts(n):
        return spark.createDataFrame([(n, dt.datetime(2020, 1, 2), 1, f"t{n}", None, 1, 1.0, 0, None, None, None)], "post_id long, created_at timestamp, community_id long, title string, body string, score int, upvote_ratio double, num_comments int, crosspost_parent_id string, url string, permalink string")

    places = spark.createDataFrame([(1, "It's {here}")], "community_id long, name string")
    a, b = (tables.extract(spark, posts(n), places, ["it's {HERE}"], "2020-01-01", "2020-01-31") for n in (1, 2))
    assert [r.post_id for r in a.collect()] == [1] and [r.post_id for r in b.collect()] == [2]
