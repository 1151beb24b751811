import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, series
from tidemark.stats import diagnostics, forecast, ols


@pytest.fixture(scope="module")
def panel(spark):
    """Series of several lengths, one of a null key and one of a single row; values missing here and there."""
    rng = random.Random(9)
    rows = []
    for key, n in (("a", 97), ("b", 64), (None, 33), ("c", 1)):
        for i in range(n):
            rows.append((key, i * 2 + 1, rng.choice([None, *range(3)]) if rng.random() < 0.6 else 1, rng.gauss(0, 1), None if rng.random() < 0.1 else rng.gauss(3, 2)))
    return spark.createDataFrame(rows, "k string, t long, v long, x double, y double").repartition(5).cache()


def same(a, b, digits=8):
    def norm(df):
        plain = lambda v: None if isinstance(v, float) and v != v else round(v, digits) + 0.0 if isinstance(v, float) else v
        return sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)

    a, b = norm(a), norm(b)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=10 ** -(digits - 1), nan_ok=True) if all(isinstance(v, int | float) for v in x) else x == y


SIZES = [1, 7, 32, 1000]


@pytest.mark.parametrize("size", SIZES)
def test_numbers_and_blocks(panel, size):
    got = blocks.blocked(panel, ["k"], "t", size)
    for r in got.collect():
        assert r[blocks.RN] == (r.t + 1) // 2 and r[blocks.BLOCK] == (r[blocks.RN] - 1) // size
    assert got.count() == panel.count() and blocks.longest(panel, ["k"]) == 97


@pytest.mark.parametrize("size", SIZES)
def test_series_operators(panel, size):
    same(series.running_sum(panel, ["k"], "t", ["y"]), series.running_sum(panel, ["k"], "t", ["y"], size))
    same(series.expanding(panel, ["k"], "t", "y"), series.expanding(panel, ["k"], "t", "y", size))
    same(series.local_median(panel, ["k"], "t", "y"), series.local_median(panel, ["k"], "t", "y", block=size))
    same(series.runs(panel, ["k"], "t", "v"), series.runs(panel, ["k"], "t", "v", size))


@pytest.mark.parametrize("size", [5, 40])
def test_without_keys_all_rows_are_one_series(panel, size):
    one = panel.where("k = 'a'").drop("k")
    same(series.running_sum(one, [], "t", ["y"]), series.running_sum(one, [], "t", ["y"], size))
    same(series.runs(one, [], "t", "v"), series.runs(one, [], "t", "v", size))
    same(diagnostics.autocorrelation(one, "y", [], "t", [1, 9]), diagnostics.autocorrelation(one, "y", [], "t", [1, 9], size))
    same(forecast.expanding_forecasts(one, "y", {"m": ()}, [], "t", None, least=3), forecast.expanding_forecasts(one, "y", {"m": ()}, [], "t", None, least=3, block=size))


@pytest.mark.parametrize("size", [3, 20])
def test_estimators(panel, size):
    rows = panel.where("k is not null")
    same(ols.fit(rows, "y", ["x"], ["k"], "t"), ols.fit(rows, "y", ["x"], ["k"], "t", block=size))
    same(forecast.long_run(rows, "y", ["k"], "t"), forecast.long_run(rows, "y", ["k"], "t", block=size))
    same(diagnostics.ljung_box(rows, "y", ["k"], "t", (1, 3)), diagnostics.ljung_box(rows, "y", ["k"], "t", (1, 3), block=size))
    models = {"mean": (), "x": ("x",)}
    same(forecast.expanding_forecasts(rows, "y", models, ["k"], "t", None, least=5), forecast.expanding_forecasts(rows, "y", models, ["k"], "t", None, least=5, block=size))


@pytest.mark.parametrize(("width", "step"), [(10, 5), (11, 3), (12, 1), (6, 50)])
def test_rolling_windows_are_differences_of_prefixes(panel, width, step):
    rows = panel.where("k is not null")
    take = lambda **kw: forecast.rolling_models(rows, "y", ["x"], ["k"], "t", width, step, least=5, **kw)
    same(take(), take(block=8))


def test_no_window_takes_a_whole_series(spark, panel):
    """Windows over the rows are partitioned by block too; those by series alone run over a row a block."""
    plan = series.running_sum(panel, ["k"], "t", ["y"], 7)._jdf.queryExecution().executedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window [" in line and "y#" in line and "__b_" not in line]
    assert over_rows and all(re.search(r"\[k#\d+, __block", line) for line in over_rows)


def test_one_run_of_a_million_rows_spreads_over_tasks(spark):
    rows = spark.range(1_000_000).select(F.col("id").alias("t"), F.when(F.col("id") < 10, 0).otherwise(1).alias("v"))
    got = sorted((r.run, r.run_start, r.run_end, r.run_length, r.run_value) for r in series.runs(rows, [], "t", "v", 50_000).collect())
    assert got == [(1, 0, 9, 10, 0), (2, 10, 999_999, 999_990, 1)]
    cut = blocks.blocked(rows, [], "t", 50_000)
    assert cut.select(blocks.BLOCK).distinct().count() == 20 and cut.groupBy(blocks.BLOCK).count().agg(F.max("count")).first()[0] == 50_000


def test_empty_series(spark):
    none = spark.createDataFrame([], "k string, t long, v long, x double, y double")
    assert series.runs(none, ["k"], "t", "v", 5).count() == 0 and series.running_sum(none, ["k"], "t", ["y"], 5).count() == 0
    assert diagnostics.autocorrelation(none, "y", ["k"], "t", [1], 5).count() == 0


@pytest.fixture(scope="module")
def far(spark):
    """A daily series over the end of the year 9999, where Python's dates end and Spark writes years with a sign."""
    rng = random.Random(3)
    rows = spark.createDataFrame([("a", i, rng.gauss(0, 1), rng.gauss(3, 2)) for i in range(60)], "k string, i int, y double, x double")
    return rows.select("k", F.date_add(F.lit("9999-12-01").cast("date"), "i").alias("day"), "y", "x").cache()


def test_days_after_the_year_9999_are_written_as_sql_writes_them(far):
    from tidemark.plans.base import day_text

    texts = sorted(r.day for r in far.select(day_text()).collect())
    assert texts[0] == "10000-01-01" and texts[-1] == "9999-12-31" and len(texts) == 60


def test_forecasts_after_the_year_9999(far):
    whole, cut = (forecast.expanding_forecasts(far, "y", {"mean": (), "x": ("x",)}, ["k"], "day", None, least=5, block=b) for b in (None, 7))
    plain = lambda df: df.select("k", F.unix_date("day").alias("day"), "model", "train_n", F.unix_date("train_end").alias("train_end"), "forecast", "error")
    assert cut.count() == 110
    same(plain(whole), plain(cut))


def test_the_comparison_of_forecasts_after_the_year_9999(far):
    pairs = forecast.paired(forecast.expanding_forecasts(far, "y", {"mean": (), "x": ("x",)}, ["k"], "day", None, least=5, block=7), ["k"], "day", "mean", "x")
    got = forecast.long_run(pairs, "adjusted", ["k"], "day", correction=True, block=7).collect()
    assert [r.n for r in got] == [55]


def test_rolling_models_after_the_year_9999(far):
    got = forecast.rolling_models(far, "y", ["x"], ["k"], "day", 30, 7, least=5, block=7).withColumn("window_end", F.unix_date("window_end")).collect()
    assert len(got) == 10 and {r.parameter for r in got} == {"const", "x"}
