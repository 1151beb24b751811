"""The series queries over long series: every event in turn, cut into blocks so that no task holds a series.

An event's number stands for its day. The SQL is that of the daily queries over another series.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, series
from ..registry import ORACLE_SQL, register
from ..session import kept, load
from ..stats import diagnostics, forecast, ols
from . import windows  # noqa: F401  its SQL is reused
from .base import SERIES_SQL, day_text, r6
from .statistics import START

EVENTS_SQL = "series AS (SELECT DATE '1998-12-01' + CAST(event_id AS INTEGER) AS day, event_type AS asset, 1 + abs(value) AS price, CAST(user_id AS DOUBLE) AS volume, 1 AS n_rows FROM events)"
#: Rows of a block; events are many enough to make several.
BLOCK = 700


def _twin(name: str) -> str:
    return ORACLE_SQL[name].replace(SERIES_SQL, EVENTS_SQL)


def events(spark, sf_dir):
    """(day, asset, price, volume) of every event."""
    day = F.date_add(F.lit("1998-12-01").cast("date"), F.col("event_id").cast("int"))
    return load(spark, sf_dir, "events").select(day.alias("day"), F.col("event_type").alias("asset"), (1 + F.abs("value")).alias("price"), F.col("user_id").cast("double").alias("volume"))


def returns(spark, sf_dir):
    """The events with their log return and its lag, by blocks that see two rows back; computed once."""
    rows = blocks.haloed(blocks.blocked(events(spark, sf_dir), ["asset"], "day", BLOCK), 2, 0, BLOCK)
    w = blocks.order_of(["asset"], BLOCK, "day")
    rows = rows.withColumn("ret", F.ln(F.col("price") / F.lag("price").over(w))).withColumn("ret_lag", F.lag("ret").over(w))
    return kept(blocks.owned(rows), "returns")


@register("long_cumulative", _twin("cumulative_volume"))
def long_cumulative(spark, sf_dir):
    return series.running_sum(events(spark, sf_dir), ["asset"], "day", ["volume"], BLOCK).select(day_text(), "asset", F.round("cumulative_volume", 4).alias("cumulative_volume"))


@register("long_expanding", _twin("expanding_window"))
def long_expanding(spark, sf_dir):
    out = series.expanding(events(spark, sf_dir), ["asset"], "day", "price", BLOCK)
    return out.select(day_text(), "asset", day_text("train_start"), day_text("train_end"), "train_n", r6("price_mean"))


@register("long_median", _twin("local_median"))
def long_median(spark, sf_dir):
    out = series.local_median(events(spark, sf_dir), ["asset"], "day", "price", block=BLOCK)
    return out.select(day_text(), "asset", r6("local_median"), F.coalesce(F.abs(F.col("price") / F.col("local_median") - 1) >= 0.2, F.lit(False)).alias("deviates"))


@register(
    "long_runs",
    "WITH c AS (SELECT event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS ch FROM events), r AS (SELECT *, sum(ch) OVER (ORDER BY event_id) AS run FROM c) SELECT CAST(run AS BIGINT) AS run, min(event_id) AS run_start, max(event_id) AS run_end, count(*) AS run_length, min(event_type) AS run_value FROM r GROUP BY 1",
)
def long_runs(spark, sf_dir):
    """Runs of one kind of event in the one series of all events."""
    rows = load(spark, sf_dir, "events").select("event_id", "event_type")
    return series.runs(rows, [], "event_id", "event_type", BLOCK).withColumn("run", F.col("run").cast("long"))


@register("long_hac", _twin("ols_hac"))
def long_hac(spark, sf_dir):
    rows = returns(spark, sf_dir)
    take = lambda c: ols.fit(rows, "ret", ["ret_lag"], ["asset"], lags=7, correction=c, block=BLOCK).where("parameter = 'ret_lag'")
    plain = take(False).select("asset", "coefficient", F.col("se").alias("plain"))
    return plain.join(take(True).select("asset", F.col("se").alias("corrected")), "asset").select("asset", r6("coefficient", "slope"), r6("plain", "se_plain"), r6("corrected", "se_corrected"))


@register("long_autocorrelation", _twin("autocorrelation"))
def long_autocorrelation(spark, sf_dir):
    return diagnostics.autocorrelation(returns(spark, sf_dir), "ret", ["asset"], "day", (1, 3, 7, 14, 30), BLOCK).select("asset", "lag", "n", r6("acf"), r6("bound"))


@register("long_ljung_box", _twin("ljung_box"))
def long_ljung_box(spark, sf_dir):
    return diagnostics.ljung_box(returns(spark, sf_dir), "ret", ["asset"], "day", (1, 3, 7), BLOCK).select("asset", "lag", F.round("q", 4).alias("q"))


def _forecasts(spark, sf_dir):
    return forecast.expanding_forecasts(returns(spark, sf_dir), "ret", {"mean": (), "lag": ("ret_lag",)}, ["asset"], "day", START, block=BLOCK)


@register("long_forecasts", _twin("expanding_forecasts"))
def long_forecasts(spark, sf_dir):
    return _forecasts(spark, sf_dir).select("asset", day_text(), "model", "train_n", day_text("train_start"), day_text("train_end"), r6("forecast"), r6("error"))


@register("long_clark_west", _twin("clark_west"))
def long_clark_west(spark, sf_dir):
    pairs = forecast.paired(_forecasts(spark, sf_dir), ["asset"], "day", "mean", "lag")
    tested = forecast.long_run(pairs, "adjusted", ["asset"], "day", correction=True, block=BLOCK)
    return tested.select("asset", "n", F.round("mean", 8).alias("mean"), F.round("z", 4).alias("z"))


@register("long_rolling", _twin("rolling_models"))
def long_rolling(spark, sf_dir):
    out = forecast.rolling_models(returns(spark, sf_dir), "ret", ["ret_lag"], ["asset"], "day", block=BLOCK)
    return out.select("asset", day_text("window_end"), "parameter", r6("coefficient"), "n")
