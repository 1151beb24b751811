"""Queries over daily panels: aggregation, calendar, status, lags, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel, series, summary
from ..registry import register
from ..session import load
from .base import CALENDAR_SQL, day_text, r6
from .base import series as base_series

EVENTS_SQL = "e AS (SELECT CAST(ts AS DATE) AS day, event_type AS kind, value, CASE WHEN value >= 100 THEN 'positive' WHEN value < 20 THEN 'negative' ELSE 'neutral' END AS label FROM events)"


def _events(spark, sf_dir):
    label = F.when(F.col("value") >= 100, "positive").when(F.col("value") < 20, "negative").otherwise("neutral")
    return load(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), "value", label.alias("label"))


@register(
    "daily_panel",
    f"""WITH {EVENTS_SQL}, p AS (SELECT day, kind, count(*) AS n, avg(value) AS mean_score, quantile_cont(value, 0.5) AS median_score, stddev_samp(value) AS std_score, count(*) FILTER (label = 'positive') AS pos FROM e GROUP BY 1, 2),
g AS (SELECT CAST(d AS DATE) AS day, kind FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM e), (SELECT DISTINCT kind FROM e)),
f AS (SELECT g.day, g.kind, CAST(coalesce(n, 0) AS BIGINT) AS n_rows, mean_score, median_score, std_score, pos::DOUBLE / n AS share_positive FROM g LEFT JOIN p USING (day, kind))
SELECT CAST(day AS VARCHAR) AS day, kind, n_rows, round(mean_score, 6) AS mean_score, round(median_score, 6) AS median_score, round(std_score, 6) AS std_score, round(share_positive, 6) AS share_positive, round(ln(1 + n_rows), 6) AS activity, lag(n_rows) OVER (PARTITION BY kind ORDER BY day) AS n_rows_lag_1 FROM f""",
)
def daily_panel(spark, sf_dir):
    daily = panel.daily_scores(_events(spark, sf_dir), "day", ["kind"], "value", F.col("label"))
    full = panel.complete(daily, "day", ["kind"], zero=["n_rows"])
    out = series.lags(full, ["kind"], "day", ["n_rows"], steps=(1,))
    return out.select(day_text(), "kind", "n_rows", r6("mean_score"), r6("median_score"), r6("std_score"), r6("share_positive"), r6(F.log1p("n_rows"), "activity"), "n_rows_lag_1")


@register(
    "daily_scores",
    f"""WITH {EVENTS_SQL} SELECT CAST(day AS VARCHAR) AS day, kind, count(*) AS n_rows, round(avg(value), 6) AS mean_score, round(quantile_cont(value, 0.5), 6) AS median_score,
count(*) FILTER (label = 'positive') AS n_positive, count(*) FILTER (label = 'neutral') AS n_neutral, count(*) FILTER (label = 'negative') AS n_negative,
round(count(*) FILTER (label = 'negative') / count(*)::DOUBLE, 6) AS share_negative FROM e GROUP BY 1, 2""",
)
def daily_scores(spark, sf_dir):
    out = panel.daily_scores(_events(spark, sf_dir), "day", ["kind"], "value", F.col("label"))
    return out.select(day_text(), "kind", "n_rows", r6("mean_score"), r6("median_score"), "n_positive", "n_neutral", "n_negative", r6("share_negative"))


@register(
    "observation_status",
    f"""WITH {EVENTS_SQL}, p AS (SELECT day, kind, count(*) AS raw, count(*) FILTER (value < 60) AS kept, avg(value) FILTER (value < 60) AS score FROM e GROUP BY 1, 2),
g AS (SELECT CAST(d AS DATE) AS day, kind FROM (SELECT unnest(generate_series(min(day), max(day) + INTERVAL 2 DAY, INTERVAL 1 DAY)) AS d FROM e), (SELECT DISTINCT kind FROM e)),
f AS (SELECT g.day, g.kind, coalesce(raw, 0) AS raw, coalesce(kept, 0) AS kept, score, g.day <= (SELECT max(day) FROM e) AS covered FROM g LEFT JOIN p USING (day, kind)),
s AS (SELECT *, CASE WHEN NOT covered THEN 'OUTSIDE_SOURCE_COVERAGE' WHEN kept > 0 THEN 'OBSERVED_RETAINED_ROWS' WHEN raw > 0 THEN 'RAW_ROWS_ALL_EXCLUDED' ELSE 'GENUINE_ZERO_OBSERVED_ACTIVITY' END AS status FROM f)
SELECT CAST(day AS VARCHAR) AS day, kind, status, CAST(CASE WHEN covered THEN kept END AS BIGINT) AS n_used, round(CASE WHEN covered THEN ln(1 + kept) END, 6) AS log_activity, round(CASE WHEN kept > 0 THEN score END, 6) AS score FROM s""",
)
def observation_status(spark, sf_dir):
    rows = _events(spark, sf_dir)
    ends = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    seen = rows.groupBy("day", "kind").agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("value") < 60).alias("kept"), F.avg(F.when(F.col("value") < 60, F.col("value"))).alias("score"))
    seen = seen.withColumn("dropped", F.col("raw") - F.col("kept"))
    kinds = rows.select("kind").distinct()
    days = spark.range(1).select(F.explode(F.sequence(F.lit(ends.a), F.date_add(F.lit(ends.b), 2))).alias("day"))
    full = days.crossJoin(kinds).join(seen, ["day", "kind"], "left").na.fill(0, ["raw", "kept", "dropped"])
    out = panel.with_status(full, "raw", "kept", "dropped", F.col("day") <= F.lit(ends.b), "n_used", ["score"])
    return out.select(day_text(), "kind", "status", "n_used", r6("log_activity"), r6("score"))


@register(
    "panel_lags",
    f"""WITH {CALENDAR_SQL}, f AS (SELECT day, asset, n_rows, price FROM calendar LEFT JOIN series USING (day, asset))
SELECT CAST(day AS VARCHAR) AS day, asset, """
    + ", ".join(f"lag(n_rows, {k}) OVER w AS n_rows_lag_{k}, round(lag(price, {k}) OVER w, 6) AS price_lag_{k}, CAST(lag(day, {k}) OVER w AS VARCHAR) AS source_lag_{k}" for k in (1, 2, 3, 7))
    + " FROM f WINDOW w AS (PARTITION BY asset ORDER BY day)",
)
def panel_lags(spark, sf_dir):
    full = panel.complete(base_series(spark, sf_dir), "day", ["asset"])
    out = series.lags(full, ["asset"], "day", ["n_rows", "price"], source="source")
    steps = (1, 2, 3, 7)
    return out.select(day_text(), "asset", *(c for k in steps for c in (F.col(f"n_rows_lag_{k}"), r6(f"price_lag_{k}"), day_text(f"source_lag_{k}"))))


@register(
    "coverage",
    f"WITH {CALENDAR_SQL}, f AS (SELECT day, asset, n_rows FROM calendar LEFT JOIN series USING (day, asset)) SELECT asset, count(*) AS n_days, count(n_rows) AS n_with, count(*) - count(n_rows) AS n_without, round(100.0 * count(n_rows) / count(*), 6) AS pct_with FROM f GROUP BY 1",
)
def coverage(spark, sf_dir):
    full = panel.complete(base_series(spark, sf_dir), "day", ["asset"])
    return panel.coverage(full, ["asset"], F.col("n_rows").isNotNull()).withColumn("pct_with", F.round("pct_with", 6))


@register("rebuilt_mean", "SELECT event_type AS kind, round(avg(value), 6) AS rebuilt_mean, count(*) AS n_rows FROM events GROUP BY 1")
def rebuilt_mean(spark, sf_dir):
    daily = panel.daily_scores(_events(spark, sf_dir), "day", ["kind"], "value", F.col("label"))
    return panel.rebuilt_mean(daily, ["kind"], "mean_score", "n_rows").withColumn("rebuilt_mean", F.round("rebuilt_mean", 6))


@register(
    "sample_sizes",
    f"""WITH {CALENDAR_SQL}, f AS (SELECT day, asset, year(day) AS yr, n_rows, price FROM calendar LEFT JOIN series USING (day, asset)), u AS (SELECT day, asset, yr, 'has_rows' AS sample, n_rows IS NOT NULL AS ok FROM f UNION ALL SELECT day, asset, yr, 'has_price', price > 1000 FROM f)
SELECT asset, sample, coalesce(CAST(yr AS VARCHAR), 'FULL') AS period, count(*) FILTER (ok) AS n, CAST(min(day) FILTER (ok) AS VARCHAR) AS first_day, CAST(max(day) FILTER (ok) AS VARCHAR) AS last_day, count(*) FILTER (ok AND isodow(day) >= 6) AS n_weekend FROM u GROUP BY GROUPING SETS ((asset, sample, yr), (asset, sample))""",
)
def sample_sizes(spark, sf_dir):
    full = panel.complete(base_series(spark, sf_dir), "day", ["asset"]).select("day", "asset", F.col("n_rows").isNotNull().alias("has_rows"), F.coalesce(F.col("price") > 1000, F.lit(False)).alias("has_price"))
    long = full.unpivot(["day", "asset"], ["has_rows", "has_price"], "sample", "ok").withColumn("yr", F.year("day"))
    ok = F.when(F.col("ok"), F.col("day"))
    out = long.groupingSets([["asset", "sample", "yr"], ["asset", "sample"]], "asset", "sample", "yr").agg(F.count(ok).alias("n"), F.min(ok).alias("first_day"), F.max(ok).alias("last_day"), F.count_if(F.col("ok") & (F.weekday("day") >= 5)).alias("n_weekend"))
    return out.select("asset", "sample", F.coalesce(F.col("yr").cast("string"), F.lit("FULL")).alias("period"), "n", day_text("first_day"), day_text("last_day"), "n_weekend")


@register(
    "missingness",
    f"""WITH {CALENDAR_SQL}, f AS (SELECT day, asset, price, volume FROM calendar LEFT JOIN series USING (day, asset)), u AS (SELECT day, asset, 'price' AS variable, price AS v FROM f UNION ALL SELECT day, asset, 'volume', volume FROM f)
SELECT asset, variable, count(*) AS n_rows, count(*) - count(v) AS n_missing, CAST(min(day) FILTER (v IS NOT NULL) AS VARCHAR) AS first_day, CAST(max(day) FILTER (v IS NOT NULL) AS VARCHAR) AS last_day, round(100.0 * (count(*) - count(v)) / count(*), 6) AS pct_missing FROM u GROUP BY 1, 2""",
)
def missingness(spark, sf_dir):
    full = panel.complete(base_series(spark, sf_dir), "day", ["asset"])
    out = summary.missingness(full, ["asset"], ["price", "volume"], "day")
    return out.select("asset", "variable", "n_rows", "n_missing", day_text("first_day"), day_text("last_day"), r6("pct_missing"))
