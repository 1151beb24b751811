"""Queries over data-quality checks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import joins, panel, quality
from ..registry import register
from ..session import kept, load, scratch
from ..streaming import events as streams
from .base import CALENDAR_SQL, MARKET_SQL, SERIES_SQL, day_text, market, r6
from .base import series as base_series
from .texts import FLAGS_SQL, flagged


@register(
    "quality_checks",
    f"""WITH {CALENDAR_SQL}, k AS (SELECT count(*) AS n FROM (SELECT day, asset FROM series GROUP BY 1, 2 HAVING count(*) > 1)), g AS (SELECT (SELECT count(*) FROM (SELECT day, asset FROM calendar EXCEPT SELECT day, asset FROM series)) AS lacking)
SELECT 'price not positive' AS name, '0' AS expected, CAST(count(*) FILTER (price <= 0) AS VARCHAR) AS actual, count(*) FILTER (price <= 0) = 0 AS passed FROM series
UNION ALL SELECT 'volume above 400', '0', CAST(count(*) FILTER (volume > 400) AS VARCHAR), count(*) FILTER (volume > 400) = 0 FROM series
UNION ALL SELECT 'unique key', '0', CAST(n AS VARCHAR), n = 0 FROM k
UNION ALL SELECT 'complete grid', '0 lacking, 0 extra', lacking || ' lacking, 0 extra', lacking = 0 FROM g""",
)
def quality_checks(spark, sf_dir):
    rows = kept(base_series(spark, sf_dir), "series")
    checks = quality.Checks(spark)
    checks.counts(rows, {"price not positive": F.col("price") <= 0, "volume above 400": quality.outside("volume", high=400)})
    checks.unique(rows, ["day", "asset"])
    checks.complete_grid(rows, panel.grid(rows, "day", ["asset"]), ["day", "asset"])
    return checks.table().select("name", "expected", "actual", "passed")


@register("extreme_audit", f"WITH {SERIES_SQL}, t AS (SELECT asset, day, volume, row_number() OVER (PARTITION BY asset ORDER BY abs(volume) DESC, day) AS n FROM series) SELECT asset, CAST(day AS VARCHAR) AS day, round(volume, 4) AS volume FROM t WHERE n <= 10 OR abs(volume) >= 420")
def extreme_audit(spark, sf_dir):
    rows = base_series(spark, sf_dir).select("asset", "day", "volume")
    return quality.extremes(rows, ["asset"], "volume", 420, 10).select("asset", day_text(), F.round("volume", 4).alias("volume"))


@register(
    "accounting_identity",
    f"WITH {FLAGS_SQL} SELECT lang, count(*) AS n_raw, count(*) FILTER (NOT exclude) AS n_retained, count(*) FILTER (reason <> 'retained') AS n_excluded, count(*) FILTER (NOT short) AS n_long, count(*) FILTER (NOT exclude) + count(*) FILTER (reason <> 'retained') = count(*) AS balanced, count(*) FILTER (NOT short) + count(*) FILTER (reason <> 'retained') = count(*) AS balanced_wrongly FROM d GROUP BY 1",
)
def accounting_identity(spark, sf_dir):
    """Per language: raw rows are those retained by flag and those excluded by reason, counted from three tables; a wrong sum shows."""
    rows = flagged(spark, sf_dir)
    raw = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_raw"))
    kept = rows.where("retain").groupBy("lang").agg(F.count(F.lit(1)).alias("n_retained"))
    gone = rows.where("reason <> 'retained'").groupBy("lang").agg(F.count(F.lit(1)).alias("n_excluded"))
    long = rows.where("not too_short").groupBy("lang").agg(F.count(F.lit(1)).alias("n_long"))
    both = raw.join(kept, "lang", "left").join(gone, "lang", "left").join(long, "lang", "left").na.fill(0)
    return both.withColumns({"balanced": F.col("n_retained") + F.col("n_excluded") == F.col("n_raw"), "balanced_wrongly": F.col("n_long") + F.col("n_excluded") == F.col("n_raw")})


@register(
    "no_look_ahead",
    f"WITH {SERIES_SQL}, {MARKET_SQL}, s AS (SELECT s.day, m.day AS source FROM series s ASOF LEFT JOIN market m ON s.day > m.day), l AS (SELECT s.day, m.day AS source FROM series s ASOF LEFT JOIN market m ON s.day >= m.day) SELECT 'strict' AS alignment, count(*) FILTER (source >= day) AS late, count(*) FILTER (day - source <> 1) AS not_one_day, count(*) FILTER (source IS NULL) AS without FROM s UNION ALL SELECT 'same day allowed', count(*) FILTER (source >= day), count(*) FILTER (day - source <> 1), count(*) FILTER (source IS NULL) FROM l",
)
def no_look_ahead(spark, sf_dir):
    """Rows whose source is not before their day, under the strict alignment and under one that looks at the day itself."""
    out = None
    for name, strict in (("strict", True), ("same day allowed", False)):
        rows = joins.asof_join(base_series(spark, sf_dir).select("day", "asset"), market(spark, sf_dir), "day", ["level"], source="source", strict=strict)
        one = rows.agg(F.count_if(F.col("source") >= F.col("day")).alias("late"), F.count_if(F.datediff("day", "source") != 1).alias("not_one_day"), F.count_if(F.col("source").isNull()).alias("without"))
        one = one.select(F.lit(name).alias("alignment"), "late", "not_one_day", "without")
        out = one if out is None else out.unionAll(one)
    return out


@register("freshness", f"WITH {SERIES_SQL}, {MARKET_SQL}, s AS (SELECT s.day, s.asset, m.day AS source FROM series s ASOF LEFT JOIN market m ON s.day > m.day) SELECT asset, day - source AS age_days, count(*) AS n, CASE WHEN source IS NULL THEN 'no information' WHEN day - source > 2 THEN 'stale' ELSE 'fresh' END AS status FROM s GROUP BY ALL")
def freshness(spark, sf_dir):
    """How old the information of each day is."""
    rows = joins.asof_join(base_series(spark, sf_dir).select("day", "asset"), market(spark, sf_dir), "day", ["level"], source="source")
    aged = rows.withColumn("age_days", scalar.age_days("day", "source").cast("long"))
    status = F.when(F.col("source").isNull(), "no information").when(F.col("age_days") > 2, "stale").otherwise("fresh")
    return aged.groupBy("asset", "age_days", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _run(spark, stream, mode="append"):
    """Run a stream over the table as it is, in a folder of its own under the shared one, and read what it wrote."""
    at = scratch(spark, "stream")
    streams.run_to_parquet(stream, f"{at}/out", f"{at}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _stream(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    return streams.read_folder(spark, f"{sf_dir}/events.parquet", schema)


@register("stream_deduplicated", "SELECT event_id, event_type FROM events")
def stream_deduplicated(spark, sf_dir):
    """Every event comes once, although clicks and errors are delivered twice."""
    twice = _stream(spark, sf_dir).unionAll(_stream(spark, sf_dir).where("event_type in ('click', 'error')"))
    return _run(spark, streams.deduplicated(twice, "ts", ["event_id"])).select("event_id", "event_type")


@register("stream_upserted", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_upserted(spark, sf_dir):
    """The last event of every user, kept by upserts of micro-batches; a second run over the same events changes nothing."""
    at, rows = scratch(spark, "upserts"), lambda: _stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    for run in range(2):
        streams.upsert_batches(rows(), f"{at}/table", "user_id", "event_id", f"{at}/checkpoint{run}")
    return streams.upserted(spark, f"{at}/table").select("user_id", "event_id", "event_type")


@register("stream_tumbling", "WITH w AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2) SELECT CAST(day AS VARCHAR) AS day, event_type, n, round(mean, 6) AS mean FROM w WHERE day + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_tumbling(spark, sf_dir):
    out = _run(spark, streams.tumbling(_stream(spark, sf_dir), "ts", ["event_type"], "value"))
    return out.select(F.to_date("start").cast("string").alias("day"), "event_type", "n", r6("mean"))


@register("stream_expanding", "SELECT event_type, ts, event_id, count(value) OVER w AS n_before, round(avg(value) OVER w, 6) + 0.0 AS mean_before FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def stream_expanding(spark, sf_dir):
    """Per event type, the mean of all earlier values at each event, from kept state."""
    out = _run(spark, streams.expanding_means(_stream(spark, sf_dir).select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"], "value"))
    return out.select("event_type", "ts", "event_id", "n_before", r6("mean_before"))


@register(
    "batch_sessions",
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def batch_sessions(spark, sf_dir):
    out = streams.sessions(load(spark, sf_dir, "events"), "ts", ["user_id"], gap="1 day")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@register("batch_sliding", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) - CAST(k AS INTEGER) AS start FROM events, range(7) r(k)) SELECT CAST(start AS VARCHAR) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM d JOIN events ON ts >= start AND ts < start + INTERVAL 7 DAY GROUP BY 1, 2")
def batch_sliding(spark, sf_dir):
    out = streams.sliding(load(spark, sf_dir, "events"), "ts", ["event_type"], "value")
    return out.select(F.to_date("start").cast("string").alias("start"), "event_type", "n", r6("mean"))
