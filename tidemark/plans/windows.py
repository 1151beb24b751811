"""Queries over ordered series: changes, medians, runs, flags, expanding windows, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from ..registry import register
from ..session import kept, load
from .base import CHANGES_SQL, SERIES_SQL, day_text, modelling, r6
from .base import series as base_series

W = "(PARTITION BY asset ORDER BY day)"


@register(
    "changes",
    f"WITH {SERIES_SQL} SELECT CAST(day AS VARCHAR) AS day, asset, round(ln(price / lag(price) OVER w), 6) AS price_return, round(price / lag(price) OVER w - 1, 6) AS price_pct, round(price - lag(price) OVER w, 6) AS price_diff, CAST(day - lag(day) OVER w AS INTEGER) AS gap_days, round(lead(price) OVER w, 6) AS price_next FROM series WINDOW w AS {W}",
)
def changes(spark, sf_dir):
    out = series.changes(base_series(spark, sf_dir), ["asset"], "day", "price")
    return out.select(day_text(), "asset", r6("price_return"), r6("price_pct"), r6("price_diff"), "gap_days", r6("price_next"))


@register(
    "local_median",
    f"WITH {SERIES_SQL} SELECT CAST(day AS VARCHAR) AS day, asset, round(CASE WHEN count(price) OVER w >= 3 THEN quantile_cont(price, 0.5) OVER w END, 6) AS local_median, coalesce(abs(price / (CASE WHEN count(price) OVER w >= 3 THEN quantile_cont(price, 0.5) OVER w END) - 1) >= 0.2, false) AS deviates FROM series WINDOW w AS (PARTITION BY asset ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)",
)
def local_median(spark, sf_dir):
    out = series.local_median(base_series(spark, sf_dir), ["asset"], "day", "price")
    return out.select(day_text(), "asset", r6("local_median"), F.coalesce(F.abs(F.col("price") / F.col("local_median") - 1) >= 0.2, F.lit(False)).alias("deviates"))


@register(
    "runs",
    """WITH c AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
SELECT conv_id, CAST(run AS BIGINT) AS run, min(turn) AS run_start, max(turn) AS run_end, count(*) AS run_length, min(role) AS run_value FROM r GROUP BY 1, 2""",
)
def runs(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return series.runs(turns, ["conv_id"], "turn", "role").withColumn("run", F.col("run").cast("long"))


@register(
    "price_flags",
    f"""WITH {SERIES_SQL}, p AS (SELECT day, asset, round(price, 0) AS price FROM series), c AS (SELECT *, price / lag(price) OVER w - 1 AS pct, coalesce(price = lag(price) OVER w, false) AS repeats_previous, coalesce(price = lead(price) OVER w, false) AS repeats_next FROM p WINDOW w AS {W})
SELECT CAST(day AS VARCHAR) AS day, asset, repeats_previous, repeats_next, coalesce(abs(pct) >= 0.15 AND abs(lead(pct) OVER {W}) >= 0.15 AND sign(pct) <> sign(lead(pct) OVER {W}), false) AS reversal, coalesce(abs(pct) >= 0.10, false) AS move_10, coalesce(abs(pct) >= 0.20, false) AS move_20 FROM c""",
)
def price_flags(spark, sf_dir):
    base = base_series(spark, sf_dir).withColumn("price", F.round("price", 0))
    moved = series.changes(series.stale(base, ["asset"], "day", "price"), ["asset"], "day", "price")
    out = series.reversal(moved, ["asset"], "day", "price_pct")
    big = lambda t: F.coalesce(F.abs("price_pct") >= t, F.lit(False))
    return out.select(day_text(), "asset", "repeats_previous", "repeats_next", "reversal", big(0.10).alias("move_10"), big(0.20).alias("move_20"))


@register(
    "expanding_window",
    f"WITH {SERIES_SQL} SELECT CAST(day AS VARCHAR) AS day, asset, CAST(min(day) OVER w AS VARCHAR) AS train_start, CAST(max(day) OVER w AS VARCHAR) AS train_end, count(price) OVER w AS train_n, round(avg(price) OVER w, 6) AS price_mean FROM series WINDOW w AS (PARTITION BY asset ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def expanding_window(spark, sf_dir):
    out = series.expanding(base_series(spark, sf_dir), ["asset"], "day", "price")
    return out.select(day_text(), "asset", day_text("train_start"), day_text("train_end"), "train_n", r6("price_mean"))


@register(
    "forecast_origins",
    f"WITH {SERIES_SQL}, n AS (SELECT *, row_number() OVER {W} AS rn FROM series), o AS (SELECT asset, day, row_number() OVER {W} AS number FROM n WHERE rn > 100) SELECT CAST(n.day AS VARCHAR) AS day, n.asset, number AS forecast_number, CASE WHEN number IS NULL THEN 'training' ELSE 'evaluation' END AS period FROM n LEFT JOIN o USING (asset, day)",
)
def forecast_origins(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("asset").orderBy("day")
    base = base_series(spark, sf_dir).select("day", "asset").withColumn("rn", F.row_number().over(w))
    number = F.when(F.col("rn") > 100, F.col("rn") - 100).cast("long")
    return base.select(day_text(), "asset", number.alias("forecast_number"), F.when(number.isNull(), "training").otherwise("evaluation").alias("period"))


@register("cumulative_volume", f"WITH {SERIES_SQL} SELECT CAST(day AS VARCHAR) AS day, asset, round(sum(volume) OVER (PARTITION BY asset ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS cumulative_volume FROM series")
def cumulative_volume(spark, sf_dir):
    return series.running_sum(base_series(spark, sf_dir), ["asset"], "day", ["volume"]).select(day_text(), "asset", F.round("cumulative_volume", 4).alias("cumulative_volume"))


@register("dense_rank", "SELECT n_regionkey, n_name, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY length(n_name) DESC) AS rank FROM nation")
def dense_rank(spark, sf_dir):
    out = load(spark, sf_dir, "nation").withColumn("size", F.length("n_name"))
    return series.rank_within(out, ["n_regionkey"], "size").select("n_regionkey", "n_name", F.col("rank").cast("long").alias("rank"))


@register(
    "alternative_lags",
    f"WITH {CHANGES_SQL} SELECT CAST(day AS VARCHAR) AS day, asset, round(ret, 6) AS lag_1, round(lag(ret, 1) OVER {W}, 6) AS lag_2, round(lag(ret, 2) OVER {W}, 6) AS lag_3, round(lag(ret, 6) OVER {W}, 6) AS lag_7 FROM r",
)
def alternative_lags(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("asset").orderBy("day")
    further = {k: F.lag("ret", k - 1).over(w) if k > 1 else F.col("ret") for k in (1, 2, 3, 7)}
    return modelling(spark, sf_dir).select(day_text(), "asset", *(r6(c, f"lag_{k}") for k, c in further.items()))


@register(
    "first_occurrence",
    """WITH k AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS key FROM documents)
SELECT doc_id, key <> '' AND row_number() OVER (PARTITION BY lang_key, key ORDER BY doc_id) > 1 AS later_copy, CASE WHEN key <> '' THEN count(*) OVER (PARTITION BY lang_key, key) ELSE 0 END AS copies FROM (SELECT k.*, substr(source, 1, 4) AS lang_key FROM k)""",
)
def first_occurrence(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]", " "), " +", " "))
    digest = F.when(F.col("key") != "", F.unhex(F.md5(F.col("key").cast("binary"))))
    # Texts are read and cleaned once; what is grouped and joined has 16 bytes for each.
    base = docs.select("doc_id", F.substring("source", 1, 4).alias("lang_key"), key.alias("key")).select("doc_id", "lang_key", digest.alias("digest"))
    return series.duplicates(kept(base, "digests"), ["lang_key", "digest"], ["doc_id"], F.col("digest").isNotNull()).select("doc_id", "later_copy", F.col("copies").cast("long").alias("copies"))
