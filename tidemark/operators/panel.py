"""Daily panels: aggregation to day x entity, the complete calendar, coverage, and why a day is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .summary import with_median


def grid(df: DataFrame, day: str, keys: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Every day from `start` to `end` (the frame's own range where not given) for every key."""
    entities = df.select(*keys).distinct()
    bounds = df.agg(F.min(day).cast("date").alias("a"), F.max(day).cast("date").alias("b"))
    first, last = (F.lit(x).cast("date") if x else F.col(c) for x, c in ((start, "a"), (end, "b")))
    days = bounds.select(F.explode(F.sequence(first, last)).alias(day))
    return days.crossJoin(entities)  # calendar x entities is the result asked for; which side is sent around goes by size


def complete(df: DataFrame, day: str, keys: Sequence[str], zero: Sequence[str] = (), **bounds) -> DataFrame:
    """The frame on the complete calendar; `zero` columns are 0 on days without a row, others null."""
    out = grid(df, day, keys, **bounds).join(df, [day, *keys], "left")
    return out.na.fill(0, list(zero)) if zero else out


def daily_scores(rows: DataFrame, day: str, keys: Sequence[str], score: str, label: Column) -> DataFrame:
    """Counts, mean, median, spread and class shares of scored rows per day and key."""
    of = lambda name: F.count_if(label == name)
    counted = rows.groupBy(day, *keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(score).alias("mean_score"),
        F.stddev_samp(score).alias("std_score"),
        of("positive").alias("n_positive"),
        of("neutral").alias("n_neutral"),
        of("negative").alias("n_negative"),
    )
    shares = {f"share_{c}": F.col(f"n_{c}") / F.col("n_rows") for c in ("positive", "neutral", "negative")}
    whole = with_median(counted, rows, [day, *keys], score, "median_score")
    return whole.withColumns(shares | {"activity": F.log1p("n_rows")})


def observation_status(raw: Column, retained: Column, excluded: Column, covered: Column) -> Column:
    """Why a day has or lacks a value: observed, all excluded, truly none, outside the source, or inconsistent."""
    return (
        F.when(~covered, "OUTSIDE_SOURCE_COVERAGE")
        .when(retained > 0, "OBSERVED_RETAINED_ROWS")
        .when((raw > 0) & (retained == 0) & (excluded == raw), "RAW_ROWS_ALL_EXCLUDED")
        .when((raw == 0) & (retained == 0) & (excluded == 0), "GENUINE_ZERO_OBSERVED_ACTIVITY")
        .otherwise("INCONSISTENT")
    )


def with_status(panel: DataFrame, raw: str, retained: str, excluded: str, covered: Column, count_out: str, scores: Sequence[str]) -> DataFrame:
    """Adds status; counts are 0 on true zero days and null outside coverage; scores are never filled."""
    status = observation_status(F.col(raw), F.col(retained), F.col(excluded), covered)
    out = panel.withColumn("status", status)
    seen = F.col("status") == "OBSERVED_RETAINED_ROWS"
    counts = F.when(F.col("status") != "OUTSIDE_SOURCE_COVERAGE", F.when(seen, F.col(retained)).otherwise(0))
    return out.withColumns({count_out: counts, "log_activity": F.log1p(counts), **{s: F.when(seen, F.col(s)) for s in scores}})


def coverage(panel: DataFrame, keys: Sequence[str], has: Column) -> DataFrame:
    """Days with and without rows per key, and the share with."""
    out = panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.count_if(has).alias("n_with"))
    return out.withColumns({"n_without": F.col("n_days") - F.col("n_with"), "pct_with": 100.0 * F.col("n_with") / F.col("n_days")})


def rebuilt_mean(daily: DataFrame, keys: Sequence[str], mean: str, n: str) -> DataFrame:
    """The mean over all rows from daily means and counts."""
    return daily.groupBy(*keys).agg((F.sum(F.col(mean) * F.col(n)) / F.sum(n)).alias("rebuilt_mean"), F.sum(n).alias("n_rows"))
