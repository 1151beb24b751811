"""Queries over kept state and tables that streams write: re-estimation at each origin, keyed merges, late rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import ORACLE_SQL, register
from ..session import load, scratch
from ..streaming import estimates, events, late, merge
from .base import modelling, r6
from .statistics import START


def _in_pieces(spark, rows, piece):
    """`rows` as a folder of files, one for each value of `piece`, in its order; streams read a file a batch."""
    folder = scratch(spark, "pieces")
    parts = rows.withColumn("__piece", piece)
    for (value,) in sorted(parts.select("__piece").distinct().collect()):
        parts.where(F.col("__piece") == value).drop("__piece").coalesce(1).write.mode("append").parquet(folder)
    return folder


@register("stream_reestimated", ORACLE_SQL["expanding_forecasts"])
def stream_reestimated(spark, sf_dir):
    """The expanding forecasts from kept state: every fifth day of a month comes some years late, after newer days."""
    rows = modelling(spark, sf_dir).select("asset", F.col("day").cast("timestamp").alias("ts"), "ret", "ret_lag")
    years = F.floor((F.year("ts") - 1990) / 3) + (F.dayofmonth("ts") % 5 == 0).cast("int")
    closing = rows.select("asset").distinct().select("asset", F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("ret"), F.lit(None).cast("double").alias("ret_lag"))
    folder = _in_pieces(spark, rows.unionByName(closing), F.when(F.year("ts") == 2200, 999).otherwise(years))
    spark.conf.set(*estimates.STORE)
    try:
        stream = events.read_folder(spark, folder, rows.schema, files_per_trigger=1)
        out = estimates.reestimated(stream, "ret", {"mean": (), "lag": ("ret_lag",)}, ["asset"], "ts", "2300 days", start=START)
        at = scratch(spark, "stream")
        events.run_to_parquet(out, f"{at}/out", f"{at}/checkpoint")
    finally:
        spark.conf.unset(estimates.STORE[0])
    got = spark.read.schema(out.schema).parquet(f"{at}/out")
    return got.select("asset", F.to_date("ts").cast("string").alias("day"), "model", "train_n", *(F.to_date(c).cast("string").alias(c) for c in ("train_start", "train_end")), r6("forecast"), r6("error"))


@register("stream_merged", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_merged(spark, sf_dir):
    """The last event of every user in a table of hash buckets, merged a kind of event at a time, then all over again."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    folder, at = _in_pieces(spark, rows, F.col("event_type")), scratch(spark, "merged")
    for run in range(2):
        stream = events.read_folder(spark, folder, rows.schema, files_per_trigger=None if run else 1)
        merge.merge_stream(stream, f"{at}/table", "user_id", "event_id", f"{at}/checkpoint{run}", buckets=16)
    merge.swept(spark, f"{at}/table")
    return merge.read(spark, f"{at}/table")


#: Events come a kind after the other; a watermark three days behind the latest of earlier kinds makes some of them late.
LATE_SQL = """WITH k AS (SELECT event_type, max(ts) AS latest FROM events GROUP BY 1), m AS (SELECT event_type, max(latest) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 20 DAY AS mark FROM k)"""


@register("stream_late", LATE_SQL + " SELECT event_id, event_type, coalesce(ts < mark, false) AS is_late, CASE WHEN ts < mark THEN round(epoch_us(mark) / 1e6 - epoch_us(ts) / 1e6, 3) END AS late_seconds FROM events JOIN m USING (event_type)")
def stream_late(spark, sf_dir):
    """Every event once, on time or late with its delay, from the two tables that the stream writes."""
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    folder, at = _in_pieces(spark, rows, F.col("event_type")), scratch(spark, "late")
    late.split_stream(events.read_folder(spark, folder, rows.schema, files_per_trigger=1), "ts", "20 days", at, f"{at}/checkpoint")
    ontime = late.on_time(spark, at).select("event_id", "event_type", F.lit(False).alias("is_late"), F.lit(None).cast("double").alias("late_seconds"))
    return ontime.unionByName(late.late(spark, at).select("event_id", "event_type", F.lit(True).alias("is_late"), F.round("late_seconds", 3).alias("late_seconds")))
