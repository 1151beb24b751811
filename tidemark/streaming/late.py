"""Late rows of a stream kept beside it: what a watermark would drop goes to a table of its own, with its delay.

Each micro-batch is held against the watermark that earlier batches leave: their latest time less the delay allowed. Rows
at or after it go to `on_time`, others to `late`, with the watermark and by how much they missed it; the latest time is
written last, as the batch's mark. A batch that is run again overwrites its own part of both tables and its mark, and
judges by the marks of earlier batches alone, so both tables have each row once, whatever was killed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _marks(spark: SparkSession, folder: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/marks")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("batch bigint, latest timestamp").parquet(f"{folder}/marks")


def watermark(spark: SparkSession, folder: str, batch: int, delay: str):
    """The watermark that batches before `batch` leave; None before the first with a time."""
    marks = _marks(spark, folder)
    if marks is None:
        return None
    return marks.where(F.col("batch") < batch).agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("mark")).first().mark


def split_stream(stream: DataFrame, ts: str, delay: str, folder: str, checkpoint: str) -> None:
    """Run over all that is there. `folder` gets on_time, late and marks. Rows without a time are late, without a delay."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = watermark(spark, folder, number, delay)
        judged = batch.withColumns({"watermark": F.lit(mark).cast("timestamp"), "__at": F.col(ts).cast("timestamp")})
        on_time = F.col("__at").isNotNull() & F.coalesce(F.col("__at") >= F.col("watermark"), F.lit(True))
        judged = judged.withColumn("late_seconds", F.unix_micros("watermark") / 1e6 - F.unix_micros("__at") / 1e6)
        judged.where(on_time).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/on_time/batch={number}")
        judged.where(~on_time).select(*batch.columns, "watermark", "late_seconds").write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        latest = batch.agg(F.max(F.col(ts).cast("timestamp")).alias("latest"))
        latest.select(F.lit(number).cast("bigint").alias("batch"), "latest").coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/n={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def on_time(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that came in time, and the batch each came with."""
    return spark.read.parquet(f"{folder}/on_time")


def late(spark: SparkSession, folder: str) -> DataFrame:
    """The rows behind the watermark, with it and their lateness in seconds, and the batch each came with."""
    return spark.read.parquet(f"{folder}/late")
