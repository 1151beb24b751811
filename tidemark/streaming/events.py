"""Structured Streaming twins of the daily panel: windows with watermarks, deduplication, upserts, stateful means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet file at `path`, or the files of that folder, as a stream.

    Unless `files_per_trigger` is given, all files that are there make one batch, so that none of their rows is late.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """The watermark wants a timestamp with zone; one without is read in the session's zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and means per window and key; state of windows older than `late` is dropped."""
    marked = _marked(events, ts, late)
    return marked.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean")


def sliding(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    marked = _marked(events, ts, late)
    return marked.groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of events of a key that lie less than `gap` apart."""
    marked = _marked(events, ts, late)
    return marked.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return _marked(events, ts, late).dropDuplicatesWithinWatermark(keys)


#: Rows of a group that are put out at once.
ROWS = 10_000


def _sortable(column: pd.Series) -> np.ndarray:
    """A plain array in the column's order, missing values last."""
    if column.dtype.kind in "iufM" and isinstance(column.dtype, np.dtype):
        return column.to_numpy()
    codes = pd.factorize(column, sort=True)[0]
    return np.where(codes < 0, len(codes), codes)


def expanding_means(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """For each event the mean of the key's values before it: state is a count and a sum.

    Events of one micro-batch count in the given order, and after those of earlier batches: "before" is what had come by
    then, so a late event sees all that came before it, not only what is older. A key's rows of one batch are sorted
    together in one worker: bound batches by files where keys are few. estimates.reestimated() waits for the watermark
    instead, holds one bucket of time at once, and takes late rows in their place.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        parts: dict[str, list[pd.Series]] = {c: [] for c in (*order, value)}
        for frame in frames:
            for c, of in parts.items():
                of.append(frame[c])
        # A column at a time, by its own plain array: a key's rows are held once, and put out in slices.
        columns = {c: pd.concat(parts.pop(c), ignore_index=True) for c in list(parts)}
        by = np.lexsort([_sortable(columns[c]) for c in reversed(order)])
        values = columns.pop(value).to_numpy(float, na_value=np.nan)[by]
        known = ~np.isnan(values)
        counts = n + np.concatenate(([0], np.cumsum(known)))
        sums = np.cumsum(np.concatenate(([total], np.where(known, values, 0.0))))
        state.update((int(counts[-1]), float(sums[-1])))
        for at in range(0, len(by), ROWS):
            here = by[at : at + ROWS]
            before, so_far = counts[at : at + len(here)], sums[at : at + len(here)]
            means = pd.Series(so_far / np.maximum(before, 1), dtype="Float64").mask(before == 0)
            out = {c: columns[c].iloc[here].reset_index(drop=True) for c in order}
            yield pd.DataFrame({key: pd.Series([group[0]] * len(here), dtype=object), **out, "n_before": before, "mean_before": means})

    kind = dict(events.dtypes)
    columns = "".join(f"`{c}` {kind[c]}, " for c in [key, *order])
    return events.groupBy(key).applyInPandasWithState(step, columns + "n_before long, mean_before double", "n long, total double", "append", GroupStateTimeout.NoTimeout)


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run over all that is there, then stop; a rerun goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, table: str) -> DataFrame:
    """The table that upsert_batches() keeps."""
    return spark.read.parquet(f"{table}/v={_versions(spark, table)[-1]}")


def _versions(spark: SparkSession, table: str) -> list[int]:
    """The complete versions in a folder, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(made(f"{table}/{n}/_SUCCESS")))


def upsert_batches(stream: DataFrame, table: str, key: str, order: str, checkpoint: str) -> None:
    """Keyed upsert of every micro-batch: each key's row of greatest `order` stays, whatever came first.

    A batch writes a new version of the table and deletes those before the last one. Running a batch again, or the whole
    stream, leaves the same rows, since a row only gives way to one of greater order.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = _versions(spark, table)
        rows = batch.unionByName(spark.read.parquet(f"{table}/v={before[-1]}")) if before else batch
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")
        version = before[-1] + 1 if before else 0
        last.write.mode("overwrite").parquet(f"{table}/v={version}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for old in before[:-1]:
            gone = path(f"{table}/v={old}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
