"""Costly work in key ranges with a commit log: a killed run goes on at the first range that isn't committed.

A job is a folder: `plan` (the ranges' bounds, written once), `data/<range>-<attempt>` (what an attempt made of a range)
and `log/<range>` (which attempt counts, with its rows). An attempt writes to a folder of its own, is checked, and is
committed by creating its log entry, which only one attempt can do; readers take committed attempts alone. So whatever was
killed, and whenever, each row is worked on once as far as the result shows, and at most one range is done again.

Ranges are cut by counts over range partitions, so each has at most `rows` rows unless one key has more; bounds are
pushed down to the scan of each range.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range: what a kill can cost.
RANGE_ROWS = 1_000_000


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def bounds(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(range, low, high): consecutive key ranges of up to `rows` rows, both ends included. Null keys are in none."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    # Keys are packed within range partitions, whose edges are edges of ranges as well: no key order passes through one task.
    dealt = counts.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    packed = dealt.withColumn("pack", F.floor((F.sum("n").over(order) - 1) / rows)).groupBy("part", "pack").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("n").alias("n"))
    return packed.select("low", "high", "n")


def planned(df: DataFrame, key: str, folder: str, rows: int = RANGE_ROWS) -> list:
    """The job's ranges, in order: those of its plan, or new ones where it has none yet."""
    spark, path = df.sparkSession, f"{folder}/plan"
    if not _exists(spark, f"{path}/_SUCCESS"):
        bounds(df, key, rows).write.mode("overwrite").parquet(path)
    return sorted(spark.read.parquet(path).collect(), key=lambda r: r.low)


def committed(spark: SparkSession, folder: str) -> dict[int, dict]:
    """The log: range -> its attempt and rows."""
    fs, at = _fs(spark, f"{folder}/log")
    if not fs.exists(at) or not len(fs.listStatus(at)):
        return {}
    lines = spark.read.text(f"{folder}/log").collect()
    return {(entry := json.loads(r.value))["range"]: entry for r in lines}


def _commit(spark: SparkSession, folder: str, entry: dict) -> bool:
    """Create the range's log entry whole; False where another attempt was first."""
    fs, temporary = _fs(spark, f"{folder}/pending/{entry['attempt']}")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    _, final = _fs(spark, f"{folder}/log/{entry['range']:08d}")
    if fs.exists(final):
        return False
    fs.mkdirs(final.getParent())
    return bool(fs.rename(temporary, final))


def within(key: str, low, high) -> Column:
    return F.col(key).between(F.lit(low), F.lit(high))


def run(df: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], folder: str, rows: int = RANGE_ROWS, at_most: int | None = None) -> int:
    """Work on the ranges that aren't committed, in order, and return how many now are.

    `work` makes a table of a range's rows and keeps the key. An attempt whose rows aren't as many as the range's is an
    error and isn't committed. `at_most` bounds the ranges of this call (a budget of time, say). The table under `df`
    must not change while its job is unfinished: the plan has its counts, and a range that differs is refused.
    """
    spark = df.sparkSession
    ranges, done = planned(df, key, folder, rows), committed(spark, folder)
    started = 0
    for number, r in enumerate(ranges):
        if number in done:
            continue
        if at_most is not None and started >= at_most:
            break
        started += 1
        attempt = uuid.uuid4().hex
        out = f"{folder}/data/{number:08d}-{attempt}"
        work(df.where(within(key, r.low, r.high))).write.parquet(out)
        made = spark.read.parquet(out).agg(F.count(F.lit(1)), F.count_if(~within(key, r.low, r.high))).first()
        if made[0] != r.n or made[1]:
            raise ValueError(f"range {number} ({r.low} to {r.high}) has {r.n} rows; its attempt made {made[0]}, {made[1]} of other keys")
        _commit(spark, folder, {"range": number, "attempt": attempt, "rows": made[0]})
    return len(committed(spark, folder))


def finished(spark: SparkSession, folder: str) -> bool:
    return _exists(spark, f"{folder}/plan/_SUCCESS") and len(committed(spark, folder)) == spark.read.parquet(f"{folder}/plan").count()


def result(spark: SparkSession, folder: str) -> DataFrame:
    """What the committed attempts made."""
    log = committed(spark, folder)
    if not log:
        raise ValueError(f"no range of {folder} is committed")
    return spark.read.parquet(*(f"{folder}/data/{n:08d}-{e['attempt']}" for n, e in sorted(log.items())))


def swept(spark: SparkSession, folder: str) -> int:
    """Delete what killed attempts left; returns how many there were. Not while a run is going on."""
    fs, at = _fs(spark, f"{folder}/data")
    if not fs.exists(at):
        return 0
    wanted = {f"{n:08d}-{e['attempt']}" for n, e in committed(spark, folder).items()}
    gone = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName() not in wanted]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
