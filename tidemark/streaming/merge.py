"""Keyed merge of a stream into a table of hash buckets: a micro-batch rewrites the buckets it touches and no others.

A table is a folder: `data/<version>/bucket=<b>` holds a bucket's rows as of a version, `manifest/<version>` names each
bucket's current version and is created whole, last. Readers follow the newest manifest, so they see a batch altogether or
not at all, and a batch that is run again after a failure leaves the same rows. A bucket is read, merged and written by a
task or a few; how many rows it has is the table's size over the number of buckets, which is chosen once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Create a file whole: written beside its place and renamed."""
    fs, final = _fs(spark, path)
    _, aside = _fs(spark, f"{final.getParent()}/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(aside, final):
        raise FileExistsError(path)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(n for f in fs.listStatus(at) if not (n := f.getPath().getName()).startswith((".", "_"))) if fs.exists(at) else []


def manifest(spark: SparkSession, table: str) -> dict | None:
    """The newest manifest: version, buckets (their number), schema, and current (bucket -> version)."""
    there = _names(spark, f"{table}/manifest")
    return json.loads("".join(r.value for r in spark.read.text(f"{table}/manifest/{there[-1]}").collect())) if there else None


def _paths(table: str, current: dict, buckets: list[str]) -> list[str]:
    return [f"{table}/data/{current[b]}/bucket={b}" for b in buckets if b in current]


def read(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows."""
    now = manifest(spark, table)
    if now is None:
        raise ValueError(f"{table} has no manifest")
    schema = StructType.fromJson(now["schema"])
    paths = _paths(table, now["current"], list(now["current"]))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def merge(batch: DataFrame, table: str, key: str, order: str, buckets: int = BUCKETS) -> dict:
    """Put `batch` into the table: each key's row of greatest `order` stays. Returns the version
    made and how many buckets it rewrote.
    """
    if "bucket" in batch.columns:
        raise ValueError("a column of the batch is called bucket, as the table's folders are")
    spark = batch.sparkSession
    last = lambda df: df.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
    now = manifest(spark, table) or {"version": -1, "buckets": buckets, "schema": batch.schema.jsonValue(), "current": {}}
    schema = StructType.fromJson(now["schema"])
    placed = last(batch.select(*schema.names)).withColumn("bucket", bucket_of(key, now["buckets"]))
    version = now["version"] + 1
    data = f"{version:08d}-{uuid.uuid4().hex}"
    aside = f"{table}/batch/{data}"
    placed.write.partitionBy("bucket").parquet(aside)
    touched = [n.removeprefix("bucket=") for n in _names(spark, aside) if n.startswith("bucket=")]
    fresh = spark.read.schema(schema).parquet(aside).select(*schema.names) if touched else None
    old = _paths(table, now["current"], touched)
    if touched:
        rows = fresh.unionByName(spark.read.schema(schema).parquet(*old)) if old else fresh
        merged = last(rows).withColumn("bucket", bucket_of(key, now["buckets"]))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{table}/data/{data}")
    now |= {"version": version, "current": now["current"] | dict.fromkeys(touched, data)}
    _put(spark, f"{table}/manifest/{version:08d}", json.dumps(now))
    fs, at = _fs(spark, aside)
    fs.delete(at, True)
    return {"version": version, "touched": len(touched)}


def swept(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Delete what only manifests older than the last `keep` name, and what failed batches left; returns the folders gone."""
    names = _names(spark, f"{table}/manifest")
    for old in names[:-keep]:
        fs, at = _fs(spark, f"{table}/manifest/{old}")
        fs.delete(at, False)
    wanted = set()
    for name in names[-keep:]:
        one = json.loads("".join(r.value for r in spark.read.text(f"{table}/manifest/{name}").collect()))
        wanted |= {f"{v}/bucket={b}" for b, v in one["current"].items()}
    gone = 0
    for version in _names(spark, f"{table}/data"):
        for bucket in _names(spark, f"{table}/data/{version}"):
            if f"{version}/{bucket}" not in wanted:
                fs, at = _fs(spark, f"{table}/data/{version}/{bucket}")
                gone += fs.delete(at, True)
    return gone


def merge_stream(stream: DataFrame, table: str, key: str, order: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Merge every micro-batch of a stream, until all that is there has been taken."""
    stream.writeStream.foreachBatch(lambda batch, _: merge(batch, table, key, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
