"""What the operators share: table access, parked intermediate tables, text helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule `[^\x20\x09-\x0D]+`.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and everything runs in one process (tests), a local folder; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"tidemark-{os.getuid()}")
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"


def park(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parked_at = path
    return out


def unpark(df: DataFrame) -> None:
    """Delete a parked table that nothing reads any more."""
    path = getattr(df, "_parked_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use) -> Column:
    """use(value) with `value` evaluated once a row, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def doc_bucket(col: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod `modulus`; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer, where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
