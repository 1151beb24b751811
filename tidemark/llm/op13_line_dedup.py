r"""Line deduplication over all documents: two Bloom filters, then an exact check of the lines they suspect.

A line's key is the line without blanks (`[\x20\x09-\x0D]`) at its ends, A-Z lower-cased. Keys of MIN_CHARS code points
or more that stand in at least two documents lose all their lines but those of the document of least id; other lines
stay, joined by \n.

One pass reads the texts and writes the MD5 digests of each document's distinct long keys. A pair of Bloom filters, for
bits set once and twice, is filled from them and merged by bits; a key in two documents has all its bits set twice, so
keys whose bits aren't are out, without a shuffle. What is left, (digest, id) rows of suspected keys, is grouped by digest
(partial sums first, so a line of every document is a row a task): keys with two ids or more are repeats, the least id is
the keeper. Filters have at most MOST_BITS bits: with more keys they suspect more, the rows that shuffle are more, and the
result stays the same. Only texts of documents that a filter of the losing ids lets through move to meet their repeats.

Defined results: a null or empty text is one empty line; a null id is one document after all others; rows that share an
id are one document (each row keeps its own lines, and none gives way to the other); a key repeated within its keeping
document stays as often as it stands there. An empty table gives an empty result. A document's text and digests are one
row, whatever their length. Other columns are kept; columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import bloom
from .common import BLANKS, park, unused

MIN_CHARS = 10
_BLANKS = BLANKS.encode()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digests(lines: list[bytes]) -> list[bytes | None]:
    """The digest of each line's key; None for a short one. Bytes lower A-Z alone."""
    keys = [line.strip(_BLANKS).lower() for line in lines]
    long = lambda k: len(k) >= 4 * MIN_CHARS or len(k) >= MIN_CHARS and len(k.decode("utf-8", "replace")) >= MIN_CHARS
    return [hashlib.md5(k).digest() if long(k) else None for k in keys]


def line_keys(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, digests): each document's distinct digests; documents without one are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [list(filter(None, dict.fromkeys(_digests(t.split(b"\n"))))) for t in part.column(1).to_pylist()]
                has = pa.array([bool(f) for f in found])
                yield pa.RecordBatch.from_arrays([part.column(0).filter(has), pa.array([f for f in found if f], pa.list_(pa.binary()))], names=["doc_id", "digests"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digests array<binary>")


def _id_digest(doc_id: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")))


@F.pandas_udf(StructType([StructField("text", BinaryType()), StructField("n_dropped", LongType())]))
def _without(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
    """Texts without the lines whose digests are gone: a look-up a line, however many a document loses."""
    kept, dropped = [], []
    for text, lost in zip(texts, gone, strict=True):
        lines, lost = text.split(b"\n"), set(lost)
        stay = [line for line, digest in zip(lines, _digests(lines), strict=True) if digest not in lost] if lost else lines
        kept.append(b"\n".join(stay))
        dropped.append(len(lines) - len(stay))
    return pd.DataFrame({"text": kept, "n_dropped": dropped})


def _tasks(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def repeated(docs: DataFrame, text: str = "text", id_col: str = "doc_id", most_bits: int = bloom.MOST_BITS) -> DataFrame:
    """(doc_id, digests): what each document loses; documents that lose nothing are absent."""
    held = park(line_keys(docs, text, id_col), "line-keys")
    n = held.agg(F.sum(F.size("digests"))).first()[0] or 0
    each = held.select("doc_id", F.explode("digests").alias("digest"))
    twice = bloom.seen_twice(each, "digest", bloom.bits_for(n, most_bits), _tasks(docs))
    suspects = park(each.where(bloom.might_hold(docs.sparkSession, twice, F.col("digest"))), "suspects")
    ids = suspects.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other"), F.max(F.col("doc_id").isNull()).alias("nameless"))
    # Written, so that a very common line's rows can be split over tasks where they meet their keeper.
    repeats = park(ids.where((F.col("keeper") < F.col("other")) | (F.col("nameless") & F.col("keeper").isNotNull())).select("digest", "keeper"), "repeats")
    losing = suspects.join(repeats, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return losing.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", most_bits: int = bloom.MOST_BITS) -> DataFrame:
    """`docs` with repeated lines dropped from their texts, and n_lines (before) and n_dropped (long)."""
    spark = docs.sparkSession
    lost = park(repeated(docs, text, id_col, most_bits).select(_id_digest(F.col("doc_id")).alias("key"), "digests"), "lost-lines")
    losers = bloom.filter_of(lost, "key", bloom.bits_for(lost.count(), most_bits), _tasks(docs))
    rows = docs.drop(*(c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")))
    key, gone, maybe, stay = (unused(rows, x) for x in ("key", "gone", "maybe", "stay"))
    marked = rows.withColumn(key, _id_digest(F.col(id_col))).withColumn(maybe, bloom.might_hold(spark, losers, F.col(key)))
    whole = F.coalesce(F.col(text), F.lit(""))
    n_lines = (F.regexp_count(whole, F.lit("\n")) + 1).cast("long")
    same = marked.where(~F.col(maybe)).select(*rows.columns, n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).withColumn(text, whole)
    met = marked.where(F.col(maybe)).join(lost.select(F.col("key").alias(key), F.col("digests").alias(gone)), key, "left")
    # Where the filter was wrong there is no list of lost digests, so every line stays.
    cut = met.withColumn(stay, _without(whole.cast("binary"), F.coalesce(F.col(gone), F.array().cast("array<binary>"))))
    cut = cut.select(*rows.columns, n_lines.alias("n_lines"), F.col(f"{stay}.n_dropped").alias("n_dropped"), F.col(f"{stay}.text").cast("string").alias(stay))
    return same.unionByName(cut.withColumn(text, F.col(stay)).drop(stay))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of the deduplicated `docs`."""
    return deduplicate(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def oracle_sql() -> str:
    """The same in DuckDB SQL, by a window over all lines."""
    return rf"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM lines),
held AS (SELECT key, min(doc_id) AS keeper, count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INT) AS n FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY 1),
judged AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.keeper AS dropped FROM keyed k LEFT JOIN held h ON h.key = k.key AND h.n > 1)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r"""
