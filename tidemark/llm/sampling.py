"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, longest: int) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """Up to `per_class` (text, label) pairs of each class 0 and 1, by a hash of the id, texts of `longest` characters at most.

    Also the number of ids of each class in the whole table, from which the sample's shares differ. Rows whose label or text is null are passed over; an id with several labels counts by its greatest.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).alias("y"))
    totals = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        own = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = own if picked is None else picked.unionAll(own)
    # At most 2 * per_class ids: small enough to broadcast.
    rows = docs.where(F.length("text") <= longest).select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_class).collect()
    return [(bytes(r["text"]), r["y"]) for r in got], totals
