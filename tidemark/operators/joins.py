"""Joins with checked cardinality, and the strictly backward as-of join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their counts (partial counts first: a hot key costs no single task)."""
    return df.groupBy(*keys).count().where("count > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "frame") -> DataFrame:
    found = duplicate_keys(df, keys).limit(5).collect()
    if found:
        raise ValueError(f"{name} repeats keys {list(keys)}: {[tuple(r) for r in found]}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "one_to_one") -> DataFrame:
    """An equi join after the uniqueness that `validate` asks for (one_to_one, many_to_one, one_to_many) was checked."""
    first, _, second = validate.partition("_to_")
    if first == "one":
        assert_unique(left, on, "left side")
    if second == "one":
        assert_unique(right, on, "right side")
    return left.join(right, list(on), how)


def with_indicator(left: DataFrame, right: DataFrame, on: Sequence[str], name: str = "matched") -> DataFrame:
    """Full outer join with a column that tells which side had the key."""
    l, r = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))  # noqa: E741
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return l.join(r, list(on), "outer").withColumn(name, side).drop("__l", "__r")


def compare_join(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """Join two frames of like columns; each non-key column gets its side's suffix."""
    tag = lambda df, s: df.select(*on, *(F.col(c).alias(c + s) for c in df.columns if c not in on))
    return tag(left, suffixes[0]).join(tag(right, suffixes[1]), list(on), how)


def offset_join(left: DataFrame, right: DataFrame, day: str, days: int, keys: Sequence[str] = ()) -> DataFrame:
    """Each row of `left` with the row of `right` that lies `days` earlier."""
    moved = right.withColumn(day, F.date_add(day, days))
    return left.join(moved, [*keys, day], "left")


def lookup(df: DataFrame, series: DataFrame, key: str, source_key: str, value: str, out: str) -> DataFrame:
    """`df` with `out`: the series' value at the day that `source_key` names."""
    return df.join(series.select(F.col(key).alias(source_key), F.col(value).alias(out)), source_key, "left")


def asof_join(left: DataFrame, right: DataFrame, day: str, values: Sequence[str], by: Sequence[str] = (), source: str = "source_date", strict: bool = True, block: str = "month", allow_age: int | None = None) -> DataFrame:
    """Each row of `left` with the latest row of `right` (same `by`) before its day; with strict=False also of its day.

    The latest *row* counts, even where its values are null. Series are cut into blocks of time: windows run within a
    block, and the last row of each block is carried into later ones over a table of one row per block. So a series of
    any length, or a single one, spreads over tasks; two shuffles, none of them on `by` alone. `source` names the day
    of the row used; rows more than `allow_age` days old give nulls.
    """
    at = F.date_trunc(block, F.col(day)).cast("date")
    keys = [F.col(k) for k in by]
    payload = F.struct(F.col(day).cast("date").alias("d"), *(F.col(v).alias(v) for v in values))
    row_id = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    ours = left.select(*keys, at.alias("__block"), F.col(day).cast("date").alias("__day"), F.lit(0 if strict else 1).alias("__side"), row_id.alias("__row"), F.lit(None).cast(_type(right, payload)).alias("__pay"))
    theirs = right.where(F.col(day).isNotNull()).select(*keys, at.alias("__block"), F.col(day).cast("date").alias("__day"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(left.select(row_id.alias("r")).schema[0].dataType).alias("__row"), payload.alias("__pay"))
    within = Window.partitionBy(*by, "__block").orderBy("__day", "__side")
    seen = ours.unionAll(theirs).withColumn("__in", F.last("__pay", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("__row").isNotNull())
    ends = theirs.groupBy(*by, "__block").agg(F.max_by("__pay", "__day").alias("__end"))
    blocks = ours.select(*by, "__block").distinct().join(ends, [*by, "__block"], "full")
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("__carried", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    on = [seen["__block"].eqNullSafe(carried["__block"]), *(seen[k].eqNullSafe(carried[k]) for k in by)]
    joined = seen.join(carried, on, "left").withColumn("__use", F.coalesce("__in", "__carried"))
    if allow_age is not None:
        joined = joined.withColumn("__use", F.when(F.datediff(seen["__day"], F.col("__use.d")) <= allow_age, F.col("__use")))
    return joined.select("__row.*", *(F.col("__use")[v].alias(v) for v in values), F.col("__use.d").alias(source))


def _type(df: DataFrame, column: Column):
    return df.select(column.alias("x")).schema[0].dataType


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of `left` that `right` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    """Whether both frames hold the same set of keys."""
    return missing_keys(left, right, keys).isEmpty() and missing_keys(right, left, keys).isEmpty()


def append_verified(df: DataFrame, literal: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`df` with the literal rows whose keys it lacks; an error where it holds a different value."""
    clash = df.join(literal.select(*keys, F.col(value).alias("__v")), list(keys)).where(~F.col(value).eqNullSafe(F.col("__v")))
    if not clash.isEmpty():
        raise ValueError(f"rows with other values than the verified ones: {clash.limit(5).collect()}")
    return df.unionByName(literal.join(df.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def upsert(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """`base` with the rows of `batch` in place of those with the same key: keep last."""
    return base.join(batch.select(key), key, "left_anti").unionByName(batch)


def remaining(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet in a checkpoint: what a resumed run works on."""
    return source.join(done.select(key).distinct(), key, "left_anti")
