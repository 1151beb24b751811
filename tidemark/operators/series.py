"""Window operators over ordered series. Every window is partitioned by the series' keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import log_return, percent_change
from . import blocks


def ordered(keys: Sequence[str], *order) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def lags(df: DataFrame, keys: Sequence[str], day: str, columns: Sequence[str], steps: Sequence[int] = (1, 2, 3, 7), source: str | None = None) -> DataFrame:
    """`column_lag_k` for every column and step, and `source_lag_k`, the day they come from. Rows must be a complete calendar."""
    w = ordered(keys, day)
    new = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in steps}
    if source:
        new |= {f"{source}_lag_{k}": F.lag(day, k).over(w) for k in steps}
    return df.withColumns(new)


def changes(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Log return, percent change, first difference, days since the row before, and the next row's value."""
    w = ordered(keys, day)
    before = F.lag(value).over(w)
    return df.withColumns(
        {
            f"{value}_return": log_return(F.col(value), before),
            f"{value}_pct": percent_change(F.col(value), before),
            f"{value}_diff": F.col(value) - before,
            "gap_days": F.datediff(F.col(day), F.lag(day).over(w)),
            f"{value}_next": F.lead(value).over(w),
        }
    )


def local_median(df: DataFrame, keys: Sequence[str], day: str, value: str, half: int = 3, least: int = 3, out: str = "local_median", block: int | None = None) -> DataFrame:
    """The exact median of the rows from `half` before to `half` after, where at least `least` have values.

    With `block`, a series is cut into blocks of so many rows, each with copies of the neighbours' edge rows.
    """
    rows = df if block is None else blocks.haloed(blocks.blocked(df, keys, day, block), half, half, block)
    w = blocks.order_of(keys, block, day).rowsBetween(-half, half)
    done = rows.withColumn(out, F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))
    return done if block is None else blocks.owned(done)


def runs(df: DataFrame, keys: Sequence[str], day: str, value: str, block: int | None = None) -> DataFrame:
    """Runs of equal values: start, end, length and value (gaps and islands).

    With `block`, each block gives its runs, and those that meet at a block's edge are joined: a run is a row a block,
    numbered over a table of runs, so one of any length spreads over tasks.
    """
    if block is not None:
        df = blocks.haloed(blocks.blocked(df, keys, day, block), 1, 0, block)
    w = blocks.order_of(keys, block, day)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__changed", changed)
    if block is None:
        numbered = marked.withColumn("run", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        # A run's number is how many have begun by then; the copied row before a block begins none of the block's.
        numbered = blocks.running(marked.where(F.col(blocks.OWN)), keys, {"run": ("sum", F.col("__changed"))})
    return numbered.groupBy(*keys, "run").agg(F.min(day).alias("run_start"), F.max(day).alias("run_end"), F.count(F.lit(1)).alias("run_length"), F.min_by(value, day).alias("run_value"))


def stale(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Whether a value repeats its neighbour before or after."""
    w = ordered(keys, day)
    near = lambda c: F.coalesce(F.col(value) == c, F.lit(False))
    return df.withColumns({"repeats_previous": near(F.lag(value).over(w)), "repeats_next": near(F.lead(value).over(w))})


def reversal(df: DataFrame, keys: Sequence[str], day: str, change: str, now: float = 0.15, following: float = 0.15) -> DataFrame:
    """Whether a large move is answered by a large opposite one in the next row."""
    after = F.lead(change).over(ordered(keys, day))
    flag = (F.abs(change) >= now) & (F.abs(after) >= following) & (F.signum(change) != F.signum(after))
    return df.withColumn("reversal", F.coalesce(flag, F.lit(False)))


def expanding(df: DataFrame, keys: Sequence[str], day: str, value: str, block: int | None = None) -> DataFrame:
    """Start, end, size and mean of everything before each row: what a forecast at that row may use.

    With `block`, prefix sums over blocks of so many rows in place of one window a series.
    """
    if block is not None:
        wanted = {"train_start": ("min", F.col(day)), "train_end": ("max", F.col(day)), "train_n": ("count", F.col(value)), "__sum": ("sum", F.col(value))}
        done = blocks.running(blocks.blocked(df, keys, day, block), keys, wanted, current=False)
        return done.withColumn(f"{value}_mean", F.try_divide(F.col("__sum"), F.col("train_n"))).drop("__sum", blocks.RN, blocks.BLOCK)
    w = ordered(keys, day).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({"train_start": F.min(day).over(w), "train_end": F.max(day).over(w), "train_n": F.count(value).over(w), f"{value}_mean": F.avg(value).over(w)})


def running_sum(df: DataFrame, keys: Sequence[str], day: str, columns: Sequence[str], block: int | None = None) -> DataFrame:
    if block is not None:
        done = blocks.running(blocks.blocked(df, keys, day, block), keys, {f"cumulative_{c}": ("sum", F.col(c)) for c in columns})
        return done.drop(blocks.RN, blocks.BLOCK)
    w = ordered(keys, day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"cumulative_{c}": F.sum(c).over(w) for c in columns})


def _text(df: DataFrame, name: str) -> Column:
    """A column as text, digests as their digits."""
    return F.hex(name) if dict(df.dtypes)[name] == "binary" else F.col(name).cast("string")


def duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str], usable: Column) -> DataFrame:
    """later_copy (not the first of its keys by the unique `order`) and copies (size of the group, 0 where not usable).

    Groups are told by 128 bits of their keys' digest (null apart from ''), so that shuffles carry 16 bytes in place of
    texts. They are counted with partial sums and joined back, and a text with a third of all rows splits over tasks,
    which a window over the text would not.
    """
    plain = F.to_json(F.array(*(_text(df, k) for k in keys)), {"ignoreNullFields": "false"})
    keyed = df.withColumn("__group", F.when(usable, F.unhex(F.md5(plain))))
    first = keyed.where(usable).groupBy("__group").agg(F.min(F.struct(*order)).alias("__first"), F.count(F.lit(1)).alias("__n"))
    joined = keyed.join(first.withColumnRenamed("__group", "__of"), F.col("__group") == F.col("__of"), "left")
    new = {"later_copy": F.coalesce(usable & (F.struct(*order) != F.col("__first")), F.lit(False)), "copies": F.when(usable, F.col("__n")).otherwise(0)}
    return joined.withColumns(new).drop("__first", "__n", "__group", "__of")


def rank_within(df: DataFrame, keys: Sequence[str], by: str, out: str = "rank", descending: bool = True) -> DataFrame:
    order = F.col(by).desc() if descending else F.col(by)
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each group: row_number() <= k is cut on the map side too."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= k)


def stratified(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum, by a hash of key and seed: the same rows whatever the partitions."""
    return top_per_group(df, strata, [F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), F.col(key)], n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key)
