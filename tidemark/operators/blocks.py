"""Window operators over series of any length: blocks of rows, with prefix sums over blocks and copies of edge rows.

blocked() numbers a series' rows and cuts it into blocks of `size` rows, however long it is: rows are dealt by range of
key and order, numbered within their range, and what a series has in earlier ranges is added (a row a range). After that

* running() gives prefix sums: within a block by a window, before it by sums over a table of one row a block;
* haloed() copies the rows at a block's edges to its neighbours, so that frames of a few rows see what they need;
* looked_back() brings a row's value from a fixed number of rows before, by a join on the row number.

Windows are then partitioned by (keys, block), and no task holds a series. Short series don't need any of this: callers
take a block size, and None means one window a series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import kept

RN, BLOCK, OWN = "__rn", "__block", "__own"
#: Series longer than this are worth cutting.
SIZE = 1_000_000


def meet(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal columns, nulls among them; `other` gives its further columns."""
    if not on:
        return df.crossJoin(F.broadcast(other))  # no keys: one row
    renamed = other.withColumnsRenamed({c: f"__of_{c}" for c in on})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in on))
    return df.join(renamed, same, how).drop(*(f"__of_{c}" for c in on))


def blocked(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], size: int = SIZE) -> DataFrame:
    """`df` with the row's number in its series (from 1) and its block (from 0); computed once and kept."""
    by = [order] if isinstance(order, str) else list(order)
    dealt = kept(df.repartitionByRange(*keys, *by).withColumn("__part", F.spark_partition_id()), "dealt")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    # Only a series that crosses into a range has rows before it: a row a range at most.
    earlier = F.broadcast(counts.withColumn("__before", F.sum("__n").over(before)).where("__before is not null").drop("__n"))
    numbered = dealt.withColumn(RN, F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*by)))
    placed = meet(numbered, earlier, [*keys, "__part"]).withColumn(RN, F.col(RN) + F.coalesce("__before", F.lit(0)))
    return kept(placed.drop("__part", "__before").withColumn(BLOCK, F.floor((F.col(RN) - 1) / size)), "blocks")


def order_of(keys: Sequence[str], block: int | None, order: str | Sequence[str]) -> WindowSpec:
    """The window of a series, or of its blocks."""
    if block is not None:
        return Window.partitionBy(*keys, BLOCK).orderBy(RN)
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


#: How a frame's own value and that of the blocks before it become one.
JOINED = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
}
_OVER = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
#: Blocks' values are put together by these.
_TOTAL = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, keys: Sequence[str], values: dict[str, tuple[str, Column]], current: bool = True) -> DataFrame:
    """`df` (blocked) with, for each name, its aggregate (sum, count, min, max) over all rows up to this one.

    Without `current`, over all rows before it.
    """
    within = Window.partitionBy(*keys, BLOCK).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, BLOCK).agg(*(_OVER[kind](c).alias(name) for name, (kind, c) in values.items()))
    totals = totals.select(*keys, BLOCK, *(_TOTAL[kind](name).over(before).alias(f"__b_{name}") for name, (kind, _) in values.items())).where(f"{BLOCK} > 0")
    own = df.withColumns({name: _OVER[kind](c).over(within) for name, (kind, c) in values.items()})
    met = meet(own, totals, [*keys, BLOCK])
    return met.withColumns({name: JOINED[kind](F.col(name), F.col(f"__b_{name}")) for name, (kind, _) in values.items()}).drop(*(f"__b_{name}" for name in values))


def haloed(df: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """`df` (blocked by `size`) with copies of the rows that blocks' edge rows need: up to `before` and `after` rows away.

    `__own` tells a block's rows from copies; drop those after the windows. A row goes to each block it is near to.
    """
    to = F.sequence(F.greatest(F.floor((F.col(RN) - 1 - after) / size), F.lit(0)), F.floor((F.col(RN) - 1 + before) / size))
    return df.withColumn("__to", F.explode(to)).withColumn(OWN, F.col("__to") == F.col(BLOCK)).withColumn(BLOCK, F.col("__to")).drop("__to")


def owned(df: DataFrame) -> DataFrame:
    """The rows of haloed() that are no copies, without the helper columns."""
    return df.where(F.col(OWN)).drop(OWN, RN, BLOCK)


def looked_back(df: DataFrame, keys: Sequence[str], columns: dict[str, str], rows: int) -> DataFrame:
    """`df` (blocked) with columns' values of `rows` rows before (name -> column; null where there is none)."""
    past = df.select(*keys, (F.col(RN) + rows).alias(RN), *(F.col(c).alias(name) for name, c in columns.items()))
    return meet(df, past, [*keys, RN])


def firsts(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """`df` (blocked) with values of each series' first row (name -> column)."""
    first = df.where(F.col(RN) == 1).select(*keys, *(F.col(c).alias(name) for name, c in columns.items()))
    return meet(df, first, keys)


def longest(df: DataFrame, keys: Sequence[str]) -> int:
    """The rows of the longest series: what a caller needs to choose a block size by."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
