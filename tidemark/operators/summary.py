"""Summaries: descriptive statistics, missingness, correlation, overlaps, shares, classification metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .blocks import meet
from .frames import unpivot


def sample_skewness(c: str) -> Column:
    """Bias-corrected skewness (G1); null under three values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis (G2); null under four values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


PERCENTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, q): exact percentiles, interpolated, of the non-null values of each key.

    Counts of distinct values are dealt by range of key and value; a block's counts add up within it, and blocks over a
    table of one row each. So a key of any size spreads over tasks, and none holds a key's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = counts.repartitionByRange(*keys, "__v").withColumn("__block", F.spark_partition_id())
    dealt = kept(dealt, "value-counts")  # the blocks must not be dealt anew
    blocks = dealt.groupBy(*keys, "__block").agg(F.sum("__n").alias("__size"))
    of_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__size").over(of_key.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"__before": before, "__all": F.sum("__size").over(of_key)})
    renamed = blocks.withColumnsRenamed({k: f"__of_{k}" for k in keys} | {"__block": "__at"})
    on = (F.col("__block") == F.col("__at")) & reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys), F.lit(True))
    placed = dealt.join(renamed, on).withColumn("__upto", F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__block").orderBy("__v")))
    at = lambda rank: F.max(F.when((F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto")), F.col("__v")))
    place = [F.lit(p) * (F.col("__all") - 1) for p in shares]
    ends = {f"__lo{i}": at(F.floor(x)) for i, x in enumerate(place)} | {f"__hi{i}": at(F.ceil(x)) for i, x in enumerate(place)}
    got = placed.groupBy(*keys).agg(F.max("__all").alias("__all"), *(c.alias(n) for n, c in ends.items()))
    between = lambda i, x: F.col(f"__lo{i}") + (x - F.floor(x)) * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))
    return got.select(*keys, F.array(*(between(i, x) for i, x in enumerate(place))).alias("q"))


def with_median(got: DataFrame, df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """`got` (a row a group of `df`) with each group's exact median, which no task gathers."""
    return meet(got, percentiles(df, keys, value, [0.5]).select(*keys, F.col("q")[0].alias(name)), keys)


def describe(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key and column: size, moments, extremes, exact percentiles, zeros."""
    long = unpivot(df, keys, columns)
    got = long.groupBy(*keys, "variable").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        sample_skewness("value").alias("skew"),
        sample_kurtosis("value").alias("kurt"),
        F.count_if(F.col("value") == 0).alias("n_zero"),
    )
    ranks = percentiles(long, [*keys, "variable"], "value", PERCENTS).withColumnsRenamed({k: f"__of_{k}" for k in [*keys, "variable"]})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in [*keys, "variable"]))
    both = got.join(ranks, on, "left")
    return both.select(*keys, "variable", "n", "mean", "std", "minimum", *(F.col("q")[i].alias(f"p{int(100 * p):02d}") for i, p in enumerate(PERCENTS)), "maximum", "skew", "kurt", "n_zero")


def grouped_scores(df: DataFrame, keys: Sequence[str], score: str, extra: Sequence[str] = ()) -> DataFrame:
    got = df.groupBy(*keys).agg(
        F.count(score).alias("n"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
        F.min(score).alias("minimum"),
        F.max(score).alias("maximum"),
        *(F.avg(c).alias(f"mean_{c}") for c in extra),
    )
    return with_median(got, df, keys, score, "median").select(*keys, "n", "mean", "median", "std", "minimum", "maximum", *(f"mean_{c}" for c in extra))


def missingness(df: DataFrame, keys: Sequence[str], columns: Sequence[str], day: str) -> DataFrame:
    """Rows, missing values, their share, first and last day with a value, per column."""
    long = unpivot(df, [*keys, day], columns)
    there = F.when(F.col("value").isNotNull(), F.col(day))
    got = long.groupBy(*keys, "variable").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.min(there).alias("first_day"), F.max(there).alias("last_day"))
    return got.withColumn("pct_missing", 100.0 * F.col("n_missing") / F.col("n_rows"))


def correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairwise-complete Pearson correlations of all pairs, from one pass: (keys, first, second, r)."""
    pairs = list(combinations(columns, 2))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    wide = df.groupBy(*keys).agg(*(F.corr(F.when(both(a, b), F.col(a).cast("double")), F.when(both(a, b), F.col(b).cast("double"))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    items = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return wide.select(*keys, F.inline(items))


def matrix(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long pairs as a symmetric matrix with ones on the diagonal, one row per name."""
    spark = pairs.sparkSession
    own = spark.createDataFrame([(n, n, 1.0) for n in names], "first string, second string, r double")
    every = pairs.select("first", "second", "r").unionAll(pairs.select(F.col("second"), F.col("first"), "r")).unionAll(own)
    return every.groupBy(F.col("first").alias("variable")).pivot("second", list(names)).agg(F.first("r"))


def high_correlations(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.abs("r") >= threshold)


def overlaps(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """How many rows have both of any two flags: one pass, one row per ordered pair."""
    pairs = [(a, b) for a in flags for b in flags]
    wide = df.agg(*(F.count_if(F.col(a) & F.col(b)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(a).alias("flag"), F.lit(b).alias("other"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)))))


def shares(df: DataFrame, group: Sequence[str], part: Sequence[str]) -> DataFrame:
    """Rows per group and part, and their share of the group."""
    counted = df.groupBy(*group, *part).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*group)) if group else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.withColumn("share", F.col("n") / whole)


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts, 0 where none, and row totals."""
    wide = df.groupBy(rows).pivot(columns, list(values)).count().na.fill(0)
    return wide.withColumn("total", sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`")))


def representation_shift(df: DataFrame, part: str, retained: str) -> DataFrame:
    """Each part's share of all rows and of the retained ones, and the change in percentage points."""
    n, k = df.groupBy(part).agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col(retained)).alias("n_retained")), Window.partitionBy(F.lit(1))
    raw, kept = 100.0 * F.col("n_raw") / F.sum("n_raw").over(k), 100.0 * F.col("n_retained") / F.sum("n_retained").over(k)
    return n.select(part, "n_raw", "n_retained", raw.alias("raw_pct"), kept.alias("retained_pct"), (kept - raw).alias("shift_pp"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and support of each class."""
    cells = confusion(df, actual, predicted)
    sides = cells.select(F.col(actual).alias("label"), F.lit(0).alias("p"), F.col("n").alias("a"), F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
    other = cells.select(F.col(predicted).alias("label"), F.col("n").alias("p"), F.lit(0).alias("a"), F.lit(0).alias("hit"))
    got = sides.unionAll(other).groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("a").alias("support"), F.sum("p").alias("predicted"))
    or_zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = or_zero(F.col("hit"), F.col("predicted")), or_zero(F.col("hit"), F.col("support"))
    return got.select("label", "support", precision.alias("precision"), recall.alias("recall"), or_zero(2 * precision * recall, precision + recall).alias("f1"))


def agreement(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, macro F1 and Cohen's kappa, one row."""
    cells = confusion(df, actual, predicted)
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    rows = cells.groupBy(F.col(actual).alias("label")).agg(F.sum("n").alias("a"))
    cols = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("p"))
    chance = rows.join(cols, "label").agg(F.coalesce(F.sum(F.col("a") * F.col("p")), F.lit(0)).alias("cross"))
    macro = class_metrics(df, actual, predicted).agg(F.avg("f1").alias("macro_f1"))
    one = total.crossJoin(F.broadcast(chance)).crossJoin(F.broadcast(macro))  # one row each
    accuracy, expected = F.col("hit") / F.col("total"), F.col("cross") / (F.col("total") * F.col("total"))
    return one.select(accuracy.alias("accuracy"), "macro_f1", F.try_divide(accuracy - expected, 1 - expected).alias("kappa"))
