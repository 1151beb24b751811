"""Residual diagnostics. Series statistics are sums of lag products; auxiliary regressions reuse the Gram pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probability
from ..functions.scalar import stars
from ..operators import blocks
from .ols import _key_schema, _unpack, fit, gram, residuals, solve

TEST = "test string, statistic double, df double, p_value double"


def durbin_watson(df: DataFrame, u: str, keys: Sequence[str], day: str) -> DataFrame:
    """sum (u_t - u_{t-1})^2 / sum u_t^2."""
    before = F.lag(u).over(Window.partitionBy(*keys).orderBy(day))
    return df.withColumn("__d", F.pow(F.col(u) - before, 2)).groupBy(*keys).agg((F.sum("__d") / F.sum(F.col(u) * F.col(u))).alias("durbin_watson"))


def autocorrelation(df: DataFrame, u: str, keys: Sequence[str], day: str, lags: Sequence[int], block: int | None = None) -> DataFrame:
    """(keys, lag, n, acf, bound): autocorrelations about the overall mean, and 1.96 / sqrt(n).

    With `block`, series are cut into blocks of so many rows, each with copies of the rows that its first ones look back to.
    """
    known = df.where(F.col(u).isNotNull())
    if block is None:
        centred = known.select(*keys, day, (F.col(u) - F.avg(u).over(Window.partitionBy(*keys))).alias("__e"))
    else:
        means = known.groupBy(*keys).agg(F.avg(u).alias("__m"))
        centred = blocks.meet(known.select(*keys, day, F.col(u).alias("__e")), means, keys).withColumn("__e", F.col("__e") - F.col("__m")).drop("__m")
        centred = blocks.haloed(blocks.blocked(centred, keys, day, block), max(lags), 0, block)
    order = blocks.order_of(keys, block, day)
    lagged = centred.withColumns({f"__l{k}": F.col("__e") * F.lag("__e", k).over(order) for k in lags})
    lagged = lagged if block is None else blocks.owned(lagged)
    got = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__e") * F.col("__e")).alias("v"), *(F.coalesce(F.sum(f"__l{k}"), F.lit(0.0)).alias(f"g{k}") for k in lags))
    items = F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"g{k}"), F.col("v")).alias("acf")) for k in lags))
    return got.select(*keys, "n", F.inline(items)).withColumn("bound", 1.96 / F.sqrt("n"))


def ljung_box(df: DataFrame, u: str, keys: Sequence[str], day: str, lags: Sequence[int] = (1, 3, 7, 14, 30), block: int | None = None) -> DataFrame:
    """Q = n (n + 2) sum_{k <= lag} acf_k^2 / (n - k), chi-square with `lag` degrees."""
    acf = autocorrelation(df, u, keys, day, range(1, max(lags) + 1), block)
    sums = acf.groupBy(*keys, "n").agg(*(F.sum(F.when(F.col("lag") <= m, F.pow("acf", 2) / (F.col("n") - F.col("lag")))).alias(f"q{m}") for m in lags))
    items = F.array(*(F.struct(F.lit(m).alias("lag"), (F.col("n") * (F.col("n") + 2) * F.col(f"q{m}")).alias("q")) for m in lags))
    return with_chi2(sums.select(*keys, "n", F.inline(items)), "q", "lag")


def with_chi2(df: DataFrame, statistic: str, degrees: str) -> DataFrame:
    """Adds p_value, the upper tail of chi-square; a few rows a model."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([probability.chi2_sf(a, b) if a == a else float("nan") for a, b in zip(x, d, strict=True)])

    return df.withColumn("p_value", tail(F.col(statistic), F.col(degrees).cast("double")))


def jarque_bera(df: DataFrame, u: str, keys: Sequence[str]) -> DataFrame:
    """n / 6 (skew^2 + kurt^2 / 4) with population moments; chi-square with two degrees: p = exp(-JB / 2)."""
    got = df.groupBy(*keys).agg(F.count(u).alias("n"), F.skewness(u).alias("skew"), F.kurtosis(u).alias("kurt"))
    jb = F.col("n") / 6 * (F.pow("skew", 2) + F.pow("kurt", 2) / 4)
    return got.withColumn("jarque_bera", jb).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))


def _auxiliary(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], name: str, degrees: int | None = None) -> DataFrame:
    """LM = n R^2 of an auxiliary regression and its F form; predictors without spread of their own drop out."""
    grams, k = gram(df, y, xs, keys), len(xs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                n, cy, c, xx, xy, yy = _unpack(row, k)
                scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
                live: list[int] = []
                for i in range(k):  # keep what isn't a combination of those before
                    if np.diag(xx)[i] > 1e-12 and np.linalg.matrix_rank((xx / np.outer(scale, scale))[np.ix_([*live, i], [*live, i])], tol=1e-10) == len(live) + 1:
                        live.append(i)
                f = solve(n, cy, c[live], xx[np.ix_(live, live)], xy[live], yy)
                if f is None:
                    continue
                d = degrees or len(live)
                lm = n * f["r2"]
                fs = (f["r2"] / len(live)) / ((1 - f["r2"]) / (n - len(live) - 1))
                own = [getattr(row, x) for x in keys]
                out.append((*own, name, lm, float(d), probability.chi2_sf(lm, d)))
                out.append((*own, f"{name} F", fs, float(len(live)), probability.f_sf(fs, len(live), n - len(live) - 1)))
            yield pd.DataFrame(out, columns=[*keys, "test", "statistic", "df", "p_value"])

    return grams.mapInPandas(run, _key_schema(grams, keys) + TEST)


def breusch_pagan(res: DataFrame, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Squared residuals on the predictors."""
    return _auxiliary(res.withColumn("__u2", F.pow("residual", 2)), "__u2", xs, keys, "Breusch-Pagan")


def white(res: DataFrame, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Squared residuals on predictors, squares and cross-products."""
    products = {f"__p{i}_{j}": F.col(xs[i]) * F.col(xs[j]) for i, j in combinations_with_replacement(range(len(xs)), 2)}
    wide = res.withColumns(products | {"__u2": F.pow("residual", 2)})
    return _auxiliary(wide, "__u2", [*xs, *products], keys, "White")


def breusch_godfrey(res: DataFrame, xs: Sequence[str], lags: int, keys: Sequence[str], day: str) -> DataFrame:
    """Residuals on predictors and their own lags (0 before the start); chi-square with `lags` degrees."""
    w = Window.partitionBy(*keys).orderBy(day)
    wide = res.withColumns({f"__u{k}": F.coalesce(F.lag("residual", k).over(w), F.lit(0.0)) for k in range(1, lags + 1)})
    return _auxiliary(wide, "residual", [*xs, *(f"__u{k}" for k in range(1, lags + 1))], keys, f"Breusch-Godfrey {lags}", lags)


def all_tests(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], day: str) -> DataFrame:
    """Every heteroscedasticity and serial-correlation test of one model as rows (keys, test, statistic, df, p_value, label)."""
    res = residuals(df, y, xs, keys)
    jb = jarque_bera(res, "residual", keys).select(*keys, F.lit("Jarque-Bera").alias("test"), F.col("jarque_bera").alias("statistic"), F.lit(2.0).alias("df"), "p_value")
    lb = ljung_box(res, "residual", keys, day).select(*keys, F.concat(F.lit("Ljung-Box "), F.col("lag")).alias("test"), F.col("q").alias("statistic"), F.col("lag").cast("double").alias("df"), "p_value")
    out = breusch_pagan(res, xs, keys).unionByName(white(res, xs, keys)).unionByName(jb).unionByName(lb)
    for lags in (1, 3, 7):
        out = out.unionByName(breusch_godfrey(res, xs, lags, keys, day))
    return out.withColumn("label", stars("p_value"))


def compare_inference(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], day: str, lags: int = 7) -> DataFrame:
    """Ordinary against HAC standard errors and p-values."""
    take = lambda d, s: d.select(*keys, "parameter", F.col("se").alias(f"se_{s}"), F.col("p_value").alias(f"p_{s}"))
    both = take(fit(df, y, xs, keys, day, lags=None), "ols").join(take(fit(df, y, xs, keys, day, lags=lags, correction=False, use_t=True), "hac"), [*keys, "parameter"])
    return both.withColumns({"se_ratio": F.col("se_hac") / F.col("se_ols"), "verdict_changes": (F.col("p_ols") < 0.05) != (F.col("p_hac") < 0.05)})
