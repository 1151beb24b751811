"""Least squares with Newey-West covariance.

One pass gives every model's centred cross-products (map-side partial sums, (k+1)(k+2)/2 numbers a model); a solve turns
them into coefficients; a second pass over the rows gives the score products of the Bartlett-weighted covariance. Solves
run in Arrow batches over one row a model. Rows with a missing value in any column of the model are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability
from ..operators import blocks
from ..operators.frames import listwise

COEFFICIENTS = "parameter string, coefficient double, se double, stat double, p_value double, ci_low double, ci_high double, n long, n_parameters int, r2 double, adj_r2 double, llf double, aic double, bic double, ssr double"


def _names(xs: Sequence[str]) -> list[str]:
    return ["const", *xs]


def centres(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.avg(y).alias("__cy"), *(F.avg(x).alias(f"__c{i}") for i, x in enumerate(xs)))


def _with(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a table of one row a model; without keys it is a single row."""
    return df.join(other, list(keys)) if keys else df.crossJoin(F.broadcast(other))


def _array(values: Sequence[Column]) -> Column:
    return F.array(*values) if values else F.array().cast("array<double>")


def gram(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per model: n, centres, and centred cross-products of predictors (xx, row by row), with y (xy) and of y (yy)."""
    mid = centres(df, y, xs, keys)
    rows = _with(df, mid, keys)
    d = [F.col(x) - F.col(f"__c{i}") for i, x in enumerate(xs)]
    dy = F.col(y) - F.col("__cy")
    k = len(xs)
    sums = {f"__xx{i}_{j}": F.sum(d[i] * d[j]) for i in range(k) for j in range(i + 1)} | {f"__xy{i}": F.sum(d[i] * dy) for i in range(k)}
    got = rows.groupBy(*keys, "__n", "__cy", *(f"__c{i}" for i in range(k))).agg(F.sum(dy * dy).alias("yy"), *(c.alias(n) for n, c in sums.items()))
    full = [F.col(f"__xx{max(i, j)}_{min(i, j)}") for i in range(k) for j in range(k)]
    return got.select(*keys, F.col("__n").alias("n"), F.col("__cy").alias("cy"), _array([F.col(f"__c{i}") for i in range(k)]).alias("c"), _array(full).alias("xx"), _array([F.col(f"__xy{i}") for i in range(k)]).alias("xy"), "yy")


def solve(n: int, cy: float, c: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: float) -> dict | None:
    """Coefficients (constant first), inverse of X'X with the constant, and fit; None where it can't be solved."""
    k = len(c)
    if n <= k + 1 or (k and np.linalg.matrix_rank(xx, hermitian=True) < k):
        return None
    inner = np.linalg.inv(xx) if k else np.empty((0, 0))
    b = inner @ xy
    ssr = max(0.0, yy - float(b @ xy))
    inverse = np.empty((k + 1, k + 1))
    inverse[1:, 1:] = inner
    inverse[0, 1:] = inverse[1:, 0] = -inner @ c
    inverse[0, 0] = 1 / n + c @ inner @ c
    p = k + 1
    r2 = 1 - ssr / yy if yy > 0 else float("nan")
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1) if ssr > 0 else float("inf")
    return {"b": np.concatenate(([cy - b @ c], b)), "inverse": inverse, "ssr": ssr, "r2": r2, "adj": 1 - (1 - r2) * (n - 1) / (n - p), "llf": llf, "aic": 2 * p - 2 * llf, "bic": p * math.log(n) - 2 * llf}


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _unpack(row, k: int) -> tuple:
    return int(row.n), float(row.cy), np.array(row.c, float), np.array(row.xx, float).reshape(k, k), np.array(row.xy, float), float(row.yy)


def _coefficients(grams: DataFrame, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    k = len(xs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                fit = solve(*_unpack(row, k))
                out.append(None if fit is None else fit["b"].tolist())
            yield frame[list(keys)].assign(b=out)

    return grams.mapInPandas(run, _key_schema(grams, keys) + "b array<double>")


def residuals(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), grams: DataFrame | None = None) -> DataFrame:
    """The complete rows of `df` with `fitted` and `residual`."""
    rows = listwise(df, [y, *xs])
    beta = _coefficients(grams if grams is not None else gram(rows, y, xs, keys), xs, keys)
    fitted = F.col("b")[0]
    for i, x in enumerate(xs, 1):
        fitted = fitted + F.col("b")[i] * F.col(x)
    return _with(rows, beta, keys).withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted")).drop("b")


def bartlett(scores: Sequence[Column], window, lags: int) -> list[Column]:
    """Each score's weighted sum of its `lags` predecessors."""
    out = []
    for s in scores:
        total = F.lit(0.0)
        for lag in range(1, lags + 1):
            total = total + (1 - lag / (lags + 1)) * F.coalesce(F.lag(s, lag).over(window), F.lit(0.0))
        out.append(total)
    return out


def meat(rows: DataFrame, names: Sequence[str], keys: Sequence[str], day: Sequence[str], lags: int, block: int | None = None) -> DataFrame:
    """S = sum s s' + sum_l w_l (G_l + G_l') of the score columns `names`, as an array `s`, one row a model.

    With `block`, series are cut into blocks of so many rows, each with copies of the `lags` rows before it.
    """
    if block is not None:
        rows = blocks.haloed(blocks.blocked(rows.select(*keys, *day, *names), keys, day, block), lags, 0, block)
    w = blocks.order_of(keys, block, day)
    lagged = rows.select(*keys, *names, *([] if block is None else [blocks.OWN]), *(c.alias(f"{n}__w") for n, c in zip(names, bartlett([F.col(n) for n in names], w, lags), strict=True)))
    lagged = lagged if block is None else lagged.where(F.col(blocks.OWN))
    sums = {f"{a}_{b}": F.sum(F.col(a) * F.col(b) + F.col(a) * F.col(f"{b}__w") + F.col(f"{a}__w") * F.col(b)) for i, a in enumerate(names) for b in names[: i + 1]}
    got = lagged.groupBy(*keys).agg(*(c.alias(n) for n, c in sums.items()))
    at = {n: i for i, n in enumerate(names)}
    full = [F.col(f"{a}_{b}" if at[a] >= at[b] else f"{b}_{a}") for a in names for b in names]
    return got.select(*keys, F.array(*full).alias("s"))


def fit(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), day: str | Sequence[str] = "day", lags: int | None = 7, correction: bool = True, use_t: bool = False, block: int | None = None) -> DataFrame:
    """One row per model and parameter. lags=None: ordinary standard errors and Student's t.

    correction: n / (n - k) on the covariance; use_t: Student's t instead of the normal distribution; block: see meat().
    """
    order = [day] if isinstance(day, str) else list(day)
    rows = listwise(df, [y, *xs])
    grams = gram(rows, y, xs, keys)
    names, k = _names(xs), len(xs)
    if lags is None:
        both = grams.withColumn("s", F.lit(None).cast("array<double>"))
    else:
        scored = residuals(df, y, xs, keys, grams)
        scores = [F.col("residual"), *(F.col("residual") * F.col(x) for x in xs)]
        scored = scored.select(*keys, *order, *(s.alias(f"s{i}") for i, s in enumerate(scores)))
        both = _with(grams, meat(scored, [f"s{i}" for i in range(k + 1)], keys, order, lags, block), keys)
    student = use_t or lags is None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                n, *rest = _unpack(row, k)
                f = solve(n, *rest)
                if f is None:
                    continue
                p = k + 1
                if row.s is None:
                    cov = f["inverse"] * f["ssr"] / (n - p)
                else:
                    cov = f["inverse"] @ np.array(row.s, float).reshape(p, p) @ f["inverse"] * (n / (n - p) if correction else 1.0)
                wide = probability.t_quantile_two_sided(0.05, n - p) if student else 1.959963984540054
                for i, name in enumerate(names):
                    b, se = float(f["b"][i]), math.sqrt(max(0.0, cov[i, i]))
                    t = b / se if se else float("nan")
                    pv = float("nan") if not se else probability.t_two_sided(t, n - p) if student else probability.normal_two_sided(t)
                    own = [getattr(row, c) for c in keys]
                    out.append((*own, name, b, se, t, pv, b - wide * se, b + wide * se, n, p, f["r2"], f["adj"], f["llf"], f["aic"], f["bic"], f["ssr"]))
            yield pd.DataFrame(out, columns=[*keys, *(c.split()[0] for c in COEFFICIENTS.split(", "))])

    return both.mapInPandas(run, _key_schema(grams, keys) + COEFFICIENTS)


def suite(df: DataFrame, y: str, models: dict[str, Sequence[str]], keys: Sequence[str] = (), common: bool = True, **options) -> DataFrame:
    """All `models` (name -> predictors), on one common sample if asked."""
    every = list(dict.fromkeys(x for xs in models.values() for x in xs))
    rows = listwise(df, [y, *every]) if common else df
    out = None
    for name, xs in models.items():
        one = fit(rows, y, xs, keys, **options).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def vif(df: DataFrame, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Variance inflation of each predictor: the diagonal of the inverse correlation matrix; infinite without spread."""
    k = len(xs)
    grams = gram(listwise(df, xs), xs[0], xs, keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                xx = np.array(row.xx, float).reshape(k, k)
                sd = np.sqrt(np.diag(xx))
                value = np.full(k, np.inf)
                live = sd > 0
                r = xx[np.ix_(live, live)] / np.outer(sd[live], sd[live])
                if np.linalg.matrix_rank(r) == live.sum():
                    value[live] = np.diag(np.linalg.inv(r))
                out += [(*(getattr(row, c) for c in keys), x, float(v), int(row.n)) for x, v in zip(xs, value, strict=True)]
            yield pd.DataFrame(out, columns=[*keys, "variable", "vif", "n"])

    return grams.mapInPandas(run, _key_schema(grams, keys) + "variable string, vif double, n long")


def pooled(df: DataFrame, y: str, xs: Sequence[str], indicator: str, day: str = "day", lags: int = 7) -> DataFrame:
    """Both entities in one model, every predictor interacted with the 0/1 `indicator`; scores are summed by day before the Bartlett sums, so that same-day errors may correlate."""
    rows = df.withColumns({indicator: F.col(indicator).cast("double"), **{f"{indicator}_x_{x}": F.col(indicator) * F.col(x) for x in xs}})
    every = [indicator, *xs, *(f"{indicator}_x_{x}" for x in xs)]
    rows = listwise(rows, [y, *every])
    grams = gram(rows, y, every)
    scored = residuals(rows, y, every, (), grams)
    k = len(every)
    scores = [F.col("residual"), *(F.col("residual") * F.col(x) for x in every)]
    daily = scored.groupBy(day).agg(*(F.sum(s).alias(f"s{i}") for i, s in enumerate(scores)))
    both = grams.crossJoin(F.broadcast(meat(daily, [f"s{i}" for i in range(k + 1)], (), [day], lags)))
    names = _names(every)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                n, *rest = _unpack(row, k)
                f = solve(n, *rest)
                if f is None:
                    continue
                p = k + 1
                cov = f["inverse"] @ np.array(row.s, float).reshape(p, p) @ f["inverse"] * n / (n - p)
                for i, name in enumerate(names):
                    b, se = float(f["b"][i]), math.sqrt(max(0.0, cov[i, i]))
                    out.append((name, b, se, b / se if se else float("nan"), probability.normal_two_sided(b / se) if se else float("nan"), b - 1.96 * se, b + 1.96 * se, n))
            yield pd.DataFrame(out, columns=["parameter", "coefficient", "se", "stat", "p_value", "ci_low", "ci_high", "n"])

    return both.mapInPandas(run, "parameter string, coefficient double, se double, stat double, p_value double, ci_low double, ci_high double, n long")
