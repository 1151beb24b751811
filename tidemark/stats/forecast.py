"""Expanding-window one-step-ahead forecasts and tests that compare them.

The cross-products of all rows before t are cumulative window sums, so a series of T rows costs O(T k^2) instead of T
refits. A short series is one window partition and panels of many series spread over tasks; with `block`, series are cut
into blocks of so many rows, and cumulative sums are prefix sums within blocks and over a table of one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import normal_cdf
from ..operators import blocks
from ..operators.frames import listwise
from .ols import _array, bartlett

PAST = (Window.unboundedPreceding, -1)


def _moments(rows: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], day: str, frame: tuple[int, int]) -> DataFrame:
    """Adds n, sx, sxx, sy, sxy, syy over the frame; values are taken about the series' first row, which keeps digits."""
    order = Window.partitionBy(*keys).orderBy(day)
    start = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = rows.withColumns({f"__b{i}": F.first(c).over(start) for i, c in enumerate([y, *xs])})
    base = base.withColumns({f"__d{i}": F.col(c).cast("double") - F.col(f"__b{i}") for i, c in enumerate([y, *xs])})
    w, k = order.rowsBetween(*frame), len(xs)
    d = [F.col(f"__d{i}") for i in range(k + 1)]
    new = {"__n": F.count(F.lit(1)).over(w), "__from": F.min(day).over(w), "__to": F.max(day).over(w)}
    new |= {f"__s{i}": F.sum(d[i]).over(w) for i in range(k + 1)} | {f"__s{i}_{j}": F.sum(d[i] * d[j]).over(w) for i in range(k + 1) for j in range(i + 1)}
    return base.withColumns(new)


def _sums(k: int) -> dict[str, tuple[str, Column]]:
    """The running sums of _moments as blocks.running() takes them."""
    d = [F.col(f"__d{i}") for i in range(k + 1)]
    return {"__n": ("count", F.lit(1))} | {f"__s{i}": ("sum", d[i]) for i in range(k + 1)} | {f"__s{i}_{j}": ("sum", d[i] * d[j]) for i in range(k + 1) for j in range(i + 1)}


def _centred(rows: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], day: str, block: int) -> DataFrame:
    """Blocked rows with their values about the series' first row."""
    every = [y, *xs]
    base = blocks.firsts(blocks.blocked(rows, keys, day, block), keys, {f"__b{i}": c for i, c in enumerate(every)})
    return base.withColumns({f"__d{i}": F.col(c).cast("double") - F.col(f"__b{i}") for i, c in enumerate(every)})


def _past(rows: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], day: str, block: int) -> DataFrame:
    """_moments over all rows before, by blocks."""
    sums = _sums(len(xs)) | {"__from": ("min", F.col(day)), "__to": ("max", F.col(day))}
    return blocks.running(_centred(rows, y, xs, keys, day, block), keys, sums, current=False)


def _trailing(rows: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], day: str, block: int, width: int, step: int) -> DataFrame:
    """_moments over the last `width` rows of every `step`-th window, by differences of prefix sums."""
    sums = _sums(len(xs))
    upto = blocks.running(_centred(rows, y, xs, keys, day, block), keys, sums)
    aside = {f"__p{name}": name for name in sums}
    ends = upto.where((F.col(blocks.RN) >= width) & ((F.col(blocks.RN) - width) % step == 0))
    past = upto.where(F.col(blocks.RN) % step == 0).select(*keys, (F.col(blocks.RN) + width).alias(blocks.RN), *(F.col(c).alias(n) for n, c in aside.items()))
    done = blocks.meet(ends, past, [*keys, blocks.RN])
    done = done.withColumns({name: F.col(name) - F.coalesce(F.col(p), F.lit(0)) for p, name in aside.items()}).drop(*aside)
    return done.withColumns({"__from": F.lit(None).cast("string"), "__to": F.lit(None).cast("string")})


def _pack(rows: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
    """Packs the moments of _moments into arrays: (keep, n, from, to, d, b, s, ss)."""
    of = lambda i, j: F.col(f"__s{max(i, j)}_{min(i, j)}")
    return rows.select(
        *keep,
        F.col("__n").alias("train_n"),
        F.col("__from").alias("train_start"),
        F.col("__to").alias("train_end"),
        _array([F.col(f"__d{i}") for i in range(k + 1)]).alias("d"),
        F.col("__b0").cast("double").alias("b0"),
        _array([F.col(f"__s{i}") for i in range(k + 1)]).alias("s"),
        _array([of(i, j) for i in range(k + 1) for j in range(k + 1)]).alias("ss"),
    )


def _rows_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of one length, none of them null, as rows."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def row_slopes(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes and constants from rows of sums (target first), and which rows have them."""
    centred = ss - s[:, :, None] * s[:, None, :] / n[:, None, None]
    xx, xy = centred[:, 1:, 1:], centred[:, 1:, 0]
    b, ok = np.zeros(xy.shape), np.ones(len(n), bool)
    if xy.size:
        ok = np.linalg.matrix_rank(xx, hermitian=True) == xx.shape[1]
        b[ok] = np.linalg.solve(xx[ok], xy[ok][:, :, None])[:, :, 0]
    return b, (s[:, 0] - (b * s[:, 1:]).sum(axis=1)) / n, ok


def slopes(n: float, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Slopes and the constant from sums (target first)."""
    b, const, known = row_slopes(np.array([n]), s[None], ss[None])
    return (b[0], float(const[0])) if known[0] else None


def expanding_forecasts(df: DataFrame, y: str, models: dict[str, Sequence[str]], keys: Sequence[str], day: str, start: str | None, least: int = 30, block: int | None = None) -> DataFrame:
    """One forecast per key, day from `start` on (None: from the first), and model; all models use the same complete rows.

    Columns: keys, day, actual, model, forecast, error, train_n, train_start, train_end. A model trains on the rows
    before the day, `least` or more of them.
    """
    every = list(dict.fromkeys(x for xs in models.values() for x in xs))
    k, places = len(every), {m: [every.index(x) + 1 for x in xs] for m, xs in models.items()}
    rows = listwise(df, [y, *every]).select(*keys, day, F.col(y).cast("double").alias("actual"), *every)
    moments = _moments(rows, "actual", every, keys, day, PAST) if block is None else _past(rows, "actual", every, keys, day, block)
    packed = _pack(moments, k, [*keys, day, "actual"])
    packed = packed.where((F.lit(True) if start is None else F.col(day) >= F.lit(start).cast("date")) & (F.col("train_n") >= least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, ss, d = (_rows_of(batch, c) for c in ("s", "ss", "d"))
            n, b0 = (batch.column(c).to_numpy() for c in ("train_n", "b0"))
            values, known = np.empty((batch.num_rows, len(places))), np.empty((batch.num_rows, len(places)), bool)
            for i, at in enumerate(places.values()):
                own = [0, *at]
                b, const, known[:, i] = row_slopes(n, s[:, own], ss.reshape(-1, k + 1, k + 1)[:, own][:, :, own])
                values[:, i] = b0 + const + (b * d[:, at]).sum(axis=1)
            # Keys and days pass as they are: Python's own dates end with the year 9999.
            each = pa.array(np.repeat(np.arange(batch.num_rows), len(places)))
            of = {c: batch.column(c).take(each) for c in [*keys, day, "actual", "train_n", "train_start", "train_end"]}
            of |= {"model": pa.array(list(places) * batch.num_rows, pa.string()), "forecast": pa.array(values.ravel(), pa.float64(), mask=~known.ravel())}
            yield pa.RecordBatch.from_arrays([of[c] for c in names], names=names)

    names = [*keys, day, "actual", "model", "forecast", "train_n", "train_start", "train_end"]
    schema = "".join(f"`{c}` {packed.schema[c].dataType.simpleString()}, " for c in [*keys, day]) + f"actual double, model string, forecast double, train_n long, train_start {packed.schema['train_start'].dataType.simpleString()}, train_end {packed.schema['train_end'].dataType.simpleString()}"
    return packed.mapInArrow(run, schema).withColumn("error", F.col("actual") - F.col("forecast"))


def rolling_models(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], day: str, width: int = 365, step: int = 7, least: int = 330, block: int | None = None) -> DataFrame:
    """Coefficients over windows of `width` rows, every `step` rows: (keys, window_end, parameter, coefficient, n)."""
    rows = listwise(df, [y, *xs]).select(*keys, day, F.col(y).alias("__y"), *xs)
    order = Window.partitionBy(*keys).orderBy(day)
    k = len(xs)
    if block is None:
        moments = _moments(rows, "__y", xs, keys, day, (-(width - 1), 0)).withColumn("__rn", F.row_number().over(order))
    else:
        moments = _trailing(rows, "__y", xs, keys, day, block, width, step)
    packed = _pack(moments, k, [*keys, F.col(day).alias("window_end"), "__rn", *(F.col(f"__b{i}").cast("double").alias(f"m{i}") for i in range(k + 1))])
    packed = packed.where((F.col("__rn") >= width) & ((F.col("__rn") - width) % step == 0) & (F.col("train_n") >= least)).withColumn("m", F.array(*(F.col(f"m{i}") for i in range(k + 1))))
    names = ["const", *xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, ss, m = (_rows_of(batch, c) for c in ("s", "ss", "m"))
            b, const, known = row_slopes(batch.column("train_n").to_numpy(), s, ss.reshape(-1, k + 1, k + 1))
            values = np.column_stack((m[:, 0] + const - (b * m[:, 1:]).sum(axis=1), b))[known]
            each = pa.array(np.repeat(np.flatnonzero(known), len(names)))
            of = [batch.column(c).take(each) for c in [*keys, "window_end"]]
            yield pa.RecordBatch.from_arrays([*of, pa.array(names * len(values), pa.string()), pa.array(values.ravel()), batch.column("train_n").take(each)], names=[*keys, "window_end", "parameter", "coefficient", "n"])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys) + f"window_end {df.schema[day].dataType.simpleString()}, parameter string, coefficient double, n long"
    return packed.mapInArrow(run, schema)


def metrics(forecasts: DataFrame, keys: Sequence[str], benchmark: str) -> DataFrame:
    """RMSE, MAE, directional accuracy and R2 against the `benchmark` model, per keys and model."""
    got = forecasts.groupBy(*keys, "model").agg(
        F.count("error").alias("n"),
        F.sqrt(F.avg(F.pow("error", 2))).alias("rmse"),
        F.avg(F.abs("error")).alias("mae"),
        F.avg((F.signum("actual") == F.signum("forecast")).cast("double")).alias("directional_accuracy"),
        F.sum(F.pow("error", 2)).alias("sse"),
    )
    base = got.where(F.col("model") == benchmark).select(*keys, F.col("sse").alias("__base"), F.col("rmse").alias("__rmse"))
    joined = got.join(base, list(keys)) if keys else got.crossJoin(F.broadcast(base))
    return joined.select(*keys, "model", "n", "rmse", "mae", "directional_accuracy", (1 - F.col("sse") / F.col("__base")).alias("oos_r2"), (100 * (F.col("rmse") / F.col("__rmse") - 1)).alias("rmse_change_pct"))


def paired(forecasts: DataFrame, keys: Sequence[str], day: str, benchmark: str, extended: str) -> DataFrame:
    """Both models' forecasts of the same days, with squared and absolute loss and the Clark-West adjusted difference."""
    take = lambda m, s: forecasts.where((F.col("model") == m) & F.col("error").isNotNull()).select(*keys, day, "actual", F.col("forecast").alias(f"f{s}"), F.col("error").alias(f"e{s}"))
    both = take(benchmark, 0).join(take(extended, 1).drop("actual"), [*keys, day])
    return both.withColumns(
        {
            "squared": F.pow("e0", 2) - F.pow("e1", 2),
            "absolute": F.abs("e0") - F.abs("e1"),
            "adjusted": F.pow("e0", 2) - (F.pow("e1", 2) - F.pow(F.col("f0") - F.col("f1"), 2)),
        }
    )


def long_run(df: DataFrame, d: str, keys: Sequence[str], day: str, lags: int = 7, correction: bool = False, block: int | None = None) -> DataFrame:
    """Mean, Newey-West long-run variance (autocovariances over n) and standard error of a series' mean."""
    known = df.where(F.col(d).isNotNull())
    if block is None:
        centred = known.select(*keys, day, F.col(d).alias("__v"), (F.col(d) - F.avg(d).over(Window.partitionBy(*keys))).alias("__e"))
    else:
        means = known.groupBy(*keys).agg(F.avg(d).alias("__m"))
        centred = blocks.meet(known.select(*keys, day, F.col(d).alias("__v")), means, keys).withColumn("__e", F.col("__v") - F.col("__m")).drop("__m")
        centred = blocks.haloed(blocks.blocked(centred, keys, day, block), lags, 0, block)
    lagged = centred.withColumn("__w", bartlett([F.col("__e")], blocks.order_of(keys, block, day), lags)[0])
    lagged = lagged if block is None else blocks.owned(lagged)
    got = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__v").alias("mean"), (F.sum(F.col("__e") * F.col("__e") + 2 * F.col("__e") * F.col("__w")) / F.count(F.lit(1))).alias("long_run_variance"))
    variance = F.col("long_run_variance") / (F.col("n") - 1 if correction else F.col("n"))
    return got.withColumn("se", F.when(F.col("long_run_variance") > 0, F.sqrt(variance))).withColumn("z", F.try_divide(F.col("mean"), F.col("se")))


def clark_west(pairs: DataFrame, keys: Sequence[str], day: str, lags: int = 7) -> DataFrame:
    """One-sided: the extended model predicts better."""
    return long_run(pairs, "adjusted", keys, day, lags, correction=True).withColumn("p_value", 1 - normal_cdf(F.col("z")))


def diebold_mariano(pairs: DataFrame, keys: Sequence[str], day: str, loss: str = "squared", lags: int = 7, correction: bool = False) -> DataFrame:
    """Two-sided: the models' losses differ."""
    return long_run(pairs, loss, keys, day, lags, correction).withColumn("p_value", 2 * (1 - normal_cdf(F.abs("z"))))


def cumulative_loss(pairs: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    run = lambda e: F.sum(F.pow(e, 2)).over(w)
    return pairs.select(*keys, day, run("e0").alias("benchmark_loss"), run("e1").alias("extended_loss"), (run("e0") - run("e1")).alias("difference"))


def supports(better: Column, p: Column) -> Column:
    """The decision rule: a lower error and a one-sided p below 5 %."""
    return F.when(better & (p < 0.05), "Supported").otherwise("Not supported")


def align_external(own: DataFrame, external: DataFrame, keys: Sequence[str], day: str, tolerance: float = 1e-9) -> DataFrame:
    """Externally supplied forecasts on the days of our own, where both name the same actual value."""
    both = own.join(external.select(*keys, day, F.col("actual").alias("__a"), F.col("forecast").alias("external_forecast")), [*keys, day])
    return both.where(F.abs(F.col("actual") - F.col("__a")) <= tolerance).drop("__a")


def compare_external(own: DataFrame, external: DataFrame, keys: Sequence[str], day: str, tolerance: float = 1e-9, level: float = 0.05) -> DataFrame:
    """Own against outside forecasts on the days both have: sizes, errors, the loss test and the decision.

    The outside forecasts win, lose or make no difference: a two-sided test at `level`, then the lower error.
    """
    both = align_external(own, external, keys, day, tolerance)
    losses = both.select(*keys, day, F.pow(F.col("actual") - F.col("forecast"), 2).alias("own_loss"), F.pow(F.col("actual") - F.col("external_forecast"), 2).alias("external_loss"))
    losses = losses.withColumn("squared", F.col("own_loss") - F.col("external_loss"))
    tests = diebold_mariano(losses, keys, day).select(*keys, "z", "p_value")
    sizes = losses.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("own_loss")).alias("rmse_own"), F.sqrt(F.avg("external_loss")).alias("rmse_external"))
    decision = F.when(F.coalesce(F.col("p_value") >= level, F.lit(True)), "no difference").when(F.col("rmse_external") < F.col("rmse_own"), "external better").otherwise("own better")
    return sizes.join(tests, list(keys)).withColumn("decision", decision)


def template(forecasts: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """An empty form for others to fill: keys, day, actual, forecast null."""
    return forecasts.select(*keys, day, "actual", F.lit(None).cast("double").alias("forecast")).distinct()
