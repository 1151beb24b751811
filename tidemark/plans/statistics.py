"""Queries over estimators: regressions, covariance, diagnostics, forecasts and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import summary
from ..registry import register
from ..stats import diagnostics, forecast, ols
from . import sql
from .base import CHANGES_SQL, SERIES_SQL, day_text, modelling, r6
from .base import series as base_series

XS = ("ret_lag", "activity_lag")
MODELS = {"M0": ("ret_lag",), "M1": ("ret_lag", "activity_lag")}
START = "1999-01-01"

ONE = f"""WITH {CHANGES_SQL}, s AS (SELECT asset, day, ret AS y, ret_lag AS x FROM r WHERE ret IS NOT NULL AND ret_lag IS NOT NULL),
g AS (SELECT asset, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx FROM s GROUP BY 1),
u AS (SELECT s.asset, s.day, y, x, y - a - b * x AS u, mx, n, sxx FROM s JOIN g USING (asset))"""
LAGS = range(1, 8)


@register(
    "ols_simple",
    ONE + """, m AS (SELECT asset, sum(u * u) AS ssr, max(n) AS n FROM u GROUP BY 1) SELECT asset, round(b, 6) AS slope, round(a, 6) AS constant, round(r2, 6) AS r2, round(1 - (1 - r2) * (g.n - 1) / (g.n - 2), 6) AS adj_r2, CAST(g.n AS BIGINT) AS n, round(-2 * (-g.n / 2 * (ln(2 * pi()) + ln(ssr / g.n) + 1)) + 4, 4) AS aic, round(-2 * (-g.n / 2 * (ln(2 * pi()) + ln(ssr / g.n) + 1)) + 2 * ln(g.n), 4) AS bic, round(sqrt(ssr / (g.n - 2) / sxx), 6) AS se FROM g JOIN m USING (asset)""",
)
def ols_simple(spark, sf_dir):
    out = ols.fit(modelling(spark, sf_dir), "ret", ["ret_lag"], ["asset"], lags=None)
    wide = out.groupBy("asset").pivot("parameter", ["ret_lag", "const"]).agg(F.first("coefficient").alias("b"), F.first("se").alias("se"), F.first("r2").alias("r2"), F.first("adj_r2").alias("adj"), F.first("n").alias("n"), F.first("aic").alias("aic"), F.first("bic").alias("bic"))
    return wide.select("asset", r6("ret_lag_b", "slope"), r6("const_b", "constant"), r6("ret_lag_r2", "r2"), r6("ret_lag_adj", "adj_r2"), F.col("ret_lag_n").alias("n"), F.round("ret_lag_aic", 4).alias("aic"), F.round("ret_lag_bic", 4).alias("bic"), r6("ret_lag_se", "se"))


@register(
    "ols_hac",
    ONE + ", z AS (SELECT asset, n, sxx, (x - mx) * u AS s, " + ", ".join(f"lag((x - mx) * u, {k}) OVER w AS s{k}" for k in LAGS) + " FROM u WINDOW w AS (PARTITION BY asset ORDER BY day)), v AS (SELECT asset, n, sxx, sum(s * s) + 2 * (" + " + ".join(f"{1 - k / 8} * sum(coalesce(s * s{k}, 0))" for k in LAGS) + ") AS s2 FROM z GROUP BY 1, 2, 3) SELECT v.asset, round(b, 6) AS slope, round(sqrt(s2) / sxx, 6) AS se_plain, round(sqrt(s2 * v.n / (v.n - 2)) / v.sxx, 6) AS se_corrected FROM v JOIN g USING (asset)".replace("/ sxx, 6", "/ v.sxx, 6"),
)
def ols_hac(spark, sf_dir):
    rows = modelling(spark, sf_dir)
    take = lambda c: ols.fit(rows, "ret", ["ret_lag"], ["asset"], lags=7, correction=c).where("parameter = 'ret_lag'")
    plain = take(False).select("asset", "coefficient", F.col("se").alias("plain"))
    return plain.join(take(True).select("asset", F.col("se").alias("corrected")), "asset").select("asset", r6("coefficient", "slope"), r6("plain", "se_plain"), r6("corrected", "se_corrected"))


def _r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


@register(
    "model_suite",
    f"WITH {sql.SUITE}, o AS (SELECT *, {sql.normal_two_sided('z')} AS p_value, coefficient - 1.959963984540054 * se AS ci_low, coefficient + 1.959963984540054 * se AS ci_high, r2 - max(r2) FILTER (model = 'M0') OVER (PARTITION BY asset) AS incremental_r2 FROM fitted) SELECT asset, model, parameter, CAST(n AS BIGINT) AS n, {_r6('coefficient', 'se', 'p_value', 'ci_low', 'ci_high', 'r2', 'incremental_r2')}, {sql.stars('p_value')} AS stars FROM o",
)
def model_suite(spark, sf_dir):
    """Nested models on one common sample with HAC errors, stars and incremental fit."""
    out = ols.suite(modelling(spark, sf_dir), "ret", MODELS, ["asset"], lags=7)
    base = out.where("model = 'M0'").select("asset", F.col("r2").alias("base_r2")).distinct()
    joined = out.join(base, "asset").withColumn("incremental_r2", F.col("r2") - F.col("base_r2"))
    return joined.select("asset", "model", "parameter", "n", *(r6(c) for c in ("coefficient", "se", "p_value", "ci_low", "ci_high", "r2", "incremental_r2")), scalar.stars("p_value").alias("stars"))


@register("vif", f"WITH {CHANGES_SQL}, s AS (SELECT * FROM r WHERE ret_lag IS NOT NULL AND activity_lag IS NOT NULL), k AS (SELECT asset, corr(ret_lag, activity_lag) AS r FROM s GROUP BY 1) SELECT asset, v AS variable, round(1 / (1 - r * r), 6) AS vif, 'low' AS band FROM k, (SELECT unnest(['ret_lag', 'activity_lag']) AS v)")
def vif(spark, sf_dir):
    return ols.vif(modelling(spark, sf_dir), XS, ["asset"]).select("asset", "variable", r6("vif"), scalar.vif_band("vif").alias("band"))


@register("residual_series", ONE + " SELECT asset, CAST(day AS VARCHAR) AS day, round(y - u, 6) AS fitted, round(u, 6) AS residual FROM u")
def residual_series(spark, sf_dir):
    return ols.residuals(modelling(spark, sf_dir), "ret", ["ret_lag"], ["asset"]).select("asset", day_text(), r6("fitted"), r6("residual"))


@register("durbin_watson", ONE + ", d AS (SELECT asset, u, u - lag(u) OVER (PARTITION BY asset ORDER BY day) AS e FROM u) SELECT asset, round(sum(e * e) / sum(u * u), 6) AS durbin_watson FROM d GROUP BY 1")
def durbin_watson(spark, sf_dir):
    res = ols.residuals(modelling(spark, sf_dir), "ret", ["ret_lag"], ["asset"])
    return diagnostics.durbin_watson(res, "residual", ["asset"], "day").withColumn("durbin_watson", F.round("durbin_watson", 6))


@register(
    "autocorrelation",
    f"WITH {CHANGES_SQL}, e AS (SELECT asset, day, ret - avg(ret) OVER (PARTITION BY asset) AS e FROM r WHERE ret IS NOT NULL), l AS (SELECT asset, e, k, lag(e, k) OVER (PARTITION BY asset, k ORDER BY day) AS p FROM e, (SELECT unnest([1, 3, 7, 14, 30]) AS k)) SELECT asset, k AS lag, count(*) AS n, round(coalesce(sum(e * p), 0) / sum(e * e), 6) AS acf, round(1.96 / sqrt(count(*)), 6) AS bound FROM l GROUP BY 1, 2",
)
def autocorrelation(spark, sf_dir):
    return diagnostics.autocorrelation(modelling(spark, sf_dir), "ret", ["asset"], "day", (1, 3, 7, 14, 30)).select("asset", "lag", "n", r6("acf"), r6("bound"))


@register(
    "ljung_box",
    f"WITH {CHANGES_SQL}, e AS (SELECT asset, day, ret - avg(ret) OVER (PARTITION BY asset) AS e FROM r WHERE ret IS NOT NULL), l AS (SELECT asset, e, k, lag(e, k) OVER (PARTITION BY asset, k ORDER BY day) AS p FROM e, (SELECT unnest(range(1, 8)) AS k)), a AS (SELECT asset, k, count(*)::DOUBLE AS n, sum(e * p) / sum(e * e) AS r FROM l GROUP BY 1, 2) SELECT asset, CAST(m AS INTEGER) AS lag, round(max(n) * (max(n) + 2) * sum(r * r / (n - k)), 4) AS q FROM a, (SELECT unnest([1, 3, 7]) AS m) WHERE k <= m GROUP BY 1, 2",
)
def ljung_box(spark, sf_dir):
    return diagnostics.ljung_box(modelling(spark, sf_dir), "ret", ["asset"], "day", (1, 3, 7)).select("asset", "lag", F.round("q", 4).alias("q"))


@register(
    "jarque_bera",
    f"WITH {CHANGES_SQL}, m AS (SELECT asset, avg(ret) AS mu FROM r GROUP BY 1), k AS (SELECT r.asset, count(ret)::DOUBLE AS n, avg((ret - mu) ** 2) AS m2, avg((ret - mu) ** 3) AS m3, avg((ret - mu) ** 4) AS m4 FROM r JOIN m USING (asset) WHERE ret IS NOT NULL GROUP BY 1) SELECT asset, CAST(n AS BIGINT) AS n, round(n / 6 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4), 4) AS jarque_bera, round(exp(-n / 12 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4)), 6) AS p_value FROM k",
)
def jarque_bera(spark, sf_dir):
    return diagnostics.jarque_bera(modelling(spark, sf_dir), "ret", ["asset"]).select("asset", "n", F.round("jarque_bera", 4).alias("jarque_bera"), r6("p_value"))


@register(
    "breusch_pagan",
    ONE + " SELECT asset, round(count(*) * regr_r2(u * u, x), 4) AS lm FROM u GROUP BY 1",
)
def breusch_pagan(spark, sf_dir):
    res = ols.residuals(modelling(spark, sf_dir), "ret", ["ret_lag"], ["asset"])
    return diagnostics.breusch_pagan(res, ["ret_lag"], ["asset"]).where("test = 'Breusch-Pagan'").select("asset", F.round("statistic", 4).alias("lm"))


def _test_rows(label: str, name: str, degrees: str, with_f: bool = True) -> str:
    lm = f"SELECT asset, '{label}' AS test, n * r2 AS statistic, {degrees}::DOUBLE AS df, {sql.chi2_upper('(n * r2)', f'{degrees}::DOUBLE')} AS p_value FROM {name}"
    fs = f"SELECT asset, '{label} F', r2 / k / ((1 - r2) / (n - k - 1)), k, {sql.f_upper('(r2 / k / ((1 - r2) / (n - k - 1)))', 'k', '(n - k - 1)')} FROM {name}"
    return f"{lm} UNION ALL {fs}"


_BEFORE = ", ".join(f"coalesce(lag(u, {k}) OVER (PARTITION BY asset ORDER BY day), 0) AS l{k}" for k in LAGS)
RESIDUAL_TESTS_SQL = f"""WITH {sql.SUITE}, res AS (SELECT asset, day, x1, x2, u1 AS u, u1 * u1 AS uu FROM e), lags AS (SELECT *, {_BEFORE} FROM res),
{sql.r_squared("bp", "res", "uu", ["x1", "x2"])}, {sql.r_squared("wh", "res", "uu", ["x1", "x2", "x1 * x1", "x1 * x2", "x2 * x2"])},
{", ".join(sql.r_squared(f"bg{m}", "lags", "u", ["x1", "x2", *(f"l{k}" for k in range(1, m + 1))]) for m in (1, 3, 7))},
cen AS (SELECT asset, day, u - avg(u) OVER (PARTITION BY asset) AS u FROM res),
lb AS (SELECT asset, k, u, lag(u, k) OVER (PARTITION BY asset, k ORDER BY day) AS p FROM cen, (SELECT unnest(range(1, 31)) AS k)),
ac AS (SELECT asset, k, count(*)::DOUBLE AS n, coalesce(sum(u * p), 0) / sum(u * u) AS r FROM lb GROUP BY 1, 2),
q AS (SELECT asset, m, max(n) * (max(n) + 2) * sum(r * r / (n - k)) AS q FROM ac, (SELECT unnest([1, 3, 7, 14, 30]) AS m) WHERE k <= m GROUP BY 1, 2),
jb AS (SELECT asset, n / 6 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4) AS jb FROM (SELECT asset, count(*)::DOUBLE AS n, avg(u ** 2) AS m2, avg(u ** 3) AS m3, avg(u ** 4) AS m4 FROM cen GROUP BY 1)),
tests AS ({_test_rows("Breusch-Pagan", "bp", "2")} UNION ALL {_test_rows("White", "wh", "5")} UNION ALL {" UNION ALL ".join(_test_rows(f"Breusch-Godfrey {m}", f"bg{m}", str(m)) for m in (1, 3, 7))}
 UNION ALL SELECT asset, 'Ljung-Box ' || m, q, m::DOUBLE, {sql.chi2_upper("q", "m::DOUBLE")} FROM q UNION ALL SELECT asset, 'Jarque-Bera', jb, 2.0, exp(-jb / 2) FROM jb)"""


@register("residual_tests", RESIDUAL_TESTS_SQL + f" SELECT asset, test, round(statistic, 4) AS statistic, df, round(p_value, 6) + 0.0 AS p_value, {sql.stars('p_value')} AS label FROM tests")
def residual_tests(spark, sf_dir):
    """Breusch-Pagan, White, Breusch-Godfrey, Ljung-Box and Jarque-Bera of the larger model."""
    out = diagnostics.all_tests(modelling(spark, sf_dir), "ret", XS, ["asset"], "day")
    return out.select("asset", "test", F.round("statistic", 4).alias("statistic"), "df", r6("p_value"), "label")


@register(
    "compare_inference",
    f"WITH {sql.SUITE}, o AS (SELECT asset, parameter, sqrt(ssr / (n - p) * inverse) AS se_ols, sqrt(hac) AS se_hac, coefficient AS b, (n - p) AS v FROM suite WHERE model = 'M1'), t AS (SELECT *, {sql.t_two_sided('(b / se_ols)', 'v')} AS p_ols, {sql.t_two_sided('(b / se_hac)', 'v')} AS p_hac, se_hac / se_ols AS se_ratio FROM o) SELECT asset, parameter, {_r6('se_ols', 'se_hac', 'se_ratio', 'p_ols', 'p_hac')}, (p_ols < 0.05) <> (p_hac < 0.05) AS verdict_changes FROM t",
)
def compare_inference(spark, sf_dir):
    out = diagnostics.compare_inference(modelling(spark, sf_dir), "ret", XS, ["asset"], "day")
    return out.select("asset", "parameter", *(r6(c) for c in ("se_ols", "se_hac", "se_ratio", "p_ols", "p_hac")), "verdict_changes")


FORECAST_SQL = f"""WITH {CHANGES_SQL}, s AS (SELECT asset, day, ret AS y, ret_lag AS x FROM r WHERE ret IS NOT NULL AND ret_lag IS NOT NULL),
f AS (SELECT asset, day, y, count(*) OVER w AS train_n, min(day) OVER w AS a, max(day) OVER w AS b, avg(y) OVER w AS f0, regr_intercept(y, x) OVER w + regr_slope(y, x) OVER w * x AS f1 FROM s WINDOW w AS (PARTITION BY asset ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, y - f0 AS e0, y - f1 AS e1 FROM f WHERE day >= DATE '{START}' AND train_n >= 30)"""


def _forecasts(spark, sf_dir):
    return forecast.expanding_forecasts(modelling(spark, sf_dir), "ret", {"mean": (), "lag": ("ret_lag",)}, ["asset"], "day", START)


def _pairs(spark, sf_dir):
    return forecast.paired(_forecasts(spark, sf_dir), ["asset"], "day", "mean", "lag")


@register(
    "expanding_forecasts",
    FORECAST_SQL + " SELECT asset, CAST(day AS VARCHAR) AS day, 'mean' AS model, train_n, CAST(a AS VARCHAR) AS train_start, CAST(b AS VARCHAR) AS train_end, round(f0, 6) + 0.0 AS forecast, round(e0, 6) + 0.0 AS error FROM p UNION ALL SELECT asset, CAST(day AS VARCHAR), 'lag', train_n, CAST(a AS VARCHAR), CAST(b AS VARCHAR), round(f1, 6) + 0.0, round(e1, 6) + 0.0 FROM p",
)
def expanding_forecasts(spark, sf_dir):
    return _forecasts(spark, sf_dir).select("asset", day_text(), "model", "train_n", day_text("train_start"), day_text("train_end"), r6("forecast"), r6("error"))


@register(
    "forecast_metrics",
    FORECAST_SQL + ", m AS (SELECT asset, day, y, 'mean' AS model, f0 AS f, e0 AS e FROM p UNION ALL SELECT asset, day, y, 'lag', f1, e1 FROM p), g AS (SELECT asset, model, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(CASE WHEN sign(y) = sign(f) THEN 1.0 ELSE 0.0 END) AS da, sum(e * e) AS sse FROM m GROUP BY 1, 2) SELECT g.asset, g.model, g.n, round(g.rmse, 6) AS rmse, round(g.mae, 6) AS mae, round(g.da, 6) AS directional_accuracy, round(1 - g.sse / b.sse, 6) AS oos_r2, round(100 * (g.rmse / b.rmse - 1), 4) AS rmse_change_pct FROM g JOIN g b ON b.asset = g.asset AND b.model = 'mean'",
)
def forecast_metrics(spark, sf_dir):
    out = forecast.metrics(_forecasts(spark, sf_dir), ["asset"], "mean")
    return out.select("asset", "model", "n", r6("rmse"), r6("mae"), r6("directional_accuracy"), r6("oos_r2"), F.round("rmse_change_pct", 4).alias("rmse_change_pct"))


def _long_run_sql(d: str, correction: bool) -> str:
    parts = ", ".join(f"lag(e, {k}) OVER w AS e{k}" for k in LAGS)
    weighted = " + ".join(f"{1 - k / 8} * sum(coalesce(e * e{k}, 0))" for k in LAGS)
    return FORECAST_SQL + f", d AS (SELECT asset, day, {d} AS d FROM p), cd AS (SELECT asset, day, d, d - avg(d) OVER (PARTITION BY asset) AS e FROM d), l AS (SELECT asset, d, e, {parts} FROM cd WINDOW w AS (PARTITION BY asset ORDER BY day)), v AS (SELECT asset, count(*) AS n, avg(d) AS mean, (sum(e * e) + 2 * ({weighted})) / count(*) AS lrv FROM l GROUP BY 1) SELECT asset, n, round(mean, 8) AS mean, round(mean / sqrt(lrv / (n - {int(correction)})), 4) AS z FROM v"


@register("clark_west", _long_run_sql("e0 * e0 - (e1 * e1 - (f0 - f1) ** 2)", True))
def clark_west(spark, sf_dir):
    return forecast.clark_west(_pairs(spark, sf_dir), ["asset"], "day").select("asset", "n", F.round("mean", 8).alias("mean"), F.round("z", 4).alias("z"))


@register("diebold_mariano", _long_run_sql("e0 * e0 - e1 * e1", False))
def diebold_mariano(spark, sf_dir):
    return forecast.diebold_mariano(_pairs(spark, sf_dir), ["asset"], "day").select("asset", "n", F.round("mean", 8).alias("mean"), F.round("z", 4).alias("z"))


def _z_sql(d: str, correction: bool) -> str:
    return f"(SELECT asset, avg(d) / sqrt(({sql.HAC}) / count(*) / (count(*) - {int(correction)})) AS z FROM (SELECT *, {sql.LAGGED} FROM (SELECT asset, day, d, d - avg(d) OVER (PARTITION BY asset) AS s FROM (SELECT asset, day, {d} AS d FROM p)) WINDOW w AS (PARTITION BY asset ORDER BY day)) GROUP BY 1)"


@register(
    "forecast_tests",
    FORECAST_SQL + f", t AS (SELECT c.asset, c.z AS cw_z, {sql.normal_upper('c.z')} AS cw_p, m.z AS dm_z, {sql.normal_two_sided('m.z')} AS dm_p FROM {_z_sql('e0 * e0 - (e1 * e1 - (f0 - f1) ** 2)', True)} c JOIN {_z_sql('abs(e0) - abs(e1)', False)} m USING (asset)), b AS (SELECT asset, sum(e1 * e1) < sum(e0 * e0) AS better FROM p GROUP BY 1) SELECT asset, {_r6('cw_z', 'cw_p', 'dm_z', 'dm_p')}, better, CASE WHEN better AND cw_p < 0.05 THEN 'Supported' ELSE 'Not supported' END AS verdict FROM t JOIN b USING (asset)",
)
def forecast_tests(spark, sf_dir):
    """Both tests with p-values and the decision rule."""
    pairs = _pairs(spark, sf_dir)
    cw = forecast.clark_west(pairs, ["asset"], "day").select("asset", F.col("z").alias("cw_z"), F.col("p_value").alias("cw_p"))
    dm = forecast.diebold_mariano(pairs, ["asset"], "day", "absolute").select("asset", F.col("z").alias("dm_z"), F.col("p_value").alias("dm_p"))
    better = pairs.groupBy("asset").agg((F.sum(F.pow("e1", 2)) < F.sum(F.pow("e0", 2))).alias("better"))
    out = cw.join(dm, "asset").join(better, "asset")
    return out.select("asset", *(r6(c) for c in ("cw_z", "cw_p", "dm_z", "dm_p")), "better", forecast.supports(F.col("better"), F.col("cw_p")).alias("verdict"))


@register("cumulative_loss", FORECAST_SQL + " SELECT asset, CAST(day AS VARCHAR) AS day, round(sum(e0 * e0) OVER w, 6) AS benchmark_loss, round(sum(e1 * e1) OVER w, 6) AS extended_loss, round(sum(e0 * e0) OVER w - sum(e1 * e1) OVER w, 6) AS difference FROM p WINDOW w AS (PARTITION BY asset ORDER BY day ROWS UNBOUNDED PRECEDING)")
def cumulative_loss(spark, sf_dir):
    return forecast.cumulative_loss(_pairs(spark, sf_dir), ["asset"], "day").select("asset", day_text(), r6("benchmark_loss"), r6("extended_loss"), r6("difference"))


@register(
    "forecast_groups",
    FORECAST_SQL + " SELECT asset, year(day) AS yr, CASE WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, count(*) AS n, round(sqrt(avg(e0 * e0)), 6) AS rmse_mean, round(sqrt(avg(e1 * e1)), 6) AS rmse_lag FROM p GROUP BY 1, 2, 3",
)
def forecast_groups(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumns({"yr": F.year("day").cast("long"), "day_type": F.when(scalar.is_weekend("day"), "weekend").otherwise("weekday")})
    rmse = lambda e: F.round(F.sqrt(F.avg(F.pow(e, 2))), 6)
    return pairs.groupBy("asset", "yr", "day_type").agg(F.count(F.lit(1)).alias("n"), rmse("e0").alias("rmse_mean"), rmse("e1").alias("rmse_lag"))


@register(
    "rolling_models",
    f"WITH {CHANGES_SQL}, s AS (SELECT asset, day, ret AS y, ret_lag AS x, row_number() OVER (PARTITION BY asset ORDER BY day) AS rn FROM r WHERE ret IS NOT NULL AND ret_lag IS NOT NULL), g AS (SELECT asset, day, rn, count(*) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM s WINDOW w AS (PARTITION BY asset ORDER BY day ROWS BETWEEN 364 PRECEDING AND CURRENT ROW)), k AS (SELECT * FROM g WHERE rn >= 365 AND (rn - 365) % 7 = 0 AND n >= 330) SELECT asset, CAST(day AS VARCHAR) AS window_end, 'ret_lag' AS parameter, round(b, 6) AS coefficient, n FROM k UNION ALL SELECT asset, CAST(day AS VARCHAR), 'const', round(a, 6), n FROM k",
)
def rolling_models(spark, sf_dir):
    out = forecast.rolling_models(modelling(spark, sf_dir), "ret", ["ret_lag"], ["asset"], "day")
    return out.select("asset", day_text("window_end"), "parameter", r6("coefficient"), "n")


ROLLED_SQL = f"WITH {CHANGES_SQL}, s AS (SELECT asset, day, ret AS y, ret_lag AS x, row_number() OVER (PARTITION BY asset ORDER BY day) AS rn FROM r WHERE ret IS NOT NULL AND ret_lag IS NOT NULL), g AS (SELECT asset, day, rn, count(*) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM s WINDOW w AS (PARTITION BY asset ORDER BY day ROWS BETWEEN 364 PRECEDING AND CURRENT ROW)), k AS (SELECT * FROM g WHERE rn >= 365 AND (rn - 365) % 7 = 0 AND n >= 330), w AS (SELECT asset, 'ret_lag' AS parameter, b AS coefficient FROM k UNION ALL SELECT asset, 'const', a FROM k), h AS (SELECT asset, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s GROUP BY 1), f AS (SELECT asset, 'ret_lag' AS parameter, b AS full_sample FROM h UNION ALL SELECT asset, 'const', a FROM h)"


@register(
    "stability",
    ROLLED_SQL + f", m AS (SELECT asset, parameter, count(*) AS n_windows, avg(coefficient) AS mean, quantile_cont(coefficient, 0.5) AS median, min(coefficient) AS minimum, max(coefficient) AS maximum, stddev_samp(coefficient) AS std, avg(CASE WHEN sign(coefficient) = sign(full_sample) THEN 1.0 ELSE 0.0 END) AS share_agreeing FROM w JOIN f USING (asset, parameter) GROUP BY 1, 2) SELECT asset, parameter, n_windows, {_r6('mean', 'median', 'minimum', 'maximum', 'std', 'share_agreeing')} FROM m",
)
def stability(spark, sf_dir):
    """Spread and signs of the rolling coefficients against the full sample's."""
    rows = modelling(spark, sf_dir)
    rolled = forecast.rolling_models(rows, "ret", ["ret_lag"], ["asset"], "day")
    full = ols.fit(rows, "ret", ["ret_lag"], ["asset"]).select("asset", "parameter", F.col("coefficient").alias("full_sample"))
    got = rolled.join(full, ["asset", "parameter"]).withColumn("agrees", scalar.same_sign("coefficient", "full_sample"))
    out = got.groupBy("asset", "parameter").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("coefficient").alias("mean"), F.percentile("coefficient", F.lit(0.5)).alias("median"), F.min("coefficient").alias("minimum"), F.max("coefficient").alias("maximum"), F.stddev_samp("coefficient").alias("std"), F.avg(F.col("agrees").cast("double")).alias("share_agreeing"))
    return out.select("asset", "parameter", "n_windows", *(r6(c) for c in ("mean", "median", "minimum", "maximum", "std", "share_agreeing")))


@register(
    "annual_models",
    f"WITH {CHANGES_SQL}, s AS (SELECT asset, year(day) AS yr, ret AS y, ret_lag AS x FROM r WHERE ret IS NOT NULL AND ret_lag IS NOT NULL) SELECT asset, yr, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r2 FROM s GROUP BY 1, 2 HAVING count(*) > 10",
)
def annual_models(spark, sf_dir):
    rows = modelling(spark, sf_dir).withColumn("yr", F.year("day").cast("long"))
    out = ols.fit(rows, "ret", ["ret_lag"], ["asset", "yr"]).where("parameter = 'ret_lag' and n > 10")
    return out.select("asset", "yr", "n", r6("coefficient", "slope"), r6("r2"))


@register(
    "extreme_sensitivity",
    f"WITH {CHANGES_SQL}, s AS (SELECT asset, ret AS y, ret_lag AS x FROM r WHERE ret IS NOT NULL AND ret_lag IS NOT NULL) SELECT asset, count(*) AS n, count(*) FILTER (abs(y) < 0.02) AS n_kept, round(regr_slope(y, x), 6) AS slope_all, round(regr_slope(y, x) FILTER (abs(y) < 0.02), 6) AS slope_kept FROM s GROUP BY 1",
)
def extreme_sensitivity(spark, sf_dir):
    rows = modelling(spark, sf_dir)
    take = lambda d, s: ols.fit(d, "ret", ["ret_lag"], ["asset"]).where("parameter = 'ret_lag'").select("asset", F.col("n").alias(f"n{s}"), F.col("coefficient").alias(f"b{s}"))
    both = take(rows, 0).join(take(rows.where(F.abs("ret") < 0.02), 1), "asset")
    return both.select("asset", F.col("n0").alias("n"), F.col("n1").alias("n_kept"), r6("b0", "slope_all"), r6("b1", "slope_kept"))


POOLED_SQL = f"""{ONE}, t AS (SELECT asset, day, n, a, b, mx, u / sxx * (x - mx) AS s_slope, (1 / n - mx * (x - mx) / sxx) * u AS s_const FROM u JOIN (SELECT asset, a, b FROM g) USING (asset) WHERE asset IN ('A', 'N')),
infl AS (SELECT day, 'const' AS parameter, s_const AS s FROM t WHERE asset = 'A' UNION ALL SELECT day, 'ret_lag', s_slope FROM t WHERE asset = 'A'
 UNION ALL SELECT day, 'is_n', CASE asset WHEN 'N' THEN 1 ELSE -1 END * s_const FROM t UNION ALL SELECT day, 'is_n_x_ret_lag', CASE asset WHEN 'N' THEN 1 ELSE -1 END * s_slope FROM t),
days AS (SELECT DISTINCT day FROM t), daily AS (SELECT day, parameter, coalesce(sum(s), 0) AS s FROM days CROSS JOIN (SELECT DISTINCT parameter FROM infl) LEFT JOIN infl USING (day, parameter) GROUP BY 1, 2),
v AS (SELECT parameter, {sql.HAC} AS hac FROM (SELECT *, {sql.LAGGED} FROM daily WINDOW w AS (PARTITION BY parameter ORDER BY day)) GROUP BY 1),
sizes AS (SELECT count(*) AS n, max(a) FILTER (asset = 'A') AS aa, max(b) FILTER (asset = 'A') AS ba, max(a) FILTER (asset = 'N') AS an, max(b) FILTER (asset = 'N') AS bn FROM t),
o AS (SELECT parameter, n, CASE parameter WHEN 'const' THEN aa WHEN 'ret_lag' THEN ba WHEN 'is_n' THEN an - aa ELSE bn - ba END AS coefficient, sqrt(hac * n / (n - 4)) AS se FROM v CROSS JOIN sizes)"""


@register("pooled_model", POOLED_SQL + f" SELECT parameter, n, {_r6('coefficient', 'se')}, round({sql.normal_two_sided('(coefficient / se)')}, 6) + 0.0 AS p_value, round(coefficient - 1.96 * se, 6) + 0.0 AS ci_low, round(coefficient + 1.96 * se, 6) + 0.0 AS ci_high FROM o")
def pooled_model(spark, sf_dir):
    """Two assets in one model with every term interacted; errors clustered by day."""
    rows = modelling(spark, sf_dir).where("asset in ('A', 'N')").withColumn("is_n", (F.col("asset") == "N").cast("double"))
    return ols.pooled(rows, "ret", ["ret_lag"], "is_n").select("parameter", "n", *(r6(c) for c in ("coefficient", "se", "p_value", "ci_low", "ci_high")))


@register(
    "effect_sizes",
    f"WITH {CHANGES_SQL}, s AS (SELECT asset, ret AS y, ret_lag AS x FROM r WHERE ret IS NOT NULL AND ret_lag IS NOT NULL), e AS (SELECT asset, regr_slope(y, x) * stddev_samp(x) AS effect FROM s GROUP BY 1) SELECT asset, round(effect, 8) AS effect, round(100 * effect, 6) AS pp, round(10000 * effect, 4) AS bps, round(100 * (exp(effect) - 1), 6) AS exact_pct, dense_rank() OVER (ORDER BY abs(effect) DESC) AS rank FROM e",
)
def effect_sizes(spark, sf_dir):
    from pyspark.sql import Window

    rows = modelling(spark, sf_dir).where("ret is not null and ret_lag is not null")
    spread = rows.groupBy("asset").agg(F.stddev_samp("ret_lag").alias("sd"))
    fit = ols.fit(rows, "ret", ["ret_lag"], ["asset"]).where("parameter = 'ret_lag'")
    out = fit.join(spread, "asset").withColumn("effect", F.col("coefficient") * F.col("sd"))
    rank = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(F.abs("effect").desc())).cast("long")
    return out.select("asset", F.round("effect", 8).alias("effect"), r6(scalar.percentage_points("effect"), "pp"), F.round(scalar.basis_points("effect"), 4).alias("bps"), r6(scalar.exact_percent("effect"), "exact_pct"), rank.alias("rank"))


@register(
    "publication_table",
    f"WITH {sql.SUITE}, o AS (SELECT *, {sql.normal_two_sided('z')} AS p_value FROM fitted WHERE asset = 'A'), t AS (SELECT model, parameter, 0 AS line, printf('%.4f', coefficient) || {sql.stars('p_value')} AS text FROM o UNION ALL SELECT model, parameter, 1, printf('(%.4f)', se) FROM o UNION SELECT model, 'N', 2, CAST(CAST(n AS BIGINT) AS VARCHAR) FROM o UNION SELECT model, 'R2', 2, printf('%.4f', r2) FROM o) SELECT parameter, line, max(text) FILTER (model = 'M0') AS M0, max(text) FILTER (model = 'M1') AS M1 FROM t GROUP BY 1, 2",
)
def publication_table(spark, sf_dir):
    """Parameters by model: coefficient with stars, error below, then N and R2, as text."""
    out = ols.suite(modelling(spark, sf_dir).where("asset = 'A'"), "ret", MODELS, ["asset"], lags=7)
    coef = out.select("model", "parameter", F.lit(0).alias("line"), scalar.coefficient_text("coefficient", "p_value").alias("text"))
    errs = out.select("model", "parameter", F.lit(1).alias("line"), scalar.error_text("se").alias("text"))
    size = out.select("model", F.lit("N").alias("parameter"), F.lit(2).alias("line"), F.col("n").cast("string").alias("text")).distinct()
    fit = out.select("model", F.lit("R2").alias("parameter"), F.lit(2).alias("line"), F.format_string("%.4f", "r2").alias("text")).distinct()
    return coef.unionAll(errs).unionAll(size).unionAll(fit).groupBy("parameter", "line").pivot("model", list(MODELS)).agg(F.first("text"))


@register("correlation_long", f"WITH {CHANGES_SQL} SELECT asset, 'ret' AS first, 'activity' AS second, round(corr(ret, activity), 6) AS r FROM r GROUP BY 1")
def correlation_long(spark, sf_dir):
    return summary.correlations(modelling(spark, sf_dir), ["ret", "activity"], ["asset"]).withColumn("r", F.round("r", 6))


@register("volume_moments", f"WITH {SERIES_SQL} SELECT asset, round(skewness(volume), 6) AS skew_raw, round(skewness(ln(1 + volume)), 6) AS skew_log, round(kurtosis(volume), 6) AS kurt_raw FROM series GROUP BY 1")
def volume_moments(spark, sf_dir):
    rows = base_series(spark, sf_dir).withColumn("log_volume", F.log1p("volume"))
    return rows.groupBy("asset").agg(F.round(summary.sample_skewness("volume"), 6).alias("skew_raw"), F.round(summary.sample_skewness("log_volume"), 6).alias("skew_log"), F.round(summary.sample_kurtosis("volume"), 6).alias("kurt_raw"))
