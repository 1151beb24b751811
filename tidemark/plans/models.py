"""Queries over several models together: cross-series models, stability, added fit, decisions, roll-ups, outside forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..registry import register
from ..stats import diagnostics, forecast, ols, rollup
from . import sql
from .base import CHANGES_SQL, modelling, r6
from .statistics import FORECAST_SQL, MODELS, ONE, POOLED_SQL, RESIDUAL_TESTS_SQL, XS, _forecasts, _pairs, _r6, _z_sql

CROSS = {"R0": ("ret_lag",), "R1": ("other_lag", "ret_lag"), "R2": ("activity_lag", "ret_lag"), "R3": ("other_lag", "activity_lag", "ret_lag")}
CROSS_SQL = f"""{CHANGES_SQL}, cross_rows AS (SELECT a.asset, a.day, a.ret AS y, a.ret_lag, a.activity_lag, b.ret_lag AS other_lag FROM r a JOIN r b ON a.day = b.day AND ((a.asset = 'A' AND b.asset = 'N') OR (a.asset = 'N' AND b.asset = 'A'))
 WHERE a.ret IS NOT NULL AND a.ret_lag IS NOT NULL AND a.activity_lag IS NOT NULL AND b.ret_lag IS NOT NULL),
{", ".join(sql.last_coefficient(m.lower(), "cross_rows", "y", xs) for m, xs in CROSS.items())},
cross_models AS ({" UNION ALL ".join(f"SELECT '{m}' AS model, * FROM {m.lower()}" for m in CROSS)})"""


def cross_rows(spark, sf_dir):
    """Two series, each with the other's lagged return."""
    rows = modelling(spark, sf_dir)
    pair = F.when(F.col("asset") == "A", "N").when(F.col("asset") == "N", "A")
    others = rows.select(pair.alias("asset"), "day", F.col("ret_lag").alias("other_lag")).where("asset is not null")
    return rows.join(others, ["asset", "day"])


def _cross_suite(spark, sf_dir):
    return ols.suite(cross_rows(spark, sf_dir), "ret", CROSS, ["asset"], lags=7)


@register("cross_series_models", f"WITH {CROSS_SQL} SELECT asset, model, CAST(n AS BIGINT) AS n, {_r6('coefficient', 'se')}, round({sql.normal_two_sided('z')}, 6) + 0.0 AS p_value, round(r2, 6) + 0.0 AS r2 FROM cross_models")
def cross_series_models(spark, sf_dir):
    """The own lag's coefficient beside the other series' return and activity, on one sample."""
    out = _cross_suite(spark, sf_dir).where("parameter = 'ret_lag'")
    return out.select("asset", "model", "n", *(r6(c) for c in ("coefficient", "se", "p_value", "r2")))


@register("incremental_r2", f"WITH {CROSS_SQL}, f AS (SELECT asset, model, r2, 1 - (1 - r2) * (n - 1) / (n - k - 1) AS adj FROM cross_models), o AS (SELECT a.asset, a.r2 AS r2_base, b.r2 AS r2_extended, b.r2 - a.r2 AS change_r2, a.adj AS adj_r2_base, b.adj AS adj_r2_extended, b.adj - a.adj AS change_adj_r2 FROM f a JOIN f b ON a.asset = b.asset AND a.model = 'R2' AND b.model = 'R3') SELECT asset, {_r6('r2_base', 'r2_extended', 'change_r2', 'adj_r2_base', 'adj_r2_extended', 'change_adj_r2')} FROM o")
def incremental_r2(spark, sf_dir):
    out = rollup.incremental_fit(_cross_suite(spark, sf_dir), "R2", "R3", ["asset"])
    return out.select("asset", *(r6(c) for c in ("r2_base", "r2_extended", "change_r2", "adj_r2_base", "adj_r2_extended", "change_adj_r2")))


@register("coefficient_stability", f"WITH {sql.SUITE}, o AS (SELECT a.asset, a.coefficient AS base, b.coefficient AS extended, b.coefficient - a.coefficient AS difference, 100 * (b.coefficient - a.coefficient) / abs(a.coefficient) AS change_pct FROM fitted a JOIN fitted b ON a.asset = b.asset AND a.model = 'M0' AND b.model = 'M1' AND a.parameter = 'ret_lag' AND b.parameter = 'ret_lag') SELECT asset, round(base, 6) AS base, round(extended, 6) AS extended, round(difference, 6) + 0.0 AS difference, round(change_pct, 4) + 0.0 AS change_pct FROM o")
def coefficient_stability(spark, sf_dir):
    suite = ols.suite(modelling(spark, sf_dir), "ret", MODELS, ["asset"], lags=7)
    out = rollup.coefficient_stability(suite, "ret_lag", "M0", "M1", ["asset"])
    return out.select("asset", r6("base"), r6("extended"), r6("difference"), (F.round("change_pct", 4) + 0.0).alias("change_pct"))


VARIANTS = (("plain", None, False, True), ("hac", 7, False, False), ("hac corrected", 7, True, False), ("hac t", 7, False, True), ("hac t corrected", 7, True, True))


@register(
    "hac_variants",
    ONE + f", z AS (SELECT asset, n, sxx, (x - mx) / sxx * u AS s FROM u), zl AS (SELECT u.asset, u.n, u.sxx, u.u, u.day, (u.x - u.mx) / u.sxx * u.u AS s FROM u), l AS (SELECT *, {sql.LAGGED} FROM zl WINDOW w AS (PARTITION BY asset ORDER BY day)), v AS (SELECT asset, max(n) AS n, sqrt({sql.HAC}) AS hac, sqrt(sum(u * u) / (max(n) - 2) / max(sxx)) AS plain FROM l GROUP BY 1), o AS (SELECT v.*, g.b FROM v JOIN g USING (asset)), e AS (SELECT asset, n, b, 'plain' AS variant, plain AS se, true AS student FROM o UNION ALL SELECT asset, n, b, 'hac', hac, false FROM o UNION ALL SELECT asset, n, b, 'hac corrected', hac * sqrt(n / (n - 2)), false FROM o UNION ALL SELECT asset, n, b, 'hac t', hac, true FROM o UNION ALL SELECT asset, n, b, 'hac t corrected', hac * sqrt(n / (n - 2)), true FROM o) SELECT asset, variant, round(se, 6) AS se, round(CASE WHEN student THEN {sql.t_two_sided('(b / se)', '(n - 2)')} ELSE {sql.normal_two_sided('(b / se)')} END, 6) + 0.0 AS p_value FROM e",
)
def hac_variants(spark, sf_dir):
    """One coefficient under every form of inference: ordinary, HAC, corrected for degrees of freedom, normal or Student's t."""
    rows, out = modelling(spark, sf_dir), None
    for name, lags, correction, student in VARIANTS:
        one = ols.fit(rows, "ret", ["ret_lag"], ["asset"], lags=lags, correction=correction, use_t=student).where("parameter = 'ret_lag'")
        one = one.select("asset", F.lit(name).alias("variant"), r6("se"), r6("p_value"))
        out = one if out is None else out.unionAll(one)
    return out


@register("diagnostic_flags", RESIDUAL_TESTS_SQL + ", f AS (SELECT asset, bool_or(p_value < 0.05 AND test IN ('Breusch-Pagan', 'White')) AS heteroscedastic, bool_or(p_value < 0.05 AND test NOT LIKE '% F' AND (test LIKE 'Breusch-Godfrey%' OR test LIKE 'Ljung-Box%')) AS serially_correlated, bool_or(p_value < 0.05 AND test = 'Jarque-Bera') AS not_normal FROM tests GROUP BY 1) SELECT *, heteroscedastic OR serially_correlated AS hac_supported FROM f")
def diagnostic_flags(spark, sf_dir):
    return rollup.diagnostic_flags(diagnostics.all_tests(modelling(spark, sf_dir), "ret", XS, ["asset"], "day"), ["asset"])


CW_ADJUSTED = "e0 * e0 - (e1 * e1 - (f0 - f1) ** 2)"
HYPOTHESES_SQL = f"""{sql.SUITE}, {FORECAST_SQL[FORECAST_SQL.index('f AS ('):].replace('FROM s WINDOW', "FROM (SELECT asset, day, ret AS y, ret_lag AS x FROM r WHERE ret IS NOT NULL AND ret_lag IS NOT NULL) WINDOW")},
cw AS (SELECT asset, avg(d) AS mean, sqrt(({sql.HAC}) / count(*) / (count(*) - 1)) AS se FROM (SELECT *, {sql.LAGGED} FROM (SELECT asset, day, d, d - avg(d) OVER (PARTITION BY asset) AS s FROM (SELECT asset, day, {CW_ADJUSTED} AS d FROM p)) WINDOW w AS (PARTITION BY asset ORDER BY day)) GROUP BY 1),
better AS (SELECT asset, sum(e1 * e1) < sum(e0 * e0) AS better FROM p GROUP BY 1)"""


@register(
    "hypotheses",
    f"""WITH {HYPOTHESES_SQL}, h AS (SELECT 'association ' || asset AS hypothesis, asset AS subject, 'in-sample association' AS test_type, coefficient AS effect, se, z AS statistic, {sql.normal_two_sided('z')} AS p_value, NULL AS better, 'two-sided p < 0.05' AS decision_rule FROM fitted WHERE model = 'M1' AND parameter = 'ret_lag'
 UNION ALL SELECT 'forecast ' || asset, asset, 'out-of-sample forecast', mean, se, mean / se, {sql.normal_upper('(mean / se)')}, better, 'lower error and one-sided p < 0.05' FROM cw JOIN better USING (asset))
SELECT hypothesis, subject, test_type, {_r6('effect', 'se')}, round(statistic, 4) + 0.0 AS statistic, round(p_value, 6) + 0.0 AS p_value, coalesce(better, true) AND p_value < 0.05 AS supported, decision_rule FROM h
UNION ALL SELECT 'difference N - A', 'N - A', 'pooled difference', d.effect, d.se, d.statistic, d.p_value, d.p_value < 0.05, 'two-sided p < 0.05' FROM (WITH {POOLED_SQL.removeprefix('WITH ')} SELECT {_r6('coefficient').replace('AS coefficient', 'AS effect')}, round(se, 6) + 0.0 AS se, round(coefficient / se, 4) + 0.0 AS statistic, round({sql.normal_two_sided('(coefficient / se)')}, 6) + 0.0 AS p_value FROM o WHERE parameter = 'is_n_x_ret_lag') d""",
)
def hypotheses(spark, sf_dir):
    """Associations, forecast gains and the series' difference, each with its decision rule."""
    rows = modelling(spark, sf_dir)
    inside = ols.suite(rows, "ret", MODELS, ["asset"], lags=7).where("model = 'M1' and parameter = 'ret_lag'")
    pairs = _pairs(spark, sf_dir)
    better = pairs.groupBy("asset").agg((F.sum(F.pow("e1", 2)) < F.sum(F.pow("e0", 2))).alias("better"))
    outside = forecast.clark_west(pairs, ["asset"], "day").join(better, "asset")
    two = rows.where("asset in ('A', 'N')").withColumn("is_n", (F.col("asset") == "N").cast("double"))
    apart = ols.pooled(two, "ret", ["ret_lag"], "is_n").where("parameter = 'is_n_x_ret_lag'")
    named = lambda kind: F.concat(F.lit(kind + " "), F.col("asset"))
    out = rollup.association(named("association"), F.col("asset"), inside).unionByName(rollup.improvement(named("forecast"), F.col("asset"), outside))
    out = out.unionByName(rollup.difference(F.lit("difference N - A"), F.lit("N - A"), apart))
    return out.select("hypothesis", "subject", "test_type", r6("effect"), r6("se"), (F.round("statistic", 4) + 0.0).alias("statistic"), r6("p_value"), "supported", "decision_rule")


OTHER_LAGS = (1, 2, 3, 7)
_P = lambda source: f"SELECT asset, {sql.normal_two_sided('z')} AS p_value FROM {source}"


@register(
    "robustness",
    f"""WITH {CROSS_SQL}, lagged AS (SELECT asset, day, ret AS y, {", ".join(f"lag(ret, {k}) OVER (PARTITION BY asset ORDER BY day) AS l{k}" for k in OTHER_LAGS)} FROM r), lag_rows AS (SELECT * FROM lagged WHERE y IS NOT NULL AND {" AND ".join(f"l{k} IS NOT NULL" for k in OTHER_LAGS)}),
{", ".join(sql.last_coefficient(f"lag{k}", "lag_rows", "y", [f"l{k}"]) for k in OTHER_LAGS)},
years AS (SELECT asset, day, year(day) AS yr, ret AS y, ret_lag FROM r WHERE ret IS NOT NULL AND ret_lag IS NOT NULL AND year(day) IN (SELECT year(day) FROM series GROUP BY 1 HAVING count(*) > 300)), {sql.last_coefficient("annual", "years", "y", ["ret_lag"], ("asset", "yr"))},
results AS (SELECT 'alternative lags' AS robustness_check, asset, p_value FROM ({" UNION ALL ".join(_P(f"lag{k}") for k in OTHER_LAGS)}) UNION ALL SELECT 'cross-series models', asset, p_value FROM ({_P("cross_models")}) UNION ALL SELECT 'years', asset, p_value FROM ({_P("annual")}))
SELECT asset, robustness_check, count(p_value) AS n_results, bool_or(p_value < 0.05) AS significant, CASE WHEN bool_or(p_value < 0.05) THEN 'at least one significant at 5%' ELSE 'none significant at 5%' END AS finding FROM results GROUP BY 1, 2""",
)
def robustness(spark, sf_dir):
    """Whether the lagged return is significant under any other lag, cross-series model or year."""
    rows = modelling(spark, sf_dir)
    w = Window.partitionBy("asset").orderBy("day")
    wide = rows.withColumns({f"l{k}": F.lag("ret", k).over(w) for k in OTHER_LAGS})
    lags = ols.suite(wide, "ret", {f"l{k}": (f"l{k}",) for k in OTHER_LAGS}, ["asset"], lags=7).where("parameter <> 'const'")
    cross = _cross_suite(spark, sf_dir).where("parameter = 'ret_lag'")
    yearly = rows.withColumn("yr", F.year("day"))
    full = yearly.groupBy("yr").count().where("count > 300").select("yr")
    annual = ols.fit(yearly.join(full, "yr", "left_semi"), "ret", ["ret_lag"], ["asset", "yr"]).where("parameter = 'ret_lag'")
    out = [rollup.any_significant(d, name, ["asset"]) for name, d in (("alternative lags", lags), ("cross-series models", cross), ("years", annual))]
    return out[0].unionAll(out[1]).unionAll(out[2])


@register(
    "annual_against_full",
    f"WITH {CHANGES_SQL}, s AS (SELECT asset, year(day) AS yr, ret AS y, ret_lag AS x FROM r WHERE ret IS NOT NULL AND ret_lag IS NOT NULL), a AS (SELECT asset, yr, regr_slope(y, x) AS b FROM s GROUP BY 1, 2 HAVING count(*) > 10), f AS (SELECT asset, regr_slope(y, x) AS full_sample FROM s GROUP BY 1) SELECT asset, yr, round(b, 6) AS slope, round(full_sample, 6) AS full_sample, round(b - full_sample, 6) + 0.0 AS difference, CASE WHEN b <> 0 AND full_sample <> 0 THEN sign(b) = sign(full_sample) END AS agrees FROM a LEFT JOIN f USING (asset)",
)
def annual_against_full(spark, sf_dir):
    """Sub-samples' coefficients beside the full sample's."""
    rows = modelling(spark, sf_dir).withColumn("yr", F.year("day").cast("long"))
    annual = ols.fit(rows, "ret", ["ret_lag"], ["asset", "yr"]).where("parameter = 'ret_lag' and n > 10").select("asset", "yr", F.col("coefficient").alias("b"))
    full = ols.fit(rows, "ret", ["ret_lag"], ["asset"]).where("parameter = 'ret_lag'").select("asset", F.col("coefficient").alias("full_sample"))
    out = annual.join(full, "asset", "left")
    return out.select("asset", "yr", r6("b", "slope"), r6("full_sample"), r6(F.col("b") - F.col("full_sample"), "difference"), scalar.same_sign("b", "full_sample").alias("agrees"))


@register(
    "external_forecasts",
    FORECAST_SQL + f", x AS (SELECT *, 0.5 * (f0 + f1) AS fx FROM p WHERE isodow(day) < 6), q AS (SELECT asset, day, f0, fx AS f1, e0, y - fx AS e1 FROM x), t AS (SELECT asset, z, {sql.normal_two_sided('z')} AS p_value FROM {_z_sql('e0 * e0 - e1 * e1', False).replace('FROM p)', 'FROM q)')}), m AS (SELECT asset, count(*) AS n, sqrt(avg(e0 * e0)) AS rmse_own, sqrt(avg(e1 * e1)) AS rmse_external FROM q GROUP BY 1) SELECT asset, n, {_r6('rmse_own', 'rmse_external')}, round(z, 4) + 0.0 AS z, round(p_value, 6) + 0.0 AS p_value, CASE WHEN p_value >= 0.05 THEN 'no difference' WHEN rmse_external < rmse_own THEN 'external better' ELSE 'own better' END AS decision FROM m JOIN t USING (asset)",
)
def external_forecasts(spark, sf_dir):
    """Forecasts from elsewhere (here: the mean of both models, weekdays, with some actual values that don't match) against the benchmark."""
    pairs = _pairs(spark, sf_dir)
    outside = pairs.select("asset", "day", F.when(scalar.is_weekend("day"), F.col("actual") + 1).otherwise(F.col("actual")).alias("actual"), (0.5 * (F.col("f0") + F.col("f1"))).alias("forecast"))
    own = _forecasts(spark, sf_dir).where("model = 'mean'").select("asset", "day", "actual", "forecast")
    return forecast.compare_external(own, outside, ["asset"], "day").select("asset", "n", r6("rmse_own"), r6("rmse_external"), (F.round("z", 4) + 0.0).alias("z"), r6("p_value"), "decision")


@register("forecast_template", FORECAST_SQL + " SELECT asset, CAST(day AS VARCHAR) AS day, round(y, 6) + 0.0 AS actual, NULL::DOUBLE AS forecast FROM p")
def forecast_template(spark, sf_dir):
    out = forecast.template(_forecasts(spark, sf_dir), ["asset"], "day")
    return out.select("asset", F.col("day").cast("string").alias("day"), r6("actual"), "forecast")
