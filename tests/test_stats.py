import math

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import probability as P
from tidemark.stats import diagnostics, forecast, ols

RNG = np.random.default_rng(0)
N = 240


def _frame(spark, n=N):
    x1, x2 = RNG.normal(24, 0.6, n), RNG.normal(size=n)
    y = 0.3 + 0.5 * x1 - 0.2 * x2 + RNG.normal(size=n) * (1 + 0.3 * np.abs(x2))
    pdf = pd.DataFrame({"k": "a", "day": pd.date_range("2021-01-01", periods=n).date, "y": y, "x1": x1, "x2": x2})
    other = pdf.assign(k="b", y=pdf.y[::-1].to_numpy())
    return pdf, spark.createDataFrame(pd.concat([pdf, other]))


def _ols(pdf, xs=("x1", "x2")):
    X = np.column_stack([np.ones(len(pdf)), *(pdf[x] for x in xs)])
    b = np.linalg.lstsq(X, pdf.y, rcond=None)[0]
    return X, b, pdf.y.to_numpy() - X @ b


def _hac(X, u, lags, correction):
    s = X * u[:, None]
    S = s.T @ s
    for k in range(1, lags + 1):
        g = s[k:].T @ s[:-k]
        S += (1 - k / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(X.T @ X)
    return inv @ S @ inv * (len(u) / (len(u) - X.shape[1]) if correction else 1)


@pytest.mark.parametrize(("lags", "correction"), [(None, True), (7, True), (7, False), (3, True)])
def test_fit_equals_numpy(spark, lags, correction):
    pdf, df = _frame(spark)
    got = ols.fit(df, "y", ["x1", "x2"], ["k"], lags=lags, correction=correction).where("k = 'a'").toPandas().set_index("parameter")
    X, b, u = _ols(pdf)
    cov = np.linalg.inv(X.T @ X) * (u @ u) / (len(u) - 3) if lags is None else _hac(X, u, lags, correction)
    for i, name in enumerate(["const", "x1", "x2"]):
        assert got.loc[name, "coefficient"] == pytest.approx(b[i], rel=1e-9)
        assert got.loc[name, "se"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-8)
    ssr, n = u @ u, len(u)
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)
    assert got.loc["x1", "aic"] == pytest.approx(6 - 2 * llf) and got.loc["x1", "bic"] == pytest.approx(3 * math.log(n) - 2 * llf)


def test_models_skip_missing_rows_and_singular_designs(spark):
    pdf, df = _frame(spark)
    from pyspark.sql import functions as F

    holes = df.withColumn("x1", F.when(F.dayofmonth("day") == 3, float("nan")).otherwise(F.col("x1")))
    assert ols.fit(holes, "y", ["x1"], ["k"]).first().n < N
    assert ols.fit(df.withColumn("x3", 2 * F.col("x1")), "y", ["x1", "x3"], ["k"]).count() == 0
    assert ols.fit(df.limit(0), "y", ["x1"], ["k"]).count() == 0


def test_pooled_by_day(spark):
    pdf, df = _frame(spark)
    from pyspark.sql import functions as F

    got = ols.pooled(df.withColumn("is_b", (F.col("k") == "b").cast("int")), "y", ["x1"], "is_b").toPandas().set_index("parameter")
    both = df.toPandas().sort_values(["day", "k"])
    i = (both.k == "b").to_numpy(float)
    X = np.column_stack([np.ones(len(both)), i, both.x1, i * both.x1])
    b = np.linalg.lstsq(X, both.y, rcond=None)[0]
    s = pd.DataFrame(X * (both.y.to_numpy() - X @ b)[:, None]).groupby(both.day.to_numpy()).sum().to_numpy()
    S = s.T @ s
    for k in range(1, 8):
        g = s[k:].T @ s[:-k]
        S += (1 - k / 8) * (g + g.T)
    inv = np.linalg.inv(X.T @ X)
    cov = inv @ S @ inv * len(X) / (len(X) - 4)
    assert got.loc["is_b_x_x1", "coefficient"] == pytest.approx(b[3], rel=1e-8)
    assert got.loc["is_b_x_x1", "se"] == pytest.approx(math.sqrt(cov[3, 3]), rel=1e-7)


def test_vif(spark):
    pdf, df = _frame(spark)
    r = np.corrcoef(pdf.x1, pdf.x2)[0, 1]
    got = {x.variable: x.vif for x in ols.vif(df.where("k = 'a'"), ["x1", "x2"]).collect()}
    assert got["x1"] == pytest.approx(1 / (1 - r * r)) == got["x2"]
    from pyspark.sql import functions as F

    assert ols.vif(df.withColumn("flat", F.lit(1.0)), ["x1", "flat"]).where("variable = 'flat'").first().vif == float("inf")


def test_diagnostics(spark):
    pdf, df = _frame(spark)
    one = df.where("k = 'a'")
    X, b, u = _ols(pdf)
    res = ols.residuals(one, "y", ["x1", "x2"], ["k"])
    assert diagnostics.durbin_watson(res, "residual", ["k"], "day").first().durbin_watson == pytest.approx(((u[1:] - u[:-1]) ** 2).sum() / (u @ u))
    n, e = len(u), u - u.mean()
    acf = [(e[k:] * e[:-k]).sum() / (e @ e) for k in range(1, 8)]
    q = n * (n + 2) * sum(r * r / (n - k) for k, r in enumerate(acf, 1))
    lb = diagnostics.ljung_box(res, "residual", ["k"], "day", (7,)).first()
    assert lb.q == pytest.approx(q) and lb.p_value == pytest.approx(P.chi2_sf(q, 7))

    def lm(y, Z):
        Z = np.column_stack([np.ones(n), Z])
        r = y - Z @ np.linalg.lstsq(Z, y, rcond=None)[0]
        return n * (1 - r @ r / ((y - y.mean()) @ (y - y.mean())))

    tests = {r.test: r.statistic for r in diagnostics.all_tests(one, "y", ["x1", "x2"], ["k"], "day").collect()}
    assert tests["Breusch-Pagan"] == pytest.approx(lm(u**2, X[:, 1:]), rel=1e-6)
    full = np.column_stack([pdf.x1, pdf.x2, pdf.x1**2, pdf.x1 * pdf.x2, pdf.x2**2])
    assert tests["White"] == pytest.approx(lm(u**2, full), rel=1e-4)
    lagged = np.column_stack([np.concatenate((np.zeros(k), u[:-k])) for k in (1, 2, 3)])
    assert tests["Breusch-Godfrey 3"] == pytest.approx(lm(u, np.column_stack([X[:, 1:], lagged])), rel=1e-6)
    m = [(e**k).mean() for k in (2, 3, 4)]
    assert tests["Jarque-Bera"] == pytest.approx(n / 6 * ((m[1] / m[0] ** 1.5) ** 2 + (m[2] / m[0] ** 2 - 3) ** 2 / 4))


def test_expanding_and_rolling(spark):
    pdf, df = _frame(spark)
    start = pdf.day[150]
    got = forecast.expanding_forecasts(df, "y", {"mean": (), "x": ("x1", "x2")}, ["k"], "day", str(start)).where("k = 'a'").toPandas().sort_values(["model", "day"])
    for model, rows in got.groupby("model"):
        assert len(rows) == N - 150
        for t, r in zip(range(150, N), rows.itertuples(), strict=True):
            past = pdf[:t]
            want = past.y.mean() if model == "mean" else np.array([1, pdf.x1[t], pdf.x2[t]]) @ _ols(past)[1]
            assert r.forecast == pytest.approx(want, rel=1e-9) and r.train_n == t and r.train_end == pdf.day[t - 1]
    rolled = forecast.rolling_models(df, "y", ["x1"], ["k"], "day", width=100, step=20, least=90).where("k = 'a' and parameter = 'x1'").toPandas().sort_values("window_end")
    want = [_ols(pdf[i : i + 100], ("x1",))[1][1] for i in range(0, N - 99, 20)]
    assert rolled.coefficient.to_numpy() == pytest.approx(np.array(want))


def test_comparison_tests(spark):
    pdf, df = _frame(spark)
    f = forecast.expanding_forecasts(df, "y", {"m0": (), "m1": ("x1", "x2")}, ["k"], "day", str(pdf.day[100]))
    pairs = forecast.paired(f, ["k"], "day", "m0", "m1")
    p = pairs.where("k = 'a'").toPandas().sort_values("day")
    d = p.e0**2 - (p.e1**2 - (p.f0 - p.f1) ** 2)
    X, u = np.ones((len(d), 1)), (d - d.mean()).to_numpy()
    se = math.sqrt(_hac(X, u, 7, True)[0, 0])
    cw = forecast.clark_west(pairs, ["k"], "day").where("k = 'a'").first()
    assert cw.z == pytest.approx(d.mean() / se) and cw.p_value == pytest.approx(P.normal_sf(cw.z), abs=1e-10)
    m = forecast.metrics(f, ["k"], "m0").where("k = 'a' and model = 'm1'").first()
    assert m.rmse == pytest.approx(math.sqrt((p.e1**2).mean())) and m.oos_r2 == pytest.approx(1 - (p.e1**2).sum() / (p.e0**2).sum())
    loss = forecast.cumulative_loss(pairs, ["k"], "day").where("k = 'a'").orderBy("day").toPandas()
    assert loss.difference.iloc[-1] == pytest.approx((p.e0**2).sum() - (p.e1**2).sum())
    assert forecast.align_external(f.where("model = 'm0'"), f.where("model = 'm1'"), ["k"], "day").count() == pairs.count()


def test_known_answers():
    assert P.normal_sf(-1.3744) == pytest.approx(0.9153, abs=5e-5)
    assert P.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert P.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and P.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert P.f_sf(4.0, 2, 30) == pytest.approx(0.028777, abs=1e-4)
    assert P.t_quantile_two_sided(0.05, 1813) == pytest.approx(1.96128, abs=1e-4)
    assert math.sqrt(1821 / 1813) == pytest.approx(1.0022038594)


def test_normal_cdf_column(spark):
    from pyspark.sql import functions as F

    xs = [-40.0, -8.0, -3.0, -2.999, -1.0, -1e-9, 0.0, 0.5, 1.96, 3.0, 5.0, 9.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", P.normal_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(1 - P.normal_sf(r.x), abs=1e-12)
