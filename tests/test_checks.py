"""Checks between stages, roll-ups, percentiles and the market source, on small known data."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import panel, quality, summary
from tidemark.session import scratch
from tidemark.sources import market, spreadsheet, tables
from tidemark.stats import forecast, rollup


def test_why_a_day_is_missing(spark):
    """One day of every kind: retained rows, all excluded, none, and one beyond the source."""
    rows = [(1, 3, 2, 1, True, 0.5), (2, 4, 0, 4, True, None), (3, 0, 0, 0, True, None), (4, 0, 0, 0, False, None)]
    df = spark.createDataFrame(rows, "day int, raw int, kept int, dropped int, covered boolean, score double")
    got = {r.day: (r.status, r.n_used, r.score) for r in panel.with_status(df, "raw", "kept", "dropped", F.col("covered"), "n_used", ["score"]).collect()}
    assert got[1] == ("OBSERVED_RETAINED_ROWS", 2, 0.5) and got[2] == ("RAW_ROWS_ALL_EXCLUDED", 0, None)
    assert got[3] == ("GENUINE_ZERO_OBSERVED_ACTIVITY", 0, None) and got[4] == ("OUTSIDE_SOURCE_COVERAGE", None, None)


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0, 2.0, 7.0], 50), None: np.array([4.0]), "c": np.array([])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = {r.k: r.q for r in summary.percentiles(df, ["k"], "v", shares).collect()}
    assert set(got) == {"a", "b", None}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile(groups[k], shares).tolist())


def test_lags_nesting_membership_and_days(spark):
    df = spark.createDataFrame([(i, float(i * i), float((i - 1) ** 2) if i and i != 3 else None) for i in range(5)], "day int, v double, stored double").withColumn("k", F.lit("x"))
    wrong = quality.rebuilt_lag(df, ["k"], "day", "v", "stored").collect()
    assert [(r.day, r.rebuilt) for r in wrong] == [(3, 4.0)]
    flags = spark.createDataFrame([(True, True), (True, None), (False, True), (None, False)], "inner_one boolean, outer_one boolean")
    assert quality.not_nested(flags, "inner_one", "outer_one").count() == 1
    one, two = (spark.createDataFrame(r, "k int, f boolean") for r in ([(1, True), (2, False), (3, True)], [(1, True), (2, True), (4, True)]))
    assert sorted((r.k, r.in_left) for r in quality.disagreement(one, two, ["k"], "f").collect()) == [(2, False), (3, True), (4, False)]
    same = {r.frame: (r.n_keys, r.n_lacking) for r in quality.same_days({"one": one, "two": two}, ["k"]).collect()}
    assert same == {"one": (3, 1), "two": (3, 1)}


def test_rules_find_what_is_wrong(spark):
    good = (0.5, 0.1, 0.2, 0.3, 0.7, 0.5, 10, 2)
    bad = [(math.nan, 0.1, 0.2, 0.3, 0.7, 0.5, 10, 2), (0.5, 0.0, 0.2, 0.3, 0.7, 0.5, 10, 2), (0.5, 0.1, 1.2, 0.3, 0.7, 0.5, 10, 2), (0.9, 0.1, 0.2, 0.3, 0.7, 0.5, 10, 2), (0.5, 0.1, 0.2, 0.3, 0.7, 1.5, 10, 2), (0.5, 0.1, 0.2, 0.3, 0.7, 0.5, 2, 2)]
    df = spark.createDataFrame([good, *bad], "coefficient double, se double, p_value double, ci_low double, ci_high double, r2 double, n int, n_parameters int")
    checks = quality.Checks(spark)
    checks.counts(df, quality.model_rules())
    assert {r[0]: int(r[2]) for r in checks.rows} == {"coefficient not finite": 1, "error not positive": 1, "p outside 0 to 1": 1, "interval without coefficient": 2, "r2 outside 0 to 1": 1, "too few rows": 1}
    scored = spark.createDataFrame([(0.2, 0.5, 0.3, "neutral", 0.1), (0.2, 0.5, 0.4, "neutral", 0.2), (0.2, 0.5, 0.3, "positive", 0.1), (-0.1, 0.6, 0.5, "neutral", 0.6), (0.2, 0.5, 0.3, "odd", 2.0)], "prob_negative double, prob_neutral double, prob_positive double, score_label string, sentiment_score double")
    checks = quality.Checks(spark)
    checks.counts(scored, quality.scoring_rules())
    assert {r[0]: int(r[2]) for r in checks.rows} == {"probability outside 0 to 1": 1, "probabilities don't add up": 1, "unknown label": 1, "label not the likeliest": 2, "score outside -1 to 1": 1}


def test_gates(spark):
    schema = "name string, passed boolean, category string"
    table = spark.createDataFrame([("a", True, "x"), ("b", False, "x"), ("c", True, "y"), ("d", None, "z")], schema)
    assert {r.category: (r.n_checks, r.n_failed, r.passed) for r in quality.gate_status(table).collect()} == {"x": (2, 1, False), "y": (1, 0, True), "z": (1, 1, False)}
    assert quality.require_passed(table.where("category = 'y'")).count() == 1
    for where in ("category = 'x'", "category = 'z'", "false"):
        with pytest.raises(AssertionError):
            quality.require_passed(table.where(where))


def test_outside_forecasts(spark):
    rng, rows, theirs = np.random.default_rng(2), [], []
    for i in range(200):
        day, y = dt.date(2021, 1, 1) + dt.timedelta(days=i), float(rng.normal())
        rows.append(("x", day, y, 0.0))
        theirs.append(("x", day, y if i % 10 else y + 1, 0.9 * y))
    schema = "asset string, day date, actual double, forecast double"
    own, outside = spark.createDataFrame(rows, schema), spark.createDataFrame(theirs, schema)
    r = forecast.compare_external(own, outside, ["asset"], "day").first()
    assert r.n == 180 and r.decision == "external better" and r.p_value < 0.05
    assert forecast.compare_external(own, own, ["asset"], "day").first().decision == "no difference"
    form = forecast.template(own, ["asset"], "day")
    assert form.count() == 200 and form.where("forecast is not null").count() == 0


def test_rollups(spark):
    suite = spark.createDataFrame([("a", "m", "x", 2.0, 0.1, 0.05), ("a", "n", "x", 1.5, 0.3, 0.2), ("b", "m", "x", 0.0, 0.1, 0.1), ("b", "n", "x", 1.0, 0.2, 0.1)], "k string, model string, parameter string, coefficient double, r2 double, adj_r2 double")
    got = {r.k: (r.difference, r.change_pct) for r in rollup.coefficient_stability(suite, "x", "m", "n", ["k"]).collect()}
    assert got == {"a": (-0.5, -25.0), "b": (1.0, None)}
    assert rollup.incremental_fit(suite, "m", "n", ["k"]).where("k = 'a'").first().change_r2 == pytest.approx(0.2)
    tests = spark.createDataFrame([("a", "White", 0.01), ("a", "Ljung-Box 3", 0.5), ("b", "White F", 0.01), ("b", "Breusch-Godfrey 1", 0.04), ("c", "Jarque-Bera", 0.01)], "k string, test string, p_value double")
    flags = {r.k: (r.heteroscedastic, r.serially_correlated, r.not_normal, r.hac_supported) for r in rollup.diagnostic_flags(tests, ["k"]).collect()}
    assert flags == {"a": (True, False, False, True), "b": (False, True, False, True), "c": (False, False, True, False)}
    found = {r.k: (r.n_results, r.significant) for r in rollup.any_significant(tests, "tests", ["k"]).collect()}
    assert found == {"a": (2, True), "b": (2, True), "c": (1, True)}


def test_words(spark):
    df = spark.createDataFrame([(" btc ", 0.01, 1.0), ("XBT", 0.5, -1.0), ("eth", None, 0.0)], "name string, p double, e double")
    aliases = {"BTC": "BTC", "XBT": "BTC", "ETH": "ETH"}
    got = df.select(scalar.canonical("name", aliases).alias("a"), scalar.evidence("p", "an effect").alias("v"), scalar.last_of("none", {"small": F.col("e") < 1, "negative": F.col("e") < 0}).alias("l"), scalar.kept_where("e", F.col("p") < 0.1).alias("k")).collect()
    assert [tuple(r) for r in got] == [("BTC", "Evidence of an effect", "none", 1.0), ("BTC", "No evidence of an effect at the 5% level", "negative", None), ("ETH", "Not available", "small", None)]
    assert scalar.formula("y", ["a", "b"]) == "y ~ a + b" and scalar.formula("y", []) == "y ~ 1"
    with pytest.raises(Exception, match="no alias for doge"):
        spark.createDataFrame([("doge",)], "name string").select(scalar.canonical("name", aliases)).collect()


def test_market_source(spark, tmp_path):
    with open(tmp_path / "A.csv", "w") as f:
        f.write('Date,Open,High,Low,Close,Volume\n2021-01-05,2,3,1,2.5,"1,000"\n2021-01-04,1,4,0.5,2,10\n2021-01-11,5,6,4,,7\n2021-02-01,9,9,9,9,9\n')
    with open(tmp_path / "B.csv", "w") as f:
        f.write("Date,Close\n")
    market.register_source(spark)
    read = lambda **o: [tuple(r) for r in spark.read.format("market").options(**o).load(str(tmp_path)).orderBy("ticker", "date").collect()]
    assert read(tickers="A,B", start="2021-01-01", end="2021-02-01", interval="1wk") == [("A", dt.date(2021, 1, 4), 1.0, 4.0, 0.5, 2.5, 1010.0), ("A", dt.date(2021, 1, 11), 5.0, 6.0, 4.0, None, 7.0)]
    assert len(read(tickers="A")) == 4 and read(tickers="B") == []
    with pytest.raises(Exception):  # noqa: B017
        read(tickers="C")


def test_sheets_keep_all_columns(spark, tmp_path):
    at = f"file://{tmp_path}/wide.xlsx"
    spreadsheet.write_sheets(at, {"One": [["a"], [None] * 29 + ["last & <b>"]], "Two": [[1.5]]})
    spreadsheet.register_source(spark)
    row = spark.read.format("sheet").option("sheet", "One").load(at)
    assert len(row.columns) == 32 and row.where("row = 2").first().c29 == "last & <b>"
    assert spark.read.format("sheet").option("sheet", "Two").load(at).first().c0 == "1.5"
    with pytest.raises(Exception, match="beyond the width"):
        spark.read.format("sheet").option("width", 16).load(at).collect()


def test_scratch_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Session, "x")


def test_counts_against_expected(spark):
    rows = spark.createDataFrame([(dt.datetime(2021, 5, 1), "a"), (dt.datetime(2021, 6, 1), "a"), (dt.datetime(2022, 1, 1), "b")], "at timestamp, name string")
    expected = spark.createDataFrame([(2021, "a", 2), (2022, "b", 2), (2023, "a", 1)], "yr long, name string, n long")
    got = {(r.yr, r.name): (r.observed, r.expected, r.agrees) for r in tables.verified(tables.coverage(rows, "at", "name"), expected, ["yr", "name"]).collect()}
    assert got == {(2021, "a"): (2, 2, True), (2022, "b"): (1, 2, False), (2023, "a"): (0, 1, False)}


def test_every_query_is_documented_by_its_sql():
    """The registry: names are unique by construction, every query has SQL, and no SQL stands alone."""
    from tidemark import plans, registry  # noqa: F401

    assert set(registry.QUERIES) == set(registry.ORACLE_SQL) and len(registry.QUERIES) > 150
