"""Queries over checks between stages: reconstruction, samples, dates, membership, sanity of models and scores, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions import text as T
from ..operators import frames, panel, quality, scoring, summary
from ..operators.joins import duplicate_keys, missing_keys
from ..registry import register
from ..session import kept, load
from ..stats import ols
from . import sql
from .base import CALENDAR_SQL, CHANGES_SQL, SERIES_SQL, modelling
from .base import series as base_series
from .statistics import FORECAST_SQL, MODELS, _forecasts


@register("reconstruction", f"WITH {SERIES_SQL}, x AS (SELECT asset, ln(1 + volume) AS exact, round(ln(1 + volume), 2) AS stored FROM series) SELECT asset, count(*) AS n, count(*) FILTER (abs(stored - exact) > 0.004) AS n_off, count(*) FILTER (abs(stored - exact) > 0.00500001) AS n_far FROM x GROUP BY 1")
def reconstruction(spark, sf_dir):
    """A stored transform against its recomputation, at two tolerances."""
    rows = base_series(spark, sf_dir).withColumns({"exact": F.log1p("volume"), "stored": F.round(F.log1p("volume"), 2)})
    off = lambda tol: F.count_if(quality.differs("stored", F.col("exact"), tol))
    return rows.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), off(0.004).alias("n_off"), off(0.00500001).alias("n_far"))


@register("lag_reconstruction", f"WITH {SERIES_SQL}, w AS (SELECT asset, day, n_rows, lag(n_rows) OVER o AS by_row, CASE WHEN day - lag(day) OVER o = 1 THEN lag(n_rows) OVER o END AS by_day FROM series WINDOW o AS (PARTITION BY asset ORDER BY day)) SELECT asset, CAST(day AS VARCHAR) AS day, by_day AS stored, by_row AS rebuilt FROM w WHERE by_day IS DISTINCT FROM by_row")
def lag_reconstruction(spark, sf_dir):
    """A lag by calendar days held against one by rows: what differs are the gaps."""
    rows = base_series(spark, sf_dir).select("asset", "day", "n_rows")
    before = rows.select("asset", F.date_add("day", 1).alias("day"), F.col("n_rows").alias("stored"))
    found = quality.rebuilt_lag(rows.join(before, ["asset", "day"], "left"), ["asset"], "day", "n_rows", "stored")
    return found.select("asset", F.col("day").cast("string").alias("day"), "stored", "rebuilt")


SAMPLES = {"s_return": ("ret", "ret_lag"), "s_activity": ("ret", "activity_lag"), "s_both": ("ret", "ret_lag", "activity_lag")}


@register("sample_hierarchy", f"WITH {CHANGES_SQL}, f AS (SELECT asset, ret IS NOT NULL AND ret_lag IS NOT NULL AS a, ret IS NOT NULL AND activity_lag IS NOT NULL AS b, ret IS NOT NULL AND ret_lag IS NOT NULL AND activity_lag IS NOT NULL AS c FROM r) SELECT asset, count(*) FILTER (a) AS n_return, count(*) FILTER (b) AS n_activity, count(*) FILTER (c) AS n_both, count(*) FILTER (c AND NOT a) + count(*) FILTER (c AND NOT b) AS not_nested, count(*) FILTER (b AND NOT a) AS activity_alone FROM f GROUP BY 1")
def sample_hierarchy(spark, sf_dir):
    """Sizes of the samples, rows that break their nesting, and rows of a pair that isn't nested."""
    rows = frames.sample_flags(modelling(spark, sf_dir), SAMPLES)
    breaks = lambda a, b: F.count_if(F.col(a) & ~F.col(b))
    return rows.groupBy("asset").agg(*(F.count_if(s).alias("n_" + s[2:]) for s in SAMPLES), (breaks("s_both", "s_return") + breaks("s_both", "s_activity")).alias("not_nested"), breaks("s_activity", "s_return").alias("activity_alone"))


@register("same_forecast_days", FORECAST_SQL + ", d AS (SELECT DISTINCT asset, day FROM p) SELECT 'mean' AS frame, count(*) AS n_keys, 0 AS n_lacking FROM d UNION ALL SELECT 'lag', count(*), 0 FROM d UNION ALL SELECT 'weekdays', count(*) FILTER (isodow(day) < 6), count(*) FILTER (isodow(day) >= 6) FROM d")
def same_forecast_days(spark, sf_dir):
    """Two models forecast the same days; a weekday sample lacks the weekends."""
    out = _forecasts(spark, sf_dir)
    own = {m: out.where(F.col("model") == m) for m in ("mean", "lag")}
    return quality.same_days(own | {"weekdays": own["lag"].where(~scalar.is_weekend("day"))}, ["asset", "day"])


@register("stage_membership", "WITH a AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS f FROM orders), b AS (SELECT l_orderkey AS k, bool_and(l_linestatus = 'F') AS f FROM lineitem GROUP BY 1) SELECT k AS order_key, coalesce(a.f, false) AS in_left, coalesce(b.f, false) AS in_right FROM a FULL JOIN b USING (k) WHERE coalesce(a.f, false) <> coalesce(b.f, false)")
def stage_membership(spark, sf_dir):
    """Orders called finished by one table and not by the other."""
    a = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), (F.col("o_orderstatus") == "F").alias("finished"))
    b = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("finished"))
    return quality.disagreement(a, b, ["order_key"], "finished")


def _rows(checks) -> object:
    return checks.table().select("name", "expected", "actual", "passed", "category")


@register(
    "model_sanity",
    f"WITH {sql.SUITE}, o AS (SELECT *, {sql.normal_two_sided('z')} AS pv FROM fitted), found AS (SELECT 'coefficient not finite' AS name, count(*) FILTER (NOT isfinite(coefficient)) AS n FROM o UNION ALL SELECT 'error not positive', count(*) FILTER (NOT se > 0) FROM o UNION ALL SELECT 'p outside 0 to 1', count(*) FILTER (pv < 0 OR pv > 1) FROM o UNION ALL SELECT 'interval without coefficient', count(*) FILTER (se < 0) FROM o UNION ALL SELECT 'r2 outside 0 to 1', count(*) FILTER (r2 < 0 OR r2 > 1) FROM o UNION ALL SELECT 'too few rows', count(*) FILTER (n <= p) FROM o UNION ALL SELECT 'significant at 5%', count(*) FILTER (pv < 0.05) FROM o) SELECT name, '0' AS expected, CAST(n AS VARCHAR) AS actual, n = 0 AS passed, 'models' AS category FROM found",
)
def model_sanity(spark, sf_dir):
    """A coefficient table's sanity, and, as one that may fail, that nothing is significant."""
    checks = quality.Checks(spark)
    suite = ols.suite(modelling(spark, sf_dir), "ret", MODELS, ["asset"], lags=7)
    checks.counts(suite, quality.model_rules() | {"significant at 5%": F.col("p_value") < 0.05}, "models")
    return _rows(checks)


POSITIVE, NEGATIVE = ("'" + "','".join(sorted(words)) + "'" for words in (scoring.POSITIVE, scoring.NEGATIVE))
#: The default scorer in SQL: words and marks of the prepared text, hits of both lists, softmax against a neutral unit.
SCORED_SQL = f"""prep AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w: CASE WHEN starts_with(w, '@') AND length(w) > 1 THEN '@user' WHEN starts_with(w, 'http') THEN 'http' ELSE w END), ' ') AS t FROM documents),
tok AS (SELECT doc_id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS w FROM prep),
hit AS (SELECT doc_id, len(w) AS token_length, len(list_filter(w, lambda x: x IN ({POSITIVE})))::DOUBLE AS pos, len(list_filter(w, lambda x: x IN ({NEGATIVE})))::DOUBLE AS neg FROM tok),
prob AS (SELECT doc_id, token_length, exp(neg - greatest(neg, 1, pos)) AS a, exp(1 - greatest(neg, 1, pos)) AS b, exp(pos - greatest(neg, 1, pos)) AS c FROM hit),
scored AS (SELECT doc_id, token_length, a / (a + b + c) AS pn, b / (a + b + c) AS pz, c / (a + b + c) AS pp FROM prob)"""


@register("score_documents", f"WITH {SCORED_SQL} SELECT doc_id, CASE WHEN pn = greatest(pn, pz, pp) THEN 'negative' WHEN pz = greatest(pn, pz, pp) THEN 'neutral' ELSE 'positive' END AS score_label, round(pp - pn, 6) + 0.0 AS sentiment_score, token_length, token_length > {scoring.MAX_TOKENS} AS was_truncated FROM scored")
def score_documents(spark, sf_dir):
    """Class probabilities of every document by the default word-list scorer."""
    docs = load(spark, sf_dir, "documents").select("doc_id", T.model_input("text").alias("text"))
    return scoring.score(docs, "text").select("doc_id", "score_label", (F.round("sentiment_score", 6) + 0.0).alias("sentiment_score"), "token_length", "was_truncated")


@register("scoring_checks", f"WITH {SCORED_SQL}, c AS (SELECT unnest(['probability outside 0 to 1', 'probabilities don''t add up', 'unknown label', 'label not the likeliest', 'score outside -1 to 1', 'truncated']) AS name, unnest([count(*) FILTER (least(pn, pz, pp) < 0 OR greatest(pn, pz, pp) > 1), count(*) FILTER (abs(pn + pz + pp - 1) > 0.00001), 0, 0, count(*) FILTER (abs(pp - pn) > 1), count(*) FILTER (token_length > {scoring.MAX_TOKENS})]) AS n FROM scored) SELECT name, '0' AS expected, CAST(n AS VARCHAR) AS actual, n = 0 AS passed, 'scores' AS category FROM c")
def scoring_checks(spark, sf_dir):
    checks = quality.Checks(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", T.model_input("text").alias("text"))
    checks.counts(scoring.score(docs, "text"), quality.scoring_rules() | {"truncated": F.col("was_truncated")}, "scores")
    return _rows(checks)


@register("truncation_audit", f"WITH {SCORED_SQL} SELECT lang, count(*) AS n, count(*) FILTER (token_length > {scoring.MAX_TOKENS}) AS n_truncated, max(token_length) AS longest, round(100.0 * count(*) FILTER (token_length > {scoring.MAX_TOKENS}) / count(*), 6) AS pct FROM scored JOIN documents USING (doc_id) GROUP BY 1")
def truncation_audit(spark, sf_dir):
    """How many texts go beyond the scorer's window, per language."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", T.model_input("text").alias("text"))
    out = scoring.score(docs, "text")
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("was_truncated").alias("n_truncated"), F.max("token_length").alias("longest"), F.round(100.0 * F.count_if("was_truncated") / F.count(F.lit(1)), 6).alias("pct"))


@register("least_confident", f"WITH {SCORED_SQL} SELECT doc_id, round(greatest(pn, pz, pp), 6) AS max_probability FROM scored ORDER BY round(greatest(pn, pz, pp), 12), doc_id LIMIT 100")
def least_confident(spark, sf_dir):
    """The hundred texts whose likeliest class is least likely."""
    docs = load(spark, sf_dir, "documents").select("doc_id", T.model_input("text").alias("text"))
    top = scoring.score(docs, "text").orderBy(F.round("max_probability", 12), "doc_id").limit(100)
    return top.select("doc_id", F.round("max_probability", 6).alias("max_probability"))


@register("mid_within_range", "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS asset, avg(l_extendedprice / l_quantity) AS mid, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high FROM lineitem GROUP BY 1, 2), w AS (SELECT *, lag(mid) OVER (PARTITION BY asset ORDER BY day) AS before FROM d) SELECT asset, count(*) AS n, count(*) FILTER (NOT mid BETWEEN low - 0.000001 AND high + 0.000001) AS outside_own, count(*) FILTER (NOT before BETWEEN low AND high) AS outside_next FROM w GROUP BY 1")
def mid_within_range(spark, sf_dir):
    """Each day's mean price between its lowest and highest, and whether the day before's is between them too."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    days = load(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("asset")).agg(F.avg(price).alias("mid"), F.min(price).alias("low"), F.max(price).alias("high"))
    rows = days.withColumn("before", F.lag("mid").over(Window.partitionBy("asset").orderBy("day")))
    out = lambda c, tol: F.count_if(~quality.within(c, "low", "high", tol))
    return rows.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), out("mid", 1e-6).alias("outside_own"), out("before", 0.0).alias("outside_next"))


@register(
    "volume_suite",
    f"""WITH {CALENDAR_SQL}, w AS (SELECT *, ln(1 + volume) AS activity, lag(volume) OVER o AS before, lag(day) OVER o AS day_before FROM series WINDOW o AS (PARTITION BY asset ORDER BY day)),
s AS (SELECT asset, skewness(volume) AS raw, skewness(ln(1 + volume)) AS logged FROM series GROUP BY 1),
c AS (SELECT 'calendar days without volume' AS name, (SELECT count(*) FROM (SELECT day, asset FROM calendar EXCEPT SELECT day, asset FROM series)) AS n UNION ALL SELECT 'volume not positive', count(*) FILTER (NOT volume > 0) FROM series UNION ALL SELECT 'transform off', count(*) FILTER (abs(exp(activity) - 1 - volume) > 0.000001 * volume) FROM w UNION ALL SELECT 'log more skewed than raw', count(*) FILTER (abs(logged) > abs(raw)) FROM s UNION ALL SELECT 'lag over a gap', count(*) FILTER (day - day_before > 1) FROM w UNION ALL SELECT 'weekend rows', count(*) FILTER (isodow(day) >= 6) FROM series UNION ALL SELECT 'repeated keys', count(*) - count(DISTINCT (day, asset)) FROM series)
SELECT name, '0' AS expected, CAST(n AS VARCHAR) AS actual, n = 0 AS passed, 'volume' AS category FROM c""",
)
def volume_suite(spark, sf_dir):
    """Calendar, raw values, transform, skew, lag, weekends and keys of the volume series."""
    rows = kept(base_series(spark, sf_dir), "series")
    o = Window.partitionBy("asset").orderBy("day")
    checks = quality.Checks(spark)
    wide = rows.withColumns({"activity": F.log1p("volume"), "day_before": F.lag("day").over(o)})
    n = missing_keys(panel.grid(rows, "day", ["asset"]), rows, ["day", "asset"]).count()
    checks.add("calendar days without volume", 0, n, n == 0, "volume")
    checks.counts(
        wide,
        {"volume not positive": ~(F.col("volume") > 0), "transform off": F.abs(F.expm1("activity") - F.col("volume")) > 1e-6 * F.col("volume"), "lag over a gap": F.datediff("day", "day_before") > 1, "weekend rows": scalar.is_weekend("day")},
        "volume",
    )
    skew = wide.groupBy("asset").agg(summary.sample_skewness("volume").alias("raw"), summary.sample_skewness("activity").alias("logged"))
    checks.counts(skew, {"log more skewed than raw": F.abs("logged") > F.abs("raw")}, "volume")
    n = duplicate_keys(rows, ["day", "asset"]).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
    checks.add("repeated keys", 0, n, n == 0, "volume")
    return _rows(checks)


@register(
    "stage_gates",
    f"""WITH {SERIES_SQL}, c AS (SELECT 'prices' AS category, count(*) FILTER (price <= 0) = 0 AS passed FROM series UNION ALL SELECT 'prices', count(*) FILTER (price IS NULL) = 0 FROM series UNION ALL SELECT 'volumes', count(*) FILTER (volume > 100) = 0 FROM series UNION ALL SELECT 'volumes', count(*) FILTER (volume <= 0) = 0 FROM series)
SELECT category, count(*) AS n_checks, count(*) FILTER (NOT passed) AS n_failed, count(*) FILTER (NOT passed) = 0 AS passed FROM c GROUP BY 1""",
)
def stage_gates(spark, sf_dir):
    """Named checks per stage, and whether each stage's gate opens."""
    rows, checks = kept(base_series(spark, sf_dir), "series"), quality.Checks(spark)
    checks.counts(rows, {"price not positive": F.col("price") <= 0, "price missing": F.col("price").isNull()}, "prices")
    checks.counts(rows, {"volume above 100": F.col("volume") > 100, "volume not positive": F.col("volume") <= 0}, "volumes")
    return quality.gate_status(checks.table())


@register("published_after_gate", f"WITH {SERIES_SQL} SELECT asset, count(*) AS n FROM series GROUP BY 1")
def published_after_gate(spark, sf_dir):
    """A table that is published only once the checks before it passed."""
    rows, checks = kept(base_series(spark, sf_dir), "series"), quality.Checks(spark)
    checks.counts(rows, {"price not positive": F.col("price") <= 0}, "prices")
    checks.unique(rows, ["asset", "day"])
    checks.gate()
    quality.require_passed(checks.table(), "prices")
    return rows.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


@register("column_safety", "SELECT * FROM (VALUES ('forbidden columns', 'none', 'c_acctbal,c_name', false), ('target named among predictors', 'none', 'ret,ret_next', false), ('safe columns', 'asset,day,activity_lag,ret_lag', 'asset,day,activity_lag,ret_lag', true)) t(name, expected, actual, passed)")
def column_safety(spark, sf_dir):
    """Personal columns, predictors that hold their target, and the columns that were known beforehand."""
    customer, rows = load(spark, sf_dir, "customer"), modelling(spark, sf_dir)
    private = sorted(set(customer.columns) & {"c_name", "c_acctbal", "c_phone"})
    leaks = frames.leaks_target(["ret", "ret_lag", "ret_next", "activity_lag"], "ret")
    safe = frames.select_safe(rows, ["asset", "day"], ["lag"]).columns
    want = "asset,day,activity_lag,ret_lag"
    got = ",".join(["asset", "day", *sorted(c for c in safe if c not in ("asset", "day"))])
    found = [("forbidden columns", "none", ",".join(private), not private), ("target named among predictors", "none", ",".join(leaks), not leaks), ("safe columns", want, got, got == want)]
    return spark.createDataFrame(found, "name string, expected string, actual string, passed boolean")
