"""Queries over scalar functions: numbers, booleans and dates from text, tolerances, labels, sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import frames, series
from ..registry import register
from ..session import load
from ..stats import ols
from . import sql
from .base import CHANGES_SQL, SERIES_SQL, modelling, r6
from .base import series as base_series

#: Texts that a column of messy input may hold, dealt over the rows of `part` by their key.
NUMBERS = ("1,234.5", " 7 ", "nan", "inf", "-3e2", "12,345,678", "x", "", "0")
TRUTHS = ("yes", "No", "1", "0.0", "TRUE", " f ", "maybe", "")
DAYS = ("2021-02-03", "03/02/2021", "2021-02-03 04:05:06", "2021-13-01", "never", "")
MOMENTS = ("2021-02-03T04:05:06+02:00", "2021-02-03 04:05:06", "03/02/2021 04:05", "2021-02-03", "2021-07-03 04:05:06-05:00", "soon")


def _dealt(values, key: str = "p_partkey"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql_dealt(values, key: str = "p_partkey") -> str:
    quoted = ", ".join(f"'{v}'" for v in values)
    return f"([{quoted}])[{key} % {len(values)} + 1]"


@register("numbers_from_text", f"WITH t AS (SELECT p_partkey, {_sql_dealt(NUMBERS)} AS given FROM part), n AS (SELECT *, TRY_CAST(replace(trim(given), ',', '') AS DOUBLE) AS x FROM t) SELECT p_partkey, given, CASE WHEN isfinite(x) THEN x END AS number FROM n")
def numbers_from_text(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", _dealt(NUMBERS).alias("given"))
    return rows.withColumn("number", scalar.to_number("given"))


@register("truths_from_text", f"WITH t AS (SELECT p_partkey, {_sql_dealt(TRUTHS)} AS given FROM part) SELECT p_partkey, given, CASE WHEN lower(trim(given)) IN ('true', 't', '1', '1.0', 'yes', 'y') THEN true WHEN lower(trim(given)) IN ('false', 'f', '0', '0.0', 'no', 'n') THEN false END::VARCHAR AS truth FROM t")
def truths_from_text(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", _dealt(TRUTHS).alias("given"))
    return rows.withColumn("truth", scalar.to_bool("given").cast("string"))


@register("days_from_text", f"WITH t AS (SELECT p_partkey, {_sql_dealt(DAYS)} AS given FROM part) SELECT p_partkey, given, CAST(CAST(coalesce(try_strptime(given, '%Y-%m-%d'), try_strptime(given, '%Y-%m-%d %H:%M:%S'), try_strptime(given, '%d/%m/%Y')) AS DATE) AS VARCHAR) AS day FROM t")
def days_from_text(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_partkey", _dealt(DAYS).alias("given"))
    return rows.withColumn("day", scalar.to_day("given").cast("string"))


@register(
    "moments_from_text",
    f"WITH t AS (SELECT p_partkey, {_sql_dealt(MOMENTS)} AS given FROM part), u AS (SELECT *, CASE given WHEN '2021-02-03T04:05:06+02:00' THEN TIMESTAMP '2021-02-03 02:05:06' WHEN '2021-02-03 04:05:06' THEN TIMESTAMP '2021-02-03 09:05:06' WHEN '03/02/2021 04:05' THEN TIMESTAMP '2021-02-03 09:05:00' WHEN '2021-02-03' THEN TIMESTAMP '2021-02-03 05:00:00' WHEN '2021-07-03 04:05:06-05:00' THEN TIMESTAMP '2021-07-03 09:05:06' END AS moment FROM t) SELECT p_partkey, given, strftime(moment, '%Y-%m-%d %H:%M:%S') AS utc, strftime(moment + CASE WHEN month(moment) = 7 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS berlin, strftime(date_trunc('day', moment), '%Y-%m-%d %H:%M:%S') AS midnight FROM u",
)
def moments_from_text(spark, sf_dir):
    """Mixed formats as UTC instants (without an offset: New York's clock), as Berlin's clock shows them, and their UTC day."""
    rows = load(spark, sf_dir, "part").select("p_partkey", _dealt(MOMENTS).alias("given"))
    at = rows.withColumn("at", scalar.to_moment("given", zone="America/New_York"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return at.select("p_partkey", "given", text("at").alias("utc"), text(scalar.in_zone("at", "Europe/Berlin")).alias("berlin"), text(scalar.midnight("at")).alias("midnight"))


ALIASES = {"A": "returned", "N": "new", "R": "refused", "NEW": "new"}


@register("aliases", "SELECT CASE l_returnflag WHEN 'A' THEN 'returned' WHEN 'N' THEN 'new' ELSE 'refused' END AS name, count(*) AS n FROM lineitem GROUP BY 1")
def aliases(spark, sf_dir):
    """Names by a table of aliases, from spellings with blanks and lower case."""
    odd = F.concat(F.lit(" "), F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")), F.lit(" "))
    return load(spark, sf_dir, "lineitem").groupBy(scalar.canonical(odd, ALIASES).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "tolerances",
    "SELECT c_custkey, abs(c_acctbal - round(c_acctbal, 0)) <= 0.25 AS near, abs(c_acctbal - 1.001 * c_acctbal) <= 1 + 0.0005 * abs(1.001 * c_acctbal) AS relative, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive_only, CASE WHEN c_nationkey <> 0 THEN c_acctbal / c_nationkey END AS share, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 9000 THEN 'rich' WHEN c_nationkey < 5 THEN 'near' ELSE 'other' END AS label FROM customer",
)
def tolerances(spark, sf_dir):
    """Equality within tolerances, masking, guarded division, and labels of which the last rule that holds wins."""
    c = load(spark, sf_dir, "customer")
    label = scalar.last_of("other", {"near": F.col("c_nationkey") < 5, "rich": F.col("c_acctbal") > 9000, "debt": F.col("c_acctbal") < 0})
    return c.select(
        "c_custkey",
        scalar.close("c_acctbal", F.round("c_acctbal", 0), 0.25).alias("near"),
        scalar.close("c_acctbal", 1.001 * F.col("c_acctbal"), 1.0, 0.0005).alias("relative"),
        scalar.kept_where("c_acctbal", F.col("c_acctbal") > 0).alias("positive_only"),
        scalar.share("c_acctbal", "c_nationkey").alias("share"),
        label.alias("label"),
    )


@register(
    "labels_of_numbers",
    f"WITH {sql.SUITE}, o AS (SELECT asset, model, parameter, coefficient, {sql.normal_two_sided('z')} AS p FROM fitted), w AS (SELECT *, max(coefficient) FILTER (model = 'M0' AND parameter = 'ret_lag') OVER (PARTITION BY asset) AS base FROM o) SELECT asset, model, parameter, CASE WHEN coefficient > 0 THEN 'positive' WHEN coefficient < 0 THEN 'negative' ELSE 'zero' END AS sign, CASE WHEN p < 0.01 THEN 'significant at 1%' WHEN p < 0.05 THEN 'significant at 5%' WHEN p < 0.10 THEN 'significant at 10%' ELSE 'not significant' END AS significance, CASE WHEN p < 0.05 THEN 'Evidence of an effect' ELSE 'No evidence of an effect at the 5% level' END AS evidence, p < 0.05 AS rejects, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS answer, CASE WHEN p < 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p_text, sign(coefficient) = sign(base) AS same_sign FROM w",
)
def labels_of_numbers(spark, sf_dir):
    """Signs, significance, evidence, answers and agreement with a base coefficient, as words."""
    out = ols.suite(modelling(spark, sf_dir), "ret", {"M0": ("ret_lag",), "M1": ("ret_lag", "activity_lag")}, ["asset"], lags=7)
    base = out.where("model = 'M0' and parameter = 'ret_lag'").select("asset", F.col("coefficient").alias("base"))
    rejects = scalar.rejects("p_value")
    return out.join(base, "asset").select(
        "asset", "model", "parameter", scalar.sign_label("coefficient").alias("sign"), scalar.significance("p_value").alias("significance"), scalar.evidence("p_value", "an effect").alias("evidence"),
        rejects.alias("rejects"), scalar.yes_no(rejects).alias("answer"), scalar.pass_fail(rejects).alias("verdict"), scalar.p_text("p_value").alias("p_text"), scalar.same_sign("coefficient", "base").alias("same_sign"),
    )


@register(
    "effect_sentences",
    f"WITH {sql.SUITE}, o AS (SELECT f.asset, coefficient, sd, coefficient * sd AS effect, {sql.normal_two_sided('z')} AS p FROM fitted f JOIN (SELECT asset, stddev_samp(x1) AS sd FROM s GROUP BY 1) USING (asset) WHERE model = 'M1' AND parameter = 'ret_lag') SELECT asset, 'ret ~ ret_lag + activity_lag' AS formula, printf('%s: one standard deviation more of ret_lag (%.6f) goes with a %s of %.8f in the expected log return, about %.4f percentage points or %.2f basis points (coefficient %.6f, p %.4f).', asset, sd, CASE WHEN effect > 0 THEN 'rise' WHEN effect < 0 THEN 'fall' ELSE 'change' END, abs(effect), abs(100 * effect), abs(10000 * effect), coefficient, p) AS sentence FROM o",
)
def effect_sentences(spark, sf_dir):
    """Effects of one standard deviation as sentences, beside the model's formula."""
    xs = ("ret_lag", "activity_lag")
    rows = modelling(spark, sf_dir)
    fit = ols.fit(rows, "ret", xs, ["asset"]).where("parameter = 'ret_lag'")
    spread = frames.listwise(rows, ["ret", *xs]).groupBy("asset").agg(F.stddev_samp("ret_lag").alias("sd"))
    out = fit.join(spread, "asset").withColumn("effect", F.col("coefficient") * F.col("sd"))
    return out.select("asset", F.lit(scalar.formula("ret", xs)).alias("formula"), scalar.effect_sentence("asset", "parameter", "sd", "effect", "coefficient", "p_value").alias("sentence"))


@register("complete_rows", f"WITH {CHANGES_SQL} SELECT asset, count(*) AS n, count(*) FILTER (ret IS NOT NULL AND ret_lag IS NOT NULL AND activity_lag IS NOT NULL) AS n_complete, count(*) FILTER (isodow(day) >= 6) AS n_weekend, CAST(sum(CAST(ret IS NOT NULL AS INTEGER) + CAST(ret_lag IS NOT NULL AS INTEGER) + CAST(activity_lag IS NOT NULL AS INTEGER)) AS BIGINT) AS n_present FROM r GROUP BY 1")
def complete_rows(spark, sf_dir):
    """Rows whose model columns are all finite, weekends, and the number of values that are there."""
    rows = modelling(spark, sf_dir)
    cols = ["ret", "ret_lag", "activity_lag"]
    return rows.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(scalar.complete(cols)).alias("n_complete"), F.count_if(scalar.is_weekend("day")).alias("n_weekend"),
        F.sum(scalar.count_of([scalar.finite(c).isNotNull() for c in cols])).alias("n_present"),
    )


@register("frame_helpers", f"WITH {SERIES_SQL} SELECT asset, CAST(day AS VARCHAR) AS day, round(volume, 6) + 0.0 AS level FROM series")
def frame_helpers(spark, sf_dir):
    """Columns by candidate names, after requiring some and dropping others, names without repeats."""
    rows = frames.require_columns(base_series(spark, sf_dir), ["day", "asset", "price"])
    value = frames.resolve_column(rows, ["turnover", "volume", "price"])
    left = frames.drop_columns(rows, ["price", "n_rows", "nowhere"])
    names = frames.unique_names(["asset", "day", value, "asset"])
    out = frames.null_missing(left.select(*names))
    return out.select("asset", F.col("day").cast("string").alias("day"), r6(value, "level"))


@register("shuffled_sample", "SELECT o_orderkey, md5('7:' || o_orderkey) AS place FROM orders ORDER BY place, o_orderkey LIMIT 50")
def shuffled_sample(spark, sf_dir):
    """The first fifty of a shuffle that is the same whatever the partitions."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey")
    return series.shuffled(rows, "o_orderkey", 7).limit(50).withColumn("place", F.md5(F.concat_ws(":", F.lit(7), F.col("o_orderkey"))))
