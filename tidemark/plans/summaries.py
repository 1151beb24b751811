"""Queries over summaries: descriptives, correlation, pivots, classification metrics, top-k, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, series, summary
from ..registry import register
from ..session import load
from .base import r6

LI = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _lineitem_long() -> str:
    return " UNION ALL ".join(f"SELECT l_returnflag AS flag, '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM lineitem" for c in LI)


@register(
    "describe",
    f"""SELECT flag, variable, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS minimum, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95,
round(max(v), 6) AS maximum, round(skewness(v), 6) AS skew, round(kurtosis(v), 6) AS kurt, count(*) FILTER (v = 0) AS n_zero FROM ({_lineitem_long()}) GROUP BY 1, 2""",
)
def describe(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    out = summary.describe(rows, ["flag"], LI)
    return out.select("flag", "variable", "n", *(r6(c) for c in ("mean", "std", "minimum", "p05", "p25", "p50", "p95", "maximum", "skew", "kurt")), "n_zero")


@register(
    "grouped_summary",
    "SELECT event_type, year(ts) AS yr, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS minimum, round(max(value), 6) AS maximum, round(avg(user_id), 6) AS mean_user_id FROM events GROUP BY 1, 2",
)
def grouped_summary(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("yr", F.year("ts").cast("long"))
    out = summary.grouped_scores(rows, ["event_type", "yr"], "value", ["user_id"])
    return out.select("event_type", "yr", "n", *(r6(c) for c in ("mean", "median", "std", "minimum", "maximum", "mean_user_id")))


@register(
    "conditional_sums",
    "SELECT year(o_orderdate) AS yr, o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS pct_f, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2",
)
def conditional_sums(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate").cast("long"))
    f, o = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    out = rows.groupBy("yr", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), f.alias("n_f"), o.alias("n_o"), F.countDistinct("o_custkey").alias("customers"))
    return out.withColumn("pct_f", F.round(100.0 * F.col("n_f") / F.col("n"), 6))


@register("correlations", "SELECT 'l_quantity' AS first, 'l_extendedprice' AS second, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem")
def correlations(spark, sf_dir):
    return summary.correlations(load(spark, sf_dir, "lineitem"), LI).withColumn("r", F.round("r", 6))


@register("correlation_matrix", "SELECT 'l_quantity' AS variable, 1.0::DOUBLE AS l_quantity, round(corr(l_quantity, l_extendedprice), 6) AS l_extendedprice FROM lineitem UNION ALL SELECT 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6), 1.0 FROM lineitem")
def correlation_matrix(spark, sf_dir):
    pairs = summary.correlations(load(spark, sf_dir, "lineitem"), LI[:2]).withColumn("r", F.round("r", 6))
    return summary.matrix(pairs, LI[:2])


@register("high_correlations", "WITH d AS (SELECT l_quantity, l_extendedprice, l_tax, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_tax AS levy FROM lineitem), p AS (SELECT 'l_quantity' AS first, 'l_extendedprice' AS second, corr(l_quantity, l_extendedprice) AS r FROM d UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM d UNION ALL SELECT 'l_quantity', 'net', corr(l_quantity, net) FROM d UNION ALL SELECT 'l_quantity', 'levy', corr(l_quantity, levy) FROM d UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM d UNION ALL SELECT 'l_extendedprice', 'net', corr(l_extendedprice, net) FROM d UNION ALL SELECT 'l_extendedprice', 'levy', corr(l_extendedprice, levy) FROM d UNION ALL SELECT 'l_tax', 'net', corr(l_tax, net) FROM d UNION ALL SELECT 'l_tax', 'levy', corr(l_tax, levy) FROM d UNION ALL SELECT 'net', 'levy', corr(net, levy) FROM d) SELECT first, second, round(r, 6) AS r FROM p WHERE abs(r) >= 0.6")
def high_correlations(spark, sf_dir):
    """Pairs of quantities, prices, amounts after discount and taxes that move together."""
    rows = load(spark, sf_dir, "lineitem").withColumns({"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "levy": F.col("l_extendedprice") * F.col("l_tax")})
    return summary.high_correlations(summary.correlations(rows, ["l_quantity", "l_extendedprice", "l_tax", "net", "levy"]), 0.6).withColumn("r", F.round("r", 6))


@register("value_counts", "SELECT lang, source, count(*) AS count FROM documents GROUP BY 1, 2")
def value_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang", "source").count()


@register("group_shares", "SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY 1, 2")
def group_shares(spark, sf_dir):
    return summary.shares(load(spark, sf_dir, "documents"), ["lang"], ["source"]).withColumn("share", F.round("share", 6))


@register("set_values", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(DISTINCT source) AS n FROM documents GROUP BY 1")
def set_values(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.countDistinct("source").alias("n"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@register("crosstab", "SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in SEGMENTS) + ", count(*) FILTER (c_mktsegment IN ('" + "', '".join(SEGMENTS) + "')) AS total FROM customer GROUP BY 1")
def crosstab(spark, sf_dir):
    return summary.crosstab(load(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", SEGMENTS)


@register("pivot_first", "SELECT l_returnflag, round(avg(l_tax) FILTER (l_linestatus = 'F'), 6) AS F, round(avg(l_tax) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY 1")
def pivot_first(spark, sf_dir):
    long = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_tax"), 6).alias("v"))
    return long.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.first("v"))


@register(
    "arg_max",
    "SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1",
)
def arg_max(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice"))


PRED = "SELECT l.doc_id, l.quality AS actual, CASE WHEN length(d.text) >= 600 THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL"


def _predictions(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", (F.length("text") >= 600).cast("int").alias("predicted"))
    return load(spark, sf_dir, "labels").where("quality is not null").join(docs, "doc_id").select("doc_id", F.col("quality").alias("actual"), F.coalesce("predicted", F.lit(0)).alias("predicted"))


@register("confusion", f"SELECT actual, predicted, count(*) AS n FROM ({PRED}) GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return summary.confusion(_predictions(spark, sf_dir), "actual", "predicted")


@register(
    "class_metrics",
    f"""WITH p AS ({PRED}), k AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS hit, count(*) FILTER (actual = label) AS support, count(*) FILTER (predicted = label) AS pred FROM p, (SELECT DISTINCT actual AS label FROM p UNION SELECT predicted FROM p) GROUP BY 1)
SELECT label, support, round(coalesce(hit / nullif(pred, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(hit / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2.0 * hit / nullif(pred + support, 0), 0), 6) AS f1 FROM k""",
)
def class_metrics(spark, sf_dir):
    out = summary.class_metrics(_predictions(spark, sf_dir), "actual", "predicted")
    return out.select("label", F.col("support").cast("long").alias("support"), r6("precision"), r6("recall"), r6("f1"))


@register(
    "agreement",
    f"""WITH p AS ({PRED}), k AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS hit, count(*) FILTER (actual = label) AS a, count(*) FILTER (predicted = label) AS p FROM p, (SELECT DISTINCT actual AS label FROM p UNION SELECT predicted FROM p) GROUP BY 1),
t AS (SELECT count(*)::DOUBLE AS n FROM p), z AS (SELECT sum(hit) / n AS acc, sum(a * p) / (n * n) AS e, avg(coalesce(2.0 * hit / nullif(p + a, 0), 0)) AS f FROM k, t GROUP BY n) SELECT round(acc, 6) AS accuracy, round(f, 6) AS macro_f1, round((acc - e) / (1 - e), 6) AS kappa FROM z""",
)
def agreement(spark, sf_dir):
    out = summary.agreement(_predictions(spark, sf_dir), "actual", "predicted")
    return out.select(r6("accuracy"), r6("macro_f1"), r6("kappa"))


@register("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@register("top_k_absolute", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 5000) DESC, c_custkey LIMIT 10")
def top_k_absolute(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs(F.col("c_acctbal") - 5000).desc(), "c_custkey").limit(10)


@register("top_per_group", "SELECT c_mktsegment, c_custkey, CAST(position AS BIGINT) AS position FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer) WHERE position <= 10")
def top_per_group(spark, sf_dir):
    out = series.top_per_group(load(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 10)
    return out.select("c_mktsegment", "c_custkey", F.col("position").cast("long").alias("position"))


@register("stratified_sample", "SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) AS n FROM customer) WHERE n <= 30")
def stratified_sample(spark, sf_dir):
    return series.stratified(load(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", 30).select("c_mktsegment", "c_custkey")


@register("custom_order", "SELECT o_orderkey, o_orderpriority, list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) AS place FROM orders")
def custom_order(spark, sf_dir):
    order = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    place = frames.order_by_list("o_orderpriority", order).cast("int")
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(place > 0, place).otherwise(0).alias("place")).orderBy("place", "o_orderkey")


@register("global_aggregates", "SELECT min(l_shipdate)::DATE::VARCHAR AS first_day, max(l_shipdate)::DATE::VARCHAR AS last_day, round(sum(l_quantity), 2) AS quantity, bool_or(l_tax > 0.07) AS any_high_tax, bool_and(l_quantity > 0) AS all_positive, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def global_aggregates(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").agg(
        F.min(F.to_date("l_shipdate")).cast("string").alias("first_day"),
        F.max(F.to_date("l_shipdate")).cast("string").alias("last_day"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.bool_or(F.col("l_tax") > 0.07).alias("any_high_tax"),
        F.bool_and(F.col("l_quantity") > 0).alias("all_positive"),
        F.countDistinct("l_suppkey").alias("suppliers"),
    )


@register("listwise", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND l_returnflag IN ('A', 'N')")
def listwise(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").where(F.col("l_shipdate").between("1996-01-01", "1996-12-31") & F.col("l_returnflag").isin("A", "N"))
    return frames.listwise(rows, ["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
