"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..registry import register
from ..session import load
from .base import MARKET_SQL, SERIES_SQL, day_text, market, r6
from .base import series as base_series

MARKET_CHANGE_SQL = MARKET_SQL + ", m AS (SELECT day, level, ln(level / lag(level) OVER (ORDER BY day)) AS level_return FROM market)"


def _market(spark, sf_dir):
    """The market's level and log return; one series of a row a weekday, small whatever the orders' number."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1)).orderBy("day")
    return market(spark, sf_dir).withColumn("level_return", F.ln(F.col("level") / F.lag("level").over(w)))


def _of(spark, sf_dir, asset):
    return base_series(spark, sf_dir).where(F.col("asset") == asset).select("day", F.col("price").alias(f"price_{asset.lower()}"))


@register(
    "asof_join",
    f"WITH {SERIES_SQL}, {MARKET_CHANGE_SQL} SELECT CAST(s.day AS VARCHAR) AS day, s.asset, round(m.level, 7) AS level, round(m.level_return, 6) AS level_return, CAST(m.day AS VARCHAR) AS source_date, CAST(s.day - m.day AS INTEGER) AS age_days FROM series s ASOF LEFT JOIN m ON s.day > m.day",
)
def asof_join(spark, sf_dir):
    left = base_series(spark, sf_dir).select("day", "asset")
    out = joins.asof_join(left, _market(spark, sf_dir), "day", ["level", "level_return"])
    return out.select(day_text(), "asset", F.round("level", 7).alias("level"), r6("level_return"), day_text("source_date"), F.datediff("day", "source_date").alias("age_days"))


@register(
    "asof_join_by_key",
    "WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click'), p AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS spent FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, round(p.spent, 6) AS spent, CAST(p.day AS VARCHAR) AS source_date FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.day > p.day",
)
def asof_join_by_key(spark, sf_dir):
    events = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    clicks = events.where(F.col("event_type") == "click").select("event_id", "user_id", "day")
    bought = events.where(F.col("event_type") == "purchase").groupBy("user_id", "day").agg(F.max("value").alias("spent"))
    return joins.asof_join(clicks, bought, "day", ["spent"], by=["user_id"]).select("event_id", r6("spent"), day_text("source_date"))


@register("join_inner", f"WITH {SERIES_SQL} SELECT CAST(a.day AS VARCHAR) AS day, round(a.price, 6) AS price_a, round(n.price, 6) AS price_n FROM series a JOIN series n ON a.day = n.day WHERE a.asset = 'A' AND n.asset = 'N'")
def join_inner(spark, sf_dir):
    out = joins.checked_join(_of(spark, sf_dir, "A"), _of(spark, sf_dir, "N"), ["day"], "inner")
    return out.select(day_text(), r6("price_a"), r6("price_n"))


@register(
    "join_outer_indicator",
    f"WITH {SERIES_SQL}, {MARKET_SQL} SELECT CAST(coalesce(a.day, m.day) AS VARCHAR) AS day, round(a.price, 6) AS price_a, round(m.level, 7) AS level, CASE WHEN a.day IS NULL THEN 'right_only' WHEN m.day IS NULL THEN 'left_only' ELSE 'both' END AS matched FROM (SELECT * FROM series WHERE asset = 'A') a FULL JOIN market m ON a.day = m.day",
)
def join_outer_indicator(spark, sf_dir):
    out = joins.with_indicator(_of(spark, sf_dir, "A"), market(spark, sf_dir), ["day"])
    return out.select(day_text(), r6("price_a"), F.round("level", 7).alias("level"), "matched")


@register("join_many_to_one", f"WITH {SERIES_SQL}, {MARKET_SQL} SELECT CAST(s.day AS VARCHAR) AS day, asset, round(price, 6) AS price, round(level, 7) AS level FROM series s LEFT JOIN market m ON s.day = m.day")
def join_many_to_one(spark, sf_dir):
    out = joins.checked_join(base_series(spark, sf_dir), market(spark, sf_dir), ["day"], validate="many_to_one")
    return out.select(day_text(), "asset", r6("price"), F.round("level", 7).alias("level"))


@register("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti(spark, sf_dir):
    """Customers without an urgent order."""
    urgent = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return joins.missing_keys(load(spark, sf_dir, "customer"), urgent.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@register("set_equality", "SELECT 'orders of customers' AS pair, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS lacking_right, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS lacking_left UNION ALL SELECT 'urgent orders of customers', (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT c_custkey FROM customer)), (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))")
def set_equality(spark, sf_dir):
    """Keys that either side lacks: none where two sets are equal."""
    customers, out = load(spark, sf_dir, "customer").select("c_custkey"), None
    for name, where in (("orders of customers", "true"), ("urgent orders of customers", "o_orderpriority = '1-URGENT'")):
        own = load(spark, sf_dir, "orders").where(where).select(F.col("o_custkey").alias("c_custkey"))
        right = joins.missing_keys(own, customers, ["c_custkey"]).agg(F.count(F.lit(1)).alias("lacking_right"))
        left = joins.missing_keys(customers, own, ["c_custkey"]).agg(F.count(F.lit(1)).alias("lacking_left"))
        one = right.crossJoin(left).select(F.lit(name).alias("pair"), "lacking_right", "lacking_left")
        out = one if out is None else out.unionAll(one)
    return out


@register("join_one_to_one", f"WITH {SERIES_SQL} SELECT CAST(a.day AS VARCHAR) AS day, a.n_rows AS n_a, b.n_rows AS n_n FROM series a LEFT JOIN series b ON a.day = b.day AND b.asset = 'N' WHERE a.asset = 'A'")
def join_one_to_one(spark, sf_dir):
    """A left join whose keys are checked to be unique on both sides."""
    of = lambda a, n: base_series(spark, sf_dir).where(F.col("asset") == a).select("day", F.col("n_rows").alias(n))
    return joins.checked_join(of("A", "n_a"), of("N", "n_n"), ["day"]).select(day_text(), "n_a", "n_n")


@register("join_semi", f"WITH {SERIES_SQL}, {MARKET_SQL} SELECT CAST(day AS VARCHAR) AS day, asset, n_rows FROM series WHERE day IN (SELECT day FROM market)")
def join_semi(spark, sf_dir):
    return base_series(spark, sf_dir).join(market(spark, sf_dir).select("day"), "day", "left_semi").select(day_text(), "asset", "n_rows")


@register("join_offset", f"WITH {SERIES_SQL} SELECT CAST(a.day AS VARCHAR) AS day, a.asset, a.n_rows, b.n_rows AS n_before FROM series a LEFT JOIN series b ON a.asset = b.asset AND a.day = b.day + 1")
def join_offset(spark, sf_dir):
    base = base_series(spark, sf_dir).select("day", "asset", "n_rows")
    return joins.offset_join(base, base.withColumnRenamed("n_rows", "n_before"), "day", 1, ["asset"]).select(day_text(), "asset", "n_rows", "n_before")


@register(
    "join_lookup",
    f"WITH {SERIES_SQL}, {MARKET_SQL}, s AS (SELECT s.day, s.asset, m.day AS source_date FROM series s ASOF LEFT JOIN market m ON s.day > m.day) SELECT CAST(s.day AS VARCHAR) AS day, asset, CAST(source_date AS VARCHAR) AS source_date, round(level, 7) AS rebuilt FROM s LEFT JOIN market m ON m.day = s.source_date",
)
def join_lookup(spark, sf_dir):
    level = market(spark, sf_dir)
    aligned = joins.asof_join(base_series(spark, sf_dir).select("day", "asset"), level, "day", ["level"])
    out = joins.lookup(aligned, level, "day", "source_date", "level", "rebuilt")
    return out.select(day_text(), "asset", day_text("source_date"), F.round("rebuilt", 7).alias("rebuilt"))


@register("join_compare", f"WITH {SERIES_SQL} SELECT CAST(a.day AS VARCHAR) AS day, a.n_rows AS n_rows_r, b.n_rows AS n_rows_n, round(a.volume, 4) AS volume_r, round(b.volume, 4) AS volume_n FROM series a JOIN series b ON a.day = b.day AND a.asset = 'R' AND b.asset = 'N'")
def join_compare(spark, sf_dir):
    pick = lambda a: base_series(spark, sf_dir).where(F.col("asset") == a).select("day", "n_rows", "volume")
    out = joins.compare_join(pick("R"), pick("N"), ["day"], ("_r", "_n"))
    return out.select(day_text(), "n_rows_r", "n_rows_n", F.round("volume_r", 4).alias("volume_r"), F.round("volume_n", 4).alias("volume_n"))


@register("lookup_broadcast", "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def lookup_broadcast(spark, sf_dir):
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    out = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register("union_all", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_all(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@register("upsert", "SELECT doc_id, 1 AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 2 FROM (SELECT DISTINCT doc_id FROM labels)")
def upsert(spark, sf_dir):
    base = load(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("version"))
    return joins.upsert(base, load(spark, sf_dir, "labels").select("doc_id", F.lit(2).alias("version")).distinct(), "doc_id")


@register("resume", "SELECT doc_id, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(spark, sf_dir):
    return joins.remaining(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.length("text").cast("long").alias("n"))


@register("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("k")).unionAll(s.select("s_nationkey")).dropDuplicates(["k"])


@register("intersect", f"WITH {SERIES_SQL}, {MARKET_SQL} SELECT CAST(day AS VARCHAR) AS day FROM (SELECT day FROM series INTERSECT SELECT day FROM market)")
def intersect(spark, sf_dir):
    return base_series(spark, sf_dir).select("day").intersect(market(spark, sf_dir).select("day")).select(day_text())


@register("except", f"WITH {SERIES_SQL}, {MARKET_SQL} SELECT CAST(day AS VARCHAR) AS day FROM (SELECT day FROM series EXCEPT SELECT day FROM market)")
def except_(spark, sf_dir):
    return base_series(spark, sf_dir).select("day").subtract(market(spark, sf_dir).select("day")).select(day_text())


@register("duplicate_keys", "SELECT l_orderkey, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return joins.duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey"])


@register(
    "append_verified",
    f"WITH {MARKET_SQL} SELECT CAST(day AS VARCHAR) AS day, round(level, 7) AS level FROM market UNION ALL SELECT '1990-01-01', 1.5",
)
def append_verified(spark, sf_dir):
    literal = spark.createDataFrame([("1990-01-01", 1.5)], "day string, level double").withColumn("day", F.to_date("day"))
    return joins.append_verified(market(spark, sf_dir), literal, ["day"], "level").select(day_text(), F.round("level", 7).alias("level"))
