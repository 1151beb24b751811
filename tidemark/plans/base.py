"""The series and panels that the registered queries work on, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept, load

#: One series per return flag, seven days a week: mean unit price and volume of each ship day.
SERIES_SQL = """series AS (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS asset, avg(l_extendedprice / l_quantity) AS price, CAST(sum(l_quantity) AS DOUBLE) AS volume, count(*) AS n_rows FROM lineitem GROUP BY 1, 2)"""
#: One level series with closures: mean order value on weekdays.
MARKET_SQL = """market AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS level FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1)"""
CALENDAR_SQL = SERIES_SQL + """,
bounds AS (SELECT min(day) AS a, max(day) AS b FROM series),
calendar AS (SELECT CAST(d AS DATE) AS day, asset FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM bounds), (SELECT DISTINCT asset FROM series))"""
CHANGES_SQL = SERIES_SQL + """,
c AS (SELECT day, asset, price, volume, ln(price / lag(price) OVER w) AS ret, ln(1 + volume) AS activity, lag(ln(1 + volume)) OVER w AS activity_lag FROM series WINDOW w AS (PARTITION BY asset ORDER BY day)),
r AS (SELECT *, lag(ret) OVER (PARTITION BY asset ORDER BY day) AS ret_lag FROM c)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem")
    return rows.groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("asset")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("n_rows")
    )


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").where(F.weekday("o_orderdate") < 5)
    return rows.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("level"))


def modelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log return, its lag, and activity with its lag, per asset and day.

    The lines are read once: what models are fitted to is a row a day and asset, kept for the passes over it.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("asset").orderBy("day")
    base = series(spark, sf_dir).withColumns({"ret": F.ln(F.col("price") / F.lag("price").over(w)), "activity": F.log1p("volume")})
    return kept(base.withColumns({"ret_lag": F.lag("ret").over(w), "activity_lag": F.lag("activity").over(w)}), "modelling")


def day_text(c: str = "day"):
    """A date as SQL writes it: Spark puts a sign before years of five digits."""
    return F.ltrim(F.col(c).cast("string"), F.lit("+")).alias(c)


def r6(c, name: str | None = None):
    """Rounded to six digits, so that sums in any order compare equal; -0.0 becomes 0.0."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + 0.0).alias(name or c)
