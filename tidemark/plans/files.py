"""Queries over sources and sinks: tables go out to files of every kind, come back, and must be the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import ORACLE_SQL, register
from ..session import load, scratch
from ..sources import market as market_source
from ..sources import spreadsheet, tables, warehouse
from .base import MARKET_SQL, r6
from .base import market as market_level


@register("csv_round_trip", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment || chr(10) || '\"quoted\", ' || c_mktsegment AS note FROM customer")
def csv_round_trip(spark, sf_dir):
    """Text with line breaks, quotes and commas through the CSV sink and scan."""
    at = scratch(spark, "csv")
    note = F.concat(F.col("c_mktsegment"), F.lit('\n"quoted", '), F.col("c_mktsegment"))
    tables.write_csv(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", note.alias("note")), at)
    again = tables.read_csv(spark, at, "c_custkey long, c_name string, c_acctbal double, note string")
    return again.select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), "note")


@register("raw_text_csv", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, coalesce(text, '') AS text FROM conversations")
def raw_text_csv(spark, sf_dir):
    """Raw texts, all quoted, out and back."""
    at = scratch(spark, "raw-text")
    tables.write_raw_text_csv(load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), at)
    return tables.read_csv(spark, at).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


@register("csv_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, yr FROM (SELECT *, year(o_orderdate) AS yr FROM orders)")
def csv_dates(spark, sf_dir):
    """Dates of a CSV, parsed on the way in."""
    at = scratch(spark, "csv-dates")
    tables.write_csv(load(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), at)
    rows = tables.read_csv(spark, at, "o_orderkey long, day string", dates=["day"])
    return rows.select("o_orderkey", F.col("day").cast("string").alias("day"), F.year("day").cast("long").alias("yr"))


@register("csv_header", "SELECT unnest(['r_regionkey', 'r_name']) AS name, unnest([0, 1]) AS place")
def csv_header(spark, sf_dir):
    """The header alone."""
    at = scratch(spark, "csv-header")
    tables.write_csv(load(spark, sf_dir, "region"), at)
    return spark.createDataFrame([(c, i) for i, c in enumerate(tables.csv_columns(spark, at))], "name string, place int")


TWO_SQL = f"WITH {MARKET_SQL}, l AS (SELECT CAST(day AS VARCHAR) AS day, level FROM market), p AS (SELECT day, 'LOW' AS ticker, floor(level) AS value FROM l UNION ALL SELECT day, 'HIGH', 2 * floor(level) FROM l)"


@register("two_row_header", TWO_SQL + " SELECT day, ticker, value FROM p")
def two_row_header(spark, sf_dir):
    """A file whose first two lines name field and ticker: one field of every ticker."""
    at = scratch(spark, "two-rows")
    level = market_level(spark, sf_dir)
    lines = level.select(F.concat_ws(",", F.col("day").cast("string"), F.floor("level").cast("string"), (2 * F.floor("level")).cast("string"), F.lit("1")).alias("value"))
    head = spark.createDataFrame([("Price,Close,Close,Volume",), ("Ticker,LOW,HIGH,LOW",), ("Date,,,",)], "value string")
    one = head.coalesce(1).unionAll(lines.orderBy("value").coalesce(1)).coalesce(1)
    one.write.text(at)
    out = tables.read_two_row_header(spark, at, "Close", "day")
    return out.select(F.col("day").cast("string").alias("day"), "ticker", "value")


@register("spreadsheet_sheets", "SELECT 'Nations' AS sheet, n_nationkey + 3 AS row, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation UNION ALL SELECT 'Regions', r_regionkey + 3, CAST(r_regionkey AS VARCHAR), r_name FROM region")
def spreadsheet_sheets(spark, sf_dir):
    """Every sheet of a workbook, below the row that holds the headings."""
    at = f"{scratch(spark, 'book')}/book.xlsx"
    of = lambda t, k, n: [[r[0], r[1]] for r in load(spark, sf_dir, t).select(k, n).orderBy(k).collect()]  # noqa: E731 (25 rows)
    spreadsheet.write_sheets(at, {"Nations": [["List of nations"], ["Key", "Name"], *of("nation", "n_nationkey", "n_name")], "Regions": [["List of regions"], ["Key", "Name"], *of("region", "r_regionkey", "r_name")]})
    spreadsheet.register_source(spark)
    out = None
    for name in spreadsheet.sheet_names(at):
        grid = spark.read.format("sheet").option("sheet", name).load(at).drop("sheet")
        rows = tables.after_header(grid, "row", ["Key", "Name"]).select(F.lit(name).alias("sheet"), "row", F.col("Key").alias("key"), F.col("Name").alias("name"))
        out = rows if out is None else out.unionAll(rows)
    return out


@register("wide_spreadsheet", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS place, n_name AS value FROM nation UNION ALL SELECT CAST((SELECT count(*) FROM nation) + r_regionkey + 1 AS BIGINT), r_name FROM region")
def wide_spreadsheet(spark, sf_dir):
    """A row of all nations and regions, thirty columns, comes as thirty: names of columns go beyond one letter."""
    at = f"{scratch(spark, 'book')}/wide.xlsx"
    names = lambda t, k, n: [r[0] for r in load(spark, sf_dir, t).orderBy(k).select(n).collect()]  # noqa: E731 (25 and 5 rows)
    spreadsheet.write_sheets(at, {"One": [[*names("nation", "n_nationkey", "n_name"), *names("region", "r_regionkey", "r_name")]]})
    spreadsheet.register_source(spark)
    row = spark.read.format("sheet").load(at)
    cells = [c for c in row.columns if c not in ("sheet", "row")]
    return row.select(F.posexplode(F.array(*cells)).alias("at", "value")).select((F.col("at") + 1).cast("long").alias("place"), "value")


@register("packed_column", f"WITH {MARKET_SQL} SELECT CAST(day AS VARCHAR) AS day, floor(level) AS value FROM market")
def packed_column(spark, sf_dir):
    """A column of 'day,value' cells found among others and split."""
    level = market_level(spark, sf_dir)
    grid = level.select(F.lit("x").alias("a"), F.concat(F.col("day").cast("string"), F.lit(","), F.format_number(F.floor("level"), 0)).alias("b"), F.lit("2021-01-01,").alias("c"))
    out = tables.packed_column(grid, ["a", "b"], "day")
    return out.select(F.col("day").cast("string").alias("day"), F.round("value", 2).alias("value"))


@register("market_level", f"WITH {MARKET_SQL} SELECT CAST(day AS VARCHAR) AS day, round(level, 6) + 0.0 AS level FROM market WHERE day BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def market_level_query(spark, sf_dir):
    """A clean level series from text that holds repeats, bad values and other years."""
    level = market_level(spark, sf_dir)
    texts = level.select(F.col("day").cast("string").alias("Date"), F.format_string("%.10f", "level").alias("Price"))
    messy = texts.unionAll(texts).unionAll(texts.select("Date", F.lit("n/a").alias("Price"))).unionAll(texts.select("Date", F.lit("-1").alias("Price")))
    return tables.market_level(messy, "Date", "Price", "1996-01-01", "1997-12-31").select(F.col("day").cast("string").alias("day"), r6("level"))


@register("market_history", "WITH h AS (SELECT l_returnflag AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS span, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) AS price, sum(l_quantity) AS quantity FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY 1, 2, 3) SELECT ticker, CAST(span AS VARCHAR) AS month, round(arg_min(price, day), 4) AS open, round(max(price) + 1, 4) AS high, round(min(price) - 1, 4) AS low, round(arg_max(price, day), 4) AS close, sum(quantity) AS volume FROM h GROUP BY 1, 2")
def market_history(spark, sf_dir):
    """Monthly bars from daily files of several tickers."""
    at = scratch(spark, "market")
    days = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("ticker"), F.to_date("l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"))
    price = lambda c: F.format_string("%.4f", c)
    lines = days.select("ticker", F.concat_ws(",", F.col("day").cast("string"), price("price"), price(F.col("price") + 1), price(F.col("price") - 1), price("price"), F.format_string("%.1f", "quantity")).alias("value"))
    tickers = [r[0] for r in days.select("ticker").distinct().orderBy("ticker").collect()]
    for t in tickers:  # a file a ticker, of a row a day
        tables.write_named_text(lines.where(F.col("ticker") == t).select("value").orderBy("value"), f"{at}/{t}.csv", "Date,Open,High,Low,Close,Volume")
    market_source.register_source(spark)
    rows = spark.read.format("market").option("tickers", ",".join(tickers)).option("start", "1997-01-01").option("end", "1998-01-01").option("interval", "1mo").load(at)
    return rows.select("ticker", F.col("date").cast("string").alias("month"), *(F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")), "volume")


@register("extract_source", "SELECT o_orderkey AS post_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS post_date, n_name AS community FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' AND lower(n_name) IN (SELECT lower(n_name) FROM nation WHERE n_nationkey IN (3, 7))")
def extract_source(spark, sf_dir):
    """The extraction query over two warehouse tables, by community and dates."""
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("community_id"))
    none = F.lit(None).cast("string")
    posts = load(spark, sf_dir, "orders").join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("post_id"), F.col("o_orderdate").alias("created_at"), "community_id", F.col("o_orderpriority").alias("title"), none.alias("body"), F.lit(1).alias("score"), F.lit(1.0).alias("upvote_ratio"), F.lit(0).alias("num_comments"), none.alias("crosspost_parent_id"), none.alias("url"), none.alias("permalink")
    )
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("community_id"), F.col("n_name").alias("name"))
    wanted = [r[0] for r in nations.where("community_id in (3, 7)").select("name").collect()]
    assert tables.reachable(posts) and tables.reachable(nations)
    return tables.extract(spark, posts, nations, wanted, "1996-01-01", "1996-12-31").select("post_id", F.col("post_date").cast("string").alias("post_date"), "community")


@register("warehouse_extract", ORACLE_SQL["extract_source"])
def warehouse_extract(spark, sf_dir):
    """The extraction query over a date-partitioned table behind a data source that is asked for its days alone."""
    at = scratch(spark, "warehouse")
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("community_id"))
    none = F.lit(None).cast("string")
    posts = load(spark, sf_dir, "orders").join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("post_id"), F.to_date("o_orderdate").alias("posted"), F.col("o_orderdate").alias("created_at"), "community_id", F.col("o_orderpriority").alias("title"), none.alias("body"), F.lit(1).alias("score"), F.lit(1.0).alias("upvote_ratio"), F.lit(0).alias("num_comments"), none.alias("crosspost_parent_id"), none.alias("url"), none.alias("permalink")
    )
    warehouse.save(posts, at, "posted")
    warehouse.register_source(spark)
    stored = spark.read.format("warehouse").option("date", "posted").load(at).where("posted between date'1996-01-01' and date'1996-12-31'").drop("posted")
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("community_id"), F.col("n_name").alias("name"))
    wanted = [r[0] for r in nations.where("community_id in (3, 7)").select("name").collect()]
    return tables.extract(spark, stored, nations, wanted, "1996-01-01", "1996-12-31").select("post_id", F.col("post_date").cast("string").alias("post_date"), "community")


@register("source_coverage", "WITH o AS (SELECT year(o_orderdate) AS yr, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT yr, name, CASE WHEN yr = 1996 THEN n + 1 ELSE n END AS n FROM o WHERE yr <> 1997) SELECT yr, name, coalesce(o.n, 0) AS observed, coalesce(e.n, 0) AS expected, coalesce(o.n, 0) - coalesce(e.n, 0) AS difference, coalesce(o.n, 0) = coalesce(e.n, 0) AS agrees FROM o FULL JOIN e USING (yr, name)")
def source_coverage(spark, sf_dir):
    """Rows per year and name against expected counts, of which one year is off by one and one is absent."""
    found = tables.coverage(load(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority")
    expected = found.where("yr <> 1997").withColumn("n", F.when(F.col("yr") == 1996, F.col("n") + 1).otherwise(F.col("n")))
    return tables.verified(found, expected, ["yr", "name"])


@register("saved_and_reloaded", "SELECT 'orders' AS name, count(*) AS n_rows, true AS present FROM orders UNION ALL SELECT 'nation', count(*), true FROM nation")
def saved_and_reloaded(spark, sf_dir):
    """Tables written, read back and counted; then the manifest of what must be there."""
    at = scratch(spark, "outputs")
    for name in ("orders", "nation"):
        tables.save_and_reload(load(spark, sf_dir, name), f"{at}/{name}")
    return tables.manifest(spark, {n: f"{at}/{n}" for n in ("orders", "nation")}).select("name", "n_rows", "present")


@register("reports", "SELECT '{\"n\": ' || count(*) || ', \"name\": \"region\"}' AS line, 'json' AS kind FROM region UNION ALL SELECT unnest(['Regions', '=======', count(*) || ' rows']), 'report' FROM region")
def reports(spark, sf_dir):
    """A JSON record and a text report, as read back line by line."""
    at = scratch(spark, "reports")
    known = tables.inventory(load(spark, sf_dir, "region"), "region")
    tables.write_json({"name": known["name"], "n": known["n_rows"]}, spark, f"{at}/json")
    tables.write_report(["Regions", "=======", f"{known['n_rows']} rows"], spark, f"{at}/report")
    line = lambda kind: spark.read.text(f"{at}/{kind}").select(F.col("value").alias("line"), F.lit(kind).alias("kind"))
    return line("json").unionAll(line("report"))


@register("listed_files", "SELECT 'nation' AS name, 1 AS n_files UNION ALL SELECT 'region', 1")
def listed_files(spark, sf_dir):
    """What a folder holds, by pattern."""
    at = scratch(spark, "listing")
    for name in ("nation", "region"):
        load(spark, sf_dir, name).coalesce(1).write.parquet(f"{at}/{name}")
    files = tables.list_files(spark, at, "*.parquet")
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("name")).agg(F.count(F.lit(1)).cast("int").alias("n_files"))
