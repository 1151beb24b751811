import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import spreadsheet, tables
from tidemark.streaming import events as S


def _xlsx(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Date</t></si><si><t>Price</t></si><si><t>note</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>2</v></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>2021-01-05</t></is></c><c r="C3"><v>1.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="B1" t="inlineStr"><is><t>2021-01-01,"7"</t></is></c></row></sheetData></worksheet>')


def test_spreadsheet(spark, tmp_path):
    path = f"{tmp_path}/a.xlsx"
    _xlsx(path)
    assert spreadsheet.sheet_names(path) == ["One", "Two"]
    spreadsheet.register_source(spark)
    both = spark.read.format("sheet").option("width", 3).load(path)
    assert both.count() == 4
    grid = spark.read.format("sheet").option("width", 3).option("sheet", "One").load(path).drop("sheet")
    out = tables.after_header(grid, "row", ["Date", "Price"])
    assert [(r.Date, r.Price) for r in out.collect()] == [("2021-01-05", "1.5")]
    with pytest.raises(ValueError):
        tables.after_header(grid, "row", ["Missing"])
    level = tables.market_level(out, "Date", "Price", "2021-01-01", "2021-12-31").collect()
    assert [(r.day, r.level) for r in level] == [(dt.date(2021, 1, 5), 1.5)]


def test_csv_variants(spark, tmp_path):
    one = f"{tmp_path}/one.csv"
    with open(one, "w") as f:
        f.write('Date,body\n2021-01-01,"line one\nline ""two"""\nbad,x\n')
    rows = tables.read_csv(spark, one, dates=["Date"]).collect()
    assert [(r.Date, r.body) for r in rows] == [(dt.date(2021, 1, 1), 'line one\nline "two"'), (None, "x")]
    assert tables.csv_columns(spark, one) == ["Date", "body"]
    two = f"{tmp_path}/two.csv"
    with open(two, "w") as f:
        f.write('Price,Close,Close,Volume\nTicker,A,B,A\n2021-01-01,1.5,2.5,"9"\n')
    got = {(r.Date, r.ticker): r.value for r in tables.read_two_row_header(spark, two, "Close").collect()}
    assert got == {(dt.date(2021, 1, 1), "A"): 1.5, (dt.date(2021, 1, 1), "B"): 2.5}
    packed = spark.createDataFrame([("x", "2021-01-01,5"), ("2021-01-02,1", "2021-01-03,1,000")], "a string, b string")
    assert [r.value for r in tables.packed_column(packed, ["a", "b"]).orderBy("Date").collect()] == [5.0, 1000.0]


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("t", F.lit('a "q"\nb'))
    assert tables.save_and_reload(df, f"{tmp_path}/p").count() == 5
    tables.write_csv(df, f"{tmp_path}/c")
    tables.write_json({"a": 1}, spark, f"{tmp_path}/j")
    tables.write_report(["one", "two"], spark, f"{tmp_path}/r")
    assert spark.read.text(f"{tmp_path}/j").first().value == '{"a": 1}'
    assert tables.list_files(spark, str(tmp_path), "*.parquet").count() >= 1
    assert tables.manifest(spark, {"p": f"{tmp_path}/p"}).first().n_rows == 5
    with pytest.raises(FileNotFoundError):
        tables.manifest(spark, {"q": f"{tmp_path}/none"})


def test_extract(spark):
    posts = spark.createDataFrame([(f"p{i}", dt.datetime(2021, 1, i + 1), i % 2, "t", "b", 1, 0.5, 2, None, None, "l") for i in range(6)], "post_id string, created_at timestamp, community_id int, title string, body string, score long, upvote_ratio double, num_comments long, crosspost_parent_id string, url string, permalink string")
    names = spark.createDataFrame([(0, "Even"), (1, "Odd")], "community_id int, name string")
    out = tables.extract(spark, posts, names, ["EVEN"], "2021-01-02", "2021-01-05").collect()
    assert [r.post_id for r in out] == ["p2", "p4"] and len(out[0]) == 12


def _events(spark, path):
    rows = [(i, dt.datetime(2021, 1, 1 + i // 4, i % 4), "ab"[i % 2], float(i)) for i in range(20)]
    df = spark.createDataFrame([*rows, rows[3]], "event_id long, ts timestamp, kind string, value double")
    df.coalesce(1).write.parquet(path)
    return df


def test_streams_equal_batches(spark, tmp_path):
    path = f"{tmp_path}/events"
    batch = _events(spark, path)
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    S.run_to_parquet(S.deduplicated(stream(), "ts", ["event_id"]), f"{tmp_path}/d", f"{tmp_path}/dc")
    assert spark.read.parquet(f"{tmp_path}/d").count() == 20
    S.run_to_parquet(S.tumbling(stream(), "ts", ["kind"], "value", late="0 seconds"), f"{tmp_path}/t", f"{tmp_path}/tc")
    closed = {(r.start, r.kind): r.n for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    want = {(r.start, r.kind): r.n for r in S.tumbling(batch, "ts", ["kind"], "value").collect()}
    assert closed and all(want[k] == n for k, n in closed.items())
    S.run_to_parquet(S.expanding_means(stream().dropDuplicates(["event_id"]), "kind", ["ts"], "value"), f"{tmp_path}/e", f"{tmp_path}/ec")
    got = {(r.kind, r.ts): (r.n_before, r.mean_before) for r in spark.read.parquet(f"{tmp_path}/e").collect()}
    assert got["a", dt.datetime(2021, 1, 1, 2)] == (1, 0.0) and len(got) == 20


def test_upsert_batches_are_idempotent(spark, tmp_path):
    path = f"{tmp_path}/events"
    batch = _events(spark, path)
    stream = lambda: spark.readStream.schema(batch.schema).parquet(path)
    for run in (1, 1, 2):  # again from its checkpoint, and again from the start
        S.upsert_batches(stream(), f"{tmp_path}/u", "kind", "event_id", f"{tmp_path}/uc{run}")
        assert sorted((r.kind, r.event_id) for r in S.upserted(spark, f"{tmp_path}/u").collect()) == [("a", 18), ("b", 19)]
    assert len(os.listdir(f"{tmp_path}/u")) <= 2


def test_later_batches_count_after_earlier_ones(spark, tmp_path):
    """Two files, the second with older events: they see what had come by then."""
    schema = "event_id long, ts timestamp, kind string, value double"
    for n, hours in enumerate(((5, 6), (1, 7))):
        rows = [(10 * n + h, dt.datetime(2021, 1, 1, h), "a", float(h)) for h in hours] + [(99 + n, dt.datetime(2021, 1, 1, 9), "a", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    seen = {}
    for n in (0, 1):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in") if n else spark.readStream.schema(schema).parquet(f"{tmp_path}/in/0")
        S.run_to_parquet(S.expanding_means(stream, "kind", ["ts", "event_id"], "value"), f"{tmp_path}/e{n}", f"{tmp_path}/ec{n}")
        seen = {r.event_id: (r.n_before, r.mean_before) for r in spark.read.parquet(f"{tmp_path}/e{n}").collect()}
        if not n:
            assert seen == {5: (0, None), 6: (1, 5.0), 99: (2, 5.5)}
    assert seen[11] == (0, None) and seen[5] == (1, 1.0) and seen[17] == (3, 4.0) and len(seen) == 6


def test_a_long_key_is_put_out_in_slices(spark, tmp_path):
    """More rows of one key than a slice takes: counts and means go on from slice to slice, nulls and late keys included."""
    n = 2 * S.ROWS + 7
    rows = spark.range(n).select(F.lit("a").alias("kind"), ((F.col("id") * 7919) % n).alias("at"), F.when(F.col("id") % 5 != 0, (F.col("id") % 100).cast("double")).alias("value"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    S.run_to_parquet(S.expanding_means(S.read_folder(spark, f"{tmp_path}/in", rows.schema), "kind", ["at"], "value"), f"{tmp_path}/out", f"{tmp_path}/c")
    got = {r["at"]: (r.n_before, r.mean_before) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    count, total = 0, 0.0
    assert len(got) == n
    for r in sorted(rows.collect(), key=lambda r: r["at"]):
        assert got[r["at"]] == (count, pytest.approx(total / count) if count else None)
        count, total = count + (r.value is not None), total + (r.value or 0.0)


def test_missing_values_sort_last():
    import pandas as pd

    for column in (pd.Series(["b", None, "a"]), pd.Series([2.0, None, 1.0]), pd.Series(pd.to_datetime(["2024-01-02", None, "2024-01-01"]))):
        assert S._sortable(column).argsort(kind="stable").tolist() == [2, 0, 1]
