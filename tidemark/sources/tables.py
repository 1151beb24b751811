"""Scans and sinks: CSV variants, raw grids, warehouse queries, verified writes, manifests."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import to_day, to_number

TEXT_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str, schema: str | None = None, dates: Sequence[str] = (), **options) -> DataFrame:
    """CSV with a header; text bodies may span lines. Without a schema everything is text."""
    reader = spark.read.options(**(TEXT_OPTIONS | options))
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.withColumns({d: to_day(d) for d in dates}) if dates else df


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header alone."""
    return spark.read.option("header", True).csv(path).columns


def read_two_row_header(spark: SparkSession, path: str, field: str, day: str = "Date") -> DataFrame:
    """A CSV whose first two lines name field and ticker: (day, ticker, value) of one field."""
    lines = spark.read.text(path)
    head = [r.value.split(",") for r in lines.limit(2).collect()]
    places = [(i, head[1][i]) for i, name in enumerate(head[0]) if name == field and i]
    cells = F.split("value", ",")
    rows = lines.where(to_day(cells[0]).isNotNull())
    items = F.array(*(F.struct(F.lit(t).alias("ticker"), to_number(cells[i]).alias("value")) for i, t in places))
    return rows.select(to_day(cells[0]).alias(day), F.inline(items))


def after_header(grid: DataFrame, index: str, labels: Sequence[str]) -> DataFrame:
    """A raw grid (text columns, row number `index`) from the row that holds all `labels`: its cells name the columns."""
    cells = [c for c in grid.columns if c != index]
    row = F.array(*(F.trim(c) for c in cells))
    has = F.lit(True)
    for label in labels:
        has = has & F.array_contains(row, label)
    found = grid.where(has).orderBy(index).limit(1).collect()
    if not found:
        raise ValueError(f"no row holds {list(labels)}")
    names = {c: found[0][c].strip() for c in cells if found[0][c]}
    return grid.where(F.col(index) > found[0][index]).select(index, *(F.col(c).alias(n) for c, n in names.items()))


def packed_column(grid: DataFrame, columns: Sequence[str], day: str = "Date", value: str = "value") -> DataFrame:
    """The column with most 'yyyy-mm-dd,value' cells, split in two."""
    hits = grid.agg(*(F.count_if(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2},")).alias(c) for c in columns)).first().asDict()
    best = max(columns, key=lambda c: hits[c])
    parts = F.split(best, ",", 2)
    return grid.where(F.col(best).rlike(r"^\d{4}-\d{2}-\d{2},")).select(to_day(parts[0]).alias(day), to_number(parts[1]).alias(value))


def market_level(rows: DataFrame, day: str, value: str, start: str, end: str) -> DataFrame:
    """A clean level series: coerced, in range, positive, one row a day (the first by value text where repeated)."""
    typed = rows.select(to_day(day).alias("day"), to_number(value).alias("level"), F.col(value).cast("string").alias("__t"))
    kept = typed.where(F.col("day").between(start, end) & (F.col("level") > 0))
    return kept.groupBy("day").agg(F.min_by("level", "__t").alias("level"))


EXTRACT = """SELECT p.post_id, p.created_at, CAST(p.created_at AS DATE) AS post_date, s.name AS community, p.title, p.body, p.score, p.upvote_ratio, p.num_comments, p.crosspost_parent_id, p.url, p.permalink
FROM {posts} p JOIN {communities} s ON p.community_id = s.community_id
WHERE CAST(p.created_at AS DATE) BETWEEN DATE '{start}' AND DATE '{end}' AND LOWER(s.name) IN ({names})
ORDER BY p.created_at, p.post_id"""


def extract(spark: SparkSession, posts: DataFrame, communities: DataFrame, names: Sequence[str], start: str, end: str) -> DataFrame:
    """The extraction query over two warehouse tables; filters reach the scan."""
    listed = ", ".join("'" + n.lower().replace("'", "''") + "'" for n in names)
    # Views of this call alone: several may run in one session at once.
    return spark.sql(EXTRACT.format(posts="{posts}", communities="{communities}", start=start, end=end, names=listed.replace("{", "{{").replace("}", "}}")), posts=posts, communities=communities)


def reachable(df: DataFrame) -> bool:
    """Whether a source answers: plans and reads one row at most."""
    df.limit(1).collect()
    return True


def save_and_reload(df: DataFrame, path: str) -> DataFrame:
    """Write, read again, and fail if the number of rows changed. Rows are counted while they are written: one pass."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    again = df.sparkSession.read.parquet(path)
    written, held = seen.get["n"], again.count()
    if held != written:
        raise OSError(f"{path} holds {held} rows, {written} were written")
    return again


def verified(observed: DataFrame, expected: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Observed counts beside expected ones, the difference and whether they agree; keys of either side, absent ones as 0."""
    both = observed.select(*keys, F.col(count).alias("observed")).join(expected.select(*keys, F.col(count).alias("expected")), list(keys), "full").na.fill(0, ["observed", "expected"])
    return both.withColumns({"difference": F.col("observed") - F.col("expected"), "agrees": F.col("observed") == F.col("expected")})


def coverage(rows: DataFrame, moment: str, name: str) -> DataFrame:
    """Rows per year and community of a source."""
    return rows.groupBy(F.year(moment).cast("long").alias("yr"), F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\n").option("dateFormat", "yyyy-MM-dd").csv(path)


def write_raw_text_csv(df: DataFrame, path: str) -> None:
    """CSV of raw text: every value quoted, quotes doubled, line breaks kept, UTF-8; nulls as empty values."""
    text = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))
    text.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n").option("encoding", "UTF-8").csv(path)


def write_json(record: dict, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(lines: Sequence[str], spark: SparkSession, path: str) -> None:
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_named_text(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Text lines as the one file `path` (small outputs: they go through one task), with a header line."""
    spark = lines.sparkSession
    part, fs = f"{path}.parts", spark.sparkContext._jvm.org.apache.hadoop.fs
    whole = lines.coalesce(1)
    if header is not None:
        whole = spark.createDataFrame([(header,)], "value string").coalesce(1).unionAll(whole.toDF("value")).coalesce(1)
    whole.write.mode("overwrite").text(part)
    folder = fs.Path(part)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = next(f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
    store.delete(fs.Path(path), False)
    store.rename(made, fs.Path(path))
    store.delete(folder, True)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def manifest(spark: SparkSession, outputs: dict[str, str]) -> DataFrame:
    """Every expected output with whether it is there, and its rows; fails if one is missing."""
    rows = []
    for name, path in outputs.items():
        try:
            rows.append((name, path, True, spark.read.parquet(path).count()))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows.append((name, path, False, None))
    table = spark.createDataFrame(rows, "name string, path string, present boolean, n_rows long")
    missing = [r[0] for r in rows if not r[2]]
    if missing:
        raise FileNotFoundError(f"outputs missing: {missing}")
    return table


def inventory(df: DataFrame, name: str) -> dict:
    return {"name": name, "columns": df.columns, "n_rows": df.count(), "schema": df.schema.simpleString()}
