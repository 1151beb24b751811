"""A Python data source for date-partitioned warehouse tables: `spark.read.format("warehouse").option("date", c).load(at)`.

A table is a folder of Parquet files by range of a date column, `range=<first day>/...`, as save() writes it and as
exports of date-partitioned tables lie in object stores. The reader takes what Spark pushes down: comparisons, equality,
membership and null tests of plain columns. Those on the date column choose the ranges (one partition of the scan each;
the others are never opened), and all of them go to the Parquet reader, which skips row groups by them. Columns are chosen
by the schema given to the reader, or the option `columns`; others aren't read. Rows leave as Arrow batches.

Filters need `spark.sql.python.filterPushdown.enabled`. The option `trace` names a folder that gets a file for every range
opened, for tests and audits of what a query costs.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Ranges by their truncation, and at most how many days each has.
RANGES = {"day": 1, "month": 31, "year": 366}


def save(df: DataFrame, path: str, date: str, by: str = "month") -> None:
    """Write `df` as a warehouse table of a range a day, month or year; rows without a date are in the range `none`."""
    first = F.date_format(F.date_trunc(by, F.col(date)), "yyyy-MM-dd")
    df.withColumn("range", F.coalesce(first, F.lit("none"))).repartition("range").write.mode("overwrite").partitionBy("range").parquet(path)


def store_of(path: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path)


class Range(InputPartition):
    """One range's folder."""

    def __init__(self, name: str):
        self.name = name


def _day(value) -> dt.date | None:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else None


def may_hold(first: dt.date, after: dt.date, f: Filter) -> bool:
    """Whether days from `first` to before `after` can satisfy a filter on the date column."""
    if isinstance(f, In):
        days = [_day(v) for v in f.value]
        return any(d is None or first <= d < after for d in days)
    day = _day(getattr(f, "value", None))
    if day is None:
        return not isinstance(f, IsNull)
    if isinstance(f, EqualTo | EqualNullSafe):
        return first <= day < after
    if isinstance(f, GreaterThan | GreaterThanOrEqual):
        return after > day
    if isinstance(f, LessThan) and not isinstance(f.value, dt.datetime):
        return first < day
    if isinstance(f, LessThan | LessThanOrEqual):
        return first <= day
    return True


class WarehouseReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, date: str, by: str, trace: str | None):
        self.path, self.schema, self.date, self.by, self.trace = path, schema, date, by, trace
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the API's name
        """Keep what the files can be asked; give back the rest for Spark to apply."""
        names = set(self.schema.names)
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            plain = isinstance(inner, EqualTo | EqualNullSafe | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In | IsNull | IsNotNull)
            # Values of moments stay Spark's to compare, after they have chosen the ranges: files may hold other units.
            moment = any(isinstance(v, dt.datetime) for v in (inner.value if isinstance(inner, In) else [getattr(inner, "value", None)])) if plain else False
            if plain and len(inner.attribute) == 1 and inner.attribute[0] in names and not isinstance(f, Not):
                self.filters.append(f)
                if moment or isinstance(inner, EqualNullSafe):
                    yield f
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = store_of(self.path)
        listed = store.get_file_info(fs.FileSelector(at))
        names = sorted(i.base_name.removeprefix("range=") for i in listed if i.type == fs.FileType.Directory and i.base_name.startswith("range="))
        of_date = [f for f in self.filters if f.attribute == (self.date,)]
        return [Range(n) for n in names if self._wanted(n, of_date)]

    def _wanted(self, name: str, filters: list[Filter]) -> bool:
        if name == "none":
            return all(isinstance(f, IsNull) or isinstance(f, EqualNullSafe) and f.value is None for f in filters)
        first = dt.date.fromisoformat(name)
        after = first + dt.timedelta(days=RANGES[self.by])
        after = after if self.by == "day" else after.replace(day=1) if self.by == "month" else after.replace(month=1, day=1)
        return all(may_hold(first, after, f) for f in filters)

    def _expression(self):
        import pyarrow.compute as pc

        out = None
        for f in self.filters:
            field, value = pc.field(f.attribute[0]), getattr(f, "value", None)
            if isinstance(f, EqualNullSafe) or any(isinstance(v, dt.datetime) for v in (value if isinstance(f, In) else [value])):
                continue
            one = (
                field.isin(list(value)) if isinstance(f, In) else field.is_null() if isinstance(f, IsNull) else field.is_valid() if isinstance(f, IsNotNull)
                else field == value if isinstance(f, EqualTo) else field > value if isinstance(f, GreaterThan) else field >= value if isinstance(f, GreaterThanOrEqual)
                else field < value if isinstance(f, LessThan) else field <= value
            )
            out = one if out is None else out & one
        return out

    def read(self, partition: Range | None) -> Iterator:
        if partition is None:  # no range is wanted
            return
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        store, at = store_of(self.path)
        if self.trace:
            traces, folder = store_of(self.trace)
            traces.create_dir(folder)
            with traces.open_output_stream(f"{folder}/{partition.name}-{uuid.uuid4().hex}") as out:
                out.write(b"opened")
        wanted = to_arrow_schema(self.schema)
        files = ds.dataset(f"{at}/range={partition.name}", filesystem=store, format="parquet")
        for batch in files.to_batches(columns=self.schema.names, filter=self._expression()):
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(t.type) for i, t in enumerate(wanted)], schema=wanted)


class WarehouseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warehouse"

    def schema(self) -> StructType:
        """The files' schema, or of them the option `columns`; without reading any rows."""
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import from_arrow_schema

        store, at = store_of(self.options["path"])
        found = ds.dataset(at, filesystem=store, format="parquet").schema  # the first file's footer
        # Spark's files keep moments in nanoseconds; Spark's own are in microseconds.
        fields = [pa.field(f.name, pa.timestamp("us", f.type.tz) if pa.types.is_timestamp(f.type) else f.type) for f in found]
        whole = from_arrow_schema(pa.schema(fields), prefer_timestamp_ntz=True)
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        missing = [n for n in names if n not in whole.names]
        if missing:
            raise ValueError(f"the table has no {missing}; it has {whole.names}")
        return StructType([whole[n] for n in names]) if names else whole

    def reader(self, schema: StructType) -> WarehouseReader:
        o = self.options
        by = o.get("by", "month")
        if by not in RANGES:
            raise ValueError(f"no ranges by {by}")
        return WarehouseReader(o["path"], schema, o["date"], by, o.get("trace"))


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(WarehouseSource)
    spark.conf.set(PUSHDOWN, "true")
