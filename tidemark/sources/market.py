"""A Python data source for market history: `spark.read.format("market").option("tickers", "A,B").load(folder)`.

The download step of such sources is a service's; this reader takes what it has left in a folder (or any URI that pyarrow
opens), one CSV per ticker named `<ticker>.csv` with a Date column and any of Open, High, Low, Close, Volume, and gives
(ticker, date, open, high, low, close, volume) rows between `start` (included) and `end` (excluded), at the `interval`
of a day, week or month: the first open, highest high, lowest low, last close and summed volume of each. One partition a
ticker. A ticker without a file is an error; without rows in the range it gives none.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ("open", "high", "low", "close", "volume")


class _Ticker(InputPartition):
    def __init__(self, name: str):
        self.name = name


def _number(text: str | None) -> float | None:
    try:
        value = float((text or "").replace(",", ""))
    except ValueError:
        return None
    return value if abs(value) < float("inf") else None


def start_of(day: dt.date, interval: str) -> dt.date:
    if interval == "1wk":
        return day - dt.timedelta(days=day.weekday())
    return day.replace(day=1) if interval == "1mo" else day


class MarketReader(DataSourceReader):
    def __init__(self, folder: str, tickers: list[str], start: dt.date, end: dt.date, interval: str):
        self.folder, self.tickers, self.start, self.end, self.interval = folder, tickers, start, end, interval

    def partitions(self) -> list[InputPartition]:
        return [_Ticker(t) for t in self.tickers]

    def read(self, partition: _Ticker) -> Iterator[tuple]:
        from pyarrow import fs

        local = "://" not in self.folder and not self.folder.startswith("file:")
        store, at = (fs.LocalFileSystem(), self.folder) if local else (fs.LocalFileSystem(), unquote(urlparse(self.folder).path)) if self.folder.startswith("file:") else fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{at.rstrip('/')}/{partition.name}.csv") as f:
            rows = list(csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline="")))
        spans: dict[dt.date, list] = {}
        for row in sorted(rows, key=lambda r: r["Date"]):
            day = dt.date.fromisoformat(row["Date"][:10])
            if not self.start <= day < self.end:
                continue
            o, h, low, c, v = (_number(row.get(f.capitalize())) for f in FIELDS)
            span = spans.setdefault(start_of(day, self.interval), [None] * 5)
            span[0] = o if span[0] is None else span[0]
            span[1] = max((x for x in (span[1], h) if x is not None), default=None)
            span[2] = min((x for x in (span[2], low) if x is not None), default=None)
            span[3] = c if c is not None else span[3]
            span[4] = (span[4] or 0.0) + v if v is not None else span[4]
        for day, values in sorted(spans.items()):
            yield (partition.name, day, *values)


class MarketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "market"

    def schema(self) -> str:
        return "ticker string, date date, " + ", ".join(f"{f} double" for f in FIELDS)

    def reader(self, schema) -> MarketReader:
        o = self.options
        interval = o.get("interval", "1d")
        if interval not in ("1d", "1wk", "1mo"):
            raise ValueError(f"no interval {interval}")
        tickers = [t.strip() for t in o["tickers"].split(",") if t.strip()]
        return MarketReader(o["path"], tickers, dt.date.fromisoformat(o.get("start", "0001-01-01")), dt.date.fromisoformat(o.get("end", "9999-12-31")), interval)


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(MarketSource)
