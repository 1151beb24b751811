"""A Python data source for spreadsheets: `spark.read.format("sheet").option("sheet", ...).load(path)`.

An .xlsx file is a zip of XML; the reader needs only the standard library. Rows come as text cells c0, c1, ... with
their row number and sheet, one partition per sheet. There are as many columns as the widest row of the sheets read has,
unless the option `width` says otherwise; a row with cells beyond it is an error, never cut. Any file system that pyarrow
opens will do.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@contextmanager
def _opened(path: str) -> Iterator[zipfile.ZipFile]:
    """The zip file at a local path or a URI."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        store, at = (fs.LocalFileSystem(), unquote(urlparse(path).path)) if path.startswith("file:") else fs.FileSystem.from_uri(path)
        with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            yield z
    else:
        with zipfile.ZipFile(path) as z:
            yield z


def sheet_names(path: str) -> list[str]:
    with _opened(path) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", _NS)]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def rows_of(path: str, sheet: str) -> Iterator[tuple[int, dict[int, str]]]:
    """Row number and cells of a sheet."""
    with _opened(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        ids = {s.get("name"): s.get(_REL) for s in book.iterfind(".//m:sheet", _NS)}
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", _NS)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        target = links[ids[sheet]].lstrip("/")
        body = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        for row in body.iterfind(".//m:row", _NS):
            cells = {}
            for c in row.iterfind("m:c", _NS):
                v = c.find("m:v", _NS)
                text = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS)) if v is None else v.text
                if text is not None:
                    cells[_column(c.get("r"))] = shared[int(text)] if c.get("t") == "s" else text
            yield int(row.get("r")), cells


class _Sheet(InputPartition):
    def __init__(self, name: str):
        self.name = name


class SheetReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, width: int):
        self.path, self.sheet, self.width = path, sheet, width

    def partitions(self) -> list[InputPartition]:
        return [_Sheet(n) for n in sheet_names(self.path) if self.sheet in (None, n)]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        for number, cells in rows_of(self.path, partition.name):
            if cells and max(cells) >= self.width:
                raise ValueError(f"{partition.name}: row {number} has {max(cells) + 1} columns, beyond the width of {self.width}")
            yield (partition.name, number, *(cells.get(i) for i in range(self.width)))


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet"

    def _width(self) -> int:
        if "width" in self.options:
            return int(self.options["width"])
        path, sheet = self.options["path"], self.options.get("sheet")
        return max((max(cells, default=-1) + 1 for n in sheet_names(path) if sheet in (None, n) for _, cells in rows_of(path, n)), default=1) or 1

    def schema(self) -> str:
        return "sheet string, row long, " + ", ".join(f"c{i} string" for i in range(self._width()))

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options["path"], self.options.get("sheet"), self._width())


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)


def write_sheets(path: str, sheets: dict[str, list[list]]) -> None:
    """A small workbook of text and number cells at a local path or URI: for fixtures and forms, not for tables."""
    import io

    main, rel = _NS["m"], _REL.strip("{}").rpartition("}")[0]
    letters = lambda i: (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    def cell(r: int, c: int, v) -> str:
        if v is None:
            return ""
        ref = f"{letters(c)}{r}"
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, int | float) else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    from pyarrow import fs

    store, at = (fs.LocalFileSystem(), unquote(urlparse(path).path)) if "://" not in path or path.startswith("file:") else fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as f:
        f.write(buffer.getvalue())
