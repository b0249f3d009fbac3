"""Workbooks as a Spark data source, and a small writer for fixtures.

`cells` reads a folder on any storage; after registering `WorkbookSource`,
`spark.read.format("workbook_cells").load(folder)` does so for local folders. Both give one row per cell with
the uniform schema of the engine, whatever the layout of a file. Files are the
unit of parallelism; only the standard library reads them. Filters on row_idx
are not needed for correctness and left to Spark.

Files not ending in .xlsx, those starting with ~ and folders are skipped. A file
that is no workbook gives one row with a null sheet and the error in cell_value,
vtype `error`, so that it is reported instead of ending the job.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "source_file string, sheet string, sheet_idx int, row_idx int, col_idx int, cell_value string, vtype string"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def list_files(folder: str) -> list[str]:
    """The workbooks of a folder, by name."""
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".xlsx") and not f.startswith("~") and os.path.isfile(os.path.join(folder, f)))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _texts(root: ET.Element) -> list[str]:
    return ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.findall("m:si", _NS)]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{{{_NS['m']}}}numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    xfs = root.find("m:cellXfs", _NS)
    return {i for i, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def read_cells(path, name: str | None = None) -> Iterator[tuple]:
    """All filled cells of a workbook (a path or an open file), sheet by sheet, typed as the file types them."""
    name = name or os.path.basename(path)
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = _texts(ET.fromstring(z.read("xl/sharedStrings.xml"))) if "xl/sharedStrings.xml" in names else []
        dates = _date_styles(z)
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for idx, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)):
            target = rels[sheet.get(_REL)].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            row = -1
            for _, e in ET.iterparse(z.open(part)):
                if e.tag == f"{{{_NS['m']}}}row":
                    row = int(e.get("r", row + 2)) - 1
                    col = -1
                    for c in e.findall("m:c", _NS):
                        col = _column(c.get("r")) if c.get("r") else col + 1
                        v = _cell(c, shared, dates)
                        if v:
                            yield name, sheet.get("name"), idx, row, col, v[0], v[1]
                    e.clear()


def _cell(c: ET.Element, shared: list[str], dates: set[int]) -> tuple[str, str] | None:
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")), "str"
    v = c.find("m:v", _NS)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)], "str"
    if kind == "b":
        return ("True" if v.text == "1" else "False"), "bool"
    if kind in ("str", "e"):
        return v.text, "str"
    if kind == "d":
        return v.text.replace("T", " "), "datetime"
    n = float(v.text)
    if int(c.get("s", 0)) in dates:
        return str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(n * 86400))), "datetime"
    return (str(int(n)), "int") if n == int(n) and "." not in v.text and "E" not in v.text.upper() else (str(n), "float")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in list_files(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _or_error(os.path.basename(partition.value), partition.value)


class WorkbookSource(DataSource):
    """S3: format "workbook_cells"; option path (a folder)."""

    @classmethod
    def name(cls) -> str:
        return "workbook_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of all workbooks of a folder, on any storage that Spark reads.

    Files are read as binary rows and parsed where they land; a folder without
    workbooks has no cells.
    """
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)
    # A path's name comes escaped.
    books = books.select(F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("name"), "content").where(~F.col("name").startswith("~"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for name, content in zip(batch.name, batch.content):
                rows = iter(_or_error(name, io.BytesIO(content)))
                while part := list(islice(rows, 50_000)):
                    yield pd.DataFrame(part, columns=columns).astype({c: "Int32" for c in ("sheet_idx", "row_idx", "col_idx")})

    return books.mapInPandas(parse, SCHEMA)


def _or_error(name: str, file) -> Iterator[tuple]:
    """A workbook's cells, or one row with the error."""
    try:
        yield from read_cells(file, name)
    except (zipfile.BadZipFile, KeyError, ET.ParseError, OSError) as e:
        yield name, None, None, None, None, f"{type(e).__name__}: {e}", "error"


def errors(all_cells: DataFrame) -> DataFrame:
    """Files that could not be read."""
    return all_cells.where("vtype = 'error'").select("source_file", F.col("cell_value").alias("error"))


def write_workbook(path: str, sheets: list[tuple[str, list[list]]]) -> None:
    """A workbook of rows of str, int, float, bool, datetime or None."""
    def letters(n: int) -> str:
        s = ""
        n += 1
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(65 + r) + s
        return s

    def cell(r: int, c: int, v) -> str:
        at = f'r="{letters(c)}{r + 1}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.datetime):
            return f'<c {at} s="1"><v>{(v - dt.datetime(1899, 12, 30)).total_seconds() / 86400}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v}</v></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, rel = _NS["m"], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="s{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="st" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        for i, (_, rows) in enumerate(sheets, 1):
            body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
