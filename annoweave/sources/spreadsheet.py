"""Office Open XML workbooks, read from any file system that Spark reads.

    read_sheet(spark, "hdfs:///in/coder.xlsx", "Code", ["Bloom", "Line"])

Rows carry source_row, the row's number in the sheet (the header is row 1); blank rows
are kept. All other columns are text as the cell holds it; numbers without a fraction
lose the ".0". Only cached values are read, never formulas. One workbook is one task:
the format can't be split.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _letters(ref: str) -> int:
    """Column number from 0 of a cell reference such as BC12."""
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _plain(el: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in el.iter(f"{_MAIN}t"))


def sheet_rows(raw: bytes, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells as text) of one sheet, gaps included."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        ids = {s.get("name"): s.get(_REL) for s in book.iter(f"{_MAIN}sheet")}
        if sheet not in ids:
            raise ValueError(f"no sheet named {sheet!r}; there are {sorted(ids)}")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[ids[sheet]]
        path = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
        shared = [_plain(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        at = 0
        with z.open(path) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r") or at + 1)
                for gap in range(at + 1, number):
                    yield gap, []
                at, cells = number, []
                for c in row.iter(f"{_MAIN}c"):
                    col = _letters(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (col - len(cells))
                    cells.append(_cell(c, shared))
                row.clear()
                yield number, cells


def _cell(c: ElementTree.Element, shared: list[str]) -> str | None:
    kind, v = c.get("t"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _plain(c)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    return v.text[:-2] if kind in (None, "n") and v.text.endswith(".0") else v.text


def table_rows(raw: bytes, sheet: str, columns: list[str]) -> Iterator[tuple]:
    """(source_row, columns...) of the rows under the header; absent columns are null, the last of equal headers counts."""
    head: dict[str, int] = {}
    for number, cells in sheet_rows(raw, sheet):
        if number == 1:
            head = {str(h).strip(): i for i, h in enumerate(cells) if h is not None}
            continue
        yield (number, *(cells[head[c]] if c in head and head[c] < len(cells) else None for c in columns))


def read_sheet(spark: SparkSession, path: str | list[str], sheet: str, columns: list[str]) -> DataFrame:
    """(source_row, columns...) of the sheet of that name in each workbook."""
    kinds = [pa.int32(), *[pa.string()] * len(columns)]
    names = ["source_row", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                rows = table_rows(raw.as_py(), sheet, columns)
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    ddl = ", ".join(["source_row int", *("`" + c.replace("`", "``") + "` string" for c in columns)])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)


def workbook(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A workbook of text cells: rows by sheet, the first being the header. None is no cell."""
    spaces = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    column = lambda j: (column(j // 26 - 1) if j > 25 else "") + chr(65 + j % 26)
    cell = lambda j, n, v: f'<c r="{column(j)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {spaces}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{n}">' + "".join(cell(j, n, v) for j, v in enumerate(r) if v is not None) + "</row>" for n, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {spaces}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()
