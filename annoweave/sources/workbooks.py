"""Folders of workbooks as a data source: spark.read.format("workbook").

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("sheets", "Code").load("/shared/coders")

A partition is one sheet of one workbook. The schema is source_file, sheet, source_row and
the headers of the first workbook's sheet; with a schema of one's own only its columns are
kept of each row. Cells are text, as in `read_sheet`. Files are opened by pyarrow, so a path is one of a file
system that it knows; `read_sheet` reads from any that Spark knows.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from annoweave.sources.spreadsheet import sheet_rows, table_rows

OWN = ("source_file", "sheet", "source_row")


def _opened(path: str) -> tuple:
    """(file system, path in it, what stands before that path)."""
    from pyarrow import fs

    if ":" not in path or path.startswith("file:"):
        inside = posixpath.abspath("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)
        return fs.LocalFileSystem(), inside, path[: -len(inside)] if path.endswith(inside) else ""
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, path[: -len(inside)] if path.endswith(inside) else ""


def _files(path: str) -> list[str]:
    """The workbook that path names, or those of the folder that it names, in order."""
    from pyarrow import fs

    system, inside, before = _opened(path)
    if system.get_file_info(inside).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(inside))
    return sorted(before + f.path for f in found if f.path.endswith(".xlsx") and not f.base_name.startswith(("~", ".", "_")))


def _content(path: str) -> bytes:
    system, inside, _ = _opened(path)
    with system.open_input_stream(inside) as f:
        return f.read()


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheets: list[str], columns: list[str]) -> None:
        self.path, self.sheets, self.columns = path, sheets, columns

    def partitions(self) -> list[InputPartition]:
        return [Sheet(f, s) for f in _files(self.path) for s in self.sheets]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        held = [c for c in self.columns if c not in OWN]
        told = {"source_file": posixpath.basename(partition.path), "sheet": partition.sheet}
        for row in table_rows(_content(partition.path), partition.sheet, held):
            cells = told | {"source_row": row[0]} | dict(zip(held, row[1:], strict=True))
            yield tuple(cells[c] for c in self.columns)


class WorkbookSource(DataSource):
    """Options: path (a workbook or a folder of them), sheets (names, separated by a pipe; default Code)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _sheets(self) -> list[str]:
        return self.options.get("sheets", "Code").split("|")

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no workbook in {self.options['path']}")
        headers = next((cells for _, cells in sheet_rows(_content(files[0]), self._sheets()[0])), [])
        names = list(dict.fromkeys(h.strip() for h in headers if h is not None and h.strip()))
        own = [StructField("source_file", StringType()), StructField("sheet", StringType()), StructField("source_row", IntegerType())]
        return StructType([*own, *[StructField(n, StringType()) for n in names if n not in OWN]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], self._sheets(), schema.names)
