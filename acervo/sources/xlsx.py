"""XLSX source: one named sheet as text columns with the row's ordinal.

:func:`books` reads files of any Hadoop file system, as Spark's ``binaryFile`` source
lists and opens them, in a batch or a stream; ``spark.read.format("acervo_xlsx")``
after :func:`register` reads those of a folder that every machine has.  Cells are text as the file states it (leading zeros survive
where the cell is text), empty cells are empty strings, and ``row_number``
counts from 2, the first row below the header.  The reader needs only the
standard library.  Each file is one partition: a worksheet is one compressed
XML stream, so files, not parts of files, are read in parallel.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from itertools import islice
from pathlib import Path
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ORDINAL = "row_number"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_path(book: zipfile.ZipFile, sheet: str | None) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    found = {s.get("name"): s.get(f"{_REL}id") for s in root.iter(f"{_MAIN}sheet")}
    if sheet is None:
        sheet = next(iter(found))
    if sheet not in found:
        raise ValueError(f"no sheet named {sheet!r}; there are {sorted(found)}")
    for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == found[sheet]:
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"sheet {sheet!r} has no part")


def rows(path: str | BinaryIO, sheet: str | None = None) -> Iterator[list[str]]:
    """All rows of a sheet as lists of text, of a file by its path or open."""
    with zipfile.ZipFile(path) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        with book.open(_sheet_path(book, sheet)) as part:
            seen = None
            for _, element in ElementTree.iterparse(part):
                if element.tag != f"{_MAIN}row":
                    continue
                out: list[str] = []
                for at, cell in enumerate(element.iter(f"{_MAIN}c")):
                    i = _column(cell.get("r")) if cell.get("r") else at
                    out += [""] * (i + 1 - len(out))
                    kind, value = cell.get("t"), cell.findtext(f"{_MAIN}v") or ""
                    if kind == "s":
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    out[i] = value
                number = int(element.get("r") or (seen or 0) + 1)
                seen = number - 1 if seen is None else seen
                yield from ([] for _ in range(seen + 1, number))  # blank rows that the sheet leaves out
                seen = number
                yield out
                element.clear()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.sheet, self.files = options.get("sheet"), _files(options["path"])

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self.files]

    def read(self, partition: _File) -> Iterator[tuple]:
        lines = rows(partition.path, self.sheet)
        header = [h.strip() for h in next(lines, [])]
        at = {h: i for i, h in enumerate(header)}
        for number, cells in enumerate(lines, start=2):
            yield tuple(number if n == ORDINAL else cells[at[n]] if n in at and at[n] < len(cells) else "" for n in self.names)


def _files(path: str) -> list[str]:
    local = Path(path.removeprefix("file://"))
    return sorted(str(p) for p in local.glob("*.xlsx")) if local.is_dir() else [str(local)]


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "acervo_xlsx"

    def schema(self) -> StructType:
        header = next(rows(_files(self.options["path"])[0], self.options.get("sheet")), [])
        return StructType([StructField(ORDINAL, LongType()), *[StructField(h.strip(), StringType()) for h in header if h.strip()]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


BATCH = 10_000
BINARY = "path string, modificationTime timestamp, length long, content binary"


def table_rows(content: bytes, columns: Sequence[str], sheet: str | None) -> Iterator[tuple]:
    """``(ordinal, cells of columns)`` of a file's rows below its header; columns that the file lacks are empty."""
    lines = rows(io.BytesIO(content), sheet)
    at = {h.strip(): i for i, h in enumerate(next(lines, []))}
    for number, cells in enumerate(lines, start=2):
        yield (number, *[cells[at[c]] if c in at and at[c] < len(cells) else "" for c in columns])


def header(files: DataFrame, sheet: str | None = None) -> list[str]:
    """Column names of the first file in order of its path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                names = [h.strip() for h in next(rows(io.BytesIO(content.as_py()), sheet), []) if h.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string()))], ["names"])

    first = files.select("path").orderBy("path").first()
    found = files.where(files.path == first.path).select("content").mapInArrow(read, "names array<string>").first() if first else None
    return found.names if found else []


def books(files: DataFrame, columns: Sequence[str], sheet: str | None = None) -> DataFrame:
    """``path, row_number, columns`` of all rows of ``files`` (``path, content``, as ``binaryFile`` reads them).

    A file is read in one task, as a worksheet is one compressed stream, and its rows
    leave in batches of ``BATCH``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                lines = table_rows(content.as_py(), columns, sheet)
                while chunk := list(islice(lines, BATCH)):
                    numbers, *cells = zip(*chunk, strict=True)
                    arrays = [pa.array([path.as_py()] * len(chunk)), pa.array(numbers, pa.int64()), *[pa.array(c, pa.string()) for c in cells]]
                    yield pa.RecordBatch.from_arrays(arrays, ["path", ORDINAL, *columns])

    kinds = [StructField("path", StringType()), StructField(ORDINAL, LongType()), *[StructField(c, StringType()) for c in columns]]
    return files.select("path", "content").mapInArrow(read, StructType(kinds))


def found_books(spark: SparkSession, path: str) -> DataFrame:
    """The XLSX files of a folder, or one file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)
