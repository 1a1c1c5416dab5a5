"""XLSX workbooks, read from their zip and XML parts by the tasks that hold the files."""

from __future__ import annotations

import io
import posixpath
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

#: Names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = 4096  # rows of a batch


def column_number(reference: str) -> int:
    """Column of a cell reference such as ``AB12``, from 0."""
    number = 0
    for c in re.match(r"[A-Za-z]+", reference)[0].upper():
        number = 26 * number + ord(c) - 64
    return number - 1


def active_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the sheet shown when the workbook is opened."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    view = root.find(f"{MAIN}bookViews/{MAIN}workbookView")
    sheets = root.findall(f"{MAIN}sheets/{MAIN}sheet")
    wanted = sheets[int(view.get("activeTab", 0)) if view is not None else 0].get(RELATION)
    for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if relation.get("Id") == wanted:
            return posixpath.normpath(posixpath.join("/xl", relation.get("Target"))).lstrip("/")
    raise ValueError("the active sheet is missing")


def strings(book: zipfile.ZipFile) -> list[str]:
    """The shared strings; phonetic readings are no part of them."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    items = ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")
    return ["".join(t.text or "" for e in item if e.tag in (f"{MAIN}t", f"{MAIN}r") for t in e.iter(f"{MAIN}t")) for item in items]


def value_of(cell, shared: list[str]) -> str | None:
    """A cell's cached value as text: whole numbers without a fraction, truth values as words."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    held = cell.find(f"{MAIN}v")
    if held is None or held.text is None:
        return None
    if kind == "s":
        return shared[int(held.text)]
    if kind == "b":
        return "True" if held.text == "1" else "False"
    if kind == "n":
        number = float(held.text)
        return str(int(number)) if number.is_integer() and abs(number) < 1 << 53 else repr(number)
    return held.text


def rows_of(content: bytes) -> Iterator[list[str | None]]:
    """The rows of the active sheet, each as wide as its last cell; cells and rows that are left out are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, at = strings(book), 0
        with book.open(active_sheet(book)) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{MAIN}row":
                    continue
                place = int(row.get("r", at + 1)) - 1
                for _ in range(at, place):
                    yield []
                cells: list[str | None] = []
                for cell in row.findall(f"{MAIN}c"):
                    k = column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (k + 1 - len(cells))
                    cells[k] = value_of(cell, shared)
                yield cells
                at = place + 1
                row.clear()


def falsy(value: str | None) -> bool:
    return value in (None, "", "0", "False")


def read(spark: SparkSession, path: str, schema: str, headers: dict[str, str] | None = None) -> DataFrame:
    """The active sheet of a workbook (or of several), one task for each: the columns of ``schema`` as strings, ``file`` and ``ord``, as a CSV gives them.

    Row 1 holds the headers. A column is the one whose header ``headers`` names,
    or, without that, the one at its place. Rows whose first cell is empty, 0 or false are skipped. A header that
    is not there is an error, and so is a file that is no workbook.
    """
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = rows_of(content.as_py())
                header = next(rows, [])
                missing = [h for h in (headers or {}).values() if h not in header]
                if missing:
                    raise ValueError(f"{file} lacks the columns {missing}")
                places = [header.index(headers[n]) if headers and n in headers else k for k, n in enumerate(names)]
                held: list[list] = []
                for order, row in enumerate(rows):
                    if falsy(row[0] if row else None):
                        continue
                    held.append([*(row[k] if k < len(row) else None for k in places), file, order])
                    if len(held) == ROWS:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    def batch_of(held):
        kinds = [pa.string()] * (len(names) + 1) + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), kinds)], names=[*names, "file", "ord"])

    content = spark.read.format("binaryFile").load(path).select("path", "content")
    return content.mapInArrow(run, ", ".join([*(f"`{n}` string" for n in names), "file string", "ord long"]))
