"""Spreadsheet workbooks: one Spark row per cell, then one table per sheet."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import EmptySource, clean_names

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELL = "file string, sheet_number int, sheet string, row int, col int, value string"


def _column(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n


def _cells(data: bytes):
    """(sheet number, sheet name, row, column, text) of a workbook's bytes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        links = {
            r.get("Id"): r.get("Target")
            for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        }
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for number, sheet in enumerate(book.iter(f"{MAIN}sheet")):
            target = links[sheet.get(f"{REL}id")].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            with z.open(target) as stream:
                for _, cell in ElementTree.iterparse(stream):
                    if cell.tag != f"{MAIN}c":
                        continue
                    kind, v = cell.get("t"), cell.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif v is None or v.text is None:
                        continue
                    else:
                        text = shared[int(v.text)] if kind == "s" else v.text
                    where = cell.get("r")
                    row = int("".join(ch for ch in where if ch.isdigit()))
                    yield number, sheet.get("name"), row, _column(where), text
                    cell.clear()


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every filled cell of every workbook that matches; one task per file."""

    def unpack(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                rows = [(name, *c) for c in _cells(data)]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELL.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, CELL)


def _as_table(cells: DataFrame) -> DataFrame:
    """Cells of one sheet to a table: the first row names the columns."""
    heads = cells.where("row = first_row").select("col", "value").orderBy("col").collect()
    if not heads:
        raise EmptySource("sheet without rows")
    names = clean_names([h.value for h in heads])
    body = cells.where("row > first_row").groupBy("file", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m")  # one row's cells
    )
    return body.select(*[F.col("m")[h.col].alias(n) for h, n in zip(heads, names)])


def _with_first_row(cells: DataFrame) -> DataFrame:
    first = cells.groupBy("file", "sheet_number").agg(F.min("row").alias("first_row"), F.countDistinct("row").alias("n_rows"))
    return cells.join(first, ["file", "sheet_number"])


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """One sheet, by position or name, with every column as text."""
    cells = _with_first_row(read_cells(spark, path))
    return _as_table(cells.where(F.col("sheet_number" if isinstance(sheet, int) else "sheet") == sheet))


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every sheet of at least two rows as one table each."""
    cells = _with_first_row(read_cells(spark, path)).where("n_rows >= 2")
    names = [r.sheet for r in cells.select("sheet_number", "sheet").distinct().orderBy("sheet_number").collect()]
    return {name: _as_table(cells.where(F.col("sheet") == name)) for name in names}
