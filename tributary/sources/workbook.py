"""Excel exports: Spark lists and reads the files, each task decodes its own workbooks.

A workbook is one compressed XML stream per sheet of at most 2^20 rows, so a workbook is a task's work
and many workbooks spread. What Excel shows is what comes out: the first sheet by the workbook's own order,
days for cells in a date format, shared texts without their reading aids. Equal headers are told apart by
a number, columns without a header are named by their place.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from posixpath import join, normpath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import NULL_TOKENS, dense_index

CELLS = "path string, sheet_row bigint, columns array<string>, cells array<string>"
_CHUNK = 5000
# Numbers of Excel's own date and time formats.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_LITERAL = re.compile(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.IGNORECASE)


def _children(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if x.tag.rsplit("}", 1)[-1] == name)


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _texts(node: ElementTree.Element) -> str:
    """The text of a cell or shared item; readings of its characters are not part of it."""
    out = []
    for part in node:
        name = part.tag.rsplit("}", 1)[-1]
        if name == "t":
            out.append(part.text or "")
        elif name in ("r", "is"):
            out.append(_texts(part))
    return "".join(out)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _part(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """(name of the part with the first sheet, whether days count from 1904)."""
    head, relations = _part(book, "xl/workbook.xml"), _part(book, "xl/_rels/workbook.xml.rels")
    if head is not None and relations is not None:
        targets = {r.get("Id"): r.get("Target") for r in _children(relations, "Relationship")}
        from_1904 = any(_attribute(p, "date1904") in ("1", "true") for p in _children(head, "workbookPr"))
        for sheet in _children(head, "sheet"):
            target = targets.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None))
            if target and "worksheet" in target:
                return normpath(target.lstrip("/") if target.startswith("/") else join("xl", target)), from_1904
    # A workbook without an order of its own: the lowest number.
    sheets = [n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    return min(sheets, key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1]).group())), False


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    """Numbers of the cell styles that show a date or a time."""
    styles = _part(book, "xl/styles.xml")
    if styles is None:
        return set()
    dates = set(DATE_FORMATS)
    for fmt in _children(styles, "numFmt"):
        if re.search(r"[ymdhs]", _LITERAL.sub("", fmt.get("formatCode") or ""), re.IGNORECASE):
            dates.add(int(fmt.get("numFmtId")))
        else:
            dates.discard(int(fmt.get("numFmtId")))
    formats = next(_children(styles, "cellXfs"), None)
    cells = [] if formats is None else [x for x in formats if x.tag.rsplit("}", 1)[-1] == "xf"]
    return {str(i) for i, x in enumerate(cells) if int(x.get("numFmtId") or 0) in dates}


def _day(value: str, from_1904: bool) -> str:
    """A serial number as a day, with the time where it has one; other texts as they are."""
    try:
        number = float(value)
        if from_1904:
            number += 1462
        elif number < 60:
            number += 1  # Excel counts a 29 February 1900
        moment = datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400))
    except (ValueError, OverflowError):
        return value
    return moment.date().isoformat() if moment.time() == datetime.min.time() else moment.isoformat(" ")


def _sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 0, cells as strings) of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        texts = _part(book, "xl/sharedStrings.xml")
        shared = [] if texts is None else [_texts(si) for si in texts if si.tag.rsplit("}", 1)[-1] == "si"]
        name, from_1904 = _first_sheet(book)
        dates = _date_styles(book)
        at_row = -1
        with book.open(name) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if node.tag.rsplit("}", 1)[-1] != "row":
                    continue
                at_row = int(node.get("r")) - 1 if node.get("r") else at_row + 1
                row: list[str | None] = []
                for cell in node:
                    at = _column(cell.get("r")) if cell.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    kind = cell.get("t")
                    value = next((c.text for c in cell if c.tag.rsplit("}", 1)[-1] == "v"), None)
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = _texts(cell)
                    elif kind == "b" and value is not None:
                        value = "True" if value == "1" else "False"
                    elif kind in (None, "n") and value is not None and cell.get("s") in dates:
                        value = _day(value, from_1904)
                    row[at] = value
                yield at_row, row
                node.clear()


def header_names(cells: list[str | None], width: int) -> list[str]:
    """Trimmed headers: equal ones get .1, .2 …, missing ones the place of their column."""
    out: dict[str, None] = {}
    for i in range(width):
        text = (cells[i] or "").strip() if i < len(cells) else ""
        text = text or f"Unnamed: {i}"
        name, n = text, 0
        while name in out:
            n += 1
            name = f"{text}.{n}"
        out[name] = None
    return list(out)


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CELLS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            head, columns, out = None, [], []
            for i, row in _sheet_rows(content):
                if head is None:
                    head = row
                    continue
                if len(row) > len(columns):
                    columns = header_names(head, max(len(head), len(row)))
                out.append((path, i, columns, row))
                if len(out) == _CHUNK:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)


def sheet_cells(files: DataFrame) -> DataFrame:
    """(path, sheet_row, columns, cells) out of (path, content): the rows below the header of the first sheet."""
    return files.select("path", "content").mapInPandas(_decode, CELLS)


def _filled(files: DataFrame) -> DataFrame:
    """Tokens nulled, empty rows out."""
    filled = F.transform("cells", lambda v: F.when(~v.isin(NULL_TOKENS), v))
    return sheet_cells(files).withColumn("cells", filled).where(F.exists("cells", lambda v: v.isNotNull()))


def workbook_values(files: DataFrame) -> DataFrame:
    """(path, sheet_row, column, value) of every cell that a header names, in one pass over the workbooks."""
    return _filled(files).select("path", "sheet_row", F.explode(F.arrays_zip("columns", "cells")).alias("c")).select(
        "path", "sheet_row", F.col("c.columns").alias("column"), F.col("c.cells").alias("value"))


def wide_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """Wide rows of (path, content) with the named columns. A projection: the cells of a row are together already."""
    cells = F.map_from_arrays("columns", F.transform("columns", lambda _, i: F.get("cells", i)))
    rows = _filled(files).withColumn("cells", cells)
    return rows.select("path", "sheet_row", *[F.try_element_at("cells", F.lit(c)).alias(c) for c in columns])


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith(".xlsx") and "*" not in path:
        raise ValueError("only .xlsx workbooks are supported")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)


def read_excel_export(spark: SparkSession, path: str) -> DataFrame:
    """One export of workbooks with the same headers: wide rows with ``row_idx``, ready for a run.

    The columns are those of any workbook of the export, in order of their first place.
    """
    files = workbook_files(spark, path)
    named = sheet_cells(files).select(F.posexplode("columns").alias("place", "column")).groupBy("column").agg(F.min("place").alias("place"))
    columns = [r["column"] for r in named.orderBy("place", "column").collect()]  # one row a header
    rows = dense_index(wide_rows(files, columns), [F.col("path"), F.col("sheet_row")])
    return rows.select(*[F.col(f"`{c}`") for c in columns], "row_idx")
