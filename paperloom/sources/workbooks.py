"""Workbooks as a source: every sheet's rows by reading the packed XML of .xlsx files, and sheets with a header row."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import header
from ..operators.batches import per_row

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(place: str) -> int:
    """The number from 0 of a place's column: A is 0, AA is 26."""
    n = 0
    for letter in re.match(r"[A-Z]*", place).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def sheets(content: bytes | None) -> list[dict]:
    """(sheet, row, values) of all rows of a workbook; an unreadable one has none.  Blank cells are null."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content or b""))
        names = set(book.namelist())
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))
        shared = [text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_LINK)].lstrip("/")
            for i, row in enumerate(ElementTree.fromstring(book.read(target if target in names else f"xl/{target}")).iter(f"{_MAIN}row")):
                values: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r") or "") if cell.get("r") else len(values)
                    values += [None] * (at + 1 - len(values))
                    raw = cell.find(f"{_MAIN}v")
                    kind = cell.get("t")
                    value = text(cell) if kind == "inlineStr" else None if raw is None else shared[int(raw.text)] if kind == "s" else raw.text
                    values[at] = value or None
                out.append({"sheet": sheet.get("name"), "row": int(row.get("r") or i + 1), "values": values})
        return out
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError):
        return []


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, values) of all .xlsx files below a folder; a file is read in one task."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    made = per_row(found, lambda content: (sheets(content),), "rows array<struct<sheet:string,row:int,values:array<string>>>", "content")
    return made.select("path", F.inline("rows"))


def read_sheet(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of a sheet (row, values) whose headers, squeezed, are in ``names``, under their new names; the first row is the header.

    Of equal headers the last counts.  Rows of nulls alone are left out; without a known header there are no rows.
    """
    known = {" ".join(k.replace("\xa0", " ").split()): v for k, v in names.items()}
    first = rows.orderBy("row").limit(1).select("row", F.transform("values", header).alias("names")).collect()
    if not first:
        return rows.select(*[F.lit(None).cast("string").alias(v) for v in dict.fromkeys(known.values())]).limit(0)
    at = {known[h]: i for i, h in enumerate(first[0].names) if h in known}
    body = rows.where((F.col("row") > first[0].row) & F.exists("values", lambda v: v.isNotNull()) & F.lit(bool(at)))
    return body.select(*[F.get("values", F.lit(at[v])).alias(v) if v in at else F.lit(None).cast("string").alias(v) for v in dict.fromkeys(known.values())])
