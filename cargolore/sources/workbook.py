"""S3: workbooks (XLSX), of which Spark has no reader.

Files are read with Spark's ``binaryFile`` source, so they may lie wherever Spark can
read, one task a file.  A workbook is a ZIP archive of XML; a sheet's rows are parsed as
they come and given out in batches, so only the shared strings of one file are held.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.functions.codes import digits

# Header names of the nomenclature's editions.
CODE_NAMES = ("hscode", "hs code", "hs_code", "code", "product code", "productcode", "subheading", "heading", "tariff", "tariff code")
TEXT_NAMES = ("description", "description (en)", "description_en", "english", "english description", "label", "name", "title")
SECOND_NAMES = ("description (fr)", "description_fr", "french", "french description", "label_fr")
MAX_TITLE, BATCH_ROWS = 512, 1000

_ROWS = "file string, sheet_no int, sheet string, row_no int, cells array<struct<header: string, value: string>>"
_CELLS = pa.list_(pa.struct([("header", pa.string()), ("value", pa.string())]))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(reference: str) -> int:
    """The number of a cell's column, from its reference (``C7`` is 2)."""
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """The text of a string item, whose runs are put together; phonetic hints are not text."""
    return "".join(t.text or "" for part in node if _local(part.tag) in ("t", "r") for t in ([part] if _local(part.tag) == "t" else part) if _local(t.tag) == "t")


def _number(text: str) -> str:
    """A number as it is written in a cell: whole ones without a fraction."""
    try:
        value = float(text)
    except ValueError:
        return text
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else text


def _cell(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind, parts = cell.get("t", "n"), {_local(p.tag): p for p in cell}
    if kind == "inlineStr":
        return _text(parts["is"]) if "is" in parts else None
    value = parts["v"].text if "v" in parts else None
    if value is None or kind == "e":
        return None
    return strings[int(value)] if kind == "s" else _number(value) if kind == "n" else value


def sheets(content: bytes) -> Iterator[tuple[int, str, Iterator[tuple[int, dict[int, str]]]]]:
    """Number, name and rows (number, values by column) of each sheet, in the book's order."""
    book = zipfile.ZipFile(io.BytesIO(content))
    strings: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        strings = [_text(item) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    listed = [n for n in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(n.tag) == "sheet"]

    def rows(path: str) -> Iterator[tuple[int, dict[int, str]]]:
        number = 0
        for _, node in ElementTree.iterparse(book.open(path)):
            if _local(node.tag) == "row":
                number = int(node.get("r", number + 1))
                own: dict[int, str] = {}
                at = -1
                for cell in node:
                    at = _column(cell.get("r")) if cell.get("r") else at + 1
                    value = _cell(cell, strings)
                    if value is not None and value.strip():
                        own[at] = value
                node.clear()
                if own:
                    yield number, own

    for i, sheet in enumerate(listed):
        link = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
        target = targets[link]
        yield i, sheet.get("name", ""), rows(target.lstrip("/") if target.startswith("/") else f"xl/{target}")


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """``file, sheet_no, sheet, row_no, cells``: the rows below each sheet's first, whose
    cells are given with that row's headers (lower case, trimmed), in column order.
    Empty cells and cells without a header are left out; dates are numbers, as they are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out: list[tuple] = []
                for number, name, rows in sheets(content.as_py()):
                    first = next(rows, (0, {}))[1]
                    headers = {at: h.replace("﻿", "").strip().lower() for at, h in first.items()}
                    for row, own in rows:
                        cells = [{"header": headers[at], "value": own[at]} for at in sorted(own) if at in headers]
                        out.append((file, number, name, row, cells))
                        if len(out) == BATCH_ROWS:
                            yield _batch(out)
                            out = []
                yield _batch(out)

    # a file a batch: workbooks are whole in a row
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.repartition(max(1, len(files.inputFiles()))).mapInArrow(run, _ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), _CELLS)
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "sheet_no", "sheet", "row_no", "cells"])


def read_nomenclature(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``hs_code, title, description`` of a nomenclature's workbooks: rows with digits for
    a code and an English text, of each file's first sheet, or of all its sheets if the
    first has none.  A French text is put after the English one."""

    def named(names: tuple[str, ...]) -> Column:
        value = F.get(F.filter("cells", lambda c: c["header"].isin(*names)), F.lit(0))["value"]
        return F.nullif(F.trim(value), F.lit(""))

    rows = read_workbook(spark, path).select("file", "sheet_no", digits(named(CODE_NAMES)).alias("hs_code"), named(TEXT_NAMES).alias("title"), named(SECOND_NAMES).alias("second"))
    usable = rows.where(F.coalesce(F.col("hs_code"), F.lit("")) != "").where("title IS NOT NULL")
    first = usable.groupBy("file").agg(F.min("sheet_no").alias("least")).where("least = 0").select("file", F.lit(True).alias("alone"))
    kept = usable.join(first, "file", "left").where("alone IS NULL OR sheet_no = 0")
    return kept.select("hs_code", F.substring("title", 1, MAX_TITLE).alias("title"), F.concat_ws(" || ", "title", "second").alias("description"))
