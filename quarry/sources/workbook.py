"""Rows of Excel workbooks (.xlsx), read as what they are: ZIP archives of XML. Only values are read, no formulas or formats."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date, timedelta
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _place(reference: str) -> int:
    """Column number from 0 of a cell reference such as ``AB12``."""
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _shared(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    with archive.open("xl/sharedStrings.xml") as xml:
        return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.parse(xml).getroot().iter(f"{_MAIN}si")]


def sheet_rows(content: bytes, sheet: int = 1) -> Iterator[list[str | None]]:
    """The cells of each row of a workbook's sheet as text, null where empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings = _shared(archive)
        with archive.open(f"xl/worksheets/sheet{sheet}.xml") as xml:
            for _, row in ElementTree.iterparse(xml):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _place(cell.get("r")) if cell.get("r") else k
                    cells += [None] * (at + 1 - len(cells))
                    value = cell.find(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is not None and value.text is not None:
                        cells[at] = strings[int(value.text)] if cell.get("t") == "s" else value.text
                row.clear()
                yield cells


def read_workbooks(spark: SparkSession, path: str, columns: Sequence[str], sheet: int = 1) -> DataFrame:
    """(file, and the named columns as text): rows below the header of every workbook at ``path``.

    The first row that is not blank is the header; columns are found by name in any order, and a workbook that lacks one is an
    error. Blank rows are left out. Each workbook is read in one task.
    """
    return workbook_rows(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), columns, sheet)


def workbook_rows(files: DataFrame, columns: Sequence[str], sheet: int = 1) -> DataFrame:
    """:func:`read_workbooks` for rows (file, content), such as the members of an archive."""
    wanted = list(columns)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["file"], frame["content"], strict=True):
                rows = (r for r in sheet_rows(bytes(content), sheet) if any(c is not None and c.strip() for c in r))
                header = [(c or "").strip() for c in next(rows, [])]
                if missing := [c for c in wanted if c not in header]:
                    raise ValueError(f"{name}: no column {', '.join(missing)}")
                places = [header.index(c) for c in wanted]
                held = [[name, *(r[p] if p < len(r) else None for p in places)] for r in rows]
                yield pd.DataFrame(held, columns=["file", *wanted], dtype="object")

    schema = ", ".join(["file string", *(f"`{c}` string" for c in wanted)])
    return files.mapInPandas(run, schema)


def serial_date(cell: Column) -> Column:
    """A date from a workbook's day number (1900 system) or from its ISO text; null for anything else."""
    epoch = F.lit(date(1900, 1, 1) - timedelta(days=2))
    return F.coalesce(F.date_add(epoch, F.floor(cell.try_cast("double")).cast("int")), F.to_date(F.try_to_timestamp(cell, F.lit("yyyy-MM-dd"))))
