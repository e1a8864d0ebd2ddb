"""Workbooks made by hand."""

import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from quarry.sources.files import unzip
from quarry.sources.workbook import read_workbooks, serial_date, workbook_rows

NAMESPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(rows, strings):
    sheet = "".join(f'<row r="{k}">{"".join(cells)}</row>' for k, cells in enumerate(rows, 1))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet {NAMESPACE}><sheetData>{sheet}</sheetData></worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NAMESPACE}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings) + "</sst>")
    return held.getvalue()


@pytest.fixture
def book():
    return workbook(
        [
            [],
            ['<c r="A2" t="s"><v>0</v></c>', '<c r="B2" t="s"><v>1</v></c>', '<c r="AA2" t="inlineStr"><is><t>note</t></is></c>'],
            ['<c r="A3"><v>45000</v></c>', '<c r="AA3" t="inlineStr"><is><t>far</t></is></c>'],
            ['<c r="B4" t="s"><v>2</v></c>', '<c r="A4" t="str"><v>2024-02-29</v></c>'],
            ['<c r="A5"/>'],
        ],
        ["ymd", "item", "쌀 &amp; 콩"],
    )


def test_rows_are_found_by_header(spark, tmp_path, book):
    (tmp_path / "a.xlsx").write_bytes(book)
    df = read_workbooks(spark, f"file://{tmp_path}/*.xlsx", ["note", "ymd", "item"])
    rows = df.select("note", "item", serial_date(F.col("ymd")).alias("day")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("far", None, date(2023, 3, 15)), (None, "쌀 & 콩", date(2024, 2, 29))], key=str)
    with pytest.raises(Exception, match="no column price"):
        read_workbooks(spark, f"file://{tmp_path}/*.xlsx", ["price"]).collect()


def test_workbooks_in_archives(spark, tmp_path, book):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x/b.xlsx", book)
    members = unzip(spark, f"file://{tmp_path}/*.zip", ".xlsx").select(F.col("member").alias("file"), "content")
    assert {(r["file"], r["item"]) for r in workbook_rows(members, ["item"]).collect()} == {("x/b.xlsx", None), ("x/b.xlsx", "쌀 & 콩")}
