"""Workbooks made here, read back."""

import zipfile

from cargolore.sources import workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def cell(at, value, shared):
    if isinstance(value, float | int):
        return f'<c r="{at}"><v>{value}</v></c>'
    if value.startswith("inline:"):
        return f'<c r="{at}" t="inlineStr"><is><t>{value[7:]}</t></is></c>'
    shared.append(value)
    return f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'


def make(path, sheets):
    """A workbook of ``{name: rows}``; None leaves a cell out."""
    shared, parts = [], []
    for rows in sheets.values():
        lines = "".join(f'<row r="{i}">' + "".join(cell(f"{chr(65 + k)}{i}", v, shared) for k, v in enumerate(row) if v is not None) + "</row>" for i, row in enumerate(rows, 1))
        parts.append(f"<worksheet {NS}><sheetData>{lines}</sheetData></worksheet>")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(parts) + 1)) + "</Relationships>")
        items = "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r><rPh><t>hint</t></rPh></si>" if s.startswith("ru") else f"<si><t>{s}</t></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{items}</sst>")
        for i, part in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", part)


def test_rows_and_cells(spark, tmp_path):
    make(f"{tmp_path}/a.xlsx", {"One": [["Code", None, "Text"], [7.0, "no header", "run on"], [None, None, None], [1.5, None, "inline:é"]], "Two": [["x"]]})
    got = [(r.sheet_no, r.sheet, r.row_no, [tuple(c) for c in r.cells]) for r in workbook.read_workbook(spark, str(tmp_path)).orderBy("row_no").collect()]
    assert got == [(0, "One", 2, [("code", "7"), ("text", "run on")]), (0, "One", 4, [("code", "1.5"), ("text", "é")])]


def test_nomenclature(spark, tmp_path):
    make(f"{tmp_path}/en.xlsx", {"HS": [["﻿HSCode", "Description (EN)", "Description (FR)"], ["01.01.21", "Pure-bred horses", "Chevaux de race"], ["", "no code", None], ["010129", None, "no text"], [720839, "Flat-rolled", None]], "Notes": [["code", "description"], ["99", "not read"]]})
    make(f"{tmp_path}/split.xlsx", {"Cover": [["HS 2022"], ["World"]], "I": [["Heading", "Label"], ["0201", "Meat"]], "II": [["subheading", "title"], ["030211", "Trout"]]})
    got = {tuple(r) for r in workbook.read_nomenclature(spark, str(tmp_path)).collect()}
    assert got == {
        ("010121", "Pure-bred horses", "Pure-bred horses || Chevaux de race"), ("720839", "Flat-rolled", "Flat-rolled"), ("0201", "Meat", "Meat"), ("030211", "Trout", "Trout"),
    }
