"""Workbook text without a spreadsheet library: the zip's XML parts, read in an Arrow-batched function."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_texts(content: bytes) -> str:
    """For each sheet its title, then its rows with tabs between cells; empty cells are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            out.append(f"## sheet: {sheet.get('name')}")
            target = links[sheet.get(_LINK)].lstrip("/")
            for row in ElementTree.fromstring(z.read(target if target in names else f"xl/{target}")).iter(f"{_MAIN}row"):
                cells: dict[int, str] = {}
                for c in row:
                    value = c.findtext(f"{_MAIN}v") or ""
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif c.get("t") == "b":
                        value = "True" if value == "1" else "False"
                    cells[_column(c.get("r")) if c.get("r") else len(cells)] = value
                out.append("\t".join(cells.get(i, "") for i in range(max(cells, default=-1) + 1)))
        return "\n".join(out)


def workbook_text(content: Column) -> Column:
    """The text of workbooks; what can't be read is null."""

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            try:
                return sheet_texts(bytes(data)) if data is not None else None
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, TypeError):
                return None

        return content.map(one).astype("object")

    return read(content)
