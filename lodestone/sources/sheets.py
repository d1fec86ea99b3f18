"""Excel workbooks of one sheet, by their published layout; a sheet's own limit of rows bounds what passes the driver."""

from __future__ import annotations

import datetime
import decimal
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .shapes import _batches, _files, _put

ROWS, COLUMNS, CHARS = 1_048_576, 16_384, 32_767  # fixed values: what a sheet and a cell hold
# fixed values: names in the format
MAIN, DOCUMENT, PACKAGE = (f"http://schemas.openxmlformats.org/{p}" for p in ("spreadsheetml/2006/main", "officeDocument/2006/relationships", "package/2006"))
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def letters(n: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


def number(cell: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", cell)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(v, at: str) -> str:
    if v is None or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float, decimal.Decimal)) and abs(v) != float("inf"):
        return f'<c r="{at}"><v>{v}</v></c>'
    text = v.isoformat(" ") if isinstance(v, datetime.datetime) else str(v)
    if len(text) > CHARS:
        raise ValueError(f"a cell holds {CHARS} characters, not {len(text)}")
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1", limit: int = ROWS - 1) -> None:
    """A workbook with a header; rows come to the driver part by part. Raises above ``limit`` rows, which a sheet has."""
    if not sheet or len(sheet) > 31 or re.search(r"[\[\]:*?/\\]", sheet):
        raise ValueError(f"not a name for a sheet: {sheet!r}")
    if len(df.columns) > COLUMNS:
        raise ValueError(f"a sheet holds {COLUMNS} columns")
    limit = min(limit, ROWS - 1)
    held = io.BytesIO()
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    marks = [letters(k) for k in range(len(df.columns))]
    row = lambda n, values: f'<row r="{n}">' + "".join(_cell(v, f"{m}{n}") for m, v in zip(marks, values, strict=True)) + "</row>"
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{xml}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{KIND}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{MAIN}" xmlns:r="{DOCUMENT}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{DOCUMENT}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            out.write(f'{xml}<worksheet xmlns="{MAIN}"><sheetData>{row(1, df.columns)}'.encode())
            for n, r in enumerate(df.limit(limit + 1).toLocalIterator(), 2):
                if n > limit + 1:
                    raise ValueError(f"more than {limit} rows for a sheet")
                out.write(row(n, r).encode())
            out.write(b"</sheetData></worksheet>")
    _put(df.sparkSession, path, held.getvalue())


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(row, values as text) of a sheet, the first unless named; what isn't stored is null."""
    tag = lambda n: f"{{{MAIN}}}{n}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        names = {s.get("name"): s.get(f"{{{DOCUMENT}}}id") for s in book.iter(tag("sheet"))}
        if sheet is not None and sheet not in names:
            raise ValueError(f"no sheet {sheet!r}; there are {sorted(names)}")
        wanted = names[sheet] if sheet is not None else next(iter(names.values()))
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == wanted)
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in i.iter(tag("t"))) for i in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(tag("si"))]
        plain = lambda s: re.sub("_x([0-9A-F]{4})_", lambda m: chr(int(m[1], 16)), s)
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            last = 0
            for _, r in ElementTree.iterparse(f):
                if r.tag != tag("row"):
                    continue
                last = int(r.get("r") or last + 1)
                values: list[str | None] = []
                for c in r.iter(tag("c")):
                    k = number(c.get("r")) if c.get("r") else len(values)
                    values += [None] * (k + 1 - len(values))
                    v = c.find(tag("v"))
                    if c.get("t") == "inlineStr":
                        values[k] = plain("".join(t.text or "" for t in c.iter(tag("t"))))
                    elif v is not None:
                        values[k] = plain(shared[int(v.text)]) if c.get("t") == "s" else v.text
                yield last, values
                r.clear()


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(row, values array of text) of a sheet of each workbook at a path, the header included; rows count from 1."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                yield from _batches(sheet_rows(bytes(data), sheet), ["row", "values"])

    return _files(spark, path, ".xlsx").select("content").mapInPandas(read, "row long, values array<string>")
