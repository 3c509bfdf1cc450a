"""Excel workbooks (xlsx) by the standard library: a workbook is a zip of XML parts.

A sheet holds about a million rows at most, so a workbook is read and written on the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .infer import typed

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACK = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _column(reference: str) -> int:
    letters = re.match(r"[A-Z]+", reference)
    n = 0
    for c in letters[0] if letters else "A":
        n = 26 * n + ord(c) - 64
    return n - 1


def _letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def _bytes(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row["content"])


def _rows(data: bytes, sheet: str) -> list[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_MAIN + "si")]
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(_PACK + "Relationship")}
        sheets = {s.get("name"): targets[s.get(_REL + "id")] for s in ET.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet")}
        if sheet and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}; there are {', '.join(map(str, sheets))}")
        target = sheets[sheet] if sheet else next(iter(sheets.values()))
        root = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    out = []
    for row in root.iter(_MAIN + "row"):
        cells: list[str | None] = []
        for at, c in enumerate(row.iter(_MAIN + "c")):
            place = _column(c.get("r")) if c.get("r") else at
            cells += [None] * (place + 1 - len(cells))
            value, kind = c.find(_MAIN + "v"), c.get("t")
            if kind == "inlineStr":
                cells[place] = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
            elif value is not None and value.text is not None:
                cells[place] = shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}.get(value.text, value.text) if kind == "b" else value.text
        out.append(cells)
    return out


def read_excel_file(spark: SparkSession, path: str, sheet: str = "") -> DataFrame:
    """A sheet (the first if not named) with voted types. It needs a header and a row."""
    rows = _rows(_bytes(spark, path), sheet)
    if len(rows) < 2:
        raise ValueError("the sheet needs a header and a row")
    names = [n or f"col{i}" for i, n in enumerate(rows[0])]
    body = [tuple([*r, *[None] * (len(names) - len(r))][: len(names)]) for r in rows[1:]]
    return typed(spark.createDataFrame(body, T.StructType([T.StructField(n, T.StringType()) for n in names])))


def write_excel_file(df: DataFrame, path: str, sheet: str = "Sheet1", most: int = 1_048_575) -> None:
    """One sheet with a header; a null is an empty cell. More rows than a sheet can hold are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a sheet holds {most} rows at most")

    def cell(at: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    lines = [f'<row r="{i}">' + "".join(cell(f"{_letters(j)}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate([tuple(df.columns), *map(tuple, rows)], 1)]
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{_PACK[1:-1]}"><Relationship Id="rId1" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{_PACK[1:-1]}"><Relationship Id="rId1" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        data = out.getvalue()
        for at in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        stream.close()
