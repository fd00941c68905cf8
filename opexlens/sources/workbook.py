"""Spreadsheet workbooks (.xlsx) as a source (S2), and a writer for tests
and round trips.

There is no built-in Spark reader for workbooks.  A folder of workbooks is
listed with the ``binaryFile`` source; ``mapInArrow`` opens each one (a
workbook is a zip of XML parts, read with the standard library) and emits
its first sheet's rows, one task per file.  Rows carry their cells by column
name, so workbooks of different headers unite by name; they are written once
and the columns are the names that occur.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, time, timedelta
from xml.etree import ElementTree as ET
from xml.parsers import expat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_CELL = re.compile(r"([A-Z]+)(\d+)")
# Rows per sheet a workbook can hold, less the header row.
SHEET_ROW_LIMIT = 1_048_575


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _col_letters(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


# Built-in number formats of the file format that show dates
# or times.
_DATE_FORMAT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _tag(name: str) -> str:
    return f"{{{_NS['m']}}}{name}"


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    """Per cell style: whether its number format shows a date."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    shows = {i: True for i in _DATE_FORMAT_IDS}
    for f in root.iter(_tag("numFmt")):
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")).lower()
        shows[int(f.get("numFmtId", -1))] = bool(re.search(r"[dy]|h|m.*s|s.*m", bare)) or bare.strip() == "m"
    xfs = root.find(_tag("cellXfs"))
    return [shows.get(int(x.get("numFmtId", 0)), False) for x in (xfs if xfs is not None else ())]


def _first_sheet(z: zipfile.ZipFile) -> tuple[str, bool]:
    """(part name of the first sheet in workbook order, 1904 date system)."""
    names = z.namelist()
    fallback = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
    if "xl/workbook.xml" not in names:
        return fallback[0], False
    book = ET.fromstring(z.read("xl/workbook.xml"))
    props, sheet = book.find(_tag("workbookPr")), book.find(f"{_tag('sheets')}/{_tag('sheet')}")
    from_1904 = props is not None and props.get("date1904", "0") in ("1", "true")
    if sheet is not None and "xl/_rels/workbook.xml.rels" in names:
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        for r in rels:
            if r.get("Id") == sheet.get(f"{_REL}id"):
                target = r.get("Target", "")
                part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                if part in names:
                    return part, from_1904
    return fallback[0], from_1904


def _serial_date(value: str, from_1904: bool) -> str:
    """Text of a serial day number: a date, with the time if it has one."""
    try:
        serial = float(value)
    except ValueError:
        return value
    epoch = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    if not from_1904 and serial < 60:  # the format counts a 29 Feb 1900
        epoch += timedelta(days=1)
    try:
        when = epoch + timedelta(seconds=round(serial * 86400))
    except OverflowError:
        return value
    return when.strftime("%Y-%m-%d") if when.time() == time() else when.strftime("%Y-%m-%d %H:%M:%S")


def read_sheet(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first worksheet as text: strings, numbers as written,
    date cells as ISO text, booleans as TRUE / FALSE, errors as missing.
    The sheet is parsed as a stream; a few rows are held at a time."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, si in ET.iterparse(z.open("xl/sharedStrings.xml")):
                if si.tag == _tag("si"):
                    shared.append("".join(t.text or "" for t in si.iter(_tag("t"))))
                    si.clear()
        dates, (part, from_1904) = _date_styles(z), _first_sheet(z)

        with z.open(part) as sheet:
            yield from _sheet_rows(sheet, shared, dates, from_1904)


def _sheet_rows(sheet, shared: list[str], dates: list[bool], from_1904: bool) -> Iterator[list[str | None]]:
    """Cells of each row that has any, by the parser's events: no tree is built."""
    row_tag, cell_tag, value_tag, text_tag = (f"{_NS['m']} {t}" for t in ("row", "c", "v", "t"))
    rows: list[list[str | None]] = []
    columns: dict[str, int] = {}
    cells: dict[int, str | None] = {}
    attributes, value, texts, held = {}, None, [], None
    in_row = in_cell = False

    def start(name, attrs):
        nonlocal cells, attributes, value, texts, held, in_row, in_cell
        if name == cell_tag and in_row:
            in_cell, attributes, value, texts = True, attrs, None, []
        elif in_cell and (name == value_tag or name == text_tag):
            held = []
        elif name == row_tag:
            in_row, cells = True, {}

    def characters(data):
        if held is not None:
            held.append(data)

    def end(name):
        nonlocal value, held, in_row, in_cell
        if held is not None:
            if name == value_tag:
                value, held = "".join(held) or None if value is None else value, None
            elif name == text_tag:
                texts.append("".join(held))
                held = None
        elif name == cell_tag and in_cell:
            in_cell = False
            letters = attributes.get("r", "").rstrip("0123456789")
            at = columns.get(letters)
            if at is None:
                m = _CELL.match(attributes.get("r", ""))
                at = _col_index(m.group(1)) if m else max(cells, default=-1) + 1
                if m and m.group(1) == letters:
                    columns[letters] = at
            cells[at] = text()
        elif name == row_tag:
            in_row = False
            if cells:
                rows.append([cells.get(i) for i in range(max(cells) + 1)])

    def text() -> str | None:
        kind = attributes.get("t")
        if kind == "inlineStr":
            return "".join(texts)
        if value is None or kind == "e":
            return None
        if kind == "s":
            return shared[int(value)]
        if kind == "b":
            return "TRUE" if value.strip() == "1" else "FALSE"
        style = int(attributes.get("s", 0))
        if kind in (None, "n") and style < len(dates) and dates[style]:
            if value not in shown:
                shown[value] = _serial_date(value, from_1904)
            return shown[value]
        return value

    shown: dict[str, str] = {}  # dates repeat: one text per day
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    while chunk := sheet.read(1 << 16):
        parser.Parse(chunk)
        yield from rows
        rows.clear()
    parser.Parse(b"", True)
    yield from rows


def write_sheet(header: list[str], rows: list[list]) -> bytes:
    """A minimal one-sheet workbook with inline strings (numbers as text)."""
    def cell(r: int, c: str, v) -> str:
        if v is None:
            return ""
        text = str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return f'<c r="{c}{r}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'
    body, letters = [], [_col_letters(i) for i in range(max(map(len, [header] + rows)))]
    for r, vals in enumerate([header] + rows, start=1):
        body.append(f'<row r="{r}">' + "".join([cell(r, c, v) for c, v in zip(letters, vals)]) + "</row>")
    sheet = ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="%s"><sheetData>%s</sheetData></worksheet>'
             % (_NS["m"], "".join(body)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/'
                   'package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-'
                   'officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/'
                   'sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.'
                   'worksheet+xml"/></Types>')
        z.writestr("xl/workbook.xml",
                   f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="http://'
                   'schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name='
                   '"Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return buf.getvalue()


def _column_names(header: list[str | None], width: int) -> list[str]:
    """Names of a sheet's columns: blank or missing header cells get their
    position, repeated names a number."""
    out: list[str] = []
    for i in range(width):
        name = (header[i] if i < len(header) else None) or f"_c{i}"
        base, k = name, 1
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def _read_rows(batches):
    """Files -> rows (file, cells by name, names in sheet order); a row
    without cells stands for the header of each file."""
    def frame(path, names, rows, header):
        """Cells of the rows as maps; ``header``: the row that stands for it, too."""
        at = [[i for i, v in enumerate(row) if v is not None] for row in rows]
        sizes = [len(x) for x in at] + [0] * header
        flat = np.array([i for x in at for i in x], np.int64)
        values = pa.array([v for row in rows for v in row if v is not None], pa.string())
        keys = pa.array(names, pa.string()).take(pa.array(flat)) if len(flat) else pa.array([], pa.string())
        cells = pa.MapArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), keys, values)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(sizes)), cells, pa.array([None] * len(rows) + [names] * header, pa.list_(pa.string()))],
                                          ["path", "cells", "names"])
    for batch in batches:
        for i in range(batch.num_rows):
            path, rows = batch.column(0)[i].as_py(), read_sheet(batch.column(1)[i].as_py())
            header = next(rows, [])
            names, out = _column_names(header, len(header)), []
            for row in rows:
                if len(row) > len(names):  # cells right of the header
                    names = _column_names(header, len(row))
                if any(v not in (None, "") for v in row):
                    out.append(row)
                if len(out) >= 5000:
                    yield frame(path, names, out, False)
                    out = []
            yield frame(path, names, out, True)


def load_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.xlsx`` files under ``path`` as one text table with the union
    of their columns, in order of first appearance."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]")
                  .option("recursiveFileLookup", True).load(path).select("path", "content"))
    rows = cut_lineage(files.mapInArrow(_read_rows, "path string, cells map<string,string>, names array<string>"), "workbook-rows")
    seen = (rows.where(F.col("names").isNotNull()).select("path", F.posexplode("names").alias("pos", "name"))
            .groupBy("name").agg(F.min(F.struct("path", "pos")).alias("at")).orderBy("at").collect())  # one row per column
    if not seen and rows.isEmpty():
        raise ValueError(f"no workbook under {path}")
    cells = rows.where(F.col("names").isNull())
    return cells.select(*[F.try_element_at("cells", F.lit(r["name"])).alias(r["name"]) for r in seen])


def _uri(path: str) -> str:
    """A URI pyarrow accepts: plain and ``file:/`` paths become ``file:///``."""
    if "://" in path:
        return path
    if path.startswith("file:"):
        path = path[len("file:"):]
    return "file://" + "/" + path.lstrip("/")


def write_workbooks(df: DataFrame, path: str, rows_per_file: int = 100_000) -> str:
    """Workbooks of at most ``rows_per_file`` rows, written as the rows of a
    partition come in, through pyarrow's filesystem layer (local, HDFS or
    object stores alike)."""
    per_file = min(rows_per_file, SHEET_ROW_LIMIT)
    header = df.columns
    target = path.rstrip("/")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext
        filesystem, base = fs.FileSystem.from_uri(_uri(target))
        filesystem.create_dir(base, recursive=True)
        # Named by partition (not attempt): a retried task overwrites its
        # own files instead of leaving a duplicate behind.
        pid, rows, k = TaskContext.get().partitionId(), [], 0

        def flush(chunk):
            name = f"{base}/part-{pid:05d}-{k:05d}.xlsx"
            with filesystem.open_output_stream(name) as out:
                out.write(write_sheet(header, chunk))
            return pd.DataFrame({"file": [name], "rows": [len(chunk)]})
        for pdf in batches:
            rows += pdf.astype(object).where(pdf.notna(), None).values.tolist()
            while len(rows) >= per_file:
                yield flush(rows[:per_file])
                rows, k = rows[per_file:], k + 1
        if rows:
            yield flush(rows)

    written = df.select(*[F.col(c).cast("string") for c in header]) \
                .mapInPandas(write, "file string, rows long")
    written.collect()  # one small row per file
    return path
