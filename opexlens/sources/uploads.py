"""Upload files as other programs write them, for the source queries.

``files.py`` and ``workbook.py`` are readers; these writers share no code with
them.  Rows of the raw cost records go into CSV files with quoted cells (line
feeds, commas and doubled quotes inside) and into workbooks with shared
strings, serial dates behind a date style, and a first sheet that is not the
first part.  Each task writes its own files through pyarrow's filesystem
layer, one per partition.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def csv_bytes(header: list[str], rows: list[list], more: bool = False) -> bytes:
    """``more``: rows that go on after others, without a header."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    if not more:
        w.writerow(header)
    w.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue().encode()


def _letters(i: int) -> str:
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def xlsx_bytes(header: list[str], rows: list[list]) -> bytes:
    """Dates as serial numbers under a date style, numbers as numbers, text
    as shared strings; the sheet is part 7, part 2 is a sheet after it."""
    strings: dict[str, int] = {}
    letters = [_letters(i) for i in range(max(map(len, [header, *rows])))]

    def cell(ref: str, v) -> str:
        if v is None:
            return ""
        if isinstance(v, date):
            return f'<c r="{ref}" s="1"><v>{(v - date(1899, 12, 30)).days}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="s"><v>{strings.setdefault(str(v), len(strings))}</v></c>'
    body = "".join(f'<row r="{n}">' + "".join([cell(f"{i}{n}", v) for i, v in zip(letters, r)]) + "</row>"
                   for n, r in enumerate([header, *rows], 1))
    escaped = (s.replace("&", "&amp;").replace("<", "&lt;") for s in strings)
    sheet = f'<worksheet xmlns="{_MAIN}"><sheetData>%s</sheetData></worksheet>'
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets><sheet name="Costs" sheetId="4" r:id="rId7"/>'
                           '<sheet name="Notes" sheetId="1" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId2" Type="{_RELS}/worksheet" Target="worksheets/sheet2.xml"/>'
                                      f'<Relationship Id="rId7" Type="{_RELS}/worksheet" Target="/xl/worksheets/sheet7.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_MAIN}">' + "".join(f"<si><t xml:space=\"preserve\">{s}</t></si>" for s in escaped) + "</sst>",
        "xl/worksheets/sheet2.xml": sheet % '<row r="1"><c r="A1"><v>1</v></c></row>',
        "xl/worksheets/sheet7.xml": sheet % body,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def write_uploads(df: DataFrame, path: str, suffix: str, encode: Callable[[list[str], list[list]], bytes], rows_per_file: int = 50_000) -> str:
    """Files of at most ``rows_per_file`` rows, named by partition."""
    header, target = df.columns, path.rstrip("/")
    target = target if "://" in target else "file:///" + target.removeprefix("file:").lstrip("/")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext
        filesystem, base = fs.FileSystem.from_uri(target)
        filesystem.create_dir(base, recursive=True)
        pid, k, held = TaskContext.get().partitionId(), 0, []

        def flush(rows):
            with filesystem.open_output_stream(f"{base}/upload-{pid:05d}-{k:05d}{suffix}") as out:
                out.write(encode(header, rows))
            return pd.DataFrame({"n": [len(rows)]})
        for pdf in batches:
            held += pdf.astype(object).where(pdf.notna(), None).values.tolist()
            while len(held) >= rows_per_file:
                yield flush(held[:rows_per_file])
                held, k = held[rows_per_file:], k + 1
        if held:
            yield flush(held)

    df.mapInPandas(write, "n long").agg({"n": "sum"}).collect()
    return path


def write_csv_uploads(df: DataFrame, path: str, rows_per_write: int = 20_000) -> str:
    """Quoted CSV files as one program would export them, one per partition,
    written as its rows come in (``rows_per_write`` at a time)."""
    header, target = df.columns, path.rstrip("/")
    target = target if "://" in target else "file:///" + target.removeprefix("file:").lstrip("/")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext
        filesystem, base = fs.FileSystem.from_uri(target)
        filesystem.create_dir(base, recursive=True)
        n = 0
        with filesystem.open_output_stream(f"{base}/upload-{TaskContext.get().partitionId():05d}.csv") as out:
            for pdf in batches:
                rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
                for a in range(0, len(rows), rows_per_write):
                    out.write(csv_bytes(header, rows[a:a + rows_per_write], more=n > 0))
                    n += len(rows[a:a + rows_per_write])
            if not n:
                out.write(csv_bytes(header, []))
        yield pd.DataFrame({"n": [n]})

    df.mapInPandas(write, "n long").agg({"n": "sum"}).collect()
    return path
