"""Workbooks (xlsx): every sheet's rows as strings, and small result tables as sheets.

A workbook is a zip of XML parts. Files are read in parallel, one whole file in a task at a time;
sheets are streamed row by row. Writing is for results (a sheet holds at most ``MOST_ROWS`` rows;
more are an error), so it happens where the program runs, from rows that are counted first.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATED = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_576
CONFIDENCE = 0.78


def _column(reference: str) -> int:
    """A cell's column from 0: A is 0, Z 25, AA 26."""
    n = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{{{MAIN}}}t"))


def sheets(content: bytes) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """Names and rows of a workbook's sheets, in order; a gap in a row is an empty string."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}

    def rows(part: str) -> Iterator[list[str]]:
        with book.open(part) as f:
            for _, element in ElementTree.iterparse(f):
                if element.tag != f"{{{MAIN}}}row":
                    continue
                out: list[str] = []
                for cell in element:
                    at = _column(cell.get("r", "")) if cell.get("r") else len(out)
                    out += [""] * (at - len(out))
                    value = cell.find(f"{{{MAIN}}}v")
                    kind = cell.get("t")
                    out.append(_text(cell) if kind == "inlineStr" else "" if value is None else shared[int(value.text)] if kind == "s" else value.text or "")
                element.clear()
                yield out

    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"):
        target = targets[sheet.get(f"{{{RELATED}}}id")].lstrip("/")
        yield sheet.get("name"), rows(target if target.startswith("xl/") else f"xl/{target}")


def read(found: DataFrame) -> DataFrame:
    """A row for each filled row under a sheet's first, from ``found(path, content)``: ``path,
    sheet_name, row_number, text, row`` (cells by the first row's names, the sheet's among them) and
    the parser's confidence. A file that is no workbook has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                try:
                    parts = list(sheets(content.as_py()))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                for name, rows in parts:
                    head = next(rows, [])
                    out = []
                    for k, cells in enumerate(rows):
                        cells = cells[: len(head)] + [""] * (len(head) - len(cells))
                        if any(cells):
                            out.append((path.as_py(), name, k + 1, " ".join(cells), [("sheetName", name), *{h: c for h, c in zip(head, cells, strict=True) if h}.items()]))
                    if out:
                        types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["path", "sheet_name", "row_number", "text", "row"])

    out = found.select("path", "content").mapInArrow(run, "path string, sheet_name string, row_number int, text string, row map<string,string>")
    return out.withColumn("parser_confidence", F.lit(CONFIDENCE))


def read_path(spark: SparkSession, path: str) -> DataFrame:
    return read(spark.read.format("binaryFile").load(path))


def _cells(values: list) -> str:
    cells = (f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in values)
    return f"<row>{''.join(cells)}</row>"


def workbook(tables: dict[str, DataFrame]) -> bytes:
    """A workbook of small result tables, a sheet each."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        numbered = list(enumerate(tables.items(), 1))
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n, _ in numbered)
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{overrides}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATED}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{RELATED}"><sheets>' + "".join(f'<sheet name={quoteattr(name[:31])} sheetId="{n}" r:id="rId{n}"/>' for n, (name, _) in numbered) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{n}" Type="{RELATED}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n, _ in numbered) + "</Relationships>")
        for n, (name, table) in numbered:
            rows = table.take(MOST_ROWS)
            if len(rows) == MOST_ROWS:
                raise ValueError(f"sheet {name} has more than {MOST_ROWS - 1} rows")
            book.writestr(f"xl/worksheets/sheet{n}.xml", f'{head}<worksheet xmlns="{MAIN}"><sheetData>{_cells(table.columns)}{"".join(_cells(list(r)) for r in rows)}</sheetData></worksheet>')
    return out.getvalue()


def markdown(tables: dict[str, DataFrame], title: str) -> str:
    """The same tables as a Markdown report."""
    cell = lambda v: ("" if v is None else str(v)).replace("|", r"\|").replace("\n", " ")
    parts = [f"# {title}"]
    for name, table in tables.items():
        rows = table.take(MOST_ROWS)
        if len(rows) == MOST_ROWS:
            raise ValueError(f"table {name} has more than {MOST_ROWS - 1} rows")
        parts.append("\n".join([f"## {name}", "", f"| {' | '.join(table.columns)} |", f"|{'-|' * len(table.columns)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows)]))
    return "\n\n".join(parts) + "\n"
