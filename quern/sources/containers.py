"""Sheets (XLSX) and texts with tables (DOCX): zip containers of XML, read by Spark as binary files and taken apart in tasks, and written as bytes.

A task streams one file after another, of which Arrow hands it a bounded number of bytes at a time; a file's rows leave in batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import batched
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.predicates import last_colon
from quern.functions.text import strip_number, tokens
from quern.operators.catalog import boundary_split
from quern.operators.ordering import few
from quern.scratch import materialize
from quern.sources.readers import SOURCE_NAMES, TARGET_NAMES

#: Rows of one batch.
BATCH = 2_000
PART_SCHEMA = "path string, kind string, part int, row int, cells array<string>"
#: Names of the two formats' elements.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _said(paragraph: ElementTree.Element) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join((e.text or "") if e.tag == f"{W}t" else marks.get(e.tag, "") for e in paragraph.iter())


def document_parts(content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(kind, part, row, cells): rows of the tables of the body in order, then its paragraphs. A cell over several columns stands in each; one that goes on from the row above has its text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as f:
        body = ElementTree.parse(f).getroot().find(f"{W}body")
    for t, table in enumerate(body.findall(f"{W}tbl")):
        above: list[str] = []
        for r, row in enumerate(table.findall(f"{W}tr")):
            cells: list[str] = []
            for cell in row.findall(f"{W}tc"):
                form = cell.find(f"{W}tcPr")
                span = form.find(f"{W}gridSpan") if form is not None else None
                merge = form.find(f"{W}vMerge") if form is not None else None
                text = "\n".join(_said(p) for p in cell.findall(f"{W}p"))
                if merge is not None and merge.get(f"{W}val", "continue") == "continue" and len(above) > len(cells):
                    text = above[len(cells)]
                cells += [text] * (int(span.get(f"{W}val", "1")) if span is not None else 1)
            above = cells
            yield "table", t, r, cells
    for k, paragraph in enumerate(body.findall(f"{W}p")):
        yield "paragraph", k, 0, [_said(paragraph)]


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference.upper())[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _number(x: str) -> str:
    v = float(x)
    return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)


def sheet_parts(content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(kind, 0, row, cells): the rows of the first sheet, from 0, as far as their last cell. Numbers stand as Python writes them, truth values as True and False, an absent cell is null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == f"{S}si":
                        shared.append("".join(t.text or "" for p in e if p.tag != f"{S}rPh" for t in p.iter(f"{S}t")))
                        e.clear()
        first = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{S}sheets/{S}sheet").get(f"{R}id")
        target = next(e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if e.get("Id") == first)
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            at = -1
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{S}row":
                    continue
                at = int(e.get("r")) - 1 if e.get("r") else at + 1
                cells: list[str | None] = []
                for c in e.findall(f"{S}c"):
                    k = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (k + 1 - len(cells))
                    kind, value = c.get("t", "n"), c.findtext(f"{S}v")
                    if kind == "inlineStr":
                        cells[k] = "".join(t.text or "" for t in c.iter(f"{S}t"))
                    elif value is not None:
                        cells[k] = shared[int(value)] if kind == "s" else ("True" if value == "1" else "False") if kind == "b" else _number(value) if kind == "n" else value
                yield "sheet", 0, at, cells
                e.clear()


def parts(files: DataFrame) -> DataFrame:
    """files (path, content) to (path, kind, part, row, cells): sheet rows of files with a workbook, table rows and paragraphs of files with a document. A file that is neither, or is damaged, gives one row of kind `unreadable`."""

    def rows_of(content: bytes | None) -> Iterator[tuple[str, int, int, list[str | None]]]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                names = set(z.namelist())
            yield from sheet_parts(content) if "xl/workbook.xml" in names else document_parts(content)
        except (zipfile.BadZipFile, zipfile.LargeZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, AttributeError, StopIteration, EOFError):
            yield "unreadable", 0, 0, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for rows in batched(rows_of(content.as_py()), BATCH):
                    kind, part, row, cells = zip(*rows)
                    arrays = [pa.array([path] * len(rows), pa.string()), pa.array(kind, pa.string()), pa.array(part, pa.int32()), pa.array(row, pa.int32()), pa.array(cells, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["path", "kind", "part", "row", "cells"])

    return files.select("path", "content").mapInArrow(run, PART_SCHEMA)


def read_parts(spark: SparkSession, path: str, suffix: str = "*.{xlsx,docx}") -> DataFrame:
    """parts() of the files below path, wherever Spark can read."""
    return parts(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path))


def _is_header(cell: Column, names: tuple[str, ...]) -> Column:
    return F.lower(F.trim(cell)).isin(*[n.lower() for n in names])


def sheet_pairs(rows: DataFrame) -> DataFrame:
    """(path, row, src, tgt) of the sheets among rows: columns by header name in any case, else the first two. Null is the text nan; a sheet of one column is an error."""
    sheets = rows.filter("kind = 'sheet'")
    head = sheets.filter("row = 0")
    named = lambda names: F.coalesce(*[F.nullif(F.array_position(F.transform("cells", lambda c: F.lower(F.trim(c))), n.lower()), F.lit(0)) for n in names])
    src, tgt = named(SOURCE_NAMES), named(TARGET_NAMES)
    known = src.isNotNull() & tgt.isNotNull()
    wide = F.when(known | (F.size("cells") >= 2), 2).otherwise(F.raise_error(F.concat(F.lit("two columns are needed in "), F.col("path")))).cast("int")
    head = materialize(head.select("path", F.when(known, src).otherwise(F.lit(1)).cast("int").alias("_s"), F.when(known, tgt).otherwise(wide).cast("int").alias("_t")), "headers")
    said = lambda k: F.coalesce(F.get("cells", F.col(k) - 1), F.lit("nan"))
    return sheets.filter("row > 0").join(few(head), "path").select("path", "row", said("_s").alias("src"), said("_t").alias("tgt"))


def document_pairs(rows: DataFrame, source_words: DataFrame, target_words: DataFrame, target_letters: str, least: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(pairs, doubtful) of the documents among rows. pairs: (path, kind, part, row, src, tgt).

    A document whose tables have rows of two cells or more gives those, without header rows. Of any other each paragraph, without its list number, is cut at the last colon if both sides have text, else where the vocabularies
    (word) say, if with a confidence of `least` or more; other lines are doubtful: (path, part, line, src, tgt, confidence), src and tgt null in lines of one word.
    """
    cell = lambda k: F.get("cells", F.lit(k))
    tables = rows.filter("kind = 'table' AND size(cells) >= 2").filter(~(_is_header(cell(0), SOURCE_NAMES) & _is_header(cell(1), TARGET_NAMES)))
    of_tables = tables.select("path", "kind", "part", "row", cell(0).alias("src"), cell(1).alias("tgt"))
    plain = rows.filter("kind = 'paragraph'").join(few(materialize(tables.select("path").distinct(), "tabled")), "path", "left_anti")
    lines = plain.select("path", "part", strip_number(F.trim(F.regexp_replace(cell(0), "^\\s+|\\s+$", ""))).alias("line")).filter("line <> ''")
    cut = last_colon(F.col("line"))
    lines = materialize(lines.withColumns({"_l": F.regexp_replace(cut["left"], "^[ \\t—–|-]+|[ \\t—–|-]+$", ""), "_r": F.regexp_replace(cut["right"], "^\\s+|\\s+$", "")}), "lines")
    clear = F.coalesce((F.col("_l") != "") & (F.col("_r") != ""), F.lit(False))
    of_colons = lines.filter(clear).select("path", F.lit("paragraph").alias("kind"), "part", F.lit(0).alias("row"), F.col("_l").alias("src"), F.col("_r").alias("tgt"))
    open_ = lines.filter(~clear).select(F.struct("path", "part").alias("key"), "line", tokens(F.col("line")).alias("_ws"))
    split = boundary_split(open_, "key", F.col("_ws"), source_words, target_words, target_letters)
    joined = lambda a, n: F.array_join(F.slice("_ws", a, n), " ")
    sides = {"src": joined(F.lit(1), F.col("at").cast("int")), "tgt": joined((F.col("at") + 1).cast("int"), F.size("_ws"))}
    judged = materialize(open_.join(split, "key", "left").select("key.path", "key.part", "line", *[F.when(F.col("at").isNotNull(), v).alias(k) for k, v in sides.items()], "confidence"), "judged")
    sure = F.coalesce(F.col("confidence") >= least, F.lit(False))
    of_words = judged.filter(sure).select("path", F.lit("paragraph").alias("kind"), "part", F.lit(0).alias("row"), "src", "tgt")
    return of_tables.unionByName(of_colons).unionByName(of_words), judged.filter(~sure)


def _zipped(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(zipfile.ZipInfo(name), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{text}')
    return out.getvalue()


def sheet_bytes(rows: list[list[object]]) -> bytes:
    """A workbook of one sheet; None leaves a cell out, numbers are numbers, anything else is text."""

    def cell(v: object) -> str:
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f"<c><v>{v!r}</v></c>"
        return "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    data = "".join(f'<row r="{k}">{"".join(map(cell, row))}</row>' for k, row in enumerate(rows, 1))
    kinds = "http://schemas.openxmlformats.org/package/2006"
    office = R[1:-1]
    return _zipped({
        "[Content_Types].xml": f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{S[1:-1]}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S[1:-1]}"><sheetData>{data}</sheetData></worksheet>',
    })


def document_bytes(tables: list[list[list[str]]], paragraphs: list[str]) -> bytes:
    """A document of tables and, after them, paragraphs."""
    said = lambda t: "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in t.split("\n"))
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{said(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"
    kinds, office = "http://schemas.openxmlformats.org/package/2006", R[1:-1]
    return _zipped({
        "[Content_Types].xml": f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(map(table, tables))}{"".join(map(said, paragraphs))}</w:body></w:document>',
    })
