"""Many workbooks at once: one row per sheet row, the first sheet of each file.

The task that holds a file only inflates it and cuts sheet and shared strings into pieces at row and string ends. Pieces
are dealt over all tasks and parsed there once; shared strings are a table that each piece is joined with.
"""

from __future__ import annotations

import codecs
import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelens.sources.readers import READ_ERRORS, _unreadable, infer_types, require_rows
from tablelens.sources.scratch import materialize, release

#: Bytes of inflated XML in a piece: some thousands of rows.
PIECE = 1 << 20
_PIECES = "path string, kind string, piece int, root string, xml binary, first long, dates array<int>, error string"
_PARSED = ("path string, kind string, piece int, rows array<array<struct<value: string, at: int>>>, needs array<long>, "
           "first long, texts array<string>, error string")
_BROKEN = (zipfile.BadZipFile, ET.ParseError, KeyError, StopIteration, ValueError, UnicodeError)
_EPOCH = dt.datetime(1899, 12, 30)
# Number formats 14-22 and 45-47 of the file format are dates and times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {int(e.get("numFmtId")) for e in root.iter() if _local(e.tag) == "numFmt"
              and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")).lower())}
    formats = next((e for e in root if _local(e.tag) == "cellXfs"), [])
    return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | custom}


def _first_sheet(book: zipfile.ZipFile) -> str:
    root = ET.fromstring(book.read("xl/workbook.xml"))
    sheet = next(e for e in root.iter() if _local(e.tag) == "sheet")
    link = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
    rels = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.get("Target") for e in rels if e.get("Id") == link)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _place(ref: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(cell: ET.Element, dates: set[int]) -> str | int | None:
    """The text of a cell, or the number of its shared string."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _runs(cell)
    value = next((e.text for e in cell if _local(e.tag) == "v"), None)
    if value is None:
        return None
    if kind == "s":
        return int(value)
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        return (_EPOCH + dt.timedelta(days=float(value))).isoformat(sep=" ", timespec="seconds")
    if kind == "n" and re.fullmatch(r"-?\d+\.0+", value):
        return value.split(".")[0]
    return None if kind == "e" else value


def _runs(e: ET.Element) -> str:
    """All runs of a rich text; reading aids (``rPh``) aren't part of it."""
    if _local(e.tag) == "t":
        return e.text or ""
    return "".join(_runs(x) for x in e if _local(x.tag) != "rPh")


def _cut(stream: io.BufferedIOBase, element: str, size: int) -> Iterator[tuple[str, bytes, int]]:
    """(start tag of the document, some whole ``element``s, how many) in order, from one pass over the inflated bytes."""
    start = re.compile(rb"<(?:[\w.-]+:)?%b(?=[\s/>])" % element.encode())
    end = re.compile(rb"</(?:[\w.-]+:)?%b\s*>|<(?:[\w.-]+:)?%b(?:\s[^<>]*)?/>" % (element.encode(), element.encode()))
    last = re.compile(rb"</(?:[\w.-]+:)?(?:sheetData|sst)\s*>")
    decode, root, rest = None, "", b""
    while True:
        more = stream.read(size)
        if decode is None:
            wide = more[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)
            decode = codecs.getincrementaldecoder("utf-16" if wide else "utf-8-sig")()
        rest += decode.decode(more, not more).encode()
        if not root and (m := re.search(rb"<[A-Za-z_][^>]*>", rest)):
            root = re.sub(r"/>$", ">", m.group().decode())
        if m := last.search(rest):
            more, rest = b"", rest[:m.start()]
        ends = list(end.finditer(rest))
        if ends:
            at = start.search(rest)
            yield root, rest[at.start():ends[-1].end()], len(ends)
            rest = rest[ends[-1].end():]
        if not more:
            if start.search(rest):
                raise ET.ParseError(f"the last {element} has no end")
            return


def _pieces(name: str, content: bytes, size: int) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        dates = sorted(_date_styles(book))
        with book.open(_first_sheet(book)) as f:
            for i, (root, xml, _) in enumerate(_cut(f, "row", size)):
                yield name, "rows", i, root, xml, 0, dates, None
        if "xl/sharedStrings.xml" in book.namelist():
            first = 0
            with book.open("xl/sharedStrings.xml") as f:
                for i, (root, xml, n) in enumerate(_cut(f, "si", size)):
                    yield name, "strings", i, root, xml, first, None, None
                    first += n


def _elements(root: str, xml: bytes) -> ET.Element:
    name = re.match(r"<([^\s>]+)", root).group(1)
    return ET.fromstring(root.encode() + xml + f"</{name}>".encode())


def _rows(root: str, xml: bytes, dates: set[int]) -> tuple[list, list[int]]:
    """Rows of cells (text, or the place of its shared string in the second list), without empty rows."""
    rows, places = [], {}
    for e in _elements(root, xml):
        cells: list[tuple[str | None, int | None]] = []
        for i, c in enumerate(c for c in e if _local(c.tag) == "c"):
            at = _place(c.get("r")) if c.get("r") else i
            cells += [(None, None)] * (at + 1 - len(cells))
            v = _text(c, dates)
            cells[at] = (None, places.setdefault(v, len(places) + 1)) if isinstance(v, int) else (v, None)
        if any(c != (None, None) for c in cells):
            rows.append(cells)
    return rows, list(places)


def parsed_pieces(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """Rows and shared strings of all workbooks, piece by piece, with an ``error`` for what can't be read."""
    names, found = ([c.split()[0] for c in re.split(r", (?=\w+ )", s)] for s in (_PIECES, _PARSED))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    for piece in _pieces(name, content, size):
                        yield pd.DataFrame([piece], columns=names)
                except _BROKEN as e:
                    yield pd.DataFrame([(name, "error", 0, "", b"", 0, None, f"{type(e).__name__}: {e}")], columns=names)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf.itertuples():
                rows = needs = texts = None
                kind, error = p.kind, p.error
                try:
                    if kind == "rows":
                        rows, needs = _rows(p.root, p.xml, set(p.dates))
                    elif kind == "strings":
                        texts = [_runs(e) for e in _elements(p.root, p.xml)]
                except _BROKEN as e:
                    kind, error = "error", f"{type(e).__name__}: {e}"
                yield pd.DataFrame([(p.path, kind, p.piece, rows, needs, p.first, texts, error)], columns=found)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cut, _PIECES).repartition("path", "kind", "piece").mapInPandas(parse, _PARSED)


def sheet_cells(parsed: DataFrame) -> DataFrame:
    """``(path, piece, row_no, head, cells)``: rows with their shared strings; ``head`` marks the first row of a workbook.

    A piece asks for each of its strings once, so a string that fills a column is one row per piece.
    """
    key = ["path", "piece"]
    pieces = parsed.where("kind = 'rows' AND size(rows) > 0").select(*key, "rows", "needs")
    strings = parsed.where("kind = 'strings'").select("path", "first", F.posexplode("texts").alias("i", "text")).select(
        "path", (F.col("first") + F.col("i")).alias("number"), "text")
    wanted = pieces.select(*key, F.posexplode("needs").alias("at", "number")).join(strings, ["path", "number"], "left")
    texts = wanted.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("texts"))
    firsts = pieces.groupBy("path").agg(F.min("piece").alias("piece")).withColumn("starts", F.lit(True))
    filled = F.transform("rows", lambda row: F.transform(row, lambda c: F.coalesce(c["value"], F.try_element_at("texts", c["at"]))))
    rows = pieces.join(texts, key, "left").select(*key, filled.alias("rows")).join(firsts, key, "left")  # before rows are told apart
    told = rows.select(*key, F.coalesce("starts", F.lit(False)).alias("starts"), F.posexplode("rows").alias("row_no", "cells"))
    return told.select(*key, "row_no", (F.col("starts") & (F.col("row_no") == 0)).alias("head"), "cells")


def read_excel(spark: SparkSession, path: str, size: int = PIECE) -> DataFrame:
    """The first row of each workbook is its header; all workbooks of one call must share it.

    Workbooks are read once: the result is a table in the shared folder.
    """
    try:
        parsed = materialize(parsed_pieces(spark, path, size), "workbook-pieces")
        error = parsed.where("kind = 'error'").select("error").first()
        if error:
            raise ValueError(f"Could not read {path} as Excel: {error[0]}")
        cells = materialize(sheet_cells(parsed), "workbook-cells")
        release(parsed)
        heads = cells.where("head").select("cells").distinct().limit(2).collect()
    except READ_ERRORS as e:
        raise _unreadable(path, "Excel", e) from e
    if len(heads) > 1:
        raise ValueError(f"Could not read {path} as Excel: the workbooks have different headers.")
    names = [n or f"Unnamed: {i}" for i, n in enumerate(heads[0]["cells"])] if heads else []
    rows = cells.where("NOT head").select(*[
        F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    return infer_types(require_rows(rows, path))
