"""Document sources: files, workbooks, PDF text and stored Markdown pages.

Files are read with Spark's ``binaryFile`` source and parsed with the standard library in Arrow batches, so any
store that Spark reads will do. Scanned PDFs need an OCR callable from the caller.
"""

from __future__ import annotations

import datetime
import io
import re
import threading
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import markdown_row, page_header
from ..operators.preflight import list_files

BLOCK_ROWS = 50
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the readable files of a folder, or of one file."""
    return list_files(spark.read.format("binaryFile").load(path).select("path", "content"))


def _date_styles(book: zipfile.ZipFile, names: set[str]) -> set[int]:
    """Cell styles that show numbers as dates or times."""
    if "xl/styles.xml" not in names:
        return set()
    root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    own = {int(x.get("numFmtId", -1)): x.get("formatCode", "") for x in root.iter(f"{_MAIN}numFmt")}
    letters = {k: re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", v.lower())) for k, v in own.items()}
    builtin = {*range(14, 23), *range(45, 48)}
    styles = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in styles] if styles is not None else []
    return {i for i, k in enumerate(ids) if (letters[k] if k in letters else k in builtin)}


def _shown(raw: str, kind: str | None, is_date: bool) -> str:
    """A cell's value as Python prints it: truth values, whole and broken numbers, dates."""
    if kind == "b":
        return str(raw == "1")
    if kind not in (None, "n") or not raw:
        return raw
    try:
        value = float(raw) if re.search("[.eE]", raw) else int(raw)
    except ValueError:
        return raw
    if not is_date:
        return str(value)
    moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(value * 86400))
    return str(moment.time() if 0 <= value < 1 else moment)


def sheets_of(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Name and rows of each sheet; cached values, empty cells as empty text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot():
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        dates = _date_styles(book, names)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
        for sheet in ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            rows: list[list[str]] = []
            for row in ElementTree.parse(book.open(target)).getroot().iter(f"{_MAIN}row"):
                cells: list[str] = []
                for cell in row.iter(f"{_MAIN}c"):
                    letters = re.match("[A-Z]+", cell.get("r", ""))
                    column = 0
                    for ch in letters[0] if letters else "":
                        column = column * 26 + ord(ch) - 64
                    at = column - 1 if letters else len(cells)
                    cells += [""] * (at - len(cells))
                    value = cell.find(f"{_MAIN}v")
                    text = value.text or "" if value is not None else "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    kind = cell.get("t")
                    cells.append(shared[int(text)] if kind == "s" and text else _shown(text, kind, int(cell.get("s", 0)) in dates))
                rows.append(cells)
            yield sheet.get("name", ""), rows


def workbook_rows(given: DataFrame) -> DataFrame:
    """``(path, sheet, sheet_index, row, cells)`` of ``given(path, content)``; a sheet without rows has one with null cells."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for k, (name, rows) in enumerate(sheets_of(content.as_py())):
                    rows = rows or [None]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(rows, pa.list_(pa.string()))],
                        ["path", "sheet", "sheet_index", "row", "cells"],
                    )

    return given.select("path", "content").mapInArrow(read, "path string, sheet string, sheet_index int, row int, cells array<string>")


def workbook_pages(rows: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """``(path, page_index, text)``: a sheet's Markdown, its header repeated before every ``block`` rows.

    Each block ends with a blank line; a sheet with a header only has its title, one without rows says that it is empty.
    """
    heads = rows.where("row = 0 AND cells IS NOT NULL").select("path", "sheet_index", F.col("cells").alias("_head"))
    body = rows.where("row > 0").join(heads, ["path", "sheet_index"])
    width = F.size("_head")
    cut = F.expr("slice(concat(cells, array_repeat('', size(_head))), 1, size(_head))")
    head = F.concat(markdown_row(F.col("_head"), header=True), F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |\n"))
    first = (F.col("row") - 1) % block == 0
    line = F.concat(F.when(first & (F.col("row") > 1), "\n").otherwise(""), F.when(first, head).otherwise(""), markdown_row(cut), F.lit("\n"))
    line = F.when(width == 0, "").otherwise(line)
    lines = body.groupBy("path", "sheet_index").agg(F.sort_array(F.collect_list(F.struct("row", line.alias("line")))).alias("_lines"))
    sheets = rows.groupBy("path", "sheet_index").agg(F.first("sheet").alias("sheet")).join(heads, ["path", "sheet_index"], "left").join(lines, ["path", "sheet_index"], "left")
    body = F.concat(F.array_join(F.col("_lines.line"), ""), F.when(width > 0, "\n").otherwise(""))
    text = F.when(F.col("_head").isNull(), "*Empty sheet*\n").otherwise(F.coalesce(body, F.lit("")))
    return sheets.select("path", F.col("sheet_index").alias("page_index"), F.concat(F.lit("# "), "sheet", F.lit("\n\n"), text).alias("text"))


_STREAM = re.compile(rb"<<(?P<dict>.*?)>>\s*stream\r?\n(?P<data>.*?)\r?\nendstream", re.S)
_TEXT = re.compile(rb"\((?P<s>(?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[(?P<a>(?:\\.|[^\]])*)\]\s*TJ|(?P<nl>T\*|ET|\bT[dD]\b)", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3})")
_CODES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_texts(content: bytes) -> list[str]:
    """Text of each content stream, empty if it has no text, of PDFs with simple fonts and Flate or plain streams.

    Streams of images, fonts, objects and metadata are no pages; one stream is taken for a page, in file order.
    """
    plain = lambda raw: _ESCAPE.sub(lambda m: _CODES.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), raw).decode("latin-1")
    pages = []
    for m in _STREAM.finditer(content):
        data = m["data"]
        if b"FlateDecode" in m["dict"]:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        if re.search(rb"/(Subtype|Type|Length1|FunctionType)\b", m["dict"]):
            continue
        out: list[str] = []
        for x in _TEXT.finditer(data):
            if x["s"] is not None:
                out.append(plain(x["s"]))
            elif x["a"] is not None:
                out += [plain(s) for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)", x["a"])]
            elif out and not out[-1].endswith("\n"):
                out.append("\n")
        pages.append("".join(out).strip())
    return pages


#: Fixed value: what stands for a page whose reading took too long.
TIMED_OUT = "*OCR timed out for this page (see logs).*"
Ocr = Callable[[bytes, int, int], tuple[str, float]]


def first_engine(*makers: Callable[[], Ocr]) -> Ocr | None:
    """The first engine that can be made: makers raise ``ImportError`` where their library is not installed."""
    for make in makers:
        try:
            return make()
        except ImportError:
            continue
    return None


def mean_confidence(lines: list[float]) -> float:
    return sum(lines) / max(len(lines), 1)


def read_page(ocr: Ocr, content: bytes, page: int, dpi: int = 150, most: int = 300, low: float = 0.7, seconds: float = 0) -> tuple[str, float]:
    """One page at ``dpi``, and again at ``most`` if the confidence is below ``low``: the second answer always stands.

    A reading that takes more than ``seconds`` (0: no limit) is given up; its thread runs on by itself.
    """

    def ask(at: int) -> tuple[str, float]:
        if seconds <= 0:
            return ocr(content, page, at)
        answer: list = []
        thread = threading.Thread(target=lambda: answer.append(ocr(content, page, at)), daemon=True)
        thread.start()
        thread.join(seconds)
        return answer[0] if answer else (TIMED_OUT, 0.0)

    text, sure = ask(dpi)
    return ask(most) if sure < low and dpi < most else (text, sure)


def pdf_pages(given: DataFrame, ocr: Ocr | None = None, **settings: float) -> DataFrame:
    """``(path, page_index, text, confidence)`` of ``given(path, content)``.

    ``ocr(content, page, dpi)`` reads the pages of files that have no text at all; ``settings`` go to :func:`read_page`.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                texts = [(t, 1.0) for t in pdf_texts(data)]
                if ocr is not None and not any(t for t, _ in texts):
                    texts = [read_page(ocr, data, page, **settings) for page in range(max(1, len(texts)))]
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([t for t, _ in texts], pa.string()), pa.array([c for _, c in texts], pa.float64())], ["path", "page_index", "text", "confidence"])

    pages = given.select("path", "content").mapInArrow(read, "path string, page_index int, text string, confidence double")
    return pages.withColumn("text", page_header(F.col("page_index"), F.coalesce(F.nullif("text", F.lit("")), F.lit("*OCR unavailable or empty page*"))))


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page_index, text)`` of ``page_N.md`` or ``sheet_N.md`` files, in numeric order."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return texts.select(F.regexp_extract("file", r"(?:page|sheet)_([0-9]+)\.md$", 1).try_cast("int").alias("page_index"), "text").where("page_index IS NOT NULL").orderBy("page_index")
