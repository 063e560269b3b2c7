"""Business documents as text: routed by format, read from binary files, rendered as prose, errors kept per file."""

from __future__ import annotations

import csv
import io
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as text_functions
from . import pdf, xls
from .scratch import fresh

FORMATS = ("pdf", "docx", "doc", "xlsx", "xls", "csv")
SAMPLE_ROWS = 5
#: The media type of each format.
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "csv": "text/csv",
}


def table_prose(rows: list[list[str]], opening: str) -> str:
    """A header row and its data as sentences: at most SAMPLE_ROWS rows are told, the rest counted."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    head, data = rows[0], rows[1:]
    if not data:
        return "Contains: " + ", ".join(c for c in head if c.strip())
    said = [opening.format(n=len(data), m=len(head)) + ", ".join(head)]
    for i, r in enumerate(data[:SAMPLE_ROWS], 1):
        said.append(f"Row {i}: " + ", ".join(f"{h}: {c}" for h, c in zip(head, r) if c.strip()))
    if len(data) > SAMPLE_ROWS:
        said.append(f"... and {len(data) - SAMPLE_ROWS} more rows")
    return "\n".join(said)


def csv_text(content: bytes) -> str:
    for encoding in ("utf-8-sig", "utf-8", "latin1", "cp1252"):
        try:
            text = content.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    rows = [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    return table_prose(rows, "CSV file contains {n} rows and {m} columns: ").replace("\n", "\n\n") if len(rows) > 1 else "[CSV file contains no data]"


def _parts(xml: bytes, tag: str) -> Iterator[ElementTree.Element]:
    return (e for e in ElementTree.fromstring(xml).iter() if e.tag.rpartition("}")[2] == tag)


def _text(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if x.tag.rpartition("}")[2] == "t")


def docx_text(content: bytes) -> str:
    """Paragraphs that aren't blank, then each table's rows with cells joined by " | "."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml")
    root = ElementTree.fromstring(xml)
    name = lambda e: e.tag.rpartition("}")[2]
    tables = [e for e in root.iter() if name(e) == "tbl"]
    inside = {id(p) for t in tables for p in t.iter()}
    out = [_text(p) for p in root.iter() if name(p) == "p" and id(p) not in inside and _text(p).strip()]
    for i, t in enumerate(tables, 1):
        out.append(f"--- Table {i} ---")
        for row in (r for r in t.iter() if name(r) == "tr"):
            cells = [_text(c).strip() for c in row.iter() if name(c) == "tc"]
            if any(cells):
                out.append(" | ".join(cells))
    return "\n\n".join(out) or "[DOCX file contains no extractable text]"


def xlsx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [_text(s) for s in _parts(z.read("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name", "") for s in _parts(z.read("xl/workbook.xml"), "sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        said = []
        for title, sheet in zip(titles, sheets):
            rows = []
            for row in _parts(z.read(sheet), "row"):
                cells: dict[int, str] = {}
                for c in row:
                    column = 0
                    for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        column = column * 26 + ord(letter) - 64
                    value = next((v.text or "" for v in c if v.tag.rpartition("}")[2] == "v"), "")
                    cells[(column or len(cells) + 1) - 1] = shared[int(value)] if c.get("t") == "s" else _text(c) if c.get("t") == "inlineStr" else value
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            prose = table_prose(rows, "This sheet contains {n} rows of data with columns: ")
            if prose:
                said.append(f"--- Sheet: {title} ---\n{prose}")
    return "\n\n".join(said) or "[Excel file contains no data]"


def xls_text(content: bytes) -> str:
    said = []
    for title, rows in xls.sheets(content):
        prose = table_prose(rows, "This sheet contains {n} rows and {m} columns: ") if len(rows) > 1 else ""
        if prose:
            said.append(f"--- Sheet: {title} ---\n\n" + prose.replace("\n", "\n\n"))
    return "\n\n".join(said) or "[Excel file contains no extractable data]"


def pdf_text(content: bytes) -> str:
    """The text that stands in a PDF as text; scanned pages need a reader with OCR."""
    own = pdf.pages(content)
    said = []
    for i, (words, images) in enumerate(own, 1):
        if words.strip() or images:
            said.append(f"--- Page {i} ---\n" + (words if words.strip() else f"[Page {i}: Contains images but no extractable text - OCR required]"))
    return "\n\n".join(said) or ("[PDF contains only images - OCR processing required]" if any(n for _, n in own) else "[PDF contains no extractable text]")


#: Readers by format. OCR needs a package of the caller's choice: put a reader of your own under "pdf".
READERS: dict[str, Callable[[bytes], str]] = {"csv": csv_text, "docx": docx_text, "xlsx": xlsx_text, "xls": xls_text, "pdf": pdf_text}


def detected(files: DataFrame) -> DataFrame:
    """files(path, ...) with format and error, by extension."""
    name = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return files.withColumn("format", F.when(name.isin(*FORMATS), name)).withColumn("error", F.when(name == "", "no file extension").when(~name.isin(*FORMATS), F.concat(F.lit("unsupported format: "), name)))


#: What a window and a file list accept, and the categories that extensions belong to.
FILTERS = {"window": ("pdf", "docx", "xlsx", "xls"), "list": ("pdf", "docx", "doc")}
CATEGORIES = {"pdf": ("pdf",), "docx": ("docx", "doc"), "excel": ("xlsx", "xls"), "csv": ("csv",), "text": ("txt",)}


def extension(path: Column) -> Column:
    """In lower case, without the dot; empty if the name has none."""
    return F.lower(F.regexp_extract(path, r"[^./\\]\.([^./\\]+)$", 1))


def category(path: Column) -> Column:
    """What kind of document the extension stands for, null for none; wider than what can be read."""
    out = F.lit(None).cast("string")
    for name, extensions in CATEGORIES.items():
        out = F.when(extension(path).isin(*extensions), name).otherwise(out)
    return out


def accepted(files: DataFrame, where: str) -> DataFrame:
    """Files that the window or the list accepts."""
    return files.where(extension(F.col("path")).isin(*FILTERS[where]))


def existing(dropped: DataFrame, files: DataFrame) -> DataFrame:
    """Dropped paths that are files of an accepted format."""
    return accepted(dropped, "window").join(files.select("path").distinct(), "path", "left_semi")


def format_or_error(paths: DataFrame, files: DataFrame) -> DataFrame:
    """paths(path) with format and error: the file must exist, have an extension, and that one must be supported; and with warning, where the
    files' own media type (column `mime`, if `files` has one; null says nothing) is not the one of its extension."""
    told = "mime" in files.columns
    (p, m) = fresh([*paths.columns, "error", "format", "warning"], "p", "m")
    own = files.groupBy(F.col("path").alias(p)).agg((F.max("mime") if told else F.lit(None).cast("string")).alias(m))
    found = paths.join(own, F.col("path") == F.col(p), "left")
    e = extension(F.col("path"))
    expected = F.try_element_at(F.create_map(*(x for kind, mime in MIME_TYPES.items() for x in (F.lit(kind), F.lit(mime)))), e)
    warning = F.when(F.col(m) != expected, F.concat(F.lit("MIME type mismatch for "), "path", F.lit(": expected "), expected, F.lit(", got "), F.col(m)))
    error = F.when(F.col(p).isNull(), F.concat(F.lit("File not found: "), "path")).when(e == "", F.concat(F.lit("File has no extension: "), "path")).when(~e.isin(*FORMATS), F.concat(F.lit("Unsupported file format: ."), e, F.lit(". Supported formats: " + ", ".join("." + f for f in FORMATS))))
    found = found.withColumn("error", error).withColumn("format", F.when(F.col("error").isNull(), e)).withColumn("warning", F.when(F.col("error").isNull(), warning))
    return found.drop(p, m)


def page_route(chars: Column, images: Column) -> Column:
    """What a page of a PDF needs: its text if it has over ten characters, or any and no image; OCR if there is an image; else it is empty."""
    return F.when(chars > 10, "text").when((chars > 0) & (images == 0), "text").when(images == 0, "empty").otherwise("ocr")


def direct_pages(pages: DataFrame) -> DataFrame:
    """pages(path, page from 1, text, images): (path, text) without OCR. Pages under their headings, one that has only images with a
    note, blank ones left out; a file without any page text says why."""
    blank = F.regexp_replace("text", r"(?U)\s+", "") == ""
    body = F.when(blank & (F.col("images") > 0), F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit(": Contains images but no extractable text - OCR required]"))).when(~blank, F.col("text"))
    said = F.when(body.isNotNull(), F.struct("page", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), body).alias("said")))
    got = pages.groupBy("path").agg(F.array_sort(F.collect_list(said)).alias("p"), F.max("images").alias("images"))
    none = F.when(F.col("images") > 0, "[PDF contains only images - OCR processing required]").otherwise("[PDF contains no extractable text]")
    return got.select("path", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x["said"]), "\n\n")).otherwise(none).alias("text"))


def frame_prose(rows: DataFrame, columns: list[str], by: str, opening: str = "CSV file contains {n} rows and {m} columns: ") -> DataFrame:
    """(line, text) of a table as prose: what it holds, its first SAMPLE_ROWS rows by `by`, how many more there are."""
    first = rows.orderBy(by).limit(SAMPLE_ROWS).withColumn("_i", F.row_number().over(Window.orderBy(by)))  # a handful of rows
    said = first.select(F.col("_i").alias("line"), text_functions.row_prose(F.col("_i"), {c: F.col(c) for c in columns}).alias("text"))
    start, end = opening.split("{n}")
    total = rows.agg(F.count("*").alias("n"))
    head = total.select(F.lit(0).alias("line"), F.when(F.col("n") == 0, "[CSV file contains no data]").otherwise(F.concat(F.lit(start), F.col("n").cast("string"), F.lit(end.format(m=len(columns)) + ", ".join(columns)))).alias("text"))
    rest = total.where(f"n > {SAMPLE_ROWS}").select(F.lit(SAMPLE_ROWS + 1).alias("line"), F.concat(F.lit("... and "), (F.col("n") - SAMPLE_ROWS).cast("string"), F.lit(" more rows")).alias("text"))
    return head.unionByName(said).unionByName(rest)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format, pages, has_images) of all files below path: pages of a PDF or sheets of a workbook, images in a PDF; null
    where the format has none or the file cannot be read."""
    files = detected(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, images = [], []
            for kind, content in zip(batch.column("format").to_pylist(), batch.column("content").to_pylist()):
                try:
                    own = pdf.pages(content) if kind == "pdf" else None
                    pages.append(len(own) if own is not None else len(list(_parts(zipfile.ZipFile(io.BytesIO(content)).read("xl/workbook.xml"), "sheet"))) if kind == "xlsx" else len(xls.sheets(content)) if kind == "xls" else None)
                    images.append(any(n for _, n in own[:3]) if own is not None else None)
                except Exception:  # a broken file has no metadata; reading it gives the error
                    pages.append(None)
                    images.append(None)
            yield pa.record_batch([batch.column("path"), batch.column("length"), batch.column("format"), pa.array(pages, pa.int64()), pa.array(images, pa.bool_())], names=["path", "length", "format", "pages", "has_images"])

    return files.select("path", "length", "format", "content").mapInArrow(run, "path string, length long, format string, pages long, has_images boolean")


def proofread(docs: DataFrame, model: Callable[[list[str], list[str]], list[str]] | None, prompts: dict[str, str], mode: str | None = None) -> DataFrame:
    """docs(text, ...) with `proofread`: the model's text for the masked text and the prompt of its mode (found by its words, or fixed).
    Without a model, and where the model fails or answers with nothing, the text stays."""
    if model is None:
        return docs.withColumn("proofread", F.col("text"))
    chosen = F.lit(mode) if mode else text_functions.proofread_mode(F.col("text"))

    @F.pandas_udf("string")
    def ask(texts: pd.Series, said: pd.Series) -> pd.Series:
        try:
            got = model(texts.fillna("").tolist(), said.tolist())
            return pd.Series([g if g else None for g in got])
        except Exception:  # whatever the model raises, the text stays
            return pd.Series([None] * len(texts))

    return docs.withColumn("proofread", F.coalesce(F.when(F.length("text") > 0, ask(text_functions.mask_all(F.col("text")), text_functions.prompt(chosen, prompts))), F.col("text")))


def read_documents(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, length, format, text, error) of all files below path; a file that can't be read has an error and no text.

    Files go through Python one by one; those without a reader never leave the JVM."""
    held = dict(READERS if readers is None else readers)
    files = detected(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for kind, content in zip(batch.column("format").to_pylist(), batch.column("content").to_pylist()):
                try:
                    texts.append(unicodedata.normalize("NFC", held[kind](content)))
                    errors.append(None)
                except Exception as e:  # any broken file: the error is data
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.record_batch([batch.column("path"), batch.column("length"), batch.column("format"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "length", "format", "text", "error"])

    known = F.col("format").isin(*held)
    done = files.where(known).select("path", "length", "format", "content").mapInArrow(run, "path string, length long, format string, text string, error string")
    rest = files.where(F.coalesce(~known, F.lit(True))).select("path", "length", "format", F.lit(None).cast("string").alias("text"), F.coalesce("error", F.concat(F.lit("no reader for "), "format")).alias("error"))
    return done.unionByName(rest)
