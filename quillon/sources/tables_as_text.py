"""CSV files and header-and-rows tables as frames: Spark's reader for each encoding and header, no file through one task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert
from ..operators import order
from .scratch import file_system, fresh

#: Different headers of one folder: more than these are an error, since each needs a reader of its own.
HEADERS = 200
SAMPLE_ROWS = 5
EMPTY = "[CSV file contains no data]"


def zipped(names: Column, values: Column) -> Column:
    """map<name, value> of a header and a row: as long as the shorter one; of equal names the last counts."""
    n = F.least(F.size(names), F.size(values))
    head = F.slice(names, 1, n)
    last = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.array_contains(F.slice(head, i + 1, F.greatest(n - i, F.lit(0))), F.get(head, i - 1)))
    pick = lambda c: F.transform(last, lambda i: F.get(c, i - 1))
    return F.when(n > 0, F.map_from_arrays(pick(head), pick(values))).otherwise(F.create_map().cast("map<string,string>"))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, path)
    out, files = [], fs.listFiles(at, True)
    while files.hasNext():
        file = files.next()
        if file.getLen() == 0 and file.getPath().getName().lower().endswith(".csv"):
            out.append(re.sub("^file:/(?!/)", "file:///", file.getPath().toUri().toString()))
    return out


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, header) of the CSV files under `path`: UTF-8 if every line of a file is, else ISO 8859-1, which reads any byte;
    header is the first line, null for a file without one that is not blank."""
    lines = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", "true").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i")).alias("place"), "value")
    # names take their meaning from whichever encoding a file has: both readings of the first line are kept
    first = F.min_by(F.col("value").cast("binary"), F.when(F.trim("value") != "", F.col("place")))
    found = rows.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), first.alias("first"))
    # files without a byte are in the listing alone
    empty = spark.createDataFrame([(p, True, None) for p in _empty_files(spark, path)], "path string, utf8 boolean, first binary")
    found = found.unionByName(empty)
    encoding = F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1")
    return found.select("path", encoding.alias("encoding"), F.when(F.col("utf8"), F.decode("first", "UTF-8")).otherwise(F.decode("first", "ISO-8859-1")).alias("header"))


def csv_rows(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """(path, place, names, row map<string,string>) of all rows of the CSV files under `path`: values are what Spark's reader makes of a column
    of that file's kind (numbers, dates), as text; place orders a file's rows. Files with one header and encoding are read by one reader.
    Blank rows are left out; a file without rows has none. A quoted value may hold line breaks: a file is then read as one stream. Without
    `line_breaks` a large file is split."""
    groups = csv_files(spark, path).where("header is not null").groupBy("encoding", "header").agg(F.collect_list("path").alias("paths")).limit(HEADERS + 1).collect()
    if len(groups) > HEADERS:
        raise ValueError(f"more than {HEADERS} different CSV headers under {path}")
    out = spark.createDataFrame([], "path string, place struct<at: long, i: long>, names array<string>, row map<string,string>")
    for g in groups:
        read = spark.read.option("header", "true").option("inferSchema", "true").option("encoding", g.encoding).option("escape", '"').option("multiLine", str(line_breaks).lower()).option("enforceSchema", "false").csv(g.paths)
        names = read.columns
        shown = [name.removeprefix("﻿") for name in names]
        (value, place, where) = fresh(names, "value", "place", "path")
        own = read.select("*", F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i")).alias(place), F.col("_metadata.file_path").alias(where))
        values = F.array(*(F.col(f"`{c}`").cast("string") for c in names))
        rows = own.select(F.col(where).alias("path"), F.col(place).alias("place"), F.array(*map(F.lit, shown)).alias("names"), zipped(F.array(*map(F.lit, shown)), values).alias("row"))
        out = out.unionByName(rows.where(F.exists(F.map_values("row"), lambda v: F.trim(v) != "")))
    return out


def csv_prose(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every CSV file under `path`: its rows and columns counted, the first rows told, the rest counted."""
    rows = csv_rows(spark, path)
    counts = rows.groupBy("path").agg(F.count("*").alias("n"), F.any_value("names").alias("names"))
    told = F.array_join(F.filter(F.transform("names", lambda c: F.when(F.trim(F.try_element_at("row", c)) != "", F.concat(c, F.lit(": "), F.try_element_at("row", c)))), lambda x: x.isNotNull()), ", ")
    first = order.first(rows, SAMPLE_ROWS, ["place"], "path").select("path", "place", told.alias("told")).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "told"))), lambda x, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), x["told"])).alias("told"))
    opening = F.concat(F.lit("CSV file contains "), F.col("n").cast("string"), F.lit(" rows and "), F.size("names").cast("string"), F.lit(" columns: "), F.array_join("names", ", "))
    more = F.when(F.col("n") > SAMPLE_ROWS, F.concat(F.lit("... and "), (F.col("n") - SAMPLE_ROWS).cast("string"), F.lit(" more rows")))
    text = F.concat_ws("\n\n", opening, F.array_join("told", "\n\n"), more)
    return csv_files(spark, path).select("path").join(counts.join(first, "path").select("path", text.alias("text")), "path", "left").select("path", F.coalesce("text", F.lit(EMPTY)).alias("text"))


def pages_as_text(pages: DataFrame, ocr: bool, read_image=None) -> DataFrame:
    """(path, text) of pages(path, page, text, images): each page under its number, by its text, as empty, or by what OCR reads; where OCR is off a page
    of images says so. `read_image` makes a page's text a column, of the page's row. Pages are in order, parted by an empty line."""
    n = F.length(convert.stripped(F.coalesce("text", F.lit(""))))
    plain = (n > 10) | (n > 0) & (F.col("images") == 0)
    off = F.concat(F.lit("[Page contains "), F.col("images").cast("string"), F.lit(" images but OCR is disabled]"))
    seen = (read_image(pages) if read_image else F.lit("")) if ocr else off
    said = F.when(plain, F.col("text")).when(F.col("images") == 0, "[Empty page]").otherwise(seen)
    rows = pages.select("path", "page", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), said).alias("said"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "said"))), lambda x: x["said"]), "\n\n").alias("text"))
