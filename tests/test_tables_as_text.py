"""CSV files by encoding, header and rows, pages as text, grids of found fields, and types of values."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import classify
from quillon.operators import monitoring, records
from quillon.operators.templates import Field, template_files
from quillon.sources import documents, tables_as_text


def prose(spark, folder):
    return {r.path.rsplit("/", 1)[1]: r.text for r in tables_as_text.csv_prose(spark, str(folder)).collect()}


def test_csv_files_of_every_kind(spark, tmp_path):
    files = {
        "plain.csv": "a,b\n1,x\n2,\n".encode(), "marked.CSV": "﻿a,b\n1,é\n".encode(), "latin.csv": "a,b\n1,caf\xe9\n".encode("latin1"), "other.csv": "n;m,k\n1.50,2024-01-02\n".encode(),
        "long.csv": ("a,b\n" + "".join(f"{i},v{i}\n" for i in range(9))).encode(), "quoted.csv": b'a,b\n1,"x, y"\n\n  ,  \n2,"q ""z""\nsecond line"\n', "empty.csv": b"", "blank.csv": b"\n \n", "head.csv": b"a,b\n", "note.txt": b"a,b\n1,2\n",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = prose(spark, tmp_path)
    head = "CSV file contains {} rows and 2 columns: a, b\n\n"
    assert got == {
        "plain.csv": head.format(2) + "Row 1: a: 1, b: x\n\nRow 2: a: 2", "marked.CSV": head.format(1) + "Row 1: a: 1, b: é", "latin.csv": head.format(1) + "Row 1: a: 1, b: café", "other.csv": "CSV file contains 1 rows and 2 columns: n;m, k\n\nRow 1: n;m: 1.5, k: 2024-01-02",
        "long.csv": head.format(9) + "\n\n".join(f"Row {i + 1}: a: {i}, b: v{i}" for i in range(5)) + "\n\n... and 4 more rows", "quoted.csv": got["quoted.csv"], "empty.csv": tables_as_text.EMPTY, "blank.csv": tables_as_text.EMPTY, "head.csv": tables_as_text.EMPTY,
    }
    assert got["quoted.csv"].startswith(head.format(2) + "Row 1: a: 1, b: x, y\n\nRow 2: a: 2, b: q \"z\"\nsecond line")


def test_header_and_row(spark):
    rows = spark.createDataFrame([(["a", "b"], ["1", "2"]), (["a", "b", "c"], ["1"]), (["a"], ["1", "2"]), (["a", "b", "a"], ["1", "2", "3"]), ([], ["1"]), (["a"], [None])], "n array<string>, v array<string>")
    got = [r.m for r in rows.select(tables_as_text.zipped(F.col("n"), F.col("v")).alias("m")).collect()]
    assert got == [dict(zip(n, v)) for n, v in rows.collect()]


def test_pages(spark):
    pages = spark.createDataFrame([("p", 2, "short", 0), ("p", 1, "a long enough text", 3), ("p", 3, " \n", 0), ("p", 4, "tiny", 2), ("p", 10, None, 1), ("q", 1, None, 0)], "path string, page int, text string, images int")
    got = {r.path: r.text for r in tables_as_text.pages_as_text(pages, ocr=False).collect()}
    off = "[Page contains {} images but OCR is disabled]"
    assert got["p"] == "\n\n".join(f"--- Page {n} ---\n{t}" for n, t in ((1, "a long enough text"), (2, "short"), (3, "[Empty page]"), (4, off.format(2)), (10, off.format(1))))
    assert got["q"] == "--- Page 1 ---\n[Empty page]"
    seen = tables_as_text.pages_as_text(pages, ocr=True, read_image=lambda df: F.concat(F.lit("read "), F.col("page").cast("string")))
    assert "--- Page 4 ---\nread 4" in {r.path: r.text for r in seen.collect()}["p"]


def test_grid_of_found_fields(spark):
    rows = spark.createDataFrame([("x/a.pdf", {"n": "1", "only here": "z"}), ("b.pdf", {"n": None, "source_file": "own"}), ("c.pdf", None)], "source_file string, data map<string,string>")
    out = records.grid(rows, template=(Field("wanted"),))
    assert out.columns == ["source_file", "n", "only here", "wanted"]
    assert sorted(map(tuple, out.collect())) == [("a.pdf", "1", "z", "—"), ("b.pdf", "—", "—", "—"), ("c.pdf", "—", "—", "—")]
    with pytest.raises(ValueError):
        records.found_fields(rows, most=2)


def test_types_of_values(spark):
    values = {"1": "int", "-12": "int", "9" * 30: "int", "1.5": "float", "1e3": "float", "true": "bool", '"a"': "str", "text": "str", "[1]": "list", '{"a": 1}': "dict", "null": "NoneType", "1.234,50 ₫": "str", "01/02/2024": "str", "": "str"}
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    assert {r.v: r.t for r in rows.select("v", classify.value_type(F.col("v")).alias("t")).collect()} == {**values, None: None}


def test_media_types(spark):
    paths = spark.createDataFrame([("a.pdf",), ("b.csv",), ("c.doc",), ("d.xyz",)], "path string")
    files = spark.createDataFrame([("a.pdf", "text/csv"), ("b.csv", "text/csv"), ("c.doc", None), ("d.xyz", "text/csv")], "path string, mime string")
    got = {r.path: (r.format, r.warning) for r in documents.format_or_error(paths, files).collect()}
    assert got == {"a.pdf": ("pdf", "MIME type mismatch for a.pdf: expected application/pdf, got text/csv"), "b.csv": ("csv", None), "c.doc": ("doc", None), "d.xyz": (None, None)}
    assert {r.warning for r in documents.format_or_error(paths, files.drop("mime")).collect()} == {None}


def test_ranks_of_jobs(spark):
    jobs = [(i, (i * 7) % 4 if i % 9 else None, (i * 5) % 6) for i in range(60)]
    got = monitoring.priority_order(spark.createDataFrame(jobs, "job_id int, p int, c int").repartition(4), priority="p", created="c", key="job_id").collect()
    want = sorted(jobs, key=lambda j: (j[1] is None, -(j[1] or 0), j[2], j[0]))
    assert [(r.job_id, r["rank"]) for r in got] == [(j[0], n) for n, j in enumerate(want, 1)]


def test_template_files(spark, tmp_path):
    good = '{"name": "T", "prompt_description": "p", "fields": [{"name": "a"}, {"name": "n", "type": "number", "number_locale": "en-US", "optional": true}]}'
    files = {"good": good, "broken": "{", "nameless": '{"name": " ", "fields": [{"name": "a"}]}', "none": '{"name": "x", "fields": []}', "twice": '{"name": "x", "fields": [{"name": "a"}, {"name": "a"}]}', "kind": '{"name": "x", "fields": [{"name": "a", "type": "blob"}]}', "second": '{"name": "x", "fields": [{"name": "a"}, {"type": "text"}]}'}
    for stem, text in files.items():
        (tmp_path / f"{stem}.json").write_text(text)
    got = {r.stem: r for r in template_files(spark, str(tmp_path)).collect()}
    assert {k: r.problem for k, r in got.items()} == {"good": None, "broken": "The file is no template", "nameless": "Template name must be a non-empty string", "none": "Template must have at least one field", "twice": "Template field names must be unique", "kind": "unknown type blob", "second": "Field 2 name must be a non-empty string"}
    assert [tuple(f) for f in got["good"].fields] == [("a", "text", "", False, "vi-VN"), ("n", "number", "", True, "en-US")]
