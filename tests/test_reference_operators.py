"""Golden pairs of the conversion, masking and document rules (fixed values: they must be these), and the data frames of the reports."""

import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillon.functions import classify, convert, text
from quillon.operators import records
from quillon.plans.fixtures import TEMPLATE
from quillon.sources import documents, sinks
from quillon.streaming import runs


def one(spark, column, v):
    return spark.createDataFrame([(v,)], "v string").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("v,locale,x", [("1.000", "vi-VN", 1000), ("1.234.567,89", "vi-VN", 1234567.89), ("1,000", "en-US", 1000), ("1,234,567.89", "en-US", 1234567.89), ("1,5", "vi-VN", 15), ("75,3%", "vi-VN", 753), ("$1,234.56", "vi-VN", 1.23456), ("-1.500", "vi-VN", -1500), ("1.234.567,89", "en-US", None), ("-", "vi-VN", None), ("abc", "vi-VN", None), ("1-2", "en-US", None), (None, "vi-VN", None)])
def test_number(spark, v, locale, x):
    assert one(spark, lambda c: convert.number(c, locale), v) == x


@pytest.mark.parametrize("v,locale,x", [("1.000.000 ₫", "vi-VN", 1000000), ("1,000,000 USD", "en-US", 1000000), ("500.000 VND", "vi-VN", 500000)])
def test_currency(spark, v, locale, x):
    assert one(spark, lambda c: convert.currency(c, locale), v) == Decimal(x)


@pytest.mark.parametrize("v", ["15/03/2024", "15-03-2024", "2024-03-15", "15.03.2024", "15/03/24", "invalid-date", "31/02/2024"])
def test_date(spark, v):
    got = one(spark, convert.date, v)
    assert (str(got)[:10] if got else None) == (None if v in ("invalid-date", "31/02/2024") else "2024-03-15")


@pytest.mark.parametrize("f,v,x", [(text.mask_account, "Account: 12345678", "Account: 12****78"), (text.mask_account, "1234567 123456789012345678901", "1234567 123456789012345678901"), (text.mask_id, "CMND: 123456789", "CMND: 12*****89"), (text.mask_email, "user@subdomain.example.com", "us**@su*******.example.com"), (text.mask_email, "ab@test.com", "**@te**.com"), (text.mask_phone, "Phone: 84123456789", "Phone: 84*******89"), (text.mask_phone, "0123456789", "0*******89"), (text.mask_all, "0987654321", "09******21")])
def test_masks(spark, f, v, x):
    assert one(spark, f, v) == x


def test_chunks_keep_words_whole(spark):
    got = one(spark, lambda c: text.chunks(c, 100), "a " * 60 + "x" * 150 + " b")
    assert len(got) > 1 and "x" * 150 in got and max(len(p) for p in got if "x" not in p) <= 100
    assert one(spark, lambda c: text.chunks(c, 100), "short  text") == ["short  text"]


def test_grades(spark):
    rows = spark.createDataFrame([(95.0,), (85.0,), (75.0,), (65.0,), (55.0,)], "s double").select(classify.grade(F.col("s")).alias("g")).collect()
    assert [r.g for r in rows] == list("ABCDF")


def test_rows_with_errors(spark):
    rows = spark.createDataFrame([(1, "a.pdf", "completed", 1.0, 0.9, {"company_name": " X ", "revenue": "1.000 ₫", "order_date": "2024-01-02"}), (2, "b.pdf", "completed", 1.0, 0.9, {"company_name": "", "revenue": "abc", "order_date": "2024-01-02", "more": "1"})], "seq long, source_file string, status string, processing_time double, confidence double, data map<string,string>")
    checked = records.validated(rows, TEMPLATE)
    assert [r.errors for r in checked.orderBy("seq").collect()] == [[], ["Required field 'company_name' is missing or empty", "Field 'revenue' conversion failed", "Unexpected field 'more' not in template schema"]]
    assert [r.field_name for r in records.required_missing(rows, TEMPLATE).collect()] == ["company_name"]
    assert [(r.seq, r.field_name) for r in records.unexpected_fields(rows, TEMPLATE).collect()] == [(2, "more")]
    assert records.failed_rows(checked).first().validation_errors.startswith("Validation errors for b.pdf: Required field")
    assert records.validated(rows.withColumn("data", F.lit(None).cast("map<string,string>")), TEMPLATE).first().errors[2].startswith("Required field 'order_date'")
    s = records.processing_summary(checked).first()
    assert (s.total_files, s.successful_files, s.failed_files, s.success_rate) == (2, 1, 1, 50.0)
    assert records.processing_summary(checked.where("seq > 9")).first().success_rate == 0


def test_documents_and_workbook(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("Name,Age,Department\nA,1,x\nB,2,y\nC,3,z\n")
    people = spark.createDataFrame([("A", 1), ("B", 2)], "Name string, Age int")
    (tmp_path / "in/b.xlsx").write_bytes(sinks.workbook({"People": people}))
    (tmp_path / "in/c.docx").write_bytes(b"broken")
    (tmp_path / "in/d.png").write_bytes(b"x")
    z = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "in/e.docx").write_bytes(z.getvalue())
    got = {r.path[-6:]: r for r in documents.read_documents(spark, str(tmp_path / "in")).collect()}
    assert got["/a.csv"].text.startswith("CSV file contains 3 rows and 3 columns: Name, Age, Department\n\nRow 1: Name: A, Age: 1, Department: x")
    assert "2 rows of data with columns: Name, Age" in got["b.xlsx"].text
    assert got["c.docx"].text is None and got["c.docx"].error
    assert got["/d.png"].error == "unsupported format: png"
    assert got["e.docx"].text == "Hello\n\n--- Table 1 ---\n\na | b"


def test_stream_resumes(spark, tmp_path):
    schema = "seq long, source_file string, status string, processing_time double, confidence double, data map<string,string>"
    put = lambda i: spark.createDataFrame([(i, f"{i}.pdf", "completed", 1.0, 0.5, {"company_name": "X"})], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for i in (1, 2):
        put(i)
        runs.validate_stream(spark, str(tmp_path / "in"), schema, TEMPLATE, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.seq for r in rows) == [1, 2] and all(len(r.errors) == 2 for r in rows)
