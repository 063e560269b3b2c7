"""Templates, extraction, monitoring rules, documents and masks, against hand-made cases and brute force."""

import io
import json
import re
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import classify, convert, normal, text
from quillon.operators import confidence, extraction, monitoring, order, records, templates
from quillon.plans.catalogue import ORACLES, QUERIES
from quillon.plans.fixtures import TEMPLATE
from quillon.sources import documents, pdf, xls
from quillon.streaming import runs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["field_quality", "error_table", "data_sheet_wide", "chunk_text", "degradation", "milestones", "retry_stats", "summary_rows", "summary_fields", "file_confidence", "field_distribution", "editor_errors", "error_banner", "template_problems", "pdf_direct", "csv_prose", "resource_alerts", "queue_stats_last50"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in "customer supplier part orders lineitem events documents pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    tidy = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    rows = lambda xs: sorted((tuple(map(tidy, x)) for x in xs), key=repr)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns) and rows(got.select(*columns).collect()) == rows(want.fetchall())


def test_values_are_converted_once(spark):
    for name in ("field_quality", "error_table", "data_sheet_wide"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("company_name, CASE") + plan.count("map(company_name") <= 6 and plan.count("regexp_replace") <= 30, name


def test_currency_keeps_every_digit(spark):
    row = spark.createDataFrame([("123.456.789.012.345.678,12 ₫",)], "v string").select(convert.currency(F.col("v")).alias("x")).first()
    assert str(row.x) == "123456789012345678.120000"


def chunked(t, most):
    if len(t) <= most:
        return [t]
    out, now, n = [], [], 0
    for w in t.split():
        if n + len(w) + 1 > most and now:
            out.append(" ".join(now))
            now, n = [], 0
        now.append(w)
        n += len(w) + 1
    return out + ([" ".join(now)] if now else [])


def test_chunks_and_masks_on_all_documents(spark):
    """On whole texts, with every letter there is: Python's word boundaries know them, too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(10**6, "đ12345678 12345678é số 0987654321, a@b.vn; é.x@đomain.com +84123456789 (084912345678)"), (10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, "x" * 9000), (10**6 + 4, " \n" * 5000)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    ends = lambda m: m[:2] + "*" * (len(m) - 4) + m[-2:]
    part = lambda p: "*" * len(p) if len(p) <= 2 else p[:2] + "*" * (len(p) - 2)

    def mail(m):
        user, domain = m.split("@")
        label = domain.split(".")[0]
        return f"{part(user)}@{part(label)}{domain[len(label):]}"

    def phone(m):
        k = 3 if m.startswith("+84") else 2 if m.startswith("84") else 1
        return m[:k] + "*" * (len(m) - k - 2) + m[-2:]

    def masked(t):
        for pattern, f in ((r"\b\d{8,20}\b", ends), (r"\b(?:\d{9}|\d{12})\b", ends), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", mail), (r"\b(?:\+84|84|0)(?:[1-9]\d{8,9})\b", phone)):
            t = re.sub(pattern, lambda m: f(m[0]), t)
        return t

    rows = docs.select("doc_id", "text", text.mask_all(F.col("text")).alias("m"), text.chunks(F.col("text"), 200).alias("c")).collect()
    assert all(r.m == (None if r.text is None else masked(r.text)) for r in rows) and sum(r.m != r.text for r in rows) > 5
    assert all(r.c == (None if r.text is None else chunked(r.text, 200)) for r in rows)


def test_template_store(spark, tmp_path):
    store = templates.Store(str(tmp_path / "t"))
    t = templates.Template("Báo cáo: 1", "what to read", (templates.Field("a"), templates.Field("b", "currency", True, "en-US", "money")), {"a": "x"})
    path = store.save(t)
    assert path.name == "Báo cáo_ 1.json" and store.load("Báo cáo: 1") == t and store.exists(t.name) and store.load("none") is None and not store.exists("")
    store.duplicate(t.name, "copy")
    assert store.names() == ["Báo cáo_ 1", "copy"] and store.delete("copy") and not store.delete("copy")
    for wrong in (templates.Template(" ", fields=(templates.Field("a"),)), templates.Template("x"), templates.Template("x", fields=(templates.Field("a"), templates.Field("a"))), templates.Template("x", fields=(templates.Field(" "),))):
        with pytest.raises(ValueError):
            store.save(wrong)
    (tmp_path / "t/broken.json").write_text("{")
    with pytest.raises(ValueError):
        store.load("broken")
    got = templates.catalogue(spark, str(tmp_path / "t")).collect()
    assert [(r.name, r.description, r.field_count) for r in got] == [(t.name, "what to read", 2)] and got[0].file_size == path.stat().st_size


def test_saved_states(spark, tmp_path):
    for i, at in enumerate((5.0, 9.0, 7.0)):
        (tmp_path / f"processing_state_{i}.json").write_text(json.dumps({"saved_at": at, "metadata": {"session_id": f"s{i}", "progress": 0.5}}))
    (tmp_path / "processing_state_x.json").write_text("{broken")
    assert [(r.session_id, r.saved_at) for r in templates.saved_states(spark, str(tmp_path)).collect()] == [("s1", 9.0), ("s2", 7.0), ("s0", 5.0)]


def test_extraction(spark):
    docs = spark.createDataFrame([("a", "company_name: X\ncompany_name: Y\nrevenue: 1,234.50 USD"), ("b", None), ("c", " "), ("d", "word " * 30 + "\nrevenue: 5\n" + "more " * 30 + "\nrevenue: 7"), ("e", "boom")], "source_file string, text string")

    def provider(parts):
        if any("boom" in p for p in parts):
            raise RuntimeError("no answer")
        return extraction.rule_provider(TEMPLATE)(parts)

    got = {r.source_file: r for r in extraction.extract(docs.repartition(5), TEMPLATE, provider, most=150, mask=False).collect()}
    assert got["a"].data == {"company_name": "Y", "revenue": "1234.5"} and got["a"].missing_fields == ["order_date"] and got["a"].status == "completed"
    assert got["b"].status == got["c"].status == "failed" and got["c"].errors == ["Text is empty"] and got["e"].errors == ["RuntimeError: no answer"] and got["e"].data == {}
    answers = spark.createDataFrame([("a", 0, [("f", "low", 0.6), ("f", "high", 0.9)]), ("a", 1, [("f", "again", 0.9), ("g", "one", None)])], "source_file string, chunk int, extractions array<struct<field:string,text:string,confidence:double>>")
    assert {(r.field_name, r.value, r.confidence) for r in extraction.merged(answers).collect()} == {("f", "high", 0.9), ("g", "one", 0.8)}
    assert {(r.field_name, r.value) for r in extraction.last_wins(answers).collect()} == {("f", "again"), ("g", "one")}
    again = [r.data for r in extraction.simulated(docs, TEMPLATE).orderBy("source_file").collect()]
    assert again == [r.data for r in extraction.simulated(docs.repartition(3), TEMPLATE).orderBy("source_file").collect()]


def test_confidence_of_no_rows(spark):
    none = spark.createDataFrame([], "seq long, source_file string, status string, processing_time double, data map<string,string>, confidence_scores map<string,double>")
    assert confidence.simple_summary(none).first().confidence == 0 and confidence.processing_metrics(none).first().success_rate == 0
    assert confidence.time_histogram(none).count() == confidence.file_means(none).count() == confidence.quality_by_field(none, TEMPLATE).count() == 0
    one = spark.createDataFrame([(1, "a", "completed", 2.0, {"x": "y"}, {})] * 3, none.schema)
    assert [(r.bin, r.n) for r in confidence.time_histogram(one).collect()] == [(1, 3)]


def test_numbered(spark):
    rows = spark.range(0, 30000, 3).withColumnRenamed("id", "seq")
    assert [r.i for r in order.numbered(rows, "seq").orderBy("seq").collect()] == list(range(10000))


def test_retry_and_degradation_rules(spark):
    attempts = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "b", 1), (5, "c", 4), (6, "c", 1)], "seq long, operation_name string, attempt_number int")
    s = monitoring.retry_stats(attempts).first()
    assert (s.operations, s.attempts, s.failed, round(s.success_rate, 4), s.average_attempts) == (3, 6, 1, 0.6667, 2.0)
    log = [(1, i, f"f{i}", "OCR", float(60 * i), float(60 * i + 30), 30.0, i < 6, 1, []) for i in range(1, 20)]
    schema = "batch_id long, seq long, file_path string, phase string, start_time double, end_time double, processing_time double, success boolean, field_count int, confidence_scores array<double>"
    out = monitoring.degradation(spark.createDataFrame(log, schema)).orderBy("seq").collect()
    base = 5 / 4.5
    assert [r.seq for r in out] == list(range(6, 20)) and all(abs(r.baseline - base) < 1e-9 for r in out)
    assert [r.alert for r in out] == [5 / (r.seq - 0.5) < base / 2 for r in out] and out[0].alert is False and out[-1].alert


def test_error_rules(spark):
    rows = [("ConnectionResetError", None), ("TimeoutError", None), ("FileNotFoundError", None), ("MemoryError", None), ("HTTPError", 503), ("HTTPError", 404), ("OSError", None), ("KeyError", None)]
    out = spark.createDataFrame(rows, "name string, status int").select(classify.error_class(F.col("name"), F.col("status")).alias("c"), classify.should_retry(F.col("name"), F.col("status"), F.lit(1)).alias("r"), classify.should_retry(F.col("name"), F.col("status"), F.lit(3)).alias("late")).collect()
    assert [r.c for r in out] == ["temporary", "temporary", "permanent", "critical", "temporary", "permanent", "temporary", "temporary"]
    assert [r.r for r in out] == [True, True, False, False, False, False, True, False] and not any(r.late for r in out)


@pytest.mark.parametrize("kind,v,x", [("currency", 1234567.89, "$1,234,567.89"), ("number", 1234.0, "1,234"), ("number", 1234.56, "1,234.6"), ("number", None, "N/A")])
def test_shown_values(spark, kind, v, x):
    assert spark.createDataFrame([(v,)], "v double").select(text.value_shown(F.col("v"), kind).alias("x")).first().x == x


def test_texts_of_progress(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.status_line(F.lit(2), F.lit(9), F.lit(65.9), F.lit(130.0))) == "Processing 2/9 files | Elapsed: 1:05 | Est. remaining: 2 min"
    assert one(text.eta_shown(F.lit(0.0))) == "Calculating..." and one(text.eta_shown(F.lit(75.5))) == "1m 15s" and one(text.eta_shown(F.lit(9.0))) == "9s"
    assert one(text.error_text(F.lit("bad"), F.array(F.lit("a"), F.lit("b")))) == "bad\n\nSuggestions:\n• a\n• b" and one(text.error_text(F.lit("bad"), F.array().cast("array<string>"))) == "bad"
    assert one(normal.nfc(F.lit("é"))) == "é"


def made_pdf(pages, pack):
    stream = lambda s: b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(s), b" /Filter /FlateDecode" if pack else b"", s)
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    out = [b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [" + kids + b"] /Count 1 >> endobj", b"3 0 obj << /Type /Font /Subtype /Type1 >> endobj", b"4 0 obj << /Subtype /Image /Width 1 >> endobj"]
    for i, (content, image) in enumerate(pages):
        x = b" /XObject << /Im 4 0 R >>" if image else b""
        out += [b"%d 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >>%s >> /Contents %d 0 R >> endobj" % (10 + 2 * i, x, 11 + 2 * i), b"%d 0 obj " % (11 + 2 * i) + stream(zlib.compress(content) if pack else content) + b" endobj"]
    return b"\n".join(out)


@pytest.mark.parametrize("pack", [False, True])
def test_pdf(pack):
    said = made_pdf([(rb"BT /F1 12 Tf (Hello \(big\) ) Tj (world) Tj 0 -14 Td [(sec) 20 (ond) -300 (line)] TJ ET", False), (b"", True), (b" ", False)], pack)
    assert pdf.pages(said) == [("Hello (big) world\nsecond line", 0), ("", 1), ("", 0)]
    assert documents.pdf_text(said) == "--- Page 1 ---\nHello (big) world\nsecond line\n\n--- Page 2 ---\n[Page 2: Contains images but no extractable text - OCR required]"
    assert documents.pdf_text(made_pdf([(b"", False)], pack)) == "[PDF contains no extractable text]"
    with pytest.raises(ValueError):
        pdf.pages(said + b"/Encrypt")


def made_xls(rows):
    """A compound file of 512-byte sectors: FAT, directory, workbook."""
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    strings = sorted({c for r in rows for c in r if isinstance(c, str)})
    sst = struct.pack("<II", len(strings), len(strings)) + b"".join(struct.pack("<HB", len(s), 1) + s.encode("utf-16-le") for s in strings)
    cells = b""
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            cells += record(0x00FD, struct.pack("<HHHI", r, c, 0, strings.index(v))) if isinstance(v, str) else record(0x0203, struct.pack("<HHHd", r, c, 0, v)) if isinstance(v, float) else record(0x027E, struct.pack("<HHHI", r, c, 0, v << 2 | 2))
    bof = record(0x0809, struct.pack("<HHHHII", 0x0600, 5, 0, 0, 0, 0))
    name = "Người"
    bound = lambda at: record(0x0085, struct.pack("<IHBB", at, 0, len(name), 1) + name.encode("utf-16-le"))
    head = len(bof + bound(0) + record(0x00FC, sst) + record(0x000A, b""))
    book = bof + bound(head) + record(0x00FC, sst) + record(0x000A, b"") + bof + cells + record(0x000A, b"")
    book += b"\0" * (4096 - len(book))
    sectors = len(book) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [i + 3 for i in range(sectors - 1)] + [0xFFFFFFFE]
    entry = lambda n, kind, start, size: n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", len(n) * 2 + 2, kind, 1) + struct.pack("<III", 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<IQ", start, size)
    header = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    header = header[:76] + struct.pack("<I", 0) + b"\xff" * (512 - 80)
    return header + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(book))).ljust(512, b"\0") + book


def test_xls():
    book = made_xls([["Tên", "Age"], ["A", 41], ["B", 2.5]])
    assert xls.sheets(book) == [("Người", [["Tên", "Age"], ["A", "41"], ["B", "2.5"]])]
    assert documents.xls_text(book) == "--- Sheet: Người ---\n\nThis sheet contains 2 rows and 2 columns: Tên, Age\n\nRow 1: Tên: A, Age: 41\n\nRow 2: Tên: B, Age: 2.5"
    with pytest.raises(ValueError):
        xls.sheets(b"no workbook")


def test_scan_and_proofread(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made_pdf([(b"BT (x) Tj ET", False), (b"", True)], True))
    (tmp_path / "b.xls").write_bytes(made_xls([["h"], ["v"]]))
    (tmp_path / "c.xlsx").write_bytes(b"broken")
    got = {r.path[-5:]: r for r in documents.scan(spark, str(tmp_path)).collect()}
    assert (got["a.pdf"].pages, got["a.pdf"].has_images, got["b.xls"].pages, got[".xlsx"].pages) == (2, True, 1, None)
    assert {r.path[-5:]: r.error for r in documents.read_documents(spark, str(tmp_path)).collect()}["a.pdf"] is None
    docs = spark.createDataFrame([("số 5 tỷ 12345678",), (None,), ("",)], "text string")
    loud = documents.proofread(docs, lambda texts, said: [f"{t}|{s}" for t, s in zip(texts, said)], {"default": "d", "number_lock": "n"}).collect()
    assert [r.proofread for r in loud] == ["số 5 tỷ 12****78|n", None, ""]
    assert [r.proofread for r in documents.proofread(docs, lambda *_: 1 / 0, {"default": "d"}).collect()] == [r.text for r in docs.collect()]


def test_progress_stream(spark, tmp_path):
    schema = "batch_id long, phase string, processing_time double, success boolean, field_count int"
    seen = []
    for i in range(2):
        spark.createDataFrame([(1, "OCR", 2.0, True, 3), (1, "OCR", 1.0, False, 1)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        runs.progress_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "cp"), lambda df, n: seen.append(df.collect())).awaitTermination()
    last = seen[-1][0]
    assert (last.records, last.successful, last.total_time, last.fields) == (4, 2, 6.0, 8)
