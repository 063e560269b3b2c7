"""Queries over paths, pages and tables as sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal, text
from ..sources import documents, sinks, tables_as_text
from ..sources.scratch import new_path
from ..streaming import runs
from .fixtures import TEMPLATE, read, results
from .masking import _ENDS as _KEPT_ENDS
from .masking import _MAIL, _P, _PHONE, _replaced
from .registry import query

_ENDS = (".PDF", ".docx", ".txt", ".csv", ".png", "", ".xls", ".doc")
_PATHS = "(select page_id, 'x/p' || page_id || ['.PDF', '.docx', '.txt', '.csv', '.png', '', '.xls', '.doc'][page_id % 8 + 1] as path, lower(regexp_extract(['.PDF', '.docx', '.txt', '.csv', '.png', '', '.xls', '.doc'][page_id % 8 + 1], '[^.]+$')) as e from pages)"


def _paths(spark, sf):
    e = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % 8 + 1).cast("int"))
    return read(spark, sf, "pages").select("page_id", F.concat(F.lit("x/p"), F.col("page_id").cast("string"), e).alias("path"))


_FORMATS = "('pdf', 'docx', 'doc', 'xlsx', 'xls', 'csv')"


@query(f"select page_id, e as format, e in {_FORMATS} as supported from {_PATHS}")
def format_detect(spark, sf):
    e = documents.extension(F.col("path"))
    return _paths(spark, sf).select("page_id", e.alias("format"), e.isin(*documents.FORMATS).alias("supported"))


@query(f"select page_id, case when page_id % 7 > 0 and e in {_FORMATS} then e end as format, case when page_id % 7 = 0 then 'File not found: ' || path when e = '' then 'File has no extension: ' || path when e not in {_FORMATS} then 'Unsupported file format: .' || e || '. Supported formats: .pdf, .docx, .doc, .xlsx, .xls, .csv' end as error from {_PATHS}")
def format_errors(spark, sf):
    paths = _paths(spark, sf)
    return documents.format_or_error(paths, paths.where("page_id % 7 > 0")).select("page_id", "format", "error")


@query(f"select page_id, 'MIME type mismatch for ' || path || ': expected ' || case e when 'pdf' then 'application/pdf' when 'docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' when 'doc' then 'application/msword' when 'xls' then 'application/vnd.ms-excel' else 'text/csv' end || ', got text/csv' as warning from {_PATHS} where e in ('pdf', 'docx', 'doc', 'xls') and page_id % 3 = 0")
def mime_warnings(spark, sf):
    """Every third file says that it is a CSV."""
    paths = _paths(spark, sf)
    files = paths.select("path", F.when(F.col("page_id") % 3 == 0, "text/csv").alias("mime"))
    return documents.format_or_error(paths, files).where("warning is not null").select("page_id", "warning")


@query(f"select page_id, case when e = 'pdf' then 'pdf' when e in ('docx', 'doc') then 'docx' when e in ('xlsx', 'xls') then 'excel' when e = 'csv' then 'csv' when e = 'txt' then 'text' end as category from {_PATHS}")
def category_detect(spark, sf):
    return _paths(spark, sf).select("page_id", documents.category(F.col("path")).alias("category"))


@query(f"select page_id, 'window' as place from {_PATHS} where e in ('pdf', 'docx', 'xlsx', 'xls') union all select page_id, 'list' from {_PATHS} where e in ('pdf', 'docx', 'doc')")
def file_filters(spark, sf):
    paths = _paths(spark, sf)
    of = lambda where: documents.accepted(paths, where).select("page_id", F.lit(where).alias("place"))
    return of("window").unionByName(of("list"))


@query(f"select page_id from {_PATHS} where e in ('pdf', 'docx', 'xlsx', 'xls') and page_id % 3 > 0")
def dropped_files(spark, sf):
    paths = _paths(spark, sf)
    return documents.existing(paths, paths.where("page_id % 3 > 0")).select("page_id")


@query("select doc_id, case when length(trim(text)) > 10 then 'text' when length(trim(text)) > 0 and doc_id % 3 > 0 then 'text' when doc_id % 3 > 0 then 'empty' else 'ocr' end as route from documents")
def page_rule(spark, sf):
    return read(spark, sf, "documents").select("doc_id", documents.page_route(F.length(F.trim("text")), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("route"))


_PAGES = "(select c_custkey // 4 as f, c_custkey % 4 + 1 as page, case when c_custkey % 3 = 0 or c_custkey // 4 % 5 = 0 then ' ' else c_name end as t, case when c_custkey // 4 % 10 = 0 then 0 else c_custkey % 2 end as images from customer)"


@query(f"select 'f' || f as path, coalesce(string_agg('--- Page ' || page || ' ---' || chr(10) || case when trim(t) <> '' then t else '[Page ' || page || ': Contains images but no extractable text - OCR required]' end, chr(10) || chr(10) order by page) filter (where trim(t) <> '' or images > 0), '[PDF contains no extractable text]') as text from {_PAGES} group by 1")
def pdf_direct(spark, sf):
    k = F.col("c_custkey")
    f = F.floor(k / 4)
    pages = read(spark, sf, "customer").select(F.concat(F.lit("f"), f.cast("string")).alias("path"), (k % 4 + 1).alias("page"), F.when((k % 3 == 0) | (f % 5 == 0), " ").otherwise(F.col("c_name")).alias("text"), F.when(f % 10 == 0, 0).otherwise(k % 2).alias("images"))
    return documents.direct_pages(pages)


@query("select 0 as line, 'CSV file contains ' || count(*) || ' rows and 3 columns: s_suppkey, s_name, s_nationkey' as text from supplier union all select r, 'Row ' || r || ': s_suppkey: ' || s_suppkey || ', s_name: ' || s_name || ', s_nationkey: ' || s_nationkey from (select *, row_number() over (order by s_suppkey) as r from supplier) where r <= 5 union all select 6, '... and ' || (count(*) - 5) || ' more rows' from supplier having count(*) > 5")
def csv_prose(spark, sf):
    return documents.frame_prose(read(spark, sf, "supplier"), ["s_suppkey", "s_name", "s_nationkey"], "s_suppkey")


@query("select url, min(page_id) as page_id from pages group by 1")
def dedup_files(spark, sf):
    return read(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber >= 4)")
def pending_files(spark, sf):
    files = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("path"))
    done = read(spark, sf, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").cast("string").alias("path"))
    return runs.pending(files, done).select("o_orderkey")


@query("select seq, 'source_file,status,processing_time,revenue,confidence_scores,n_data,seq' as names, source_file || '|' || status || '|' || coalesce(revenue, '') || '|' || case when seq % 37 = 0 then 0 when seq % 41 = 0 then 4 else 3 end || '|' || seq as row from fx", True)
def data_columns(spark, sf):
    """The sheet's rows, each as its columns' names in order and its values."""
    rows = results(spark, sf).select(F.size("data").alias("n_data"), "seq", F.try_element_at("data", F.lit("revenue")).alias("revenue"), F.size("confidence_scores").alias("confidence_scores"), "processing_time", "status", "source_file")
    sheet = sinks.data_columns(rows, [f.name for f in TEMPLATE])
    return sheet.select("seq", F.lit(",".join(sheet.columns)).alias("names"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sheet.columns if c not in ("processing_time", "confidence_scores"))).alias("row"))


@query("select doc_id, md5(nfc_normalize(text || chr(10) || case doc_id % 4 when 0 then 'e' || chr(769) || 'o' || chr(803) || chr(770) || 'Å' || chr(8491) when 1 then replace(text, 'e', 'e' || chr(768)) else '' end)) as h from documents")
def nfc_normalise(spark, sf):
    """The documents, some with letters and marks that stand apart."""
    k, t = F.col("doc_id") % 4, F.col("text")
    more = F.when(k == 0, "e\u0301o\u0323\u0302Å\u212b").when(k == 1, F.replace(t, F.lit("e"), F.lit("e\u0300"))).otherwise("")
    return read(spark, sf, "documents").select("doc_id", F.md5(normal.nfc(F.concat(t, F.lit("\n"), more))).alias("h"))


_MASKED = "select o_orderkey, 'call 0' || cast(o_orderkey % 1000 + 910000000 as varchar) || ' or a.b' || o_orderkey || '@mail.example.com' as t from orders"


@query(" union all ".join(f"select o_orderkey, '{name}' as name, '{what}' as description, t as original, {_replaced('t', _P[name], {'account': _KEPT_ENDS, 'id': _KEPT_ENDS, 'email': _MAIL, 'phone': _PHONE}[name])} as masked from ({_MASKED})" for name, (_, what) in text.MASKS.items()))
def mask_catalogue(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", text.masked_by_each(F.concat(F.lit("call 0"), (F.col("o_orderkey") % 1000 + 910000000).cast("string"), F.lit(" or a.b"), F.col("o_orderkey").cast("string"), F.lit("@mail.example.com"))).alias("m"))
    return rows.select("o_orderkey", F.explode("m").alias("m")).select("o_orderkey", "m.*")


@query("select doc_id, case when greatest(" + ",".join(f"contains(lower(text), '{w}')" for w in text.NUMBER_WORDS) + ") then 'keep numbers' else 'default' end as prompt from documents")
def prompt_lookup(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.prompt(text.proofread_mode(F.col("text")), {"default": "default", "number_lock": "keep numbers"}).alias("prompt"))


@query("select doc_id, text as proofread from documents")
def proofread_offline(spark, sf):
    return documents.proofread(read(spark, sf, "documents"), None, {"default": ""}).select("doc_id", "proofread")


@query("select doc_id, case when trim(m) = '' then text else upper(m) || ' [' || case when greatest(" + ",".join(f"contains(lower(text), '{w}')" for w in text.NUMBER_WORDS) + ") then 'keep numbers' when greatest(" + ",".join(f"contains(lower(text), '{w}')" for w in text.BUSINESS_WORDS) + ") then 'business' else 'default' end || ']' end as proofread from (select doc_id, text, text as m from (select o_orderkey as doc_id, case o_orderkey % 4 when 0 then '' when 1 then 'doanh thu tang 5 %' when 2 then 'bao cao ' || o_orderpriority else 'plain ' || o_orderpriority end as text from orders))")
def proofread_by_model(spark, sf):
    """A model that writes in capitals and names its prompt; it answers an empty text with nothing, which then stays."""
    k = F.col("o_orderkey")
    docs = read(spark, sf, "orders").select(k.alias("doc_id"), F.when(k % 4 == 0, "").when(k % 4 == 1, "doanh thu tang 5 %").when(k % 4 == 2, F.concat(F.lit("bao cao "), "o_orderpriority")).otherwise(F.concat(F.lit("plain "), "o_orderpriority")).alias("text"))
    model = lambda texts, prompts: [t and f"{t.upper()} [{p}]" for t, p in zip(texts, prompts)]
    return documents.proofread(docs, model, {"default": "default", "number_lock": "keep numbers", "business": "business"}).select("doc_id", "proofread")


@query(f"select 'f' || f as path, string_agg('--- Page ' || page || ' ---' || chr(10) || case when length(trim(t)) > 10 or trim(t) <> '' and images = 0 then t when images = 0 then '[Empty page]' else '[Page contains ' || images || ' images but OCR is disabled]' end, chr(10) || chr(10) order by page) as text from {_PAGES} group by 1")
def page_text(spark, sf):
    """Pages to text with OCR off."""
    k = F.col("c_custkey")
    f = F.floor(k / 4)
    pages = read(spark, sf, "customer").select(F.concat(F.lit("f"), f.cast("string")).alias("path"), (k % 4 + 1).alias("page"), F.when((k % 3 == 0) | (f % 5 == 0), " ").otherwise(F.col("c_name")).alias("text"), F.when(f % 10 == 0, 0).otherwise(k % 2).alias("images"))
    return tables_as_text.pages_as_text(pages, ocr=False)


_SUPPLIED = "(select s_nationkey as n, row_number() over (partition by s_nationkey order by s_suppkey) as r, 'code: ' || s_suppkey || ', name: ' || s_name || ' é, nation: ' || s_nationkey as told from supplier)"


@query(f"select n as nation, 'CSV file contains ' || count(*) || ' rows and 3 columns: code, name, nation' || chr(10) || chr(10) || string_agg('Row ' || r || ': ' || told, chr(10) || chr(10) order by r) filter (where r <= 5) || case when count(*) > 5 then chr(10) || chr(10) || '... and ' || (count(*) - 5) || ' more rows' else '' end as text from {_SUPPLIED} group by 1")
def csv_files_prose(spark, sf):
    """CSV files, one for each nation, every other one in ISO 8859-1, written and read again."""
    rows = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("of"), F.col("s_suppkey").alias("code"), F.concat("s_name", F.lit(" é")).alias("name"), F.col("s_nationkey").alias("nation"))
    path = new_path(spark, "csv")
    for odd, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        rows.where(F.col("of") % 2 == odd).repartition("of").sortWithinPartitions("of", "code").write.partitionBy("of").option("header", "true").option("encoding", encoding).csv(f"{path}/{odd}")
    return tables_as_text.csv_prose(spark, path).select(F.regexp_extract("path", "of=(\\d+)", 1).cast("long").alias("nation"), "text")


@query("select p_partkey, p_name as a, p_brand as b, case when p_partkey % 2 = 0 then p_type end as c, case when p_partkey % 2 = 0 then 3 else 2 end as n from part")
def zipped_rows(spark, sf):
    """A header and rows of other lengths, the header with a name twice: the last counts."""
    names, values = F.array(*map(F.lit, ("a", "b", "b", "c"))), F.when(F.col("p_partkey") % 2 == 0, F.array("p_name", F.lit("first"), "p_brand", "p_type", F.lit("over"))).otherwise(F.array("p_name", F.lit("first"), "p_brand"))
    row = tables_as_text.zipped(names, values)
    return read(spark, sf, "part").select("p_partkey", row.alias("row")).select("p_partkey", *(F.try_element_at("row", F.lit(c)).alias(c) for c in "abc"), F.size("row").alias("n"))
