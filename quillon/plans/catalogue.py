"""Every query by name, and the SQL that must give the same rows. Fixed values in the SQL, here and in the other modules: labels, messages,
recommendations, patterns and limits, which must be those of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, convert, text
from ..operators import records, reports
from .fixtures import SQL, TEMPLATE, read, results
from ..sources.tables import spread
from .masking import _ENDS, _MAIL, _P, _PHONE, _replaced
from .registry import ORACLES, QUERIES, query

def _rows(spark, sf):
    return records.validated(results(spark, sf), TEMPLATE)


def _valid(spark, sf):
    return records.valid_observations(results(spark, sf), TEMPLATE)


def _own(name: str) -> str:
    """Another query's SQL without the results' CTEs, which the asking query has itself."""
    return ORACLES[name].removeprefix(f"with {SQL} ")


def _obs(spark, sf):
    return records.observations(results(spark, sf), TEMPLATE)


# conversion
_NUMBERS = "select l_orderkey * 10 + l_linenumber as k, case l_linenumber % 4 when 0 then format('{:,.2f}', l_extendedprice) when 1 then translate(format('{:,.2f}', l_extendedprice), ',.', '.,') when 2 then cast(cast(l_quantity as bigint) as varchar) || '.000' else '  ' || cast(cast(l_quantity as bigint) as varchar) || ',5 kg' end as v from lineitem"


def _numbers(spark, sf):
    n, money = F.col("l_linenumber"), F.format_number("l_extendedprice", 2)
    q = F.col("l_quantity").cast("long").cast("string")
    v = F.when(n % 4 == 0, money).when(n % 4 == 1, F.translate(money, ",.", ".,")).when(n % 4 == 2, F.concat(q, F.lit(".000"))).otherwise(F.concat(F.lit("  "), q, F.lit(",5 kg")))
    return read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("k"), v.alias("v"))


@query(f"select k, try_cast(regexp_replace(case when length(v) - length(replace(v, ',', '')) = 1 and contains(v, '.') then replace(replace(v, '.', ''), ',', '.') when contains(v, '.') and not contains(v, ',') then replace(v, '.', '') else v end, '[^0-9.\\-]', '', 'g') as double) as x from (select k, trim(v) as v from ({_NUMBERS}))")
def conv_number_vi(spark, sf):
    return _numbers(spark, sf).select("k", convert.number(F.col("v"), "vi-VN").alias("x"))


@query(f"select k, try_cast(regexp_replace(replace(v, ',', ''), '[^0-9.\\-]', '', 'g') as double) as x from ({_NUMBERS})")
def conv_number_en(spark, sf):
    return _numbers(spark, sf).select("k", convert.number(F.col("v"), "en-US").alias("x"))


@query("select seq, cast(number_value as double) as x from conv where kind = 'currency'", True)
def conv_currency(spark, sf):
    return _obs(spark, sf).where("kind = 'currency'").select("seq", F.col("number_value").cast("double").alias("x"))


@query("select seq, strftime(date_value, '%Y-%m-%d') as d from conv where kind = 'date'", True)
def conv_date(spark, sf):
    return _obs(spark, sf).where("kind = 'date'").select("seq", F.date_format("date_value", "yyyy-MM-dd").alias("d"))


@query(f"select k, try_cast(replace(trim(v), ',', '.') as double) as x, try_cast(replace(regexp_extract(v, '[0-9,.]+'), ',', '') as double) as y from ({_NUMBERS})")
def conv_extractor_coerce(spark, sf):
    return _numbers(spark, sf).select("k", convert.extracted_number(F.col("v")).alias("x"), convert.extracted_currency(F.col("v")).alias("y"))


# validation and implicit joins
@query("select seq, field_name, missing, error from judged", True)
def template_left_join(spark, sf):
    return _obs(spark, sf).select("seq", "field_name", "missing", "error")


@query("select seq, 'note' as field_name from fx where note is not null", True)
def unexpected_fields_anti(spark, sf):
    return records.unexpected_fields(results(spark, sf), TEMPLATE).select("seq", "field_name")


@query("select seq, field_name from judged where missing", True)
def required_missing(spark, sf):
    return records.required_missing(results(spark, sf), TEMPLATE).select("seq", "field_name")


@query("select seq, 'Validation errors for ' || source_file || ': ' || array_to_string(errors, '; ') as message from rows_ where len(errors) > 0", True)
def row_validation(spark, sf):
    rows = _rows(spark, sf).where("size(errors) > 0")
    return rows.select("seq", records.joined_error(rows).alias("message"))


@query("select source_file, 'failed' as status, len(errors) as n_errors from rows_ where len(errors) > 0", True)
def failed_rows(spark, sf):
    return records.failed_rows(_rows(spark, sf)).drop("validation_errors")


@query("select r.source_file, case when len(r.errors) = 0 then r.status else 'failed' end as status, r.processing_time, max(text_value) filter (where len(r.errors) = 0) as company_name, cast(max(number_value) filter (where len(r.errors) = 0) as double) as revenue, strftime(max(date_value) filter (where len(r.errors) = 0), '%Y-%m-%d') as order_date from judged j join rows_ r using (seq) group by all", True)
def data_sheet_wide(spark, sf):
    return records.wide(_rows(spark, sf), TEMPLATE).withColumns({"revenue": F.col("revenue").cast("double"), "order_date": F.date_format("order_date", "yyyy-MM-dd")})


@query("select seq, try_cast(revenue as double) as revenue, case when regexp_full_match(order_date, '\\d{4}-\\d{2}-\\d{2}') then strftime(try_strptime(order_date, '%Y-%m-%d'), '%Y-%m-%d') end as order_date from fx", True)
def column_coercion(spark, sf):
    at = lambda c: F.try_element_at("data", F.lit(c)).alias(c)
    return records.coerced(results(spark, sf).select("seq", at("revenue"), at("order_date")), TEMPLATE).withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


# aggregates
@query("select count(*) as total_files, count(*) filter (where len(errors) = 0 and status = 'completed') as successful_files, count(distinct source_file) filter (where len(errors) > 0) as failed_files, 100.0 * count(*) filter (where len(errors) = 0 and status = 'completed') / count(*) as success_rate, sum(processing_time) as total_processing_time, avg(processing_time) filter (where processing_time > 0) as average_processing_time, median(processing_time) filter (where processing_time > 0) as median_processing_time from rows_", True)
def processing_summary(spark, sf):
    return records.processing_summary(_rows(spark, sf), results(spark, sf))


@query("select field_name, total_count, null_count, unique_count from stats", True)
def field_counts(spark, sf):
    return records.field_quality(_valid(spark, sf)).select("field_name", "total_count", "null_count", "unique_count")


@query("select field_name, field_type, total_count, null_count, completeness_rate, unique_count, uniqueness_score, (completeness_rate + uniqueness_score) / 2 as data_quality_score from stats", True)
def field_quality(spark, sf):
    return records.field_quality(_valid(spark, sf)).drop("pos")


@query("select field_name, min(v) as min_value, max(v) as max_value, round(avg(v), 4) as mean_value, round(median(v), 4) as median_value, round(coalesce(stddev_samp(v), 0), 4) as std_deviation from (select field_name, cast(number_value as double) as v from valid where number_value is not null) group by 1", True)
def field_numeric_stats(spark, sf):
    out = records.numeric_stats(_valid(spark, sf))
    return out.withColumns({c: F.round(c, 4) for c in ("mean_value", "median_value", "std_deviation")})


@query("select field_name, cast(min(length(text_value)) as int) as min_length, cast(max(length(text_value)) as int) as max_length, avg(length(text_value)) as avg_length from valid where text_value is not null group by 1", True)
def field_text_stats(spark, sf):
    return records.text_stats(_valid(spark, sf))


@query("select field_name, strftime(min(date_value), '%Y-%m-%d') as earliest_date, strftime(max(date_value), '%Y-%m-%d') as latest_date, cast(date_diff('day', min(date_value), max(date_value)) as int) as date_range_days from valid where date_value is not null group by 1", True)
def field_date_stats(spark, sf):
    return records.date_stats(_valid(spark, sf))


_SCORED = "(select *, (completeness_rate + uniqueness_score) / 2 as q from stats)"
_GRADE = "case when {0} >= 90 then 'A' when {0} >= 80 then 'B' when {0} >= 70 then 'C' when {0} >= 60 then 'D' else 'F' end"


@query(f"select avg(q) as overall_quality_score, count(*) filter (where q < 80) as fields_with_issues, 100.0 * sum(total_count - null_count) / sum(total_count) as completeness_rate, {_GRADE.format('avg(q)')} as quality_grade from {_SCORED}", True)
def overall_quality(spark, sf):
    return records.overall_quality(records.field_quality(_valid(spark, sf)))


_PATTERNS = "(select case when e like '%missing%' then 'missing_required_fields' when e like '%conversion failed%' then 'type_conversion_errors' when e like '%unexpected field%' then 'schema_mismatches' end as pattern, count(*) as n from (select lower(array_to_string(errors, '; ')) as e from rows_ where len(errors) > 0) group by 1)"


@query(f"select * from {_PATTERNS} order by n desc limit 5", True)
def error_patterns(spark, sf):
    return records.error_patterns(_rows(spark, sf))


@query(f"select field_name, q as quality_score, completeness_rate, array_to_string(list_filter([case when completeness_rate < 90 then 'Low completeness rate' end, case when unique_count < 2 then 'Low data diversity' end], lambda x: x is not null), '; ') as issues from {_SCORED} where q < 80", True)
def problematic_fields(spark, sf):
    return records.problematic_fields(records.field_quality(_valid(spark, sf)))


@query(f"select k as o_orderkey, {_GRADE.format('s')} as grade from (select o_orderkey as k, cast(o_orderkey % 101 as double) as s from orders)")
def quality_grade(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", classify.grade((F.col("o_orderkey") % 101).cast("double")).alias("grade"))


@query(f"select cast(row_number() over (order by i) - 1 as int) as pos, recommendation from (select unnest([1,2,3,4,5]) as i, unnest([q < 80, m > 2, c > 2, comp < 85, succ < 90]) as ok, unnest(['Consider reviewing document quality and OCR settings', 'Review extraction prompts for better field detection', 'Verify field type configurations match document formats', 'Consider improving document preprocessing or extraction templates', 'Review failed files for common patterns and adjust processing parameters']) as recommendation from (select (select avg(q) from {_SCORED}) as q, (select coalesce(sum(n) filter (where pattern = 'missing_required_fields'), 0) from {_PATTERNS}) as m, (select coalesce(sum(n) filter (where pattern = 'type_conversion_errors'), 0) from {_PATTERNS}) as c, (select 100.0 * sum(total_count - null_count) / sum(total_count) from stats) as comp, (select 100.0 * count(*) filter (where len(errors) = 0 and status = 'completed') / count(*) from rows_) as succ)) where ok", True)
def recommendations(spark, sf):
    rows = _rows(spark, sf)
    return records.recommendations(records.overall_quality(records.field_quality(_valid(spark, sf))), records.processing_counts(rows), records.error_patterns(rows))


@query("select source_file, count(*) as error_count, 'Validation errors for ' || source_file || ': ' || array_to_string(any_value(errors), '; ') as error_details from rows_ where len(errors) > 0 group by 1", True)
def error_table(spark, sf):
    return records.error_table(_rows(spark, sf))


_F1 = "format('{{:.1f}}', {0})"
_SUMMARY = "(select count(*) as n, count(*) filter (where len(errors) = 0 and status = 'completed') as ok, count(distinct source_file) filter (where len(errors) > 0) as bad, count(*) filter (where len(errors) > 0) as bad_rows, coalesce(sum(processing_time), 0) as t, avg(processing_time) filter (where processing_time > 0) as mean, median(processing_time) filter (where processing_time > 0) as mid from rows_)"
_PROCESSING = f"select 'Processing Summary' as section, unnest([1,2,3,4,5,6,7]) as pos, unnest(['Total Files', 'Successful Files', 'Failed Files', 'Success Rate', 'Total Processing Time', 'Average Processing Time', 'Median Processing Time']) as label, unnest([cast(n as varchar), cast(ok as varchar), cast(bad as varchar), format('{{:.1f}}%', 100.0 * ok / n), format('{{:.2f}}s', t), format('{{:.2f}}s', mean), format('{{:.2f}}s', mid)]) as value from {_SUMMARY}"
_QUALITY = "select 'Data Quality Summary' as section, unnest([1,2,3,4]) as pos, unnest(['Overall Quality Score', 'Completeness Rate', 'Data Consistency', 'Error Rate']) as label, unnest([format('{:.1f}', avg((completeness_rate + uniqueness_score) / 2)), format('{:.1f}%', 100.0 * sum(total_count - null_count) / sum(total_count)), '0.0', '0.0%']) as value from stats"
_ERRORS = f"select 'Error Analysis' as section, unnest([1,2]) as pos, unnest(['Total Errors: ' || bad_rows, 'Files with Errors: ' || bad]) as label, '' as value from {_SUMMARY}"


@query(_PROCESSING, True)
def summary_processing(spark, sf):
    return reports.processing_block(records.processing_summary(_rows(spark, sf), results(spark, sf)))


@query(_QUALITY, True)
def summary_quality(spark, sf):
    return reports.quality_block(records.overall_quality(records.field_quality(_valid(spark, sf))))


@query(_ERRORS, True)
def summary_errors(spark, sf):
    return reports.error_block(_rows(spark, sf))


@query(f"select * from ({_PROCESSING}) union all select * from ({_QUALITY}) union all select * from ({_ERRORS})", True)
def summary_rows(spark, sf):
    return reports.summary_sheet(_rows(spark, sf), _valid(spark, sf))


@query("select t.pos, t.field_name, t.field_type, format('{:.1f}%', coalesce(completeness_rate, 0)) as completeness, coalesce(unique_count, 0) as unique_values, coalesce(format('{:,.0f} ₫', lo), 'N/A') as min, coalesce(format('{:,.0f} ₫', hi), 'N/A') as max, coalesce(format('{:,.0f} ₫', mean), 'N/A') as mean from (select unnest([1,2,3]) as pos, unnest(['company_name', 'revenue', 'order_date']) as field_name, unnest(['text', 'currency', 'date']) as field_type) t left join stats using (field_name) left join (select field_name, cast(min(number_value) as double) as lo, cast(max(number_value) as double) as hi, avg(cast(number_value as double)) as mean from valid where number_value is not null group by 1) using (field_name)", True)
def summary_fields(spark, sf):
    return reports.field_table(_valid(spark, sf), TEMPLATE)


@query("select label, n from (select unnest(['Successful', 'Failed']) as label, unnest([count(*) filter (where len(errors) = 0 and status = 'completed'), count(distinct source_file) filter (where len(errors) > 0)]) as n from rows_) where n > 0", True)
def pie_data(spark, sf):
    return records.processing_counts(_rows(spark, sf)).selectExpr("stack(2, 'Successful', successful_files, 'Failed', failed_files) as (label, n)").where("n > 0")


# text
_DOCS = "(select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') as t from documents)"


def _ascii(spark, sf):
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("t"))


@query(f"select doc_id, md5({_replaced('t', _P['account'], _ENDS)}) as h from {_DOCS}")
def mask_account(spark, sf):
    return _ascii(spark, sf).select("doc_id", F.md5(text.mask_account(F.col("t"))).alias("h"))


@query(f"select doc_id, md5({_replaced('t', _P['id'], _ENDS)}) as h from {_DOCS}")
def mask_id(spark, sf):
    return _ascii(spark, sf).select("doc_id", F.md5(text.mask_id(F.col("t"))).alias("h"))


@query(f"select doc_id, md5({_replaced('t', _P['email'], _MAIL)}) as h from {_DOCS}")
def mask_email(spark, sf):
    return _ascii(spark, sf).select("doc_id", F.md5(text.mask_email(F.col("t"))).alias("h"))


@query(f"select k, {_replaced('t', _P['phone'], _PHONE)} as masked from (select o_orderkey as k, 'call ' || case o_orderkey % 3 when 0 then '+84' when 1 then '84' else '0' end || cast(910000000 + o_orderkey % 1000 as varchar) || ' now' as t from orders)")
def mask_phone(spark, sf):
    k = F.col("o_orderkey")
    t = F.concat(F.lit("call "), F.when(k % 3 == 0, "+84").when(k % 3 == 1, "84").otherwise("0"), (k % 1000 + 910000000).cast("string"), F.lit(" now"))
    return read(spark, sf, "orders").select(k.alias("k"), text.mask_phone(t).alias("masked"))


@query(f"select doc_id, md5({_replaced('em', _P['phone'], _PHONE)}) as h from (select doc_id, {_replaced('im', _P['email'], _MAIL)} as em from (select doc_id, {_replaced('am', _P['id'], _ENDS)} as im from (select doc_id, {_replaced('t', _P['account'], _ENDS)} as am from {_DOCS})))")
def mask_all(spark, sf):
    return _ascii(spark, sf).select("doc_id", F.md5(text.mask_all(F.col("t"))).alias("h"))


def _log_sql() -> str:
    out = "t"
    table = _DOCS
    for pattern, change in ((r"\b\d{10,16}\b", "repeat('*', length(m))"), (r"\b\d{9,12}\b", "repeat('*', length(m))"), (_P["email"], "m[1:1] || '***@' || split_part(m, '@', 2)"), (r"\b(?:\+84|0)[1-9]\d{8,9}\b", "m[1:3] || '***' || m[-4:]"), (r"\b[A-Za-z0-9]{20,}\b", "repeat('*', length(m))")):
        table = f"(select doc_id, {_replaced(out, pattern, change)} as t from {table})"
    return f"select doc_id, md5(t) as h from {table}"


@query(_log_sql())
def mask_log(spark, sf):
    return _ascii(spark, sf).select("doc_id", F.md5(text.mask_log(F.col("t"))).alias("h"))


@query("select c_custkey, case when length(c_name) > 7 then c_name[1:4] || repeat('*', length(c_name) - 7) || c_name[-3:] else repeat('*', length(c_name)) end as masked from customer")
def mask_key(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", text.mask_key(F.col("c_name")).alias("masked"))


@query("select doc_id, case when greatest(" + ",".join(f"contains(lower(text), '{w}')" for w in text.NUMBER_WORDS) + ") then 'number_lock' when greatest(" + ",".join(f"contains(lower(text), '{w}')" for w in text.BUSINESS_WORDS) + ") then 'business' else 'minimal' end as mode from documents")
def proofread_mode(spark, sf):
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.proofread_mode(F.col("text")).alias("mode"))


_FOLDED = "list_reduce(list_transform(w, lambda x: {'cuts': [0], 'n': length(x) + 1, 'i': 0}), lambda a, x: case when a.n + x.n > 8000 then {'cuts': list_append(a.cuts, a.i + 1), 'n': x.n, 'i': a.i + 1} else {'cuts': a.cuts, 'n': a.n + x.n, 'i': a.i + 1} end)"
_LONG = f"select doc_id, w, {_FOLDED}.cuts as cuts from (select doc_id, list_filter(string_split_regex(text, '[\\s\\x0b\\x{{85}}\\pZ]+'), lambda x: x <> '') as w from documents where length(text) > 8000) where len(w) > 0"


@query(f"select doc_id, n, length(part) as n_chars, md5(part) as h from (select doc_id, 0 as n, text as part from documents where length(text) <= 8000 union all select doc_id, k - 1, array_to_string(w[cuts[k] + 1 : coalesce(cuts[k + 1], len(w))], ' ') from ({_LONG}), unnest(range(1, len(cuts) + 1)) as t(k))")
def chunk_text(spark, sf):
    parts = spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("n", "part"))
    return parts.select("doc_id", "n", F.length("part").cast("long").alias("n_chars"), F.md5("part").alias("h"))


@query("select s_suppkey, 'Row ' || s_suppkey || ': ' || concat_ws(', ', 'name: ' || s_name, 'nation: ' || s_nationkey) as prose from supplier")
def row_prose(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", text.row_prose(F.col("s_suppkey"), {"name": F.col("s_name"), "nation": F.col("s_nationkey")}).alias("prose"))


@query("select p_partkey, trim(regexp_replace(lower(strip_accents('Tên ' || p_name)), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') as name from part")
def snake_case(spark, sf):
    return read(spark, sf, "part").select("p_partkey", text.snake_case(F.concat(F.lit("Tên "), "p_name")).alias("name"))


@query("select page_id, case when v = '' then 'untitled' else left(v, 200) end as name from (select page_id, trim(translate(url, '<>:\"/\\|?*', '_________'), ' .') as v from pages)")
def sanitize_filename(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.file_name(F.col("url")).alias("name"))


@query("select doc_id, case when n is null then null when n = 0 then '0 B' when n < 1024 then format('{:.1f} B', n) when n < 1048576 then format('{:.1f} KB', n / 1024) else format('{:.1f} MB', n / 1048576) end as size from (select doc_id, cast(n_chars * 512 as double) as n from documents)")
def file_size_format(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.file_size(F.col("n_chars") * 512).alias("size"))


@query("select page_id, regexp_extract(url, '[^/\\\\]+$') as name from pages")
def basename(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.base_name(F.col("url")).alias("name"))


@query("select c_custkey, case when length(c_name) > 15 then c_name[1:15] || '...' else c_name end as label from customer")
def label_truncate(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", text.label(F.col("c_name")).alias("label"))


@query(f"""select quality_grade as overall_quality_grade, completeness_rate, total_errors, files_with_errors, (select string_agg(pattern || '=' || n, '; ' order by n desc, pattern) from {_PATTERNS} where pattern is not null) as common_error_patterns,
  coalesce((select string_agg(field_name || ': ' || issues, '; ' order by field_name) from (PROBLEMS)), '') as problematic_fields, (select string_agg(recommendation, '; ' order by pos) from (ADVICE)) as recommendations
  from (OVERALL), (select count(*) as total_errors, count(distinct source_file) as files_with_errors from rows_ where len(errors) > 0)""".replace("PROBLEMS", _own("problematic_fields")).replace("ADVICE", _own("recommendations")).replace("OVERALL", _own("overall_quality")), True)
def quality_report(spark, sf):
    rows = _rows(spark, sf)
    return reports.quality_report(rows, _valid(spark, sf))


from . import live, logs, sources, views  # noqa: E402, F401  they register theirs
