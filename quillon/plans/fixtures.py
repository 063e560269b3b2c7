"""Extraction results made from the order tables, so that every report has input of known content; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.templates import Field
from ..sources.tables import read, spread


TEMPLATE = (Field("company_name", "text"), Field("revenue", "currency"), Field("order_date", "date"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: seq, source_file, status, processing_time, data map<string,string>, confidence_scores map<string,double>.
    Every 37th has no data, every 31st no scores; revenue has none in every 13th."""
    k = F.col("o_orderkey")
    rows = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")).join(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    money = F.format_number("o_totalprice", 2)
    days = F.when(k % 5 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
    for i, layout in enumerate(("dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yy", "dd.MM.yyyy"), 1):
        days = days.when(k % 5 == i, F.date_format("o_orderdate", layout))
    data = F.create_map(
        F.lit("company_name"), F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, "").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" "))),
        F.lit("revenue"), F.when(k % 2 == 0, F.concat(F.translate(money, ",.", ".,"), F.lit(" ₫"))).otherwise(F.concat(money, F.lit(" USD"))),
        F.lit("order_date"), F.when(k % 29 == 0, "not a date").otherwise(days),
    )
    data = F.when(k % 37 == 0, F.create_map().cast("map<string,string>")).when(k % 41 == 0, F.map_concat(data, F.create_map(F.lit("note"), F.lit("extra")))).otherwise(data)
    score = lambda by, plus: ((k * by + plus) % 100 / F.lit(100.0)).cast("double")
    scores = F.create_map(F.lit("company_name"), score(37, 0), F.lit("order_date"), score(71, 29))
    scores = F.when(k % 31 == 0, F.create_map().cast("map<string,double>")).when(k % 13 == 0, scores).otherwise(F.map_concat(scores, F.create_map(F.lit("revenue"), score(53, 11))))
    return rows.select(k.alias("seq"), F.concat(F.lit("order_"), k.cast("string"), F.lit(".pdf")).alias("source_file"), F.when(k % 23 == 0, "failed").otherwise("completed").alias("status"), ((k % 50) / F.lit(10.0)).cast("double").alias("processing_time"), data.alias("data"), scores.alias("confidence_scores"))


#: The same rows as SQL: fx has one column per field, obs one row per template field.
SQL = """
fx as (select o_orderkey as seq, 'order_' || o_orderkey || '.pdf' as source_file,
  case when o_orderkey % 23 = 0 then 'failed' else 'completed' end as status,
  cast((o_orderkey % 50) / 10.0 as double) as processing_time,   case when o_orderkey % 31 <> 0 then cast(((o_orderkey * 37) % 100) / 100.0 as double) end as cs_company_name,
  case when o_orderkey % 31 <> 0 and o_orderkey % 13 <> 0 then cast(((o_orderkey * 53 + 11) % 100) / 100.0 as double) end as cs_revenue,
  case when o_orderkey % 31 <> 0 then cast(((o_orderkey * 71 + 29) % 100) / 100.0 as double) end as cs_order_date,
  case when o_orderkey % 37 = 0 then null when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then '' else '  ' || c_name || ' ' end as company_name,
  case when o_orderkey % 37 = 0 then null when o_orderkey % 2 = 0 then translate(format('{:,.2f}', o_totalprice), ',.', '.,') || ' ₫' else format('{:,.2f}', o_totalprice) || ' USD' end as revenue,
  case when o_orderkey % 37 = 0 then null when o_orderkey % 29 = 0 then 'not a date' else case o_orderkey % 5 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then strftime(o_orderdate, '%d-%m-%Y')
    when 2 then strftime(o_orderdate, '%Y-%m-%d') when 3 then strftime(o_orderdate, '%d/%m/%y') else strftime(o_orderdate, '%d.%m.%Y') end end as order_date,
  case when o_orderkey % 41 = 0 and o_orderkey % 37 <> 0 then 'extra' end as note
  from orders join customer on o_custkey = c_custkey),
obs as (select seq, source_file, status, processing_time, cs_company_name as score, 'company_name' as field_name, 1 as pos, 'text' as kind, company_name as raw from fx
  union all select seq, source_file, status, processing_time, cs_revenue, 'revenue', 2, 'currency', revenue from fx
  union all select seq, source_file, status, processing_time, cs_order_date, 'order_date', 3, 'date', order_date from fx),
scores as (select seq, source_file, status, field_name, pos, score from obs where score is not null),
conv as (select *, raw is null or raw = '' as missing,
  case when kind = 'text' and raw <> '' then trim(raw) end as text_value,
  case when kind = 'currency' then try_cast({vi} as decimal(38,6)) end as number_value,
  case when kind = 'date' then {date} end as date_value from (select *, trim(regexp_replace(raw, '₫|VND|đ|\\$|€|£|USD|EUR|GBP', '', 'g')) as v from obs)),
judged as (select *, case when missing then 'Required field ''' || field_name || ''' is missing or empty'
  when text_value is null and number_value is null and date_value is null then 'Field ''' || field_name || ''' conversion failed' end as error from conv),
rowerr as (select source_file, seq, any_value(status) as status, any_value(processing_time) as processing_time,
  list(error order by pos) filter (where error is not null) as field_errors from judged group by 1, 2),
rows_ as (select r.*, list_concat(coalesce(field_errors, []), case when note is not null then ['Unexpected field ''note'' not in template schema'] else [] end) as errors
  from rowerr r join fx using (seq)),
valid as (select j.* from judged j join rows_ r using (seq) where len(r.errors) = 0),
stats as (select field_name, any_value(kind) as field_type, any_value(pos) as pos, count(*) as total_count, count(*) filter (where missing) as null_count,
  count(distinct coalesce(text_value, cast(number_value as varchar), cast(date_value as varchar))) as unique_count,
  100.0 * count(*) filter (where not missing) / count(*) as completeness_rate,
  least(100.0 * count(distinct coalesce(text_value, cast(number_value as varchar), cast(date_value as varchar))) / greatest(count(*) filter (where not missing), 1), 100.0) as uniqueness_score
  from valid group by 1)
""".replace("{vi}", """regexp_replace(case when length(v) - length(replace(v, ',', '')) = 1 and contains(v, '.') then replace(replace(v, '.', ''), ',', '.')
   when contains(v, '.') and not contains(v, ',') then replace(v, '.', '') else v end, '[^0-9.\\-]', '', 'g')""").replace("{date}", """coalesce(
   case when regexp_full_match(v, '\\d{1,2}/\\d{1,2}/\\d{4}') then try_strptime(v, '%d/%m/%Y') end, case when regexp_full_match(v, '\\d{1,2}-\\d{1,2}-\\d{4}') then try_strptime(v, '%d-%m-%Y') end,
   case when regexp_full_match(v, '\\d{4}-\\d{1,2}-\\d{1,2}') then try_strptime(v, '%Y-%m-%d') end, case when regexp_full_match(v, '\\d{1,2}/\\d{1,2}/\\d{2}') then try_strptime(v, '%d/%m/%y') end,
   case when regexp_full_match(v, '\\d{1,2}\\.\\d{1,2}\\.\\d{4}') then try_strptime(v, '%d.%m.%Y') end)""")


PHASES = ("Ingestion", "OCR", "Extraction", "Validation")


def _picked(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a processing log of 16 batches; see operators.monitoring for the columns."""
    k, t = F.col("event_id"), F.col("value") / 100
    share = lambda by: ((k * by) % 100 / F.lit(100.0)).cast("double")
    scores = F.when(k % 5 == 0, F.array().cast("array<double>")).otherwise(F.array(share(37), share(53)))
    return read(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("batch_id"), k.alias("seq"), F.concat(F.lit("file_"), F.col("user_id").cast("string")).alias("file_path"), _picked(PHASES, k % 4).alias("phase"), (k * 2).cast("double").alias("start_time"), ((k * 2).cast("double") + t).alias("end_time"), t.alias("processing_time"), (F.col("event_type") != "error").alias("success"), (k % 7).alias("field_count"), scores.alias("confidence_scores"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of progress(): each has five files that no record names."""
    b = F.col("batch_id")
    got = progress(spark, sf_dir).groupBy("batch_id").agg((F.count_distinct("file_path") + 5).alias("total_files"), (F.max("end_time") - F.min("start_time")).alias("elapsed"))
    return got.select("batch_id", "total_files", _picked(PHASES, b % 4).alias("current_phase"), (b % 10 / F.lit(10.0)).cast("double").alias("current_progress"), "elapsed")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    status = F.when(k % 17 == 0, "cancelled").when(kind.isin("purchase", "click"), "completed").when(kind == "error", "failed").when(kind == "view", "running").otherwise("queued")
    rows = read(spark, sf_dir, "events").select(k.alias("job_id"), k.alias("seq"), (F.col("user_id") % 16).alias("batch_id"), (k % 5 + 1).cast("int").alias("priority"), status.alias("status"), (k * 3).cast("double").alias("created_at"), "value")
    rows = rows.withColumn("started_at", F.when(F.col("status") != "queued", F.col("created_at") + F.col("job_id") % 11))
    return rows.withColumn("completed_at", F.when(F.col("status").isin("completed", "failed", "cancelled"), F.col("started_at") + F.col("value") / 100)).drop("value")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("op_"), F.col("user_id").cast("string")).alias("operation_name"), (F.col("event_id") % 4 + 1).cast("int").alias("attempt_number"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    tenth = lambda by: ((k * by) % 1000 / F.lit(10.0)).cast("double")
    return read(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("host"), k.alias("seq"), tenth(37).alias("memory_percent"), tenth(53).alias("cpu_percent"), ((k * 91) % 20000).cast("double").alias("disk_free_mb"), (k % 12 + 1).alias("threads"))


ERRORS = ("ConnectionError", "TimeoutError", "FileNotFoundError", "PermissionError", "MemoryError", "ValueError", "OSError", "HTTPError", "KeyError")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return read(spark, sf_dir, "events").select(k.alias("event_id"), _picked(ERRORS, k % 9).alias("name"), F.when(k % 9 == 7, 300 + k % 300).alias("status"), F.concat(F.lit("no. "), k.cast("string")).alias("message"), (k % 4 + 1).alias("attempt"))


#: The same tables as SQL.
LOG = """
pr as (select user_id % 16 as batch_id, event_id as seq, 'file_' || user_id as file_path, ['Ingestion', 'OCR', 'Extraction', 'Validation'][event_id % 4 + 1] as phase,
  cast(event_id * 2 as double) as start_time, cast(event_id * 2 as double) + value / 100 as end_time, value / 100 as processing_time, event_type <> 'error' as success, event_id % 7 as field_count,
  case when event_id % 5 = 0 then [] else [cast(event_id * 37 % 100 as double) / 100, cast(event_id * 53 % 100 as double) / 100] end as confidence_scores from events),
ba as (select batch_id, count(distinct file_path) + 5 as total_files, ['Ingestion', 'OCR', 'Extraction', 'Validation'][batch_id % 4 + 1] as current_phase, cast(batch_id % 10 as double) / 10 as current_progress,
  max(end_time) - min(start_time) as elapsed from pr group by batch_id),
do_ as (select batch_id, count(distinct file_path) as done from pr where success group by 1),
bd as (select ba.*, coalesce(done, 0) as done from ba left join do_ using (batch_id)),
firsts as (select batch_id, file_path, min(seq) as s from pr where success group by 1, 2),
ru as (select pr.*, count(*) over w as n, sum(case when seq = s then 1 else 0 end) over w as done, end_time - min(start_time) over w as so_far from pr left join firsts using (batch_id, file_path)
  window w as (partition by batch_id order by seq rows between unbounded preceding and current row)),
rt as (select *, done / greatest(so_far / 60, 0.1) as throughput from ru),
jb as (select *, case when status in ('completed', 'failed', 'cancelled') then started_at + value / 100 end as completed_at from (select *, case when status <> 'queued' then created_at + job_id % 11 end as started_at from (
  select event_id as job_id, event_id as seq, user_id % 16 as batch_id, cast(event_id % 5 + 1 as int) as priority, case when event_id % 17 = 0 then 'cancelled' when event_type in ('purchase', 'click') then 'completed'
  when event_type = 'error' then 'failed' when event_type = 'view' then 'running' else 'queued' end as status, cast(event_id * 3 as double) as created_at, value from events))),
sa as (select user_id % 16 as host, event_id as seq, cast(event_id * 37 % 1000 as double) / 10 as memory_percent, cast(event_id * 53 % 1000 as double) / 10 as cpu_percent, cast(event_id * 91 % 20000 as double) as disk_free_mb,
  event_id % 12 + 1 as threads from events),
er as (select event_id, ['ConnectionError', 'TimeoutError', 'FileNotFoundError', 'PermissionError', 'MemoryError', 'ValueError', 'OSError', 'HTTPError', 'KeyError'][event_id % 9 + 1] as name,
  case when event_id % 9 = 7 then 300 + event_id % 300 end as status, 'no. ' || event_id as message, event_id % 4 + 1 as attempt from events)
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers: an order is a document, its lines are the chunks, each with three extractions, some without confidence."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    one = lambda name, value, score: F.struct(F.lit(name).alias("field"), value.alias("text"), score.cast("double").alias("confidence"))
    found = F.array(one("revenue", F.format_number("l_extendedprice", 2), F.when((k + n) % 3 != 0, F.col("l_discount") * 10)), one("company_name", F.concat("l_returnflag", "l_linestatus"), F.when(n % 4 != 0, F.col("l_tax") * 10)), one("note", F.concat(F.lit("n"), n.cast("string")), F.lit(0.5)))
    return read(spark, sf_dir, "lineitem").select(F.concat(F.lit("doc_"), k.cast("string")).alias("source_file"), (n - 1).alias("chunk"), found.alias("extractions"))


#: The same, one row for each extraction.
ANSWERS = """
an as (select 'doc_' || l_orderkey as source_file, l_linenumber - 1 as chunk, 0 as pos, 'revenue' as field_name, format('{:,.2f}', l_extendedprice) as value, coalesce(case when (l_orderkey + l_linenumber) % 3 <> 0 then l_discount * 10 end, 0.8) as confidence from lineitem
  union all select 'doc_' || l_orderkey, l_linenumber - 1, 1, 'company_name', l_returnflag || l_linestatus, coalesce(case when l_linenumber % 4 <> 0 then l_tax * 10 end, 0.8) from lineitem
  union all select 'doc_' || l_orderkey, l_linenumber - 1, 2, 'note', 'n' || l_linenumber, 0.5 from lineitem)
"""


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with one fault or another: parts of one size are the fields of one template."""
    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, "  ").when(k % 13 == 0, "Data").when(k % 17 == 0, F.repeat(F.lit("x"), 101)).when(k % 7 == 0, F.upper("p_type")).otherwise(F.concat(F.col("p_type"), F.lit(" "), (k % 5).cast("string")))
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("t"), F.col("p_size").cast("string")).alias("template"), k.alias("pos"), name.alias("name"), _picked(("text", "number", "date", "currency"), k % 4).alias("kind"),
        F.when(k % 19 == 0, F.repeat(F.lit("d"), 301)).when(k % 23 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("description"), F.when(k % 3 == 0, "").otherwise("vi-VN").alias("locale"),
    )


TEMPLATES = """
tf as (select 't' || p_size as template, p_partkey as pos, case when p_partkey % 11 = 0 then '  ' when p_partkey % 13 = 0 then 'Data' when p_partkey % 17 = 0 then repeat('x', 101) when p_partkey % 7 = 0 then upper(p_type) else p_type || ' ' || (p_partkey % 5) end as name,
  ['text', 'number', 'date', 'currency'][p_partkey % 4 + 1] as kind, case when p_partkey % 19 = 0 then repeat('d', 301) when p_partkey % 23 = 0 then null else p_name end as description, case when p_partkey % 3 = 0 then '' else 'vi-VN' end as locale from part),
own as (select *, case when trim(name) = '' then 'Tên trường không được để trống' when length(trim(name)) > 100 then 'Tên trường quá dài (' || length(trim(name)) || '/100 ký tự)' when lower(trim(name)) in ('data', 'summary', 'source_file', 'parsed_at') then 'Tên trường "' || trim(name) || '" là từ khóa dành riêng' end as mine from tf),
nth as (select *, count(*) filter (where mine is null) over (partition by template, lower(trim(name)) order by pos rows between unbounded preceding and current row) as k from own),
wrong as (select template, pos, 'name' as part, coalesce(mine, 'Tên trường "' || trim(name) || '" đã tồn tại') as message, 0 as ord from nth where mine is not null or k > 1
  union all select template, pos, 'description', 'Mô tả quá dài (' || length(description) || '/300 ký tự)', 1 from tf where length(description) > 300
  union all select template, pos, 'locale', 'Locale không được để trống cho trường currency', 2 from tf where kind = 'currency' and locale = '')
"""
