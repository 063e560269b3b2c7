"""Queries over progress, queue, retry and resource logs; the events stand for the logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import monitoring, order
from . import fixtures
from .fixtures import LOG, read
from .registry import ORACLES, query, rounded

_PART = "(case when current_phase > 'Extraction' then 0.4 when current_phase = 'Extraction' then 0.4 * current_progress else 0 end + case when current_phase > 'Ingestion' then 0.2 when current_phase = 'Ingestion' then 0.2 * current_progress else 0 end + case when current_phase > 'OCR' then 0.3 when current_phase = 'OCR' then 0.3 * current_progress else 0 end + case when current_phase = 'Validation' then 0.1 * current_progress else 0 end)"
_PERFORMANCE = "(select batch_id, coalesce(done / greatest(elapsed / 60, 0.1), 0) as docs_per_min, fields / greatest(elapsed, 0.1) as fields_per_sec, mean_time, rate as success_rate, coalesce(conf, 0) as avg_confidence from bd join (select batch_id, sum(field_count) as fields, avg(processing_time) as mean_time, avg(case when success then 1.0 else 0.0 end) as rate from pr group by 1) using (batch_id) left join (select batch_id, avg(s) as conf from (select batch_id, unnest(confidence_scores) as s from pr) group by 1) using (batch_id))"
_PERFORMANCE_SHOWN = "batch_id, round(docs_per_min, 6) as docs_per_min, round(fields_per_sec, 6) as fields_per_sec, round(mean_time, 6) as mean_time, round(success_rate, 6) as success_rate, round(avg_confidence, 6) as avg_confidence"


@query(f"select batch_id, round(least(1.0, done / total_files + {_PART} / total_files), 6) as progress from bd", LOG)
def progress_by_phase(spark, sf):
    return rounded(monitoring.batch_progress(fixtures.batches(spark, sf), fixtures.progress(spark, sf)))


_ETA = "(select bd.*, mean from bd join (select batch_id, avg(t) as mean from (select batch_id, file_path, sum(processing_time) as t from (select *, row_number() over (partition by batch_id order by seq desc) as r from pr) where r <= 20 group by 1, 2) group by 1) using (batch_id))"


@query(f"select batch_id, round(mean * (1 - current_progress), 9) as current_eta, round(mean * (1 - current_progress) + (total_files - done - 1) * mean, 9) as batch_eta from {_ETA}", LOG)
def eta_last20(spark, sf):
    return rounded(monitoring.eta(fixtures.batches(spark, sf), fixtures.progress(spark, sf)), 9)  # six places leave halves, which the order of a sum decides


@query("select batch_id, seq, round(so_far / n * greatest(total_files - n, 0), 6) as eta from ru join ba using (batch_id)", LOG)
def basic_eta(spark, sf):
    return rounded(monitoring.basic_eta(fixtures.progress(spark, sf), fixtures.batches(spark, sf)))


@query("select batch_id, m as milestone, min(seq) as reached from (select ru.*, total_files from ru join ba using (batch_id) where success), (select unnest([0.25, 0.5, 0.75, 0.9]::double[]) as m) where done / total_files >= m group by 1, 2", LOG)
def milestones(spark, sf):
    return monitoring.milestones(fixtures.progress(spark, sf), fixtures.batches(spark, sf))


@query("select batch_id, seq, round(baseline, 6) as baseline, round(throughput, 6) as throughput, throughput < baseline * 0.5 as alert from (select *, first_value(case when throughput > 0 then throughput end ignore nulls) over (partition by batch_id order by seq rows between unbounded preceding and 1 preceding) as baseline from rt where n >= 5) where baseline is not null", LOG)
def degradation(spark, sf):
    return rounded(monitoring.degradation(fixtures.progress(spark, sf)))


@query(f"select {_PERFORMANCE_SHOWN} from {_PERFORMANCE}", LOG)
def performance_metrics(spark, sf):
    return rounded(monitoring.performance(fixtures.batches(spark, sf), fixtures.progress(spark, sf)))


@query("select phase, count(*) as n, round(avg(processing_time), 6) as avg_time, min(processing_time) as min_time, max(processing_time) as max_time, round(sum(processing_time), 4) as total_time from pr group by 1", LOG)
def phase_stats(spark, sf):
    out = monitoring.phase_stats(fixtures.progress(spark, sf))
    return out.withColumns({"avg_time": F.round("avg_time", 6), "total_time": F.round("total_time", 4)})


@query(f"select {_PERFORMANCE_SHOWN}, total_files, round(elapsed, 6) as elapsed, round(least(1.0, done / total_files + {_PART} / total_files), 6) as progress, ocr from {_PERFORMANCE} join bd using (batch_id) left join (select batch_id, count(*) as ocr from pr where phase = 'OCR' group by 1) using (batch_id)", LOG)
def processing_overview(spark, sf):
    out = monitoring.summary(fixtures.batches(spark, sf), fixtures.progress(spark, sf))
    return rounded(out.withColumn("ocr", F.try_element_at("phases", F.lit("OCR"))["n"]).drop("phases"))


@query("select batch_id, case when e <= 0 then 'Calculating...' when e >= 60 then cast(floor(e / 60) as bigint) || 'm ' || cast(floor(e) as bigint) % 60 || 's' else cast(floor(e) as bigint) || 's' end as eta, 'Processing ' || done || '/' || total_files || ' files | Elapsed: ' || cast(floor(elapsed / 60) as bigint) || ':' || lpad(cast(cast(floor(elapsed) as bigint) % 60 as varchar), 2, '0') || ' | Est. remaining: ' || cast(floor(e / 60) as bigint) || ' min' as line from (select *, round(mean * (1 - current_progress) + (total_files - done - 1) * mean, 6) as e from " + _ETA + ")", LOG)
def progress_text(spark, sf):
    batches, log = fixtures.batches(spark, sf), fixtures.progress(spark, sf)
    rows = batches.join(rounded(monitoring.eta(batches, log)), "batch_id").join(monitoring.done_files(log), "batch_id")
    return rows.select("batch_id", text.eta_shown(F.col("batch_eta")).alias("eta"), text.status_line(F.col("done"), F.col("total_files"), F.col("elapsed"), F.col("batch_eta")).alias("line"))


@query("select event_id, format('{:.1f} docs/min, {:.1f} fields/sec', cast(event_id % 77 as double), cast(event_id % 50 as double) / 2) as said from events")
def throughput_text(spark, sf):
    return read(spark, sf, "events").select("event_id", text.throughput_shown((F.col("event_id") % 77).cast("double"), (F.col("event_id") % 50) / 2).alias("said"))


@query("select host, seq from (select host, seq, row_number() over (partition by host order by seq desc) as r from sa) where r <= 50", LOG)
def performance_history(spark, sf):
    return order.last(fixtures.samples(spark, sf), 50, "seq", "host").select("host", "seq")


@query("select host, seq from (select host, seq, row_number() over (partition by host order by seq desc) as r from sa) where r <= 10", LOG)
def retention_top10(spark, sf):
    return order.last(fixtures.samples(spark, sf), 10, "seq", "host").select("host", "seq")


# queue
@query("select batch_id, count(*) as total_jobs, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in monitoring.STATUSES) + ", round(100.0 * count(*) filter (where status in ('completed', 'failed', 'cancelled')) / count(*), 6) as progress, count(*) filter (where status in ('completed', 'failed', 'cancelled')) = count(*) as is_complete from jb group by 1", LOG)
def batch_progress(spark, sf):
    jobs = fixtures.jobs(spark, sf)
    over = F.col("status").isin("completed", "failed", "cancelled")
    return rounded(monitoring.queue_progress(jobs.select("batch_id", "job_id"), jobs.where(~over), jobs.where(over)))


@query("select (select count(*) from jb where completed_at is not null) as total, (select count(*) from jb where status = 'completed') as completed, (select count(*) from jb where status = 'failed') as failed, (select count(*) from jb where status = 'cancelled') as cancelled, round(avg(completed_at - started_at), 6) as avg_time, round(avg(started_at - created_at), 6) as avg_wait, round(count(*) / ((max_by(completed_at, seq) - min_by(created_at, seq)) / 3600), 6) as per_hour from (select * from jb where completed_at is not null order by seq desc limit 50)", LOG)
def queue_stats_last50(spark, sf):
    return rounded(monitoring.queue_stats(fixtures.jobs(spark, sf)))


@query("select o_orderkey, row_number() over (order by o_orderpriority desc, o_orderdate, o_orderkey) as rank from orders order by 2")
def priority_order(spark, sf):
    return monitoring.priority_order(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), priority="o_orderpriority", created="o_orderdate", key="o_orderkey").select("o_orderkey", "rank")


@query("select event_id, case when q > w * 2 and w < 8 then 'scale_up' when q = 0 and a < w // 2 and w > 1 then 'scale_down' end as action from (select event_id, event_id % 5 * 4 as q, event_id % 4 as a, event_id % 9 as w from events)")
def scaling_decision(spark, sf):
    k = F.col("event_id")
    return read(spark, sf, "events").select("event_id", classify.scaling(k % 5 * 4, k % 4, k % 9).alias("action"))


# retries and errors
@query("select count(*) as operations, cast(sum(n) as bigint) as attempts, count(*) filter (where l >= 3) as failed, round(count(*) filter (where l < 3) / count(*), 6) as success_rate, round(sum(n) / count(*), 6) as average_attempts from (select user_id, count(*) as n, max_by(event_id % 4 + 1, event_id) as l from events group by 1)")
def retry_stats(spark, sf):
    return rounded(monitoring.retry_stats(fixtures.attempts(spark, sf)))


@query("select event_id, cast(least(pow(2, event_id % 10), 60) as double) as delay from events")
def retry_delay(spark, sf):
    return read(spark, sf, "events").select("event_id", classify.retry_delay(F.col("event_id") % 10 + 1).alias("delay"))


_CLASS = "case when name in ('ConnectionError', 'TimeoutError') then 'temporary' when name in ('FileNotFoundError', 'PermissionError') then 'permanent' when name = 'MemoryError' then 'critical' when status >= 400 and status < 500 then 'permanent' else 'temporary' end"


@query(f"select event_id, name, {_CLASS} as class from er", LOG)
def error_class(spark, sf):
    return monitoring.error_rows(fixtures.errors(spark, sf)).select("event_id", "name", "class")


@query(f"select event_id, {_CLASS} = 'temporary' and attempt < 3 and name in ('ConnectionError', 'TimeoutError', 'OSError') as retry from er", LOG)
def should_retry(spark, sf):
    return monitoring.error_rows(fixtures.errors(spark, sf)).select("event_id", "retry")


@query("select event_id, case name when 'FileNotFoundError' then 'file_access' when 'PermissionError' then 'file_access' when 'ConnectionError' then 'api_error' when 'ValueError' then 'validation_error' else 'configuration_error' end as category, case when name in ('FileNotFoundError', 'PermissionError', 'ConnectionError', 'ValueError') then 'medium' else 'high' end as severity, case name when 'FileNotFoundError' then 'File not found: ' when 'PermissionError' then 'Permission denied: ' when 'ConnectionError' then 'Network connection error: ' when 'ValueError' then 'Invalid value: ' else 'Unexpected error: ' end || message as reported from er", LOG)
def error_kind(spark, sf):
    return monitoring.error_rows(fixtures.errors(spark, sf)).select("event_id", "category", "severity", "reported")


@query("select event_id, message || case when event_id % 3 = 0 then '' when event_id % 3 = 1 then chr(10) || chr(10) || 'Suggestions:' || chr(10) || '• ' || name else chr(10) || chr(10) || 'Suggestions:' || chr(10) || '• ' || name || chr(10) || '• again' end as said from er", LOG)
def error_text(spark, sf):
    k = F.col("event_id")
    tips = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array("name")).otherwise(F.array(F.col("name"), F.lit("again")))
    return fixtures.errors(spark, sf).select("event_id", text.error_text(F.col("message"), tips).alias("said"))


# resources
_MEM = "case when memory_percent > 80 then 'MEMORY_CRITICAL' when memory_percent > 70 then 'MEMORY_WARNING' end"
_CPU = "case when cpu_percent > 90 then 'CPU_CRITICAL' when cpu_percent > 70 then 'CPU_WARNING' end"
_STATUS = f"coalesce(nullif(concat_ws(', ', {_MEM}, {_CPU}, case when disk_free_mb < 1000 then 'DISK_CRITICAL' end), ''), 'NORMAL')"


@query(f"select host, seq, {_STATUS} as status, case when memory_percent > 75 then 'critical' when memory_percent > 60 then 'warning' else 'normal' end as pressure from sa", LOG)
def resource_status(spark, sf):
    return fixtures.samples(spark, sf).select("host", "seq", monitoring.resource_status(F.col("memory_percent"), F.col("cpu_percent"), F.col("disk_free_mb")).alias("status"), classify.memory_pressure(F.col("memory_percent")).alias("pressure"))


_CRITICAL = "(memory_percent > 80 or cpu_percent > 90 or disk_free_mb < 1000)"


@query(f"select host, seq, 'critical' as level, format('Memory usage critical: {{:.1f}}% (limit: 80.0%)', memory_percent) as message from sa where memory_percent > 80 union all select host, seq, 'critical', format('CPU usage critical: {{:.1f}}% (limit: 90.0%)', cpu_percent) from sa where cpu_percent > 90 union all select host, seq, 'critical', format('Disk space critical: {{:.0f}}MB free (threshold: 1000MB)', disk_free_mb) from sa where disk_free_mb < 1000 union all select host, seq, 'warning', format('Memory usage high: {{:.1f}}% (warning at: 70.0%)', memory_percent) from sa where memory_percent > 70 and not {_CRITICAL} union all select host, seq, 'warning', format('CPU usage high: {{:.1f}}% (warning at: 70.0%)', cpu_percent) from sa where cpu_percent > 70 and not {_CRITICAL}", LOG)
def resource_alerts(spark, sf):
    return monitoring.alerts(fixtures.samples(spark, sf))


_ROOM = "(select *, memory_percent > 80 or cpu_percent > 90 as tight, n >= 5 and mm < 56 and mc < 56 and threads < 8 as room from (select *, row_number() over w as n, avg(memory_percent) over (partition by host order by seq rows between 4 preceding and current row) as mm, avg(cpu_percent) over (partition by host order by seq rows between 4 preceding and current row) as mc from sa window w as (partition by host order by seq)))"


@query(f"select host, seq, round(mm, 6) as mean_memory, round(mc, 6) as mean_cpu, room as has_room, case when n >= 3 and tight then 'scale_down' when n >= 3 and room then 'scale_up' end as action, cast(case when n >= 3 and tight then greatest(1, floor(threads * 0.7::double)) when n >= 3 and room then floor(threads * 1.5::double) end as bigint) as recommended_threads from {_ROOM}", LOG)
def headroom_last5(spark, sf):
    return rounded(monitoring.headroom(fixtures.samples(spark, sf)).select("host", "seq", "mean_memory", "mean_cpu", "has_room", "action", "recommended_threads"))


@query("select host, seq, round(memory_percent - lag(memory_percent) over (partition by host order by seq), 6) as trend from sa", LOG)
def memory_trend(spark, sf):
    return rounded(monitoring.memory_trend(fixtures.samples(spark, sf)))


_THREADS = "cast(least(case when cpu_percent > 70 then greatest(1, floor(case when memory_percent > 70 then 4 else 8 end * 0.7::double)) else case when memory_percent > 70 then 4 else 8 end end, 8) as bigint)"


@query(f"select host, seq, {_THREADS} as threads from sa", LOG)
def optimal_threads(spark, sf):
    return fixtures.samples(spark, sf).select("host", "seq", monitoring.optimal_threads(F.col("memory_percent"), F.col("cpu_percent"), 8).cast("long").alias("threads"))


@query(f"select host, memory_percent, cpu_percent, disk_free_mb, threads, round(mean_memory, 6) as mean_memory, round(mean_cpu, 6) as mean_cpu, {_STATUS} as status, {_THREADS} as optimal_threads, {_CRITICAL} as should_scale_down from (select *, avg(memory_percent) over (partition by host) as mean_memory, avg(cpu_percent) over (partition by host) as mean_cpu from (select *, row_number() over (partition by host order by seq desc) as r from sa) where r <= 10) where r = 1", LOG)
def resource_summary(spark, sf):
    return rounded(monitoring.resource_summary(fixtures.samples(spark, sf)))


def _facts(section: str, sql: str, key: str | None) -> str:
    """The SQL of a summary as rows of facts; texts are told apart by name."""
    texts = ("status",)
    keyed = f"cast({key} as varchar)" if key else "''"
    rows = f"select {keyed} as key, columns(lambda c: c not in ('{key}', 'status')) from ({sql})"
    numbers = f"select '{section}' as section, key, fact, value, null as said from (unpivot (select key, cast(columns(lambda c: c <> 'key') as double) from ({rows})) on columns(lambda c: c <> 'key') into name fact value value)"
    return numbers + (f" union all select '{section}', {keyed}, 'status', null, status from ({sql})" if section == "resources" else "")


@query(" union all ".join(_facts(*x) for x in (("retry", ORACLES["retry_stats"], None), ("queue", ORACLES["queue_stats_last50"], None), ("resources", ORACLES["resource_summary"], "host"), ("processing", ORACLES["performance_metrics"], "batch_id"))))
def enhanced_statistics(spark, sf):
    return rounded(monitoring.enhanced_statistics(fixtures.batches(spark, sf), fixtures.progress(spark, sf), fixtures.jobs(spark, sf), fixtures.attempts(spark, sf), fixtures.samples(spark, sf)))


@query("select doc_id, round(c, 6) as complexity, round(c * 60, 6) as duration from (select doc_id, case doc_id % 3 when 0 then 1.0 when 1 then 0.8 else 1.2 end * case when mb <= 1 then 1.0 when mb <= 5 then 1.2 when mb <= 10 then 1.5 when mb <= 50 then 2.0 else 3.0 end as c from (select doc_id, coalesce(n_chars / 1024.0, 5) as mb from documents))")
def complexity(spark, sf):
    extension = F.element_at(F.array(F.lit("pdf"), F.lit("docx"), F.lit("png")), (F.col("doc_id") % 3 + 1).cast("int"))
    hard = classify.complexity(extension, F.col("n_chars") * 1024)
    return rounded(read(spark, sf, "documents").select("doc_id", hard.alias("complexity"), classify.duration(hard).alias("duration")))
