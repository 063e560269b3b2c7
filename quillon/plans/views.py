"""Queries over confidence, previews, extraction answers and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import confidence, extraction, order, records, templates
from ..operators.templates import Field
from . import fixtures
from .fixtures import ANSWERS, TEMPLATE, TEMPLATES, results
from .registry import query, rounded

_R = "round({0}, 6)"
_BANDS = "case when {0} >= 0.8 then 'high' when {0} >= 0.5 then 'medium' else 'low' end"
_LEVEL = "case when {0} >= 0.95 then 'excellent' when {0} >= 0.8 then 'good' when {0} >= 0.6 then 'fair' else 'poor' end"
_FULL = "case when raw is null or trim(raw) = '' then 0.0 else 1.0 end"
_GIVEN = "case when raw is null or raw = '' then 0.0 else 1.0 end"
_HAS_DATA = "seq % 37 <> 0"
_QUALITY = f"(select field_name, pos, avg({_FULL}) as c, cast(sum({_FULL}) as bigint) as extracted, count(*) as total, coalesce(avg(score), 0) as conf, min(score) as lo, max(score) as hi from obs where {_HAS_DATA} group by 1, 2)"


# extraction answers
@query("select source_file, chunk, pos, field_name, value, confidence from an", ANSWERS)
def flatten_extractions(spark, sf):
    return extraction.flattened(fixtures.answers(spark, sf))


@query("select source_file, field_name, value, confidence from (select *, row_number() over (partition by source_file, field_name order by chunk desc, pos desc, value desc, confidence desc) as r from an) where r = 1", ANSWERS)
def extract_last_wins(spark, sf):
    return extraction.last_wins(fixtures.answers(spark, sf))


@query("select source_file, field_name, value, confidence from (select *, row_number() over (partition by source_file, field_name order by confidence desc, chunk, pos, value) as r from an) where r = 1", ANSWERS)
def merge_best_confidence(spark, sf):
    return extraction.merged(fixtures.answers(spark, sf))


@query("select source_file, chunk, pos, confidence from an", ANSWERS)
def default_confidence(spark, sf):
    return extraction.flattened(fixtures.answers(spark, sf)).select("source_file", "chunk", "pos", "confidence")


@query("select source_file, field_name, case field_name when 'company_name' then 'text' when 'revenue' then 'currency' end as kind, case field_name when 'revenue' then replace(value, ',', '') else value end as v from an", ANSWERS)
def extraction_types(spark, sf):
    out = extraction.typed(extraction.flattened(fixtures.answers(spark, sf)), TEMPLATE)
    # the text of a double is its shortest one; the SQL has two places
    shown = F.when(F.col("kind") == "currency", F.col("coerced").cast("decimal(20,2)").cast("string")).otherwise(F.col("coerced"))
    return out.select("source_file", "field_name", "kind", shown.alias("v"))


@query("select source_file, list_sort(list(field_name))::varchar as fields, 'order_date' as missing from (select distinct source_file, field_name from an) group by 1", ANSWERS)
def result_shape(spark, sf):
    out = extraction.as_results(extraction.merged(fixtures.answers(spark, sf)), TEMPLATE)
    return out.select("source_file", F.concat(F.lit("["), F.array_join(F.array_sort(F.map_keys("data")), ", "), F.lit("]")).alias("fields"), F.array_join("missing_fields", ",").alias("missing"))


@query()
def rule_extract(spark, sf):
    """The prompt's own provider over documents that are made of the results' data, a line for each field."""
    said = F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
    docs = results(spark, sf).select("source_file", said.alias("text"))
    return extraction.extract(docs, TEMPLATE, extraction.rule_provider(TEMPLATE)).select("source_file", "status", F.to_json("data").alias("data"), F.array_join("missing_fields", ",").alias("missing"))


@query()
def simulated_extract(spark, sf):
    out = extraction.simulated(results(spark, sf).select("source_file"), TEMPLATE)
    return out.select("source_file", F.to_json("data").alias("data"), F.to_json("confidence_scores").alias("scores"))


# confidence
@query("select seq, field_name, score from scores", True)
def explode_confidences(spark, sf):
    return confidence.exploded(results(spark, sf)).select("seq", "field_name", "score")


@query("select seq, field_name, coalesce(score, 0.0) as score from obs", True)
def field_confidence(spark, sf):
    return confidence.with_default(results(spark, sf), TEMPLATE).select("seq", "field_name", "score")


@query(f"select seq, source_file from fx where {_HAS_DATA}", True)
def extracted_results(spark, sf):
    return records.extracted(results(spark, sf)).select("seq", "source_file")


@query("select seq, source_file from fx where seq % 31 <> 0", True)
def results_with_confidence(spark, sf):
    return records.with_confidence(results(spark, sf)).select("seq", "source_file")


@query("select seq, source_file from fx where status = 'completed' and processing_time > 0", True)
def completed_and_timed(spark, sf):
    return records.timed(records.completed(results(spark, sf))).select("seq", "source_file")


_MEANS = "(select seq, round(coalesce(avg(score) filter (where score > 0), 0.0), 9) as c from scores group by 1)"
_LEVELS = "case when {0} >= 0.8 then 'high' when {0} >= 0.5 then 'medium' when {0} > 0 then 'low' else 'missing' end"


@query(f"select 'order_' || seq || '.pdf' as source_file, round(c, 6) as confidence, {_LEVELS.format('c')} as level, case when c >= 0.8 then 'high' when c >= 0.6 then 'medium' when c > 0 then 'low' else 'none' end as colour, cast(floor(c * 5) as bigint) as dots from {_MEANS}", True)
def file_confidence(spark, sf):
    c = F.col("confidence")
    return rounded(confidence.file_means(results(spark, sf)).select("source_file", c, classify.confidence_level(c).alias("level"), classify.grid_colour(c).alias("colour"), classify.dots(c).alias("dots")))


@query(f"select round(avg(c), 6) as mean, round(min(c), 6) as min, round(max(c), 6) as max, count(*) filter (where c >= 0.8) as high, count(*) filter (where c >= 0.5 and c < 0.8) as medium, count(*) filter (where c < 0.5) as low from {_MEANS}", True)
def confidence_summary(spark, sf):
    return rounded(confidence.summary(results(spark, sf)))


@query(f"select {_BANDS.format('score')} as band, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as share from scores where status = 'completed' group by 1", True)
def confidence_bands(spark, sf):
    return rounded(confidence.distribution(results(spark, sf)))


@query("select field_name, round(avg(score), 6) as mean_score from scores where score > 0 group by 1 order by 2 desc limit 3", True)
def top3_fields(spark, sf):
    return rounded(confidence.top_fields(results(spark, sf)))


@query("select round(avg(score), 6) as confidence, case when avg(score) >= 0.9 then 'Excellent' when avg(score) >= 0.8 then 'Good' when avg(score) >= 0.7 then 'Fair' else 'Needs Improvement' end as label from scores where status = 'completed'", True)
def overall_confidence(spark, sf):
    return rounded(confidence.overall(results(spark, sf)))


@query(f"select row_number() over (order by seq) - 1 as i, seq, round(c, 6) as confidence from {_MEANS}", True)
def confidence_trend(spark, sf):
    return rounded(order.numbered(confidence.file_means(results(spark, sf)).select("seq", "confidence"), "seq").select("i", "seq", "confidence"))


@query("select seq, i from (select seq, row_number() over (order by seq) - 1 as i, count(*) over () as n from fx) where n <= 10 or i % greatest(1, n // 8) = 0", True)
def axis_marks(spark, sf):
    return order.axis_marks(results(spark, sf).select("seq"), "seq").select("seq", "i")


# completeness and previews
@query(f"select field_name, round(c, 6) as completeness, extracted as extracted_count, total as total_count, round(conf, 6) as avg_confidence, {_LEVEL.format('c')} as level from {_QUALITY}", True)
def quality_metrics(spark, sf):
    return rounded(confidence.quality_by_field(results(spark, sf), TEMPLATE).drop("pos"))


@query(f"select max(total) as total_files, round(avg(c), 6) as avg_completeness, {_LEVEL.format('avg(c)')} as overall_quality, " + ", ".join(f"count(*) filter (where {_LEVEL.format('c')} = '{x}') as {x}" for x in ("excellent", "good", "fair", "poor")) + f" from {_QUALITY}", True)
def quality_overview(spark, sf):
    return rounded(confidence.quality_overall(confidence.quality_by_field(results(spark, sf), TEMPLATE)))


@query(f"select max_by(field_name, c * 1000 - pos) as best_field, min_by(field_name, c * 1000 + pos) as worst_field, round(max(c) - min(c), 6) as score_range from {_QUALITY}", True)
def best_worst_field(spark, sf):
    return rounded(confidence.best_and_worst(confidence.quality_by_field(results(spark, sf), TEMPLATE)))


@query(f"select field_name, round(c, 6) as completeness, round(conf, 6) as avg_confidence, coalesce(lo, 0) as min_confidence, coalesce(hi, 0) as max_confidence, case when extracted > 0 then 'str' else '' end as types from {_QUALITY} order by c desc, pos", True)
def field_distribution(spark, sf):
    return rounded(confidence.field_distribution(results(spark, sf), TEMPLATE).drop("pos", "kind", "optional"))


@query(f"select field_name, round(avg({_GIVEN}), 6) as completeness, case when avg({_GIVEN}) >= 0.9 then 'high' when avg({_GIVEN}) >= 0.7 then 'medium' else 'required_low' end as band from obs where status = 'completed' group by 1", True)
def completeness_bands(spark, sf):
    return rounded(confidence.completeness_bands(results(spark, sf), TEMPLATE).select("field_name", "completeness", "band"))


@query(f"select field_name, round(avg({_GIVEN}), 6) as completeness, round(coalesce(avg(coalesce(score, 0.0)) filter (where raw <> ''), 0.0), 6) as mean_confidence from obs where status = 'completed' group by 1", True)
def preview_field_stats(spark, sf):
    return rounded(confidence.preview_stats(results(spark, sf), TEMPLATE))


@query("select seq, field_name, case when raw is null or raw = '' then 'missing' when coalesce(score, 0) >= 0.8 then 'high' when coalesce(score, 0) >= 0.5 then 'medium' else 'low' end as section, case when raw is null or raw = '' then '⚠ Required field missing' when coalesce(score, 0) < 0.5 then '⚠ Low confidence - please verify' when coalesce(score, 0) < 0.7 then 'ℹ Medium confidence' end as status_text from obs", True)
def preview_sections(spark, sf):
    return confidence.preview_sections(results(spark, sf), TEMPLATE)


@query("select seq, count(raw) as extracted_fields, count(*) as total_fields, round(coalesce(avg(score), 0.0), 6) as avg_confidence from obs group by 1", True)
def file_preview_stats(spark, sf):
    return rounded(confidence.file_stats(results(spark, sf), TEMPLATE).drop("source_file"))


@query("select count(*) as total, count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed, round(avg(processing_time) filter (where status = 'completed'), 6) as mean_time from fx", True)
def summary_header(spark, sf):
    return rounded(confidence.header(results(spark, sf)))


@query("select count(*) as total, count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed, (select round(avg(score), 6) from scores) as confidence, round(sum(processing_time), 6) as total_time from fx", True)
def simple_summary(spark, sf):
    return rounded(confidence.simple_summary(results(spark, sf)))


@query("select count(*) as total, count(*) filter (where processing_time > 0) as completed, count(*) filter (where processing_time <= 0) as failed, round(count(*) filter (where processing_time > 0) / count(*), 6) as success_rate, round(count(*) filter (where processing_time <= 0) / count(*), 6) as error_rate, round(avg(processing_time) filter (where processing_time > 0), 6) as mean_time, min(processing_time) filter (where processing_time > 0) as min_time, max(processing_time) as max_time, round(sum(processing_time), 6) as total_time, round(60.0 * count(*) filter (where processing_time > 0) / sum(processing_time), 6) as per_minute from fx", True)
def processing_metrics(spark, sf):
    return rounded(confidence.processing_metrics(results(spark, sf)))


@query("select case when r > 0.9 then 'Good' when r > 0.7 then 'Fair' else 'Poor' end as performance from (select count(*) filter (where processing_time > 0) / count(*) as r from fx)", True)
def performance_label(spark, sf):
    return confidence.processing_metrics(results(spark, sf)).select(classify.performance(F.col("success_rate")).alias("performance"))


@query("select cast(least(floor((processing_time - lo) * bins / (hi - lo)), bins - 1) as int) as bin, count(*) as n from fx, (select min(processing_time) as lo, max(processing_time) as hi, least(count(*), 10) as bins from fx where processing_time > 0) where processing_time > 0 group by 1", True)
def time_histogram(spark, sf):
    return confidence.time_histogram(results(spark, sf))


@query("select source_file, coalesce(company_name, '—') as company_name, coalesce(note, '—') as note, coalesce(order_date, '—') as order_date, coalesce(revenue, '—') as revenue from fx", True)
def result_grid(spark, sf):
    """No field is named: the columns are what the results hold."""
    return records.grid(results(spark, sf))


@query("select distinct field_name from (select field_name from obs union all select 'note' from fx where note is not null) order by 1", True)
def field_union(spark, sf):
    return records.union_of_fields(results(spark, sf), TEMPLATE)


@query("select source_file, case when processing_time <= 0 then null when processing_time < 2 then 'Fast' when processing_time < 5 then 'Normal' else 'Slow' end as speed from fx", True)
def speed_labels(spark, sf):
    return results(spark, sf).select("source_file", classify.speed(F.col("processing_time")).alias("speed"))


@query("select source_file, case when s = 'completed' then 'Processing completed successfully' when s = 'processing' then 'Currently processing...' when s = 'failed' then 'Processing failed' when s = 'pending' then 'Waiting to be processed' when s = 'cancelled' then 'Processing was cancelled' else 'Unknown status' end as said from (select source_file, ['completed', 'processing', 'failed', 'pending', 'cancelled', 'lost'][seq % 6 + 1] as s from fx)", True)
def status_texts(spark, sf):
    s = F.element_at(F.array(*map(F.lit, ("completed", "processing", "failed", "pending", "cancelled", "lost"))), (F.col("seq") % 6 + 1).cast("int"))
    return results(spark, sf).select("source_file", classify.status_text(s).alias("said"))


@query("select o_orderkey, format('${:,.2f}', o_totalprice) as currency, format('{:,}', o_custkey) as whole, case when o_totalprice = floor(o_totalprice) then format('{:,.0f}', o_totalprice) else format('{:,.1f}', round_even(o_totalprice, 1)) end as number, case when length(t) > 50 then t[1:47] || '... (' || length(t) || ' chars)' else t end as long_text, coalesce(nullif(o_orderstatus, 'F'), 'N/A') as missing from (select *, repeat(o_orderpriority, cast(o_orderkey % 9 as int)) as t from orders)")
def value_formats(spark, sf):
    rows = fixtures.read(spark, sf, "orders")
    price = F.col("o_totalprice")
    return rows.select("o_orderkey", text.value_shown(price, "currency").alias("currency"), text.value_shown(F.col("o_custkey"), "number", whole=True).alias("whole"), text.value_shown(price, "number").alias("number"), text.value_shown(F.repeat("o_orderpriority", (F.col("o_orderkey") % 9).cast("int")), "text").alias("long_text"), text.value_shown(F.nullif("o_orderstatus", F.lit("F")), "text").alias("missing"))


@query("select o_orderkey, format('{:,.2f}', o_totalprice) as number, format('{:,.0f} ₫', o_totalprice) as currency, strftime(o_orderdate, '%d/%m/%Y') as date, left(repeat(o_orderpriority, 9), 50) as text, 'N/A' as none from orders")
def stat_formats(spark, sf):
    price = F.col("o_totalprice")
    return fixtures.read(spark, sf, "orders").select("o_orderkey", text.stat_shown(price, "number").alias("number"), text.stat_shown(price, "currency").alias("currency"), text.stat_shown(F.col("o_orderdate"), "date").alias("date"), text.stat_shown(F.repeat("o_orderpriority", F.lit(9)), "text").alias("text"), text.stat_shown(F.lit(None).cast("double"), "number").alias("none"))


# templates
@query("select template, pos, part, message from wrong", TEMPLATES)
def editor_errors(spark, sf):
    return templates.editor_errors(fixtures.templates(spark, sf)).drop("order")


@query("select template, array_to_string(list('Row ' || (pos + 1) || ': ' || message order by pos, ord)[1:3], ' • ') || case when count(*) > 3 then ' • and ' || (count(*) - 3) || ' more...' else '' end as banner from wrong group by 1", TEMPLATES)
def error_banner(spark, sf):
    return templates.error_banner(templates.editor_errors(fixtures.templates(spark, sf)))


@query("select template, case when count(distinct name) < count(*) then 'Template field names must be unique' when min(i) filter (where trim(name) = '') <= coalesce(min(i) filter (where description is null), 1e9) then 'Field ' || min(i) filter (where trim(name) = '') || ' name must be a non-empty string' else 'Field ' || min(i) filter (where description is null) || ' description must be a string' end as problem from (select *, row_number() over (partition by template order by pos) as i from (select template || '/' || pos // 40 as template, pos, name, description from tf)) group by 1 having count(distinct name) < count(*) or count(*) filter (where trim(name) = '' or description is null) > 0", TEMPLATES)
def template_problems(spark, sf):
    rows = fixtures.templates(spark, sf).withColumn("template", F.concat("template", F.lit("/"), F.floor(F.col("pos") / 40).cast("string")))
    fields = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "description"))), lambda f: F.struct(f["name"].alias("name"), f["description"].alias("description")))
    return templates.structural_problems(rows.groupBy("template").agg(fields.alias("fields")).withColumn("prompt_description", F.lit("")))


_VALUES = {"kind": ("event_type", "event_type"), "count": ("cast(event_id as varchar)", "cast(event_id as string)"), "amount": ("case when event_id % 3 = 0 then cast(event_id as varchar) else cast(event_id as varchar) || '.5' end", "case when event_id % 3 = 0 then cast(event_id as string) else concat(event_id, '.5') end"), "flag": ("case when event_id % 2 = 0 then 'true' else '  ' end", "case when event_id % 2 = 0 then 'true' else '  ' end"), "items": ("case when event_id % 5 = 0 then '[' || event_id || ']' when event_id % 5 = 1 then '{\"a\": 1}' when event_id % 5 = 2 then 'null' when event_id % 5 = 3 then '\"text\"' else 'not [json' end", "case when event_id % 5 = 0 then concat('[', event_id, ']') when event_id % 5 = 1 then '{\"a\": 1}' when event_id % 5 = 2 then 'null' when event_id % 5 = 3 then '\"text\"' else 'not [json' end")}
_TYPE = "case when not json_valid(v) then 'str' else case json_type(cast(v as json)) when 'UBIGINT' then 'int' when 'BIGINT' then 'int' when 'DOUBLE' then 'float' when 'BOOLEAN' then 'bool' when 'NULL' then 'NoneType' when 'ARRAY' then 'list' when 'OBJECT' then 'dict' else 'str' end end"


@query("select field_name, string_agg(distinct t, ',' order by t) as types from (select field_name, " + _TYPE + " as t from (" + " union all ".join(f"select '{n}' as field_name, {v[0]} as v from events" for n, v in _VALUES.items()) + ") where trim(v) <> '') group by 1")
def field_types(spark, sf):
    """Values that come as JSON text, of several types in one field."""
    data = F.create_map(*(x for n, v in _VALUES.items() for x in (F.lit(n), F.expr(v[1]))))
    rows = fixtures.read(spark, sf, "events").select(data.alias("data"), F.create_map().cast("map<string,double>").alias("confidence_scores"))
    return confidence.field_distribution(rows, tuple(Field(n) for n in _VALUES)).select("field_name", "types")
