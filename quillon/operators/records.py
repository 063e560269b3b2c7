"""Validation of extraction results against a template, and the statistics and reports over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, convert, text
from ..sources.scratch import fresh, written
from . import order


_CONVERT = {"text": lambda v, f: convert.stripped(v), "number": lambda v, f: convert.number(v, f.locale).cast("decimal(38,6)"), "currency": lambda v, f: convert.currency(v, f.locale), "date": lambda v, f: convert.date(v)}


def _judged_field(f, i: int, raw: Column) -> Column:
    """One template field of a result: its raw and typed value, and what is wrong with it. raw is evaluated once, so is its value."""
    absent = F.lit(None if f.optional else f"Required field '{f.name}' is missing or empty").cast("string")

    def build(r: Column) -> Column:
        def with_value(v: Column) -> Column:
            typed = lambda kinds, t: (v if f.kind in kinds else F.lit(None)).cast(t)
            wrong = F.when(convert.is_missing(r), absent).when(v.isNull(), F.lit(f"Field '{f.name}' conversion failed"))
            return F.struct(F.lit(i + 1).alias("pos"), F.lit(f.name).alias("field_name"), F.lit(f.kind).alias("kind"), F.lit(f.optional).alias("optional"), r.alias("raw"), convert.is_missing(r).alias("missing"), typed(["text"], "string").alias("text_value"), typed(["number", "currency"], "decimal(38,6)").alias("number_value"), typed(["date"], "timestamp_ntz").alias("date_value"), wrong.alias("error"))

        return convert.bound(F.when(~convert.is_missing(r), _CONVERT[f.kind](r, f)), with_value)

    return convert.bound(raw, build)


def validated(results: DataFrame, template: Sequence) -> DataFrame:
    """One row per result, unchanged, with `fields` (one struct for each template field, typed) and `errors`: what its fields and
    unexpected fields say, in template order. Every value is converted once: a one-element explode keeps later filters on the errors from
    being pasted below it. No join, no shuffle."""
    names = F.array(*(F.lit(f.name) for f in template))
    data = F.coalesce("data", F.create_map().cast("map<string,string>"))
    fields = F.array(*(_judged_field(f, i, F.try_element_at(data, F.lit(f.name))) for i, f in enumerate(template)))
    more = F.transform(F.array_except(F.map_keys(data), names), lambda k: F.concat(F.lit("Unexpected field '"), k, F.lit("' not in template schema")))
    whole = F.transform(F.array(fields), lambda fs: F.struct(fs.alias("fields"), F.concat(F.filter(F.transform(fs, lambda x: x["error"]), lambda e: e.isNotNull()), more).alias("errors")))
    kept = [c for c in results.columns if c not in ("fields", "errors")]
    (v,) = fresh([*results.columns, "fields", "errors"], "v")
    return results.select(*kept, F.explode(whole).alias(v)).select(*kept, f"{v}.fields", f"{v}.errors")


def _long(rows: DataFrame) -> DataFrame:
    (f,) = fresh(rows.columns, "f")
    return rows.withColumn(f, F.explode("fields")).select(*[c for c in rows.columns if c not in ("fields", "errors")], f"{f}.*")


def observations(results: DataFrame, template: Sequence) -> DataFrame:
    """Long form: one row per result and template field, missing ones included, with typed values and the field's error."""
    return _long(validated(results, template))


def valid_observations(results: DataFrame, template: Sequence) -> DataFrame:
    return _long(validated(results, template).where(F.size("errors") == 0))


def required_missing(results: DataFrame, template: Sequence) -> DataFrame:
    """(the results' columns, field_name): required fields that a result's extraction does not have at all, or has empty."""
    return observations(results, template).where("missing and not optional")


def unexpected_fields(results: DataFrame, template: Sequence) -> DataFrame:
    """The results' columns with field_name: fields that the template does not know."""
    names = F.array(*(F.lit(f.name) for f in template))
    return results.withColumn("field_name", F.explode(F.array_except(F.map_keys("data"), names)))


def failed_rows(rows: DataFrame) -> DataFrame:
    """Validated rows that failed: status failed, no values, the errors as one message."""
    return rows.where("size(errors) > 0").select("source_file", F.lit("failed").alias("status"), F.size("errors").cast("long").alias("n_errors"), joined_error(rows).alias("validation_errors"))


def completed(results: DataFrame) -> DataFrame:
    return results.where("status = 'completed'")


def extracted(results: DataFrame) -> DataFrame:
    """Results with any extracted field."""
    return results.where("size(data) > 0")


def with_confidence(results: DataFrame) -> DataFrame:
    return results.where("size(confidence_scores) > 0")


def timed(results: DataFrame) -> DataFrame:
    return results.where("processing_time > 0")


def processing_counts(rows: DataFrame) -> DataFrame:
    """processing_summary() without the median."""
    ok = (F.size("errors") == 0) & (F.col("status") == "completed")
    t = F.when(F.col("processing_time") > 0, F.col("processing_time"))
    return rows.agg(F.count("*").alias("total_files"), F.count_if(ok).alias("successful_files"), F.count_distinct(F.when(F.size("errors") > 0, F.col("source_file"))).alias("failed_files"), F.coalesce(100.0 * F.count_if(ok) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("success_rate"), F.coalesce(F.sum(t), F.lit(0.0)).alias("total_processing_time"), F.coalesce(F.avg(t), F.lit(0.0)).alias("average_processing_time"))


def processing_summary(rows: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Of validated rows. failed_files are the distinct source files with errors, successful_files the rows that are completed and
    without errors: they need not sum to the total. Times of zero are left out of the averages. `times` are the results that `rows` were
    validated from, if at hand: the median then reads no field."""
    return processing_counts(rows).join(F.broadcast(middle_time(rows if times is None else times)))


def middle_time(rows: DataFrame) -> DataFrame:
    """One row, median_processing_time of the times above zero; 0 without any."""
    middle = order.medians(rows.where("processing_time > 0").select("processing_time"), [], "processing_time", "m")
    return middle.agg(F.coalesce(F.max("m"), F.lit(0.0)).alias("median_processing_time"))


def field_quality(valid: DataFrame) -> DataFrame:
    value = F.coalesce("text_value", F.col("number_value").cast("string"), F.col("date_value").cast("string"))
    n = F.count_if(~F.col("missing"))
    out = valid.groupBy("field_name").agg(F.first("kind").alias("field_type"), F.first("pos").alias("pos"), F.count("*").alias("total_count"), F.count_if("missing").alias("null_count"), F.count_distinct(value).alias("unique_count"), (100.0 * n / F.count("*")).alias("completeness_rate"), n.alias("n"))
    out = out.withColumn("uniqueness_score", F.least(100.0 * F.col("unique_count") / F.greatest("n", F.lit(1)), F.lit(100.0)))
    return out.withColumn("data_quality_score", (F.col("completeness_rate") + F.col("uniqueness_score")) / 2).drop("n")


def numeric_stats(valid: DataFrame) -> DataFrame:
    numbers = valid.where("number_value is not null").select("field_name", F.col("number_value").cast("double").alias("v"))
    # values are counted once, for the medians of all fields and for the rest
    counted = written(numbers.groupBy("field_name", "v").agg(F.count("*").alias("k")))
    n, mean = F.sum("k"), F.sum(F.col("v") * F.col("k")) / F.sum("k")
    means = counted.groupBy("field_name").agg(F.min("v").alias("min_value"), F.max("v").alias("max_value"), n.alias("n"), mean.alias("mean_value"))
    # one row for each field
    far = counted.join(means.select("field_name", "mean_value"), "field_name").groupBy("field_name").agg(F.sum(F.col("k") * F.pow(F.col("v") - F.col("mean_value"), 2)).alias("far"))
    out = means.join(far, "field_name").join(order.medians(counted, ["field_name"], "v", "median_value", weight="k"), "field_name")
    return out.select("field_name", "min_value", "max_value", "mean_value", "median_value", F.coalesce(F.sqrt(F.col("far") / F.nullif(F.col("n") - 1, F.lit(0))), F.lit(0.0)).alias("std_deviation"))


def text_stats(valid: DataFrame) -> DataFrame:
    n = F.length("text_value")
    return valid.where("text_value is not null").groupBy("field_name").agg(F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("avg_length"))


def date_stats(valid: DataFrame) -> DataFrame:
    lo, hi = F.min("date_value"), F.max("date_value")
    return valid.where("date_value is not null").groupBy("field_name").agg(F.date_format(lo, "yyyy-MM-dd").alias("earliest_date"), F.date_format(hi, "yyyy-MM-dd").alias("latest_date"), F.datediff(hi, lo).alias("date_range_days"))


def overall_quality(fields: DataFrame) -> DataFrame:
    score = F.avg("data_quality_score")
    return fields.agg(score.alias("overall_quality_score"), F.count_if(F.col("data_quality_score") < 80).alias("fields_with_issues"), (100.0 * F.sum(F.col("total_count") - F.col("null_count")) / F.sum("total_count")).alias("completeness_rate"), classify.grade(score).alias("quality_grade"))


def joined_error(rows: DataFrame) -> Column:
    return F.concat(F.lit("Validation errors for "), F.col("source_file"), F.lit(": "), F.array_join("errors", "; "))


def error_patterns(rows: DataFrame) -> DataFrame:
    """The first keyword of each failing row's joined message names its kind; the five most frequent."""
    e = F.lower(joined_error(rows))
    kind = F.when(e.contains("missing"), "missing_required_fields").when(e.contains("conversion failed"), "type_conversion_errors").when(e.contains("unexpected field"), "schema_mismatches")
    return rows.where("size(errors) > 0").select(kind.alias("pattern")).where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(5)


def problematic_fields(fields: DataFrame) -> DataFrame:
    issues = F.array_compact(F.array(F.when(F.col("completeness_rate") < 90, F.lit("Low completeness rate")), F.when(F.col("unique_count") < 2, F.lit("Low data diversity"))))
    return fields.where("data_quality_score < 80").select("field_name", F.col("data_quality_score").alias("quality_score"), "completeness_rate", F.array_join(issues, "; ").alias("issues"))


def recommendations(overall: DataFrame, summary: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pos, recommendation) of the rules that hold, in their order. The three inputs have one row, one row and five at most."""
    n = lambda p: F.coalesce(F.max(F.when(F.col("pattern") == p, F.col("n"))), F.lit(0))
    counts = patterns.agg(n("missing_required_fields").alias("missing_n"), n("type_conversion_errors").alias("conversion_n"))
    one = overall.select("overall_quality_score", "completeness_rate").join(F.broadcast(summary.select("success_rate"))).join(F.broadcast(counts))
    # The recommendations.
    rules = [(F.col("overall_quality_score") < 80, "Consider reviewing document quality and OCR settings"), (F.col("missing_n") > 2, "Review extraction prompts for better field detection"), (F.col("conversion_n") > 2, "Verify field type configurations match document formats"), (F.col("completeness_rate") < 85, "Consider improving document preprocessing or extraction templates"), (F.col("success_rate") < 90, "Review failed files for common patterns and adjust processing parameters")]
    return one.select(F.posexplode(F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in rules)))).alias("pos", "recommendation"))


def error_table(rows: DataFrame, most: int = 3) -> DataFrame:
    """Each failing file with the number of its failing rows and the first three messages, those of the least `seq`. A file's messages are
    cut to three before they are shuffled, and only these are gathered."""
    # written once: the values are not converted again for the second look
    bad = written(rows.where("size(errors) > 0").select("source_file", "seq", joined_error(rows).alias("message")))
    counts = bad.groupBy("source_file").agg(F.count("*").alias("error_count"))
    kept = order.first(bad, most, ["seq", "message"], "source_file")
    details = kept.groupBy("source_file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]), "; ").alias("error_details"))
    return counts.join(details, "source_file")


def wide(rows: DataFrame, template: Sequence) -> DataFrame:
    """The data sheet of validated rows: one column per template field, null in rows with errors; typed. A projection, not a pivot."""
    ok = F.size("errors") == 0
    held = {"text": "text_value", "number": "number_value", "currency": "number_value", "date": "date_value"}
    columns = [F.when(ok, F.get("fields", F.lit(i))[held[f.kind]]).alias(f.name) for i, f in enumerate(template)]
    return rows.select("source_file", F.when(ok, F.col("status")).otherwise("failed").alias("status"), "processing_time", *columns)


def coerced(rows: DataFrame, template: Sequence) -> DataFrame:
    """rows with the template's columns as the sheet holds them: numbers and dates, null where they cannot be read; text as it is."""
    kinds = {f.name: f.kind for f in template if f.name in rows.columns}
    read = {"number": lambda c: c.try_cast("double"), "currency": lambda c: c.try_cast("double"), "date": lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), "text": lambda c: c}
    return rows.withColumns({name: read[kind](F.col(name)) for name, kind in kinds.items()}) if kinds else rows


def union_of_fields(results: DataFrame, template: Sequence) -> DataFrame:
    """(field_name) of all results and the template, sorted."""
    spark = results.sparkSession
    own = spark.createDataFrame([(f.name,) for f in template], "field_name string")
    return results.select(F.explode(F.map_keys("data")).alias("field_name")).where("field_name is not null").distinct().unionByName(own).distinct().orderBy("field_name")


def found_fields(results: DataFrame, template: Sequence = (), most: int = 1000) -> list[str]:
    """The names of all fields that any result has, and the template's, sorted; over `most` of them are an error, since each is to be a
    column. Only distinct names come to the driver."""
    rows = union_of_fields(results, template).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} different fields")
    return sorted(r.field_name for r in rows)


def grid(results: DataFrame, names: Sequence[str] | None = None, template: Sequence = ()) -> DataFrame:
    """Files by base name against these fields, by default all that are found, a dash for what is missing. A field called source_file would
    hide the file's own column: it is left to data."""
    names = found_fields(results, template) if names is None else names
    return results.select(text.base_name(F.col("source_file")).alias("source_file"), *(F.coalesce(F.try_element_at("data", F.lit(c)), F.lit("—")).alias(c) for c in names if c != "source_file"))
