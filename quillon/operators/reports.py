"""The workbook's Summary sheet and the quality report, as rows of text and numbers. Inputs are the frames of `records`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import records


def _fixed(v: Column, places: int, unit: str = "") -> Column:
    """With so many places, halves to the even digit; null is zero."""
    return F.concat(F.format_string(f"%.{places}f", F.bround(F.coalesce(v, F.lit(0.0)), places)), F.lit(unit))


def _rows(one: DataFrame, section: str, labelled: Sequence[tuple[str, Column]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), value.alias("value")) for i, (label, value) in enumerate(labelled, 1)))
    return one.select(F.lit(section).alias("section"), F.explode(rows).alias("x")).select("section", "x.*")


def processing_block(summary: DataFrame) -> DataFrame:
    """(section, pos, label, value) of processing_summary()."""
    count = lambda c: F.col(c).cast("string")
    return _rows(summary, "Processing Summary", [
        ("Total Files", count("total_files")), ("Successful Files", count("successful_files")), ("Failed Files", count("failed_files")), ("Success Rate", _fixed(F.col("success_rate"), 1, "%")),
        ("Total Processing Time", _fixed(F.col("total_processing_time"), 2, "s")), ("Average Processing Time", _fixed(F.col("average_processing_time"), 2, "s")), ("Median Processing Time", _fixed(F.col("median_processing_time"), 2, "s")),
    ])


def quality_block(overall: DataFrame) -> DataFrame:
    """(section, pos, label, value) of overall_quality(). Consistency and error rate are nowhere computed and always 0."""
    zero = F.lit(0.0)
    return _rows(overall, "Data Quality Summary", [("Overall Quality Score", _fixed(F.col("overall_quality_score"), 1)), ("Completeness Rate", _fixed(F.col("completeness_rate"), 1, "%")), ("Data Consistency", _fixed(zero, 1)), ("Error Rate", _fixed(zero, 1, "%"))])


def field_table(valid: DataFrame, template: Sequence) -> DataFrame:
    """One row for each template field, in order: type, completeness, distinct values, least, greatest and mean as they are shown; a field
    without values has zeros and N/A. The template's few rows are broadcast."""
    spark = valid.sparkSession
    own = spark.createDataFrame([(i, f.name, f.kind) for i, f in enumerate(template, 1)], "pos int, field_name string, field_type string")
    quality = records.field_quality(valid).select("field_name", "completeness_rate", "unique_count")
    got = F.broadcast(own).join(quality, "field_name", "left").join(records.numeric_stats(valid), "field_name", "left")
    shown = lambda c: F.when(F.col("field_type") == "number", text.stat_shown(F.col(c), "number")).when(F.col("field_type") == "currency", text.stat_shown(F.col(c), "currency")).otherwise("N/A")
    return got.select("pos", "field_name", "field_type", _fixed(F.col("completeness_rate"), 1, "%").alias("completeness"), F.coalesce("unique_count", F.lit(0)).alias("unique_values"), shown("min_value").alias("min"), shown("max_value").alias("max"), shown("mean_value").alias("mean")).orderBy("pos")


def error_block(rows: DataFrame) -> DataFrame:
    """(section, pos, label, value): how many errors and files with errors there are, or that there are none."""
    bad = rows.where("size(errors) > 0").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("files"))
    said = F.when(F.col("n") == 0, F.array(F.lit("No validation errors found"))).otherwise(F.array(F.concat(F.lit("Total Errors: "), F.col("n").cast("string")), F.concat(F.lit("Files with Errors: "), F.col("files").cast("string"))))
    return bad.select(F.lit("Error Analysis").alias("section"), F.posexplode(said).alias("pos", "label")).select("section", (F.col("pos") + 1).alias("pos"), "label", F.lit("").alias("value"))


def summary_sheet(rows: DataFrame, valid: DataFrame) -> DataFrame:
    """All labelled rows of the Summary sheet, in order of section and pos."""
    return processing_block(records.processing_summary(rows)).unionByName(quality_block(records.overall_quality(records.field_quality(valid)))).unionByName(error_block(rows))


def quality_report(rows: DataFrame, valid: DataFrame) -> DataFrame:
    """One row: grade, completeness, errors in all, files with errors, the five most frequent patterns, fields with issues and
    recommendations, the last three as arrays of at most five, the template's fields and five."""
    quality = records.field_quality(valid)
    overall, summary, patterns = records.overall_quality(quality), records.processing_counts(rows), records.error_patterns(rows)
    errors = rows.where("size(errors) > 0").agg(F.count("*").alias("total_errors"), F.count_distinct("source_file").alias("files_with_errors"))
    listed = lambda df, name, *c: df.agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    common = listed(patterns, "patterns", (-F.col("n")).alias("less"), "pattern").select(F.array_join(F.transform("patterns", lambda x: F.concat(x["pattern"], F.lit("="), (-x["less"]).cast("string"))), "; ").alias("common_error_patterns"))
    fields = listed(records.problematic_fields(quality), "f", "field_name", "issues").select(F.array_join(F.transform("f", lambda x: F.concat(x["field_name"], F.lit(": "), x["issues"])), "; ").alias("problematic_fields"))
    advice = listed(records.recommendations(overall, summary, patterns), "r", "pos", "recommendation").select(F.array_join(F.transform("r", lambda x: x["recommendation"]), "; ").alias("recommendations"))
    out = overall.select(F.col("quality_grade").alias("overall_quality_grade"), "completeness_rate")
    for one in (errors, common, fields, advice):
        out = out.join(F.broadcast(one))
    return out
