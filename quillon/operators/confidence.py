"""Reports over the confidence scores and the completeness of extraction results.

Results have `data` map<string,string> and `confidence_scores` map<string,double>; both may lack any field. The reports differ on
purpose in which rows and scores they count; each function says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, convert
from ..sources.scratch import fresh
from . import records



def exploded(results: DataFrame) -> DataFrame:
    """(seq, source_file, status, field_name, score): one row for each score."""
    return results.select("seq", "source_file", "status", F.explode("confidence_scores").alias("field_name", "score"))


def by_field(results: DataFrame, template: Sequence) -> DataFrame:
    """One row for each result and template field: raw value, its score (null where there is none), whether it is missing (null or
    empty) or blank."""
    fields = F.array(*(F.struct(F.lit(i + 1).alias("pos"), F.lit(f.name).alias("field_name"), F.lit(f.kind).alias("kind"), F.lit(f.optional).alias("optional")) for i, f in enumerate(template)))
    told = ("pos", "field_name", "kind", "optional")
    (f,) = fresh([*results.columns, *told], "f")
    kept = [c for c in results.columns if c not in told]
    rows = results.withColumn(f, F.explode(fields)).select(*kept, *(F.col(f"{f}.{c}").alias(c) for c in told))
    rows = rows.withColumn("raw", F.try_element_at("data", F.col("field_name"))).withColumn("score", F.try_element_at("confidence_scores", F.col("field_name")))
    return rows.withColumn("missing", convert.is_missing(F.col("raw"))).withColumn("blank", convert.is_blank(F.col("raw")))


def with_default(results: DataFrame, template: Sequence, default: float = 0.0) -> DataFrame:
    """Every template field's score, the default where a result has none."""
    return by_field(results, template).withColumn("score", F.coalesce("score", F.lit(default)))


def file_means(results: DataFrame) -> DataFrame:
    """Of results with scores: source_file and the mean of its scores above 0, or 0. It is rounded to nine places, so that bands do not
    hang on the order in which scores are added."""
    scores = F.filter(F.map_values("confidence_scores"), lambda c: c > 0)
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, c: a + c) / F.size(scores)).otherwise(0.0)
    return records.with_confidence(results).select("seq", "source_file", "processing_time", F.round(mean, 9).alias("confidence"))


def summary(results: DataFrame, high: float = 0.8, medium: float = 0.5) -> DataFrame:
    """One row over the files' means: mean, least, greatest, and how many are high, medium and low."""
    c = F.col("confidence")
    return file_means(results).agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.count_if(c >= high).alias("high"), F.count_if((c >= medium) & (c < high)).alias("medium"), F.count_if(c < medium).alias("low"))


def top_fields(results: DataFrame, n: int = 3) -> DataFrame:
    """The n fields with the highest mean of their scores above 0; ties by name."""
    means = exploded(results).where("score > 0").groupBy("field_name").agg(F.avg("score").alias("mean_score"))
    return means.orderBy(F.desc("mean_score"), "field_name").limit(n)


def overall(results: DataFrame) -> DataFrame:
    """The mean of all scores of completed results, and its label."""
    c = F.avg("score")
    return exploded(records.completed(results)).agg(c.alias("confidence"), classify.overall_label(c).alias("label"))


def distribution(results: DataFrame) -> DataFrame:
    """How many of the scores of completed results are high, medium and low, and their share in per cent."""
    band = F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    counts = exploded(records.completed(results)).groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("band", "n", (100.0 * F.col("n") / F.col("total")).alias("share"))


def quality_by_field(results: DataFrame, template: Sequence) -> DataFrame:
    """Over results with any data: share of values that are not blank, its level, and the mean score of the results that have one
    (else 0)."""
    c = F.avg(F.when(F.col("blank"), 0.0).otherwise(1.0))
    rows = by_field(records.extracted(results), template)
    return rows.groupBy("field_name", "pos").agg(c.alias("completeness"), F.count_if(~F.col("blank")).alias("extracted_count"), F.count("*").alias("total_count"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_confidence"), classify.completeness_level(c).alias("level"))


def quality_overall(fields: DataFrame) -> DataFrame:
    """Over quality_by_field(): the plain mean of the fields' completeness, its level, and how many fields have each level."""
    c = F.avg("completeness")
    return fields.agg(F.max("total_count").alias("total_files"), c.alias("avg_completeness"), classify.completeness_level(c).alias("overall_quality"), *(F.count_if(F.col("level") == x).alias(x) for x in ("excellent", "good", "fair", "poor")))


def best_and_worst(fields: DataFrame) -> DataFrame:
    """Over quality_by_field(): the fields of the highest and lowest completeness (of ties the first in the template), and the range."""
    c = F.col("completeness")
    return fields.agg(F.max_by("field_name", F.struct(c, -F.col("pos"))).alias("best_field"), F.min_by("field_name", F.struct(c, F.col("pos"))).alias("worst_field"), (F.max(c) - F.min(c)).alias("score_range"))


def field_distribution(results: DataFrame, template: Sequence) -> DataFrame:
    """quality_by_field() with least and greatest score and the types of value found, most complete fields first, ties in template order."""
    rows = by_field(records.extracted(results), template)
    zero = F.lit(0.0)
    out = rows.groupBy("field_name", "pos", "kind", "optional").agg(
        F.avg(F.when(F.col("blank"), 0.0).otherwise(1.0)).alias("completeness"), F.coalesce(F.avg("score"), zero).alias("avg_confidence"), F.coalesce(F.min("score"), zero).alias("min_confidence"), F.coalesce(F.max("score"), zero).alias("max_confidence"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("blank"), classify.value_type(F.col("raw"))))), ",").alias("types"),
    )
    return out.orderBy(F.desc("completeness"), "pos")


def completeness_bands(results: DataFrame, template: Sequence) -> DataFrame:
    """Over completed results: share of values that are neither null nor empty, and its band."""
    c = F.avg(F.when(F.col("missing"), 0.0).otherwise(1.0))
    rows = by_field(records.completed(results), template).groupBy("field_name", "pos", "optional").agg(c.alias("completeness"))
    return rows.withColumn("band", classify.completeness_band(F.col("completeness"), F.col("optional")))


def preview_stats(results: DataFrame, template: Sequence) -> DataFrame:
    """Over completed results: completeness, and the mean score of the values that are not missing; one without a score counts as 0."""
    rows = with_default(records.completed(results), template)
    return rows.groupBy("field_name").agg(F.avg(F.when(F.col("missing"), 0.0).otherwise(1.0)).alias("completeness"), F.coalesce(F.avg(F.when(~F.col("missing"), F.col("score"))), F.lit(0.0)).alias("mean_confidence"))


def preview_sections(results: DataFrame, template: Sequence) -> DataFrame:
    """The section that each field of each result is shown in, its status text and its value as shown."""
    rows = with_default(results, template)
    return rows.select("seq", "field_name", classify.preview_section(F.col("missing"), F.col("score")).alias("section"), classify.field_status(F.col("raw").isNull() | F.col("missing"), F.col("optional"), F.col("score")).alias("status_text"))


def file_stats(results: DataFrame, template: Sequence) -> DataFrame:
    """Of each result: template fields whose value is not null, how many there are, and the mean of all its scores (0 without)."""
    got = F.array(*(F.try_element_at("data", F.lit(f.name)) for f in template))
    scores = F.map_values("confidence_scores")
    mean: Column = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, c: a + c) / F.size(scores)).otherwise(0.0)
    return results.select("seq", "source_file", F.size(F.array_compact(got)).cast("long").alias("extracted_fields"), F.lit(len(template)).cast("long").alias("total_fields"), mean.alias("avg_confidence"))


def header(results: DataFrame) -> DataFrame:
    """How many results there are, completed and failed, and the mean time of the completed ones (null without)."""
    done = F.col("status") == "completed"
    return results.agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg(F.when(done, F.col("processing_time"))).alias("mean_time"))


def simple_summary(results: DataFrame) -> DataFrame:
    """Counts, the mean of all scores of all results (0 without), and the total time."""
    scores = F.map_values("confidence_scores")
    total = F.aggregate(scores, F.lit(0.0), lambda a, c: a + c)
    rows = results.select("status", "processing_time", total.alias("s"), F.greatest(F.size(scores), F.lit(0)).alias("n"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("confidence"), F.sum("processing_time").alias("total_time"))


def processing_metrics(results: DataFrame, elapsed: float | None = None) -> DataFrame:
    """Completed are the results that took any time. Rates are fractions; files a minute over `elapsed` seconds, or over the total time."""
    t, on = F.col("processing_time"), F.col("processing_time") > 0
    n, done = F.count("*"), F.count_if(on)
    spent = F.lit(elapsed) if elapsed is not None else F.sum(F.when(on, t))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return results.agg(n.alias("total"), done.alias("completed"), (n - done).alias("failed"), zero(done / F.nullif(n, F.lit(0))).alias("success_rate"), zero((n - done) / F.nullif(n, F.lit(0))).alias("error_rate"), zero(F.avg(F.when(on, t))).alias("mean_time"), zero(F.min(F.when(on, t))).alias("min_time"), zero(F.max(F.when(on, t))).alias("max_time"), zero(F.sum(F.when(on, t))).alias("total_time"), zero(60.0 * done / F.nullif(spent, F.lit(0.0))).alias("per_minute"))


def time_histogram(results: DataFrame) -> DataFrame:
    """(bin, n) of the times above 0 in ten bins of one width from the least to the greatest, or as many as there are times; times
    that are all equal are spread half a second to either side, as a histogram of one value is."""
    t = records.timed(results).select("processing_time")
    ends = t.agg(F.min("processing_time").alias("lo"), F.max("processing_time").alias("hi"), F.least(F.count("*"), F.lit(10)).alias("bins"))
    ends = ends.select("bins", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.floor((F.col("processing_time") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo")))
    return t.join(F.broadcast(ends)).groupBy(F.least(place, F.col("bins") - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
