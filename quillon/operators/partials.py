"""What a part of a session's results adds to its summary: frames that are merged by counting, adding up and uniting, never by going back to
the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import order

#: name -> (columns that a row is known by, how the others are merged).
KINDS: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "files": ((), {"total_files": "sum", "successful_files": "sum", "total_time": "sum", "timed": "sum"}),
    "failed": (("source_file",), {}),
    "times": (("processing_time",), {"n": "sum"}),
    "fields": (("field_name",), {"field_type": "min", "pos": "min", "total_count": "sum", "null_count": "sum"}),
    "values": (("field_name", "value"), {}),
}


def partials(rows: DataFrame) -> dict[str, DataFrame]:
    """Of validated rows (fields, errors): counts, failed files, times with their counts, and by field counts and distinct values."""
    good = F.size("errors") == 0
    t = F.when(F.col("processing_time") > 0, F.col("processing_time"))
    valid = rows.where(good).select(F.explode("fields").alias("f")).select("f.*")
    value = F.coalesce("text_value", F.col("number_value").cast("string"), F.col("date_value").cast("string"))
    return {
        "files": rows.agg(F.count("*").alias("total_files"), F.count_if(good & (F.col("status") == "completed")).alias("successful_files"), F.coalesce(F.sum(t), F.lit(0.0)).alias("total_time"), F.count(t).alias("timed")),
        "failed": rows.where("size(errors) > 0 and source_file is not null").select("source_file").distinct(),
        "times": rows.where("processing_time > 0").groupBy("processing_time").agg(F.count("*").alias("n")),
        "fields": valid.groupBy("field_name").agg(F.min("kind").alias("field_type"), F.min("pos").alias("pos"), F.count("*").alias("total_count"), F.count_if("missing").alias("null_count")),
        "values": valid.select("field_name", value.alias("value")).where("value is not null").distinct(),
    }


def merged(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Frames of several parts to one of the same form."""
    out = {}
    for name, (keys, rest) in KINDS.items():
        grouped = parts[name].groupBy(*keys)
        out[name] = grouped.agg(*(getattr(F, how)(c).alias(c) for c, how in rest.items())) if rest else parts[name].select(*keys).distinct()
    return out


def summary(parts: dict[str, DataFrame]) -> DataFrame:
    """processing_summary() of all the rows that the parts come from."""
    one = parts["files"].agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in KINDS["files"][1]))
    failed = parts["failed"].agg(F.count_distinct("source_file").alias("failed_files"))
    middle = order.medians(parts["times"], [], "processing_time", "m", weight="n").agg(F.coalesce(F.max("m"), F.lit(0.0)).alias("median_processing_time"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return one.join(F.broadcast(failed)).join(F.broadcast(middle)).select("total_files", "successful_files", "failed_files", (100.0 * share("successful_files", "total_files")).alias("success_rate"), F.col("total_time").alias("total_processing_time"), share("total_time", "timed").alias("average_processing_time"), "median_processing_time")


def field_quality(parts: dict[str, DataFrame]) -> DataFrame:
    """records.field_quality() of all the valid rows that the parts come from."""
    all_ = merged(parts)
    unique = all_["values"].groupBy("field_name").agg(F.count("*").alias("unique_count"))
    n = F.col("total_count") - F.col("null_count")
    rows = all_["fields"].join(unique, "field_name", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    rows = rows.withColumns({"completeness_rate": 100.0 * n / F.col("total_count"), "uniqueness_score": F.least(100.0 * F.col("unique_count") / F.greatest(n, F.lit(1)), F.lit(100.0))})
    return rows.select("field_name", "field_type", "pos", "total_count", "null_count", "unique_count", "completeness_rate", "uniqueness_score", ((F.col("completeness_rate") + F.col("uniqueness_score")) / 2).alias("data_quality_score"))
