"""Extraction by a model: texts are masked and cut into chunks, a provider answers for each chunk, its answers become one result.

Answers are arrays of struct<field string, text string, confidence double>; `answers` frames have one row for each chunk: source_file,
chunk, extractions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import convert, text

DEFAULT_CONFIDENCE = 0.8
ANSWER = "array<struct<field:string,text:string,confidence:double>>"
Provider = Callable[[list[str]], list[list[tuple[str, str, float | None]]]]


def flattened(answers: DataFrame) -> DataFrame:
    """(source_file, chunk, pos, field_name, value, confidence): one row for each extraction; without a confidence it is 0.8."""
    rows = answers.select("source_file", "chunk", F.posexplode("extractions").alias("pos", "x"))
    return rows.select("source_file", "chunk", "pos", F.col("x.field").alias("field_name"), F.col("x.text").alias("value"), F.coalesce("x.confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"))


def _kind(field: Column, template: Sequence) -> Column:
    kind = F.lit(None).cast("string")
    for f in reversed(template):  # of equal names the first counts
        kind = F.when(field == f.name, f.kind).otherwise(kind)
    return kind


def _coerced(kind: Column, value: Column) -> Column:
    number = F.when(kind == "number", convert.extracted_number(value)).when(kind == "currency", convert.extracted_currency(value))
    return F.coalesce(number.cast("string"), value)


def typed(rows: DataFrame, template: Sequence) -> DataFrame:
    """rows(field_name, value) with the template's kind of the field (null for one it does not have) and `coerced`: numbers and currencies
    as text of a double, everything else, and what cannot be read, as it is."""
    rows = rows.withColumn("kind", _kind(F.col("field_name"), template))
    return rows.withColumn("coerced", _coerced(F.col("kind"), F.col("value")))


def last_wins(answers: DataFrame) -> DataFrame:
    """(source_file, field_name, value, confidence): of several extractions of a field the last one counts (by chunk and place; where rows
    of one chunk are repeated, by value and confidence)."""
    return flattened(answers).groupBy("source_file", "field_name").agg(F.max(F.struct("chunk", "pos", "value", "confidence")).alias("x")).select("source_file", "field_name", "x.value", "x.confidence")


def merged(answers: DataFrame) -> DataFrame:
    """(source_file, field_name, value, confidence): of several extractions of a field the most confident counts, of equal ones the first."""
    best = F.min(F.struct((-F.col("confidence")).alias("less"), "chunk", "pos", "value"))
    return flattened(answers).groupBy("source_file", "field_name").agg(best.alias("x")).select("source_file", "field_name", "x.value", (-F.col("x.less")).alias("confidence"))


def as_results(rows: DataFrame, template: Sequence) -> DataFrame:
    """One result for each file of rows(source_file, field_name, value, confidence): data and confidence_scores as maps, values coerced,
    and the required fields that are missing. A file has at most one row for each field."""
    needed = F.array(*(F.lit(f.name) for f in template if not f.optional)) if any(not f.optional for f in template) else F.array().cast("array<string>")
    pairs = F.array_sort(F.collect_list(F.struct("field_name", "coerced", "confidence")))
    out = typed(rows, template).groupBy("source_file").agg(pairs.alias("p"))
    return out.select("source_file", F.map_from_entries(F.transform("p", lambda x: F.struct(x["field_name"], x["coerced"]))).alias("data"), F.map_from_entries(F.transform("p", lambda x: F.struct(x["field_name"], x["confidence"]))).alias("confidence_scores"), F.array_except(needed, F.transform("p", lambda x: x["field_name"])).alias("missing_fields"))


def _answered(answers: DataFrame, template: Sequence) -> DataFrame:
    """answers(source_file, chunk, extractions, error) to one result for each file. The answers are gone through once, so that no provider is
    asked again: each field's last and best extraction are both kept until the number of the file's answers tells which of them counts."""
    needed = F.array(*(F.lit(f.name) for f in template if not f.optional)).cast("array<string>")
    rows = answers.select("source_file", "chunk", "error", F.posexplode_outer("extractions").alias("pos", "x"))
    has, sure = F.col("pos").isNotNull(), F.coalesce("x.confidence", F.lit(DEFAULT_CONFIDENCE))
    last = F.struct("chunk", "pos", F.col("x.text").alias("value"), sure.alias("confidence"))
    best = F.struct((-sure).alias("less"), "chunk", "pos", F.col("x.text").alias("value"))
    # an answer is counted where it begins
    fields = rows.groupBy("source_file", F.col("x.field").alias("field_name"), has.alias("has"), "error").agg(F.max(last).alias("last"), F.min(best).alias("best"), F.count_if(~has | (F.col("pos") == 0)).alias("n"))
    files = fields.groupBy("source_file").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("error")).alias("errors"), F.collect_list(F.when(F.col("has"), F.struct("field_name", "last", "best"))).alias("found"))
    one = lambda x, a, b: F.when(F.col("n") == 1, x["last"][a]).otherwise(b)
    chosen = lambda x: F.struct(x["field_name"].alias("field_name"), one(x, "value", x["best"]["value"]).alias("value"), one(x, "confidence", -x["best"]["less"]).alias("confidence"))
    coerced = lambda x: F.struct(x["field_name"].alias("field_name"), _coerced(_kind(x["field_name"], template), x["value"]).alias("coerced"), x["confidence"].alias("confidence"))
    told = files.select("source_file", "errors", F.array_sort(F.transform(F.transform("found", chosen), coerced)).alias("p"))
    pairs = lambda what: F.map_from_entries(F.transform("p", lambda x: F.struct(x["field_name"], x[what])))
    missing = F.when(F.size("p") == 0, needed).otherwise(F.array_except(needed, F.transform("p", lambda x: x["field_name"])))
    return told.select("source_file", pairs("coerced").alias("data"), pairs("confidence").alias("confidence_scores"), missing.alias("missing_fields"), F.when(F.size("errors") > 0, "failed").otherwise("completed").alias("status"), "errors")


def extract(texts: DataFrame, template: Sequence, provider: Provider, most: int = 8000, mask: bool = True) -> DataFrame:
    """One result for each row of texts(source_file, text): source_file, data, confidence_scores, missing_fields, status, errors.

    The provider gets lists of chunks and answers for each; what it raises becomes the error of the files whose chunks it was given, status
    failed. One chunk: the last extraction of a field counts; several: the most confident. A null or blank text is a failed result."""
    clean = text.mask_all(F.col("text")) if mask else F.col("text")
    blank = convert.is_blank(F.col("text"))
    chunks = texts.where(~blank).select("source_file", F.posexplode(text.chunks(clean, most)).alias("chunk", "part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                got, errors = provider(frame["part"].tolist()), [None] * len(frame)
            except Exception as e:  # what goes wrong with a provider is data
                got, errors = [[] for _ in range(len(frame))], [f"{type(e).__name__}: {e}"] * len(frame)
            yield pd.DataFrame({"source_file": frame["source_file"], "chunk": frame["chunk"], "extractions": [[{"field": f, "text": t, "confidence": c} for f, t, c in x] for x in got], "error": errors})

    answers = chunks.mapInPandas(run, f"source_file string, chunk int, extractions {ANSWER}, error string")
    done = _answered(answers, template)
    needed = F.array(*(F.lit(f.name) for f in template if not f.optional)).cast("array<string>")
    empty = texts.where(blank).select("source_file", F.create_map().cast("map<string,string>").alias("data"), F.create_map().cast("map<string,double>").alias("confidence_scores"), needed.alias("missing_fields"), F.lit("failed").alias("status"), F.array(F.lit("Text is empty")).alias("errors"))
    return done.unionByName(empty)


def rule_provider(template: Sequence) -> Provider:
    """Answers with what stands behind a field's name and a colon on a line; a provider that needs no network."""
    rules = [(f.name, re.compile(rf"(?im)^[ \t]*{re.escape(f.name).replace('_', '[ _]')}[ \t]*:[ \t]*(\S[^\n]*?)[ \t]*$")) for f in template]
    return lambda parts: [[(name, m[1], 0.9) for name, rule in rules for m in rule.finditer(part)] for part in parts]


def simulated(files: DataFrame, template: Sequence, share: float = 0.7) -> DataFrame:
    """files(source_file) with made-up data: each field is filled in a `share` of the files, by hash, so the same in every run."""
    at: Callable[[Column, str], Column] = lambda c, what: F.pmod(F.xxhash64(c, F.lit(what)), F.lit(1000)) / 1000.0
    path = F.col("source_file")
    has = {f.name: at(path, f.name) < share for f in template}
    entry = lambda name, value: F.when(has[name], F.struct(F.lit(name).alias("key"), value.alias("value")))
    data = F.array_compact(F.array(*(entry(f.name, F.concat(F.lit(f"Sample {f.name} "), F.pmod(F.xxhash64(path), F.lit(100)).cast("string"))) for f in template)))
    scores = F.array_compact(F.array(*(entry(f.name, F.round(0.6 + 0.4 * at(path, f"score {f.name}"), 3)) for f in template)))
    return files.select("*", F.map_from_entries(data).alias("data"), F.map_from_entries(scores).alias("confidence_scores"))
