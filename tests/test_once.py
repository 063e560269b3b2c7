"""What is costly is done once for each row: the provider's answers, and the rows of a live run."""

import pandas as pd
from pyspark.sql import functions as F

from quillon.operators import extraction
from quillon.operators.templates import Field
from quillon.plans.live import in_turns


def counter(path):
    def count(n):
        with open(path, "a") as f:
            f.write("x" * n)

    return count


def test_a_provider_is_asked_once_for_each_chunk(spark, tmp_path):
    log = str(tmp_path / "asked")
    counted = counter(log)

    def provider(parts):
        counted(len(parts))
        if any("bad" in p for p in parts):
            raise ValueError("bad")
        return [[("a", w, 0.9 if w == "b1" else 0.5) for w in p.split() if w[0] == "b"] for p in parts]

    rows = [("one", "b0 b1 b2"), ("many", "b0 " * 3 + "b1 " * 3 + "b2 " * 3), ("none", "x"), ("blank", " "), ("blank", None), ("twice", "b0"), ("twice", "b1"), ("wrong", "bad")]
    texts = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "source_file string, text string, i int").repartitionByRange(len(rows), "i").select("source_file", "text").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = extraction.extract(texts, [Field("a", "text"), Field("z", "text")], provider, most=12, mask=False).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    said = sorted((r.source_file, r.data.get("a"), r.status, tuple(r.missing_fields), tuple(r.errors)) for r in got if r.source_file != "blank")
    # one answer: the last counts; several: the most confident
    assert said == [("many", "b1", "completed", ("z",), ()), ("none", None, "completed", ("a", "z"), ()), ("one", "b2", "completed", ("z",), ()), ("twice", "b1", "completed", ("z",), ()), ("wrong", None, "failed", ("a", "z"), ("ValueError: bad",))]
    assert [r.errors for r in got if r.source_file == "blank"] == [["Text is empty"]] * 2
    with open(log) as f:
        assert len(f.read()) == 1 + 3 + 1 + 2 + 1


def test_rows_of_a_live_run_are_made_once(spark, tmp_path):
    log, seen = str(tmp_path / "made"), []
    counted = counter(log)

    def make(frames):
        for frame in frames:
            counted(len(frame))
            yield pd.DataFrame({"seq": frame["id"]})

    in_turns(spark.range(300).mapInPandas(make, "seq long"), "seq", lambda path: seen.append(spark.read.parquet(path).agg(F.count("*"), F.sum("seq")).first()))
    assert len(seen) == 3 and tuple(seen[-1]) == (300, 44850)
    with open(log) as f:
        assert len(f.read()) == 300
