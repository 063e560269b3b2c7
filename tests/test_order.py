"""Numbering, running values, sliding frames and medians in several parts, against plain Python; and what their plans hold."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import monitoring, order, records


@pytest.fixture()
def parts(spark):
    """Many parts, however small the rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_numbers_of_sparse_keys_and_ties(parts):
    rng = random.Random(1)
    keys = [rng.choice([rng.randrange(-(10**15), 10**15), 7, None]) for _ in range(500)]
    df = parts.createDataFrame([(k, "x", 0, 0) for k in keys], "k long, part string, i int, _part int").repartition(5)
    out = order.numbered(df, "k")
    assert sorted(out.columns) == ["_part", "i", "k", "part"]
    got = sorted((r.i, r.k) for r in out.collect())
    assert [i for i, _ in got] == list(range(500)) and [k for _, k in got] == sorted(keys, key=lambda k: (k is not None, k))
    assert "SinglePartition" not in plan(out)
    assert order.numbered(df.where("false"), "k").collect() == []


def test_running_values(parts):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), s, rng.choice([None, rng.randrange(-50, 50)])) for s in rng.sample(range(10**9), 400)]
    df = parts.createDataFrame([(*r, "key", "v0") for r in rows], "g string, seq long, x long, key string, v0 string")
    got = order.scanned(df, "g", "seq", {"s": ("sum", F.col("x")), "m": ("min", F.col("x")), "n": ("count", F.lit(1)), "f": ("first", F.col("x"))})
    seen = {(r.g, r.seq): (r.s, r.m, r.n, r.f, r.key, r.v0) for r in got.collect()}
    assert len(seen) == len(rows)
    for g in {r[0] for r in rows}:
        so_far, n = [], 0
        for _, s, x in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            n += 1
            so_far += [] if x is None else [x]
            assert seen[g, s] == (sum(so_far) if so_far else None, min(so_far, default=None), n, so_far[0] if so_far else None, "key", "v0")


def test_frames_over_the_ends_of_spans(parts, monkeypatch):
    monkeypatch.setattr(order, "SPAN", 10)
    df = parts.createDataFrame([(i % 3 % 2, i * 37, float(i)) for i in range(200)], "host int, seq long, x double")
    rows = order.framed(df, "host", "seq", 4, "n", "span", "copy")
    got = {(r.host, r.seq): r.m for r in rows.withColumn("m", F.sum("x").over(Window.partitionBy("host", "span").orderBy("n").rowsBetween(-4, 0))).where("not copy").collect()}
    assert len(got) == 200
    for host in (0, 1):
        own = [(i * 37, float(i)) for i in range(200) if i % 3 % 2 == host]
        for k, (seq, _) in enumerate(own):
            assert got[host, seq] == sum(x for _, x in own[max(0, k - 4) : k + 1])


def test_medians(parts):
    rng = random.Random(3)
    values = {"ties": [rng.choice([1.0, 2.0, 2.0]) for _ in range(301)], "wide": [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(402)], "one": [5.5], "two": [1.0, 4.0], "hot": [0.0] * 600 + [-1.0] * 599, None: [3.0, 9.0, 4.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("none", None), ("two", None)]
    df = parts.createDataFrame(rows, "field string, v double").repartition(6)
    out = order.medians(df, ["field"], "v")
    assert {r.field: r["median"] for r in out.collect()} == {k: statistics.median(v) for k, v in values.items()}
    assert "percentile" not in plan(out) and "median(" not in plan(out)
    assert order.medians(df, [], "v").collect()[0]["median"] == statistics.median([v for _, v in rows if v is not None])
    weighted = df.where("v is not null").groupBy("field", "v").agg(F.count("*").alias("w"))
    assert {r.field: r.m for r in order.medians(weighted, ["field"], "v", "m", weight="w").collect()} == {k: statistics.median(v) for k, v in values.items()}
    assert order.medians(df.where("false"), [], "v").collect() == []


def test_three_messages_are_all_that_is_gathered(parts):
    rows = [(i, f"f{i % 3}.pdf", "failed", [f"e{i}"]) for i in range(100)] + [(200, "ok.pdf", "completed", [])]
    df = parts.createDataFrame(rows, "seq long, source_file string, status string, errors array<string>")
    out = records.error_table(df)
    got = {r.source_file: (r.error_count, r.error_details) for r in out.collect()}
    assert set(got) == {"f0.pdf", "f1.pdf", "f2.pdf"} and got["f0.pdf"] == (34, "; ".join(f"Validation errors for f0.pdf: e{i}" for i in (0, 3, 6)))
    assert "WindowGroupLimit" in plan(out)


def test_progress_of_one_batch_in_parts(parts, monkeypatch):
    """The running log of a single long batch, record by record."""
    monkeypatch.setattr(order, "SPAN", 16)
    rng = random.Random(4)
    log = [(1, s, f"f{rng.randrange(60)}", float(s), s + rng.random(), rng.random() < 0.7) for s in range(300)]
    progress = parts.createDataFrame(log, "batch_id int, seq long, file_path string, start_time double, end_time double, success boolean")
    batches = parts.createDataFrame([(1, 60)], "batch_id int, total_files int")
    done, at, marks = set(), {}, {}
    for n, (_, s, f, start, end, ok) in enumerate(log, 1):
        if ok:
            done.add(f)
            for m in (0.25, 0.5, 0.75, 0.9):
                if len(done) / 60 >= m:
                    marks.setdefault(m, s)
        at[s] = (n, len(done), len(done) / max((end - log[0][3]) / 60, 0.1), (end - log[0][3]) / n * max(60 - n, 0))
    got = {r.seq: r for r in monitoring.running(progress).collect()}
    assert {s: (r.n, r.done) for s, r in got.items()} == {s: x[:2] for s, x in at.items()}
    assert all(abs(got[s].throughput - x[2]) < 1e-9 for s, x in at.items())
    assert all(abs(r.eta - at[r.seq][3]) < 1e-9 for r in monitoring.basic_eta(progress, batches).collect())
    assert {r.milestone: r.reached for r in monitoring.milestones(progress, batches).collect()} == marks
    base = next((s, x[2]) for s, x in at.items() if x[0] >= 5 and x[2] > 0)
    got = {r.seq: (r.baseline, r.alert) for r in monitoring.degradation(progress).collect()}
    assert got == {s: (base[1], x[2] < base[1] * 0.5) for s, x in at.items() if s > base[0]}
