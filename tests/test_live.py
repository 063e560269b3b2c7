"""Live progress, sessions and saved states: after each micro-batch the same as a recomputation over everything so far; restarts, replays
and saves that are stopped."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillon.operators import monitoring, records
from quillon.operators.templates import Field, saved_states
from quillon.sources import states
from quillon.streaming import progress, session

LOG = "batch_id long, seq long, file_path string, phase string, start_time double, end_time double, processing_time double, success boolean"
RESULT = "seq long, source_file string, status string, processing_time double, data map<string,string>, confidence_scores map<string,double>"
TEMPLATE = (Field("name", "text"), Field("sum", "number", locale="en-US") if "locale" in Field.__dataclass_fields__ else Field("sum", "number"))


def log_rows(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3]), s, f"f{rng.randrange(12)}", rng.choice(list(monitoring.PHASES)), float(s), s + 0.5, rng.randrange(1, 64) / 8, rng.random() < 0.6) for s in range(n)]


def arrive(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(path)


def test_progress_after_each_micro_batch(spark, tmp_path):
    batches = spark.createDataFrame([(1, 12, "OCR", 0.5), (2, 12, "Ingestion", 0.0), (3, 12, "Validation", 1.0)], "batch_id long, total_files long, current_phase string, current_progress double")
    rows, got, source = log_rows(120), {}, str(tmp_path / "log")

    def keep(df, n):
        got.update({r.batch_id: r for r in df.collect()})

    for upto, part in ((30, rows[:30]), (75, rows[30:75]), (120, rows[75:])):
        # each turn is a query of its own that goes on from the checkpoint
        arrive(spark, random.Random(upto).sample(part, len(part)), LOG, source)
        progress.track(spark, source, spark.createDataFrame([], LOG).schema, batches, str(tmp_path / "check"), keep).awaitTermination()
        so_far = spark.createDataFrame(rows[:upto], LOG)
        share = {r.batch_id: r.progress for r in monitoring.batch_progress(batches, so_far).collect()}
        etas = {r.batch_id: (r.current_eta, r.batch_eta) for r in monitoring.eta(batches, so_far).collect()}
        marks = {}
        for r in monitoring.milestones(so_far, batches).collect():
            marks.setdefault(r.batch_id, []).append((r.milestone, r.reached))
        for b in {r[0] for r in rows[:upto]}:
            own, g = [r for r in rows[:upto] if r[0] == b], got[b]
            assert g.progress == pytest.approx(share[b]) and (g.current_eta, g.batch_eta) == pytest.approx(etas[b])
            assert (g.records, g.done, g.since, g.last_seq) == (len(own), len({r[2] for r in own if r[7]}), own[0][4], own[-1][1])
            assert [(m.milestone, m.reached) for m in g.milestones] == sorted(marks.get(b, []))
            assert {p.phase: (p.n, p.total_time) for p in g.phases} == {p: (sum(r[3] == p for r in own), sum(r[6] for r in own if r[3] == p)) for p in {r[3] for r in own}}


def result_rows(n, seed=2):
    rng = random.Random(seed)
    return [(s, f"f{rng.randrange(n)}.pdf", rng.choice(["completed", "failed"]), rng.choice([0.0, 0.5, 1.25, 2.0]), {"name": rng.choice(["a", "b", "c"]), **({"sum": rng.choice(["1", "2.5", "x"])} if rng.random() < 0.9 else {})}, {}) for s in range(n)]


def same(got, want):
    rows = [sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=repr) for df in (got, want)]
    assert len(rows[0]) == len(rows[1])
    for a, b in zip(*rows):
        assert a == pytest.approx(b) if all(isinstance(x, (int, float)) for x in a) else [pytest.approx(x) if isinstance(x, float) else x for x in a] == list(b)


def test_session_after_each_micro_batch(spark, tmp_path):
    rows, seen = result_rows(60), []
    source, folder, schema = str(tmp_path / "in"), str(tmp_path / "session"), spark.createDataFrame([], RESULT).schema

    def check(batch, view, n):
        seen.append(n)
        so_far = records.validated(spark.read.schema(schema).parquet(source), TEMPLATE)
        same(view.summary(), records.processing_summary(so_far))
        same(view.field_quality().drop("pos"), records.field_quality(records.valid_observations(spark.read.schema(schema).parquet(source), TEMPLATE)).drop("pos"))

    for i in range(5):
        arrive(spark, rows[12 * i : 12 * i + 12], RESULT, source)
        session.live_session(spark, source, schema, TEMPLATE, folder, str(tmp_path / "check"), check, merge_every=2).awaitTermination()
    view = session.SessionView(spark, f"{folder}/view", 2)
    assert seen == [0, 1, 2, 3, 4] and view.base()["upto"] == 3
    before = [sorted(map(str, df.collect())) for df in (view.summary(), view.field_quality())]
    # micro-batches that are run again: the last one's set is replaced, one in the base is known
    for n in (4, 2):
        view.add(records.validated(spark.createDataFrame(rows[12 * n : 12 * n + 12], RESULT), TEMPLATE), n)
    assert [sorted(map(str, df.collect())) for df in (view.summary(), view.field_quality())] == before


def test_an_empty_session(spark, tmp_path):
    view = session.SessionView(spark, str(tmp_path / "view"))
    view.add(records.validated(spark.createDataFrame([], RESULT), TEMPLATE), 0)
    assert view.summary().first().asDict() == {"total_files": 0, "successful_files": 0, "failed_files": 0, "success_rate": 0.0, "total_processing_time": 0.0, "average_processing_time": 0.0, "median_processing_time": 0.0}
    assert view.field_quality().collect() == []


def test_saved_states(spark, tmp_path):
    folder = str(tmp_path / "states")
    for i in range(12):
        path = states.save_state(spark, folder, f"s{i % 2}", {"rows": spark.range(i)}, progress=i / 12, current_file=f"f{i} é", remaining_files=12 - i)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    listed = saved_states(spark, folder).collect()
    assert [r.current_file for r in listed] == [f"f{i} é" for i in range(11, 1, -1)] and [r.remaining_files for r in listed] == list(range(1, 11))
    assert len([x for x in os.listdir(folder) if x.endswith(".tables")]) == 10
    facts, tables = states.load_state(spark, listed[0].path)
    assert (facts["session_id"], facts["progress"]) == ("s1", 11 / 12) and tables["rows"].count() == 11


@pytest.mark.parametrize("where", ["tables", "rename", "manifest"])
def test_a_save_that_is_stopped_leaves_the_former_state(spark, tmp_path, monkeypatch, where):
    folder = str(tmp_path / "states")
    states.save_state(spark, folder, "run", {"rows": spark.range(3)})
    broken = spark.range(4).select(F.raise_error(F.lit("killed")).alias("x"))
    stop = lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt())
    if where != "tables":
        monkeypatch.setattr(states, {"rename": "put_tables", "manifest": "put_text"}[where], stop)
    with pytest.raises(BaseException):
        states.save_state(spark, folder, "run", {"a": spark.range(1), "b": broken if where == "tables" else spark.range(1)})
    monkeypatch.undo()
    (only,) = saved_states(spark, folder).collect()
    assert states.load_state(spark, only.path)[1]["rows"].count() == 3
    # what it left goes once it is old
    for x in os.listdir(folder):
        os.utime(os.path.join(folder, x), (time.time() - 9999,) * 2)
    states.retain(spark, folder)
    assert len([x for x in os.listdir(folder) if not x.startswith(".")]) == 2


def test_a_manifest_of_another_version_is_read(spark, tmp_path):
    path = states.save_state(spark, str(tmp_path), "run", {})
    with open(path) as f:
        facts = json.load(f)
    states.put_text(spark, path, json.dumps(facts | {"version": "0.9"}))
    assert states.load_state(spark, path)[0]["session_id"] == "run"
    with pytest.raises(ValueError):
        states.save_state(spark, str(tmp_path), "a/b", {})
