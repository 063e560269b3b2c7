"""Queries over live runs: the given rows arrive in turns, and the result is what the run holds after the last of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records
from ..operators.templates import saved_states
from ..sources import states
from ..sources.scratch import new_path, written
from ..streaming import progress, runs, session
from . import fixtures
from .fixtures import LOG, TEMPLATE, results
from .logs import _ETA, _PART
from .registry import query, rounded


def in_turns(rows: DataFrame, by: str, run: Callable[[str], None], turns: int = 3) -> None:
    """The rows in `turns` ranges of `by`, each written into one folder after the one before has been worked off. The rows are made once, not
    for the bounds and each turn again."""
    rows = written(rows)
    path = new_path(rows.sparkSession, "arrivals")
    bounds = rows.approxQuantile(by, [i / turns for i in range(1, turns)], 0.01)
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = rows if low is None else rows.where(F.col(by) > low)
        (part if high is None else part.where(F.col(by) <= high)).write.mode("append").parquet(path)
        run(path)


_MARKS = "(select batch_id, string_agg(cast(m as varchar) || ':' || reached, ',' order by m) as marks from (select batch_id, m, min(seq) as reached from (select ru.*, total_files from ru join ba using (batch_id) where success), (select unnest([0.25, 0.5, 0.75, 0.9]::double[]) as m) where done / total_files >= m group by 1, 2) group by 1)"


@query(f"select batch_id, n as records, bd.done, round(least(1.0, bd.done / total_files + {_PART} / total_files), 9) as progress, round(mean * (1 - current_progress), 9) as current_eta, round(mean * (1 - current_progress) + (total_files - bd.done - 1) * mean, 9) as batch_eta, phases, coalesce(marks, '') as milestones from bd join (select batch_id, mean from {_ETA}) using (batch_id) join (select batch_id, count(*) as n from pr group by 1) using (batch_id) join (select batch_id, string_agg(phase || '=' || k, ',' order by phase) as phases from (select batch_id, phase, count(*) as k from pr group by 1, 2) group by 1) using (batch_id) left join {_MARKS} using (batch_id)", LOG)
def live_progress(spark, sf):
    """The log in three turns through the stateful operator; of each batch the last state that was given out."""
    log, batches = fixtures.progress(spark, sf), fixtures.batches(spark, sf)
    out, checkpoint = new_path(spark, "updates"), new_path(spark, "checkpoint")
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/update={n}")
    in_turns(log, "seq", lambda path: progress.track(spark, path, log.schema, batches, checkpoint, keep).awaitTermination())
    latest = spark.read.parquet(out).groupBy("batch_id").agg(F.max_by(F.struct("records", "done", "progress", "current_eta", "batch_eta", "phases", "milestones"), "update").alias("x")).select("batch_id", "x.*")
    listed = lambda c, a, b, mark: F.array_join(F.transform(c, lambda x: F.concat_ws(mark, x[a].cast("string"), x[b].cast("string"))), ",")
    return rounded(latest.withColumns({"phases": listed("phases", "phase", "n", "="), "milestones": listed("milestones", "milestone", "reached", ":")}), 9)


@query("select field_name, field_type, total_count, null_count, unique_count, round((completeness_rate + uniqueness_score) / 2, 6) as data_quality_score, total_files, failed_files, round(success_rate, 6) as success_rate, round(median_time, 6) as median_processing_time from stats, (select count(*) as total_files, count(distinct source_file) filter (where len(errors) > 0) as failed_files, 100.0 * count(*) filter (where len(errors) = 0 and status = 'completed') / count(*) as success_rate, median(processing_time) filter (where processing_time > 0) as median_time from rows_)", True)
def live_session(spark, sf):
    """The results in three turns; the session as it is given out after the last."""
    rows, folder, checkpoint = results(spark, sf), new_path(spark, "session"), new_path(spark, "checkpoint")
    in_turns(rows, "seq", lambda path: session.live_session(spark, path, rows.schema, TEMPLATE, folder, checkpoint).awaitTermination())
    out = session.emitted(session.SessionView(spark, f"{folder}/view"))
    return rounded(out.select("field_name", "field_type", "total_count", "null_count", "unique_count", "data_quality_score", "total_files", "failed_files", "success_rate", "median_processing_time"))


@query("select source_file, (select count(*) from rows_ where status = 'completed') as done_files, (select cast(count(*) as bigint) from rows_ where status <> 'completed') as remaining_files from rows_ where status <> 'completed'", True)
def resumed_state(spark, sf):
    """A run that stopped after its completed files: saved, found again as the newest saved state, and loaded; the files that are left."""
    files = results(spark, sf)
    done = records.completed(records.validated(files, TEMPLATE)).drop("fields")
    left = runs.pending(files.select(F.col("source_file").alias("path")), done.select(F.col("source_file").alias("path")))
    folder = new_path(spark, "states")
    n, k = files.count(), left.count()
    states.save_state(spark, folder, "run", {"results": done, "remaining": left}, progress=100.0 * (n - k) / max(n, 1), remaining_files=k)
    newest = saved_states(spark, folder).first()
    facts, tables = states.load_state(spark, newest.path)
    return tables["remaining"].select(F.col("path").alias("source_file"), F.lit(tables["results"].count()).alias("done_files"), F.lit(facts["remaining_files"]).cast("long").alias("remaining_files"))
