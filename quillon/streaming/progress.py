"""The state of running batches, kept by a stateful operator while their log arrives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import monitoring

MARKS = (0.25, 0.5, 0.75, 0.9)
RECENT = 20
OUT = "batch_id long, total_files long, records long, done long, since double, last_seq long, mean double, phases array<struct<phase: string, n: long, total_time: double>>, milestones array<struct<milestone: double, reached: long>>"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _needed(mark: float, total: int) -> int:
    """The fewest done files whose share of the total is `mark` or more."""
    n = max(0, int(mark * total) - 1)
    while n / total < mark:
        n += 1
    return max(n, 1)


class BatchProgress(StatefulProcessor):
    """One batch's totals, its phases, its successful files, its last records and the milestones it has reached.

    The state grows with a batch's distinct successful files alone; they lie in a map, of which only the files of the rows at hand are
    looked up. With `forget_after` seconds the state of a batch whose files are all done goes once so long nothing has come."""

    def __init__(self, forget_after: float | None = None):
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "records long, done long, since double, last_seq long, total long")
        self.phases = handle.getMapState("phases", "phase string", "n long, total_time double")
        self.files = handle.getMapState("files", "file_path string", "seq long")
        self.recent = handle.getListState("recent", "seq long, file_path string, processing_time double")
        self.reached = handle.getMapState("reached", "milestone double", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        records, done, since, last_seq, total = self.totals.get() if self.totals.exists() else (0, 0, None, None, 0)
        phases: dict[str, list] = {}
        firsts: dict[str, int] = {}
        recent = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []
        for part in rows:
            records += len(part)
            total = int(part["total_files"].iloc[-1])
            since = min(float(part["start_time"].min()), float("inf") if since is None else since)
            last_seq = max(int(part["seq"].max()), last_seq or 0)
            for phase, t in part.groupby("phase")["processing_time"]:
                own = phases.setdefault(phase, [0, 0.0])
                own[0] += len(t)
                own[1] += float(t.sum())
            for name, seq in part[part["success"].astype(bool)].groupby("file_path")["seq"].min().items():
                firsts[name] = min(int(seq), firsts.get(name, int(seq)))
            late = part.nlargest(RECENT, "seq")
            recent = sorted(recent + list(zip(late["seq"].tolist(), late["file_path"], late["processing_time"].tolist())), key=lambda x: x[0])[-RECENT:]
        for phase, (n, t) in phases.items():
            old = self.phases.getValue((phase,)) if self.phases.containsKey((phase,)) else (0, 0.0)
            self.phases.updateValue((phase,), (old[0] + n, old[1] + t))
        new = sorted((seq, name) for name, seq in firsts.items() if not self.files.containsKey((name,)))
        for seq, name in new:
            self.files.updateValue((name,), (seq,))
        for mark in MARKS:
            need = _needed(mark, total) if total else 0
            if done < need <= done + len(new):
                self.reached.updateValue((mark,), (new[need - done - 1][0],))
        done += len(new)
        self.totals.update((records, done, since, last_seq, total))
        self.recent.put(recent)
        if self.forget_after is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if total and done >= total:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.forget_after * 1000))
        times: dict[str, float] = {}
        for _, name, t in recent:
            times[name] = times.get(name, 0.0) + t
        held = [{"phase": k[0], "n": v[0], "total_time": v[1]} for k, v in self.phases.iterator()]
        marks = [{"milestone": k[0], "reached": v[0]} for k, v in self.reached.iterator()]
        yield pd.DataFrame({"batch_id": [key[0]], "total_files": [total], "records": [records], "done": [done], "since": [since], "last_seq": [last_seq], "mean": [sum(times.values()) / len(times)], "phases": [sorted(held, key=lambda x: x["phase"])], "milestones": [sorted(marks, key=lambda x: x["milestone"])]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.totals, self.phases, self.files, self.recent, self.reached):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, which maps and lists of a state need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def batch_states(log: DataFrame, batches: DataFrame, forget_after: float | None = None) -> DataFrame:
    """The streaming frame `log` (see operators.monitoring) to one row for each batch that has new records, as OUT says. Micro-batches come in
    the order of `seq`; inside one, rows may have any order. `batches` names each batch's total_files; records of no such batch are
    left out, as are those without a seq."""
    sized = batches.select(F.col("batch_id").cast("long").alias("batch_id"), F.col("total_files").cast("long").alias("total_files"))
    rows = log.where("seq is not null").select(F.col("batch_id").cast("long").alias("batch_id"), F.col("seq").cast("long").alias("seq"), "file_path", "phase", F.col("start_time").cast("double").alias("start_time"), F.coalesce(F.col("processing_time").cast("double"), F.lit(0.0)).alias("processing_time"), F.coalesce("success", F.lit(False)).alias("success")).join(sized, "batch_id")
    return rows.groupBy("batch_id").transformWithStateInPandas(BatchProgress(forget_after), outputStructType=OUT, outputMode="Update", timeMode="None" if forget_after is None else "ProcessingTime")


def shown(states: DataFrame, batches: DataFrame) -> DataFrame:
    """States with the batch's progress and both remaining times, by the same expressions as over a whole log."""
    rows = states.drop("total_files").join(batches.select(F.col("batch_id").cast("long").alias("batch_id"), "total_files", "current_phase", "current_progress"), "batch_id")
    return rows.select(*states.columns, monitoring.share_done().alias("progress"), *(c.alias(n) for n, c in monitoring.etas().items()))


def track(spark: SparkSession, source: str, schema, batches: DataFrame, checkpoint: str, on_update: Callable[[DataFrame, int], None], files_at_once: int | None = None, forget_after: float | None = None) -> StreamingQuery:
    """Follows the log files that arrive under `source`. After each micro-batch on_update gets the batches that have changed, as shown();
    a micro-batch that is run again after a failure gives the same rows. It works off what is there and ends; run again with the same
    checkpoint, it goes on from its state."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader
    states = batch_states(reader.parquet(source), batches, forget_after)
    with _rocks(spark):
        return states.writeStream.outputMode("update").foreachBatch(lambda df, n: on_update(shown(df, batches), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
