"""A live session: results are validated as they arrive, and after each micro-batch the whole session's summary and field statistics are
given out anew, from partial results that are merged, not from the rows so far."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import partials, records
from ..sources.scratch import file_system
from ..sources.states import get_text, put_tables, put_text

#: Micro-batches whose partials are merged into one base.
MERGE_EVERY = 16


class SessionView:
    """The partial results of a session in a folder: a base, merged from all micro-batches up to one, and one set for each later
    micro-batch, known by its number: a micro-batch that is run again replaces its own set, or is in the base already."""

    def __init__(self, spark: SparkSession, folder: str, merge_every: int = MERGE_EVERY):
        self.spark, self.folder, self.merge_every = spark, folder, merge_every

    def base(self) -> dict:
        """The manifest of the merged part: upto, the last micro-batch in it, and the folder of its tables."""
        fs, at = file_system(self.spark, f"{self.folder}/base.json")
        return json.loads(get_text(self.spark, f"{self.folder}/base.json")) if fs.exists(at) else {"upto": -1, "tables": None}

    def _later(self, upto: int) -> list[tuple[int, str]]:
        fs, at = file_system(self.spark, self.folder)
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        numbers = (int(n[6:]) for n in found if n.startswith("batch=") and n[6:].isdigit())
        return [(n, f"{self.folder}/batch={n}") for n in sorted(numbers) if n > upto]

    def add(self, rows: DataFrame, batch: int) -> None:
        """Takes in a micro-batch of validated rows."""
        base = self.base()
        if batch <= base["upto"]:
            return
        put_tables(self.spark, self.folder, f"batch={batch}", partials.partials(rows))
        # micro-batches before this one are committed and will not be run again
        done = [x for x in self._later(base["upto"]) if x[0] < batch]
        if len(done) >= self.merge_every:
            self._merge(base, done)

    def _merge(self, base: dict, done: list[tuple[int, str]]) -> None:
        upto = done[-1][0]
        tables = put_tables(self.spark, self.folder, f"base={upto}", partials.merged(self._read([p for _, p in done], base)))
        put_text(self.spark, f"{self.folder}/base.json", json.dumps({"upto": upto, "tables": tables}))
        # only now is nothing read from these any more
        for path in [p for _, p in done] + [base["tables"]] * bool(base["tables"]):
            fs, at = file_system(self.spark, path)
            fs.delete(at, True)

    def _read(self, paths: list[str], base: dict) -> dict[str, DataFrame]:
        paths = paths + [base["tables"]] * bool(base["tables"])
        return {kind: self.spark.read.parquet(*(f"{p}/{kind}" for p in paths)) for kind in partials.KINDS}

    def parts(self) -> dict[str, DataFrame]:
        base = self.base()
        return self._read([p for _, p in self._later(base["upto"])], base)

    def summary(self) -> DataFrame:
        return partials.summary(self.parts())

    def field_quality(self) -> DataFrame:
        return partials.field_quality(self.parts())


def live_session(spark: SparkSession, source: str, schema, template: Sequence, folder: str, checkpoint: str, on_update: Callable[[DataFrame, SessionView, int], None] | None = None, files_at_once: int | None = None, merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Validates the result rows that arrive under `source`, appends them to folder/rows, takes them into the session's view, and calls
    on_update with the micro-batch's rows, the view of all so far, and the number. It works off what is there and ends; run again with the
    same checkpoint, it goes on after the last finished micro-batch."""
    view = SessionView(spark, f"{folder}/view", merge_every)
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader
    rows = records.validated(reader.parquet(source), template)

    def take(batch: DataFrame, n: int) -> None:
        path = f"{folder}/rows/batch={n}"
        batch.write.mode("overwrite").parquet(path)
        held = spark.read.schema(batch.schema).parquet(path)
        view.add(held, n)
        if on_update:
            on_update(held.drop("fields"), view, n)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def emitted(view: SessionView) -> DataFrame:
    """The session as one row for each field, with the session's own figures beside it."""
    return view.field_quality().join(F.broadcast(view.summary()))
