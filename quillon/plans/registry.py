"""Where queries and their SQL are put by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, fixture: bool | str = False):
    """Registers a function under its name; `fixture`: the SQL stands on the results' CTEs, or on those of the name given."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {fixtures.SQL if fixture is True else fixture} {sql}" if fixture else sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Sums of doubles depend on the order of rows: every double column is rounded, here and in the SQL."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
