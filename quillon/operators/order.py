"""Numbering, running totals, sliding frames and medians of long sequences, without sending them to one task.

Rows are dealt out by ranges of their order (Spark samples the bounds) and written, so that every later step sees the same parts.
What each part adds up to is a row for each part; the sums of the parts before it are added to what a window inside the part finds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import fresh, written

#: Rows of a span of a sliding frame.
SPAN = 1 << 16


def ranged(rows: DataFrame, by: Sequence[str], part: str) -> DataFrame:
    """rows with `part`, the number of the range of `by` that they are in: all of a smaller part come before all of a greater one, and
    equal ones are in one part."""
    return written(rows.repartitionByRange(*by).withColumn(part, F.spark_partition_id()))


def numbered(rows: DataFrame, by: str | Sequence[str], name: str = "i") -> DataFrame:
    """rows with `name`: their number from 0 in the order of `by`, nulls first; equal ones are numbered in any order. A column of that
    name is replaced. Windows hold one part; the driver gets one count for each."""
    by = [by] if isinstance(by, str) else list(by)
    part, before, inside = fresh([*rows.columns, name], "part", "before", "inside")
    own = ranged(rows, by, part)
    starts, at = [], 0
    for r in sorted(own.groupBy(part).agg(F.count("*")).collect()):
        starts.append((r[0], at))
        at += r[1]
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, f"{part} int, {before} long"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*by))
    return own.withColumn(inside, place).join(starts, part).withColumn(name, F.col(before) + F.col(inside) - 1).drop(part, before, inside)


_RUN = {"sum": F.sum, "min": F.min, "count": F.count, "first": lambda c: F.first(c, ignorenulls=True)}


def scanned(rows: DataFrame, within: str, by: str, running: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with running values over the rows of their group `within` up to and with them in the order of `by`: name -> (sum, min, count
    or first, column); `first` is the first that is not null. Columns of these names are replaced. A null group is a group.

    Two levels: windows hold one part of a group, and the parts' totals are summed up by group."""
    names = list(running)
    part, key, *inputs = fresh([*rows.columns, *names], "part", "key", *(f"v{i}" for i in range(len(names))))
    kinds = [running[n][0] for n in names]
    own = ranged(rows.withColumns({v: running[n][1] for v, n in zip(inputs, names)}), [within, by], part).withColumn(key, F.struct(within))
    inner = Window.partitionBy(key, part).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    # a part's total, and what all earlier parts of the group come to
    total = {"sum": F.sum, "min": F.min, "count": F.count, "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(by)))}
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    add = {"sum": F.sum, "count": F.sum, "min": F.min, "first": lambda c: F.first(c, ignorenulls=True)}
    before = fresh([*rows.columns, *names, part, key, *inputs], *(f"b{i}" for i in range(len(names))))
    spans = own.groupBy(key, part).agg(*(total[k](v).alias(v) for k, v in zip(kinds, inputs)))
    spans = spans.select(key, part, *(add[k](v).over(earlier).alias(b) for k, v, b in zip(kinds, inputs, before)))
    told = own.withColumns({v: _RUN[k](v).over(inner) for k, v in zip(kinds, inputs)}).join(spans, [key, part])
    joined = {"sum": lambda b, v: F.when(b.isNull() & v.isNull(), None).otherwise(F.coalesce(b, F.lit(0)) + F.coalesce(v, F.lit(0))), "count": lambda b, v: F.coalesce(b, F.lit(0)) + v, "min": lambda b, v: F.least(b, v), "first": lambda b, v: F.coalesce(b, v)}
    kept = [c for c in rows.columns if c not in names]
    return told.select(*kept, *(joined[k](F.col(b), F.col(v)).alias(n) for n, k, b, v in zip(names, kinds, before, inputs)))


def framed(rows: DataFrame, within: str, by: str, reach: int, number: str, span: str, copy: str) -> DataFrame:
    """For windows that look back `reach` rows at most: rows with their number from 1 in their group, the span of SPAN numbers that they are
    looked at in, and whether they are there only as a copy, for the rows after them to look back on. Windows are to be partitioned by `within`
    and `span` and ordered by `number`; copies are to be dropped after."""
    rows = scanned(rows, within, by, {number: ("count", F.lit(1))})
    at = F.floor((F.col(number) - 1) / SPAN).cast("long")
    (x,) = fresh(rows.columns, "x")
    last = (F.col(number) - 1) % SPAN >= SPAN - reach
    places = F.when(last, F.array(F.struct(at.alias("s"), F.lit(False).alias("c")), F.struct((at + 1).alias("s"), F.lit(True).alias("c")))).otherwise(F.array(F.struct(at.alias("s"), F.lit(False).alias("c"))))
    return rows.withColumn(x, F.explode(places)).withColumns({span: F.col(f"{x}.s"), copy: F.col(f"{x}.c")}).drop(x)


def medians(rows: DataFrame, keys: Sequence[str], value: str, name: str = "median", weight: str | None = None) -> DataFrame:
    """(keys, name): the exact median of `value` for each key (one row without keys), nulls left out; groups of nulls only have none. With
    `weight` a row counts that often.

    Values are counted, and the counts dealt out by ranges of key and value: a histogram with one total for each key and part. It tells
    the one or two parts that hold the middle ranks; only their values are put in order."""
    part, n, before, rank, total, x = fresh([*keys, value, name], "part", "n", "before", "rank", "total", "x")
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias(n))
    own = ranged(counted, [*keys, value], part)
    if not keys:
        (one,) = fresh([*own.columns, name], "one")
        own, keys = own.withColumn(one, F.lit(1)), [one]
    else:
        one = None
    of_key = Window.partitionBy(*keys)
    spans = own.groupBy(*keys, part).agg(F.sum(n).alias(n))
    spans = spans.withColumns({before: F.sum(n).over(of_key.orderBy(part)) - F.col(n), total: F.sum(n).over(of_key)})
    middle = F.array_distinct(F.array(F.floor((F.col(total) - 1) / 2), F.floor(F.col(total) / 2)))
    wanted = spans.withColumn(rank, F.explode(middle)).where((F.col(before) <= F.col(rank)) & (F.col(rank) < F.col(before) + F.col(n))).select(*keys, part, before, rank)
    near = own.alias("o").join(wanted.alias("w"), [F.col(f"o.{k}").eqNullSafe(F.col(f"w.{k}")) for k in [*keys, part]]).select(*(F.col(f"o.{k}").alias(k) for k in keys), F.col(f"o.{value}").alias(value), F.col(f"o.{n}").alias(n), F.col(f"w.{before}").alias(before), F.col(f"w.{rank}").alias(rank))
    so_far = F.col(before) + F.sum(n).over(Window.partitionBy(*keys, rank).orderBy(value))
    hit = near.withColumn(x, so_far).where((F.col(x) - F.col(n) <= F.col(rank)) & (F.col(rank) < F.col(x)))
    return hit.groupBy(*keys).agg(F.avg(value).alias(name)).drop(*([one] if one else []))


def last(rows: DataFrame, n: int, by: str, *within: str) -> DataFrame:
    """The n last rows by `by` of each group; Spark cuts each task's rows to n of a group before it shuffles them."""
    (r,) = fresh(rows.columns, "r")
    return rows.withColumn(r, F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(by)))).where(F.col(r) <= n).drop(r)


def first(rows: DataFrame, n: int, by: Sequence[str], *within: str) -> DataFrame:
    """The n first rows by `by` of each group, cut before the shuffle like last()."""
    (r,) = fresh(rows.columns, "r")
    return rows.withColumn(r, F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col(r) <= n).drop(r)


def axis_marks(rows: DataFrame, by: str) -> DataFrame:
    """rows with `i`, only those that an axis labels: all of up to ten, else every n // 8-th."""
    (total,) = fresh([*rows.columns, "i"], "total")
    count = rows.agg(F.count("*").alias(total))
    step: Column = F.when(F.col(total) <= 10, 1).otherwise(F.greatest(F.lit(1), F.floor(F.col(total) / 8)))
    return numbered(rows, by).join(F.broadcast(count)).where(F.col("i") % step == 0).drop(total)
