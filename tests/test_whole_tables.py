"""Queries that once left rows out, on whole tables: against brute force and against the catalogue's SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def sql(statement):
    con = duckdb.connect()
    for t in ("documents", "orders", "customer", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.execute(statement).fetchall()


def shown(n):
    if n is None or n == 0:
        return None if n is None else "0 B"
    i = 0
    while n >= 1024 and i < 4:
        n, i = n / 1024, i + 1
    return f"{n:.1f} {['B', 'KB', 'MB', 'GB', 'TB'][i]}"


def test_file_size_format(spark):
    got = [tuple(r) for r in QUERIES["file_size_format"](spark, SF).collect()]
    assert sorted(got) == [(i, shown(None if n is None else n * 512)) for i, n in sql("select doc_id, n_chars from documents order by 1")]
    assert sorted(sql(ORACLES["file_size_format"])) == sorted(got)


def test_file_size_ties_and_nulls(spark):
    sizes = [None, 0, 1, 1023, 1024, 512 * 513, 1024**2 * 5 // 4, 1024**2 * 7 // 4, 1024**2 - 1, 1024**3 * 9 // 4, 1024**4 * 3, 1024**5 * 2]
    rows = spark.createDataFrame(list(enumerate(sizes)), "i long, n long").select("i", text.file_size(F.col("n")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [shown(n) for n in sizes]


@pytest.mark.parametrize("name", ["conv_number_vi", "conv_number_en", "conv_extractor_coerce"])
def test_numbers_of_all_lines(spark, name):
    got = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    want = sql(ORACLES[name])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {k % 10 for k, *_ in got} == set(range(1, 8)) and len(got) == sql("select count(*) from lineitem")[0][0]


def test_dates_of_all_orders(spark):
    got = sorted((tuple(r) for r in QUERIES["column_coercion"](spark, SF).collect()))
    want = sorted(sql(ORACLES["column_coercion"]))
    assert got == want and len(got) == sql("select count(*) from orders")[0][0]
    assert all((d is not None) == (k % 5 == 2 and k % 29 != 0 and k % 37 != 0) for k, _, d in got)


def test_priority_order_of_all_orders(spark):
    got = [tuple(r) for r in QUERIES["priority_order"](spark, SF).collect()]
    assert got == sql(ORACLES["priority_order"]) and len(got) == sql("select count(*) from orders")[0][0]
