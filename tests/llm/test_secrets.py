"""Candidates of the secret scan: names, blanks, users and escapes of any length, against a plain finder; marks never show."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.made_findings(spark))


def candidates(spark, texts, forest):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.find(df, forest).orderBy("doc_id").collect()
    return [[f.candidate for f in r.findings] for r in rows], rows


def test_what_caps_once_lost(spark, forest):
    texts = ['SECRET_KEY_FOR_THE_STAGING_ENVIRONMENT = "Tr0ub4dor&3x"', 'PASSWORD_OF_THE_REPORTING_DATABASE="Tr0ub4dor&3x"', f"password{' ' * 40}= \t{' ' * 30}'Tr0ub4dor&3x'", f"see postgres://{'u' * 500}:Tr0ub4dor3x@host/db", 'token = "' + '\\"a1' * 500 + '"', f"{'x' * 3000}_token_{'y' * 3000}: Tr0ub4dor&3x"]
    got, rows = candidates(spark, texts, forest)
    assert [g[:1] for g in got] == [["Tr0ub4dor&3x"]] * 3 + [["Tr0ub4dor3x"], ['\\"a1' * 500], ["Tr0ub4dor&3x"]]
    assert all("[SECRET]" in r.redacted and "ub4dor" not in r.redacted for r in rows[:4])


def test_assigned_values_by_a_plain_finder(spark, forest):
    rng = random.Random(6)
    part = lambda n: "".join(rng.choice("abcdefghijklmnop_-QRS") for _ in range(n))
    texts = []
    for _ in range(200):
        name = rng.choice(["", part(3) + "_", part(40) + "-"]) + rng.choice(["key", "Token", "SECRETS", "password", "pwd", "auth"]) + rng.choice(["", "_" + part(30), "2", "-" + part(2)])
        sign = " " * rng.randrange(6) + rng.choice(["=", ":", ":=", "=>", "=="]) + "\t" * rng.randrange(6)
        value = "".join(rng.choice("abcXYZ019!#%") for _ in range(rng.randrange(6, 14)))
        q = rng.choice(["", '"', "'"])
        texts.append(f"plain words here {name}{sign}{q}{value}{q} and more")
    got, _ = candidates(spark, texts, forest)
    for text, found in zip(texts, got):
        value = re.search(r"(?::=|=>|==|=|:)\t*[\"']?([^\s\"']+)", text)[1]
        assert found[-1:] == [value], text  # a long name with a digit is a candidate, too


def test_marks_never_show(spark, forest):
    odd = "".join((secrets._VALUE, secrets._QUOTED, secrets._USER, secrets._ESCAPE))
    texts = [f"a{odd} password = x{odd}7Zq! {secrets._ESCAPE}b {secrets._ESCAPE}{secrets._VALUE}", "key: a", None, "", "secret 'Tr0ub4dor&3x' bearer Tr0ub4dor", f"no word {odd} ABCdef0123456789abcdefXYZ {odd}"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, marked string")
    rows = {r.doc_id: r for r in secrets.find(df, forest).collect()}
    assert rows[0].findings[0].candidate == f"x{odd}7Zq!" and rows[0].redacted in (texts[0], texts[0].replace(f"x{odd}7Zq!", "[SECRET]"))
    assert rows[1].redacted == texts[1] and rows[2].redacted is None and rows[3].redacted == "" and {r.marked for r in rows.values()} == {"m"}
    assert rows[5].findings[0].candidate == "ABCdef0123456789abcdefXYZ" and rows[5].redacted.replace("[SECRET]", "ABCdef0123456789abcdefXYZ") == texts[5]
    same = df.select(secrets._clean(secrets.marked(F.col("text"))).alias("t"), "text").where("not t <=> text")
    assert same.count() == 0


@pytest.mark.parametrize("text", ["key-" * 100_000, "keyA" * 100_000 + "_", ("key" + " " * 50) * 8_000, 'password="' * 40_000, 'password="' + "\\a" * 200_000 + '"', "://a:" * 80_000, "://" + "a" * 300_000 + ":"], ids=range(7))
def test_long_runs(spark, forest, text):
    assert candidates(spark, [text], forest)[1][0].redacted is not None
