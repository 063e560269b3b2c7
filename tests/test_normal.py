"""Normal forms as expressions against Python's own."""

import random
import unicodedata

from pyspark.sql import functions as F

from quillon.functions import normal

#: Latin, Greek, Cyrillic and combining blocks.
BLOCKS = ((0x20, 0x250), (0x300, 0x530), (0x1AB0, 0x1B00), (0x1C80, 0x1C90), (0x1DC0, 0x2000), (0x20D0, 0x2150), (0x2C60, 0x2C80), (0x2DE0, 0x2E00), (0xA640, 0xA6A0), (0xA720, 0xA800), (0xAB30, 0xAB70), (0xFE20, 0xFE30))


def test_equal_to_the_library(spark):
    chars = [chr(c) for a, b in BLOCKS for c in range(a, b) if unicodedata.category(chr(c)) != "Cn"]
    marks, rng = [c for c in chars if unicodedata.combining(c)], random.Random(1)
    texts = ["".join(x) for x in zip(chars, ["a"] * len(chars), chars)] + ["".join(rng.choice(chars[100:]) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    texts += ["".join(rng.choice("aeoAEOuyαωЕи ") + "".join(rng.choice(marks) for _ in range(rng.randint(0, 4))) for _ in range(5)) for _ in range(600)] + ["", "plain", "中文 é\ńx", "́", "a\ń"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(4)
    out = df.select("t", normal.nfc(F.col("t")).alias("c"), normal.without_marks(F.col("t")).alias("w"))
    assert "Python" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        if r.t is None:
            assert r.c is None and r.w is None
            continue
        assert r.c == unicodedata.normalize("NFC", r.t), list(map(hex, map(ord, r.t)))
        assert r.w == "".join(c for c in unicodedata.normalize("NFD", r.t) if unicodedata.category(c) != "Mn"), list(map(hex, map(ord, r.t)))
