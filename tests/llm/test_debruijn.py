"""Substring deduplication: rows of one id with several texts by brute force, compacted paths, and their verification."""

import hashlib
import random
import re
from collections import Counter

from quillon.llm import debruijn


def brute(rows, width=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for p in range(len(w) - width + 1):
            if i is not None:
                g = tuple(w[p : p + width])
                least[g] = min(i, least.get(g, i))
    out = Counter()
    for i, w in words:
        gone = {q for p in range(len(w) - width + 1) if i is not None and least[tuple(w[p : p + width])] < i for q in range(p, p + width)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def got(spark, rows, parts=5):
    df = spark.createDataFrame([(i, t, "tid", "key", 3) for i, t in rows], "doc_id long, text string, tid string, key string, digest int").repartition(parts)
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.cut_repeats(df).collect())


def test_two_texts_of_one_id(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    rows = [(1, p), (2, f"x {p} y"), (2, q)]
    assert got(spark, rows) == brute(rows)
    assert {r.n_removed for r in debruijn.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text == q} == {0}


def test_repeated_ids_by_brute_force(spark):
    rng = random.Random(11)
    passages = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([13, 14, 20, 60, 200]))) for _ in range(12)]
    rows = []
    for _ in range(150):
        i = rng.choice([None, *range(20)])
        t = rng.choice([" ", "  ", "\n"]).join([*rng.sample(passages, rng.randrange(3)), *(f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(15)))])
        rows += [(i, t)] * rng.choice([1, 1, 1, 3])
    rows += [(3, None), (None, None), (4, ""), (5, passages[0].replace(" ", "   "))]
    for parts in (1, 6):
        assert got(spark, rows, parts) == brute(rows)


def test_paths_are_compacted(spark):
    """A passage is one path however many minimizers its windows have; without compaction it would be several pieces."""
    rng = random.Random(3)
    passage = [f"v{rng.randrange(10**9)}" for _ in range(300)]
    rows = [(1, " ".join(["a", *passage, "b"])), (5, " ".join([*("c" + str(i) for i in range(4)), *passage, "d"])), (9, " ".join(passage[50:250]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.start, r.end, r.source, r.source_start) for r in debruijn.repeated_spans(df).collect()} == {(5, 4, 304, 1, 1), (9, 0, 200, 1, 51)}
    assert debruijn.pieces(debruijn.keyed(df), 13).count() > 2


def test_only_words_that_stand_at_the_source_are_cut(spark, monkeypatch):
    """A span that the fingerprints give wrongly is not cut."""
    rows = [(1, " ".join(f"a{i}" for i in range(30))), (2, " ".join(f"b{i}" for i in range(30)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first, second = debruijn.keyed(df.where("doc_id = 1")).first(), debruijn.keyed(df.where("doc_id = 2")).first()
    wrong = spark.createDataFrame([(2, second.tid, 3, 20, 1, first.tid, 3)], "doc_id long, tid long, start int, end int, source long, stid long, source_start int")
    monkeypatch.setattr(debruijn, "repeated_spans", lambda docs, width: wrong)
    assert {r.n_removed for r in debruijn.cut_repeats(df).collect()} == {0}
