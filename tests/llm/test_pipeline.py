"""The corpus pipeline against brute force, with null and repeated ids."""

import hashlib
import random

import pytest

import corpus_pipeline
from quillon.llm import quality

SCHEMA = "doc_id long, text string, n_chars long"


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "and", "walk", "house", "green", "river", "stone", "light", "of", "to"]) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    item = "unheard question about seventeen purple elephants dancing on frozen lakes"
    texts = [(i, prose(i)) for i in range(6)]
    texts += [(10, prose(3) + " more"), (None, prose(20)), (None, prose(1)), (7, prose(31)), (7, prose(30)), (7, None), (8, prose(4)), (8, "a " + prose(33)), (9, prose(40) + " " + item + " " + prose(41)), (11, prose(50) + ' password = "Tr0ub4dor&3xyz" ' + prose(51)), (2, prose(2))]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in texts], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), texts, item


def pairs(rows):
    return sorted(((r.doc_id, r.text) for r in rows.collect()), key=repr)


def distinct(rows):
    """What stage 2 is to leave of (doc_id, text)."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[i] = min(least.get(i, (True, "")), (t is None, t or "")) if i in least else (t is None, t or "")
    least = {i: None if none else t for i, (none, t) in least.items()}
    sets, top = {i: shingles(t) for i, t in least.items()}, {i: i for i in least}
    for _ in least:
        for a in least:
            for b in least:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    return sorted([(i, t) for i, t in least.items() if top[i] == i] + [(i, t) for i, t in rows if i is None], key=repr)


def test_stages(spark, sf):
    at, texts, item = sf
    docs = spark.read.parquet(f"{at}/documents.parquet").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert pairs(stages["quality rules"](spark, docs, at)) == sorted(((r.doc_id, r.text) for r in quality.apply_rules(docs, spark.read.parquet(f"{at}/labels.parquet")).collect() if r.kept), key=repr)
    got = stages["n-gram Jaccard join"](spark, docs, at)
    assert got.columns == docs.columns and pairs(got) == distinct(texts)
    assert sum(i is None for i, _ in pairs(got)) == 2 and (7, min(prose(30), prose(31))) in pairs(got) and 10 not in dict(pairs(got))
    clean = dict(pairs(stages["benchmark decontamination"](spark, docs, at)))
    assert item.split()[3] not in clean[9] and clean[9].split() == (prose(40) + " " + prose(41)).split() and clean[0] == prose(0)
    safe = stages["secret scans"](spark, docs, at)
    assert pairs(safe) == sorted(((i, t and t.replace("Tr0ub4dor&3xyz", "[SECRET]")) for i, t in texts), key=repr)
    assert all(r.n_chars == len(r.text) for r in safe.where("text is not null").collect())


def test_run(spark, sf):
    at, texts, item = sf
    docs = spark.read.parquet(f"{at}/documents.parquet")
    good = [(r.doc_id, r.text) for r in quality.apply_rules(docs, spark.read.parquet(f"{at}/labels.parquet")).where("kept").collect()]
    cut = {9: prose(40) + "  " + prose(41)}  # the words go, the blanks around them stay
    want = [(i, cut.get(i, t).replace("Tr0ub4dor&3xyz", "[SECRET]")) for i, t in distinct(good)]
    out = corpus_pipeline.run(spark, at).collect()
    assert len(want) > 8 and sorted(((r.doc_id, r.decoded_sha256) for r in out), key=repr) == sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want), key=repr)


def test_columns_of_any_name_and_type(spark, sf):
    """Columns named like an operator's own, and a map, come through every stage as they were."""
    at, texts, _ = sf
    names = ["none", "n_hit", "n_words", "kept", "p_good", "redacted", "findings", "clean_text", "contaminated", "own_column_0", "spans", "x", "tid"]
    docs = spark.createDataFrame([(i, t, len(t or ""), {"a": 1}, [t], *names) for i, t in texts], SCHEMA + ", facts map<string,int>, list array<string>, " + ", ".join(f"{c} string" for c in names)).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, at)
        assert docs.dtypes == before.dtypes, name
        rows = docs.collect()
        assert rows and all(r.facts == {"a": 1} and all(r[c] == c for c in names) for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, at).count() == len(rows)
