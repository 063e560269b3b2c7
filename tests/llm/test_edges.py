"""Null, empty, very long and repeated texts, ties and clashing column names, for every operator; base columns against brute force."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from quillon.llm import bpe, debruijn, licences, near, quality, queries, quotes, secrets, shards, winnow

SF = "/root/testdata/sf0.01"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Names that operators use inside or give out.
NAMES = ["spans", "tid", "_facts", "region", "flat", "leaf", "pieces", "found", "shard", "n_words", "salt", "path", "hits"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(300_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, long), (6, long + " and more"), (7, "x" * 400_000), (8, "same text here " * 20), (8, "same text here " * 20), (None, "no id " * 10), (None, None), (9, "é" * 10 + "\r\n" + "\x1c\x85\xa0 中文 字")]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in NAMES)
    return texts, spark.createDataFrame([(i, t, *NAMES) for i, t in texts], schema).repartition(4)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def kept_columns(rows, replaced):
    """Columns that are not replaced hold their own names still."""
    return all(getattr(r, c) == c for r in rows for c in NAMES if c not in replaced)


def test_every_row_comes_out(spark, odd):
    texts, df = odd
    labels = spark.createDataFrame([(8, 1, 0), (8, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "same text here " * 4), (2, None), (None, "w1")], "item_id long, text string")
    runs = {
        "quality": (quality.apply_rules(df, labels), {"n_words"}), "bpe": (bpe.tokenize(df, queries.vocabulary_path()), set()), "licences": (licences.scan_licences(df), {"n_words"}), "secrets": (secrets.find(df), set()),
        "decontaminate": (winnow.decontaminate(df, items), {"n_words"}), "measure": (winnow.measure(df, items), {"n_words"}), "cut": (debruijn.cut_repeats(df), {"n_words"}), "assign": (shards.assign(df, shards.even_tree(5)), {"shard"}),
    }
    for name, (out, replaced) in runs.items():
        rows = out.collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts), name
        assert kept_columns(rows, replaced), name
    assert Counter(r.doc_id for r in near.near_duplicates(df).collect()) == Counter(i for i, _ in texts)
    assert Counter(r.doc_id for r in shards.shard(df).collect()) == Counter(i for i, _ in texts)


def test_long_texts(spark, odd):
    texts, df = odd
    near_rows = {r.doc_id: r for r in near.near_duplicates(df).collect() if r.doc_id}
    assert near_rows[6].component_id == 5 and near_rows[1].component_id == 1 and near_rows[1].n_shingles == 0
    cut = {r.doc_id: r for r in debruijn.cut_repeats(df).collect() if r.doc_id}
    assert (cut[6].n_words, cut[6].n_removed, cut[6].kept_text) == (300_002, 300_000, "and more") and cut[5].n_removed == cut[8].n_removed == 0
    items = spark.createDataFrame([(1, " ".join(texts[4][1].split(" ")[150_000:150_040]))], "item_id long, text string")
    hit = {r.doc_id: r for r in winnow.measure(df, items).collect() if r.doc_id}
    assert hit[5].n_hit == hit[6].n_hit == 40 and hit[5].n_items == 1 and not hit[8].contaminated


def test_ids_of_rows_with_several_texts(spark):
    """Brute force over ids that repeat with other texts: an id is one node, whichever of its texts links."""
    rng = random.Random(4)
    base = [" ".join(f"t{k}x{i}" for i in range(40)) for k in range(8)]
    rows = [(rng.randrange(12), " ".join(w for w in rng.choice(base).split() if rng.random() > 0.02)) for _ in range(40)]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for _, t in rows]
    top = {i: i for i, _ in rows}
    for _ in rows:
        for (a, _), x in zip(rows, sets):
            for (b, _), y in zip(rows, sets):
                if 100 * len(x & y) >= 90 * len(x | y):
                    top[a] = top[b] = min(top[a], top[b])
    for order in (rows, rows[::-1]):
        got = near.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3), 3, 90, 100).collect()
        assert {(r.doc_id, r.component_id) for r in got} == set(top.items())


def test_shards_by_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = shards.shard(df).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 40)
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_changed_weights_move_rows_within_their_subtree(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = [[[1.0, 1.0], [1.0, 2.0]], [[1.0], [3.0, 1.0]]]
    other = [[[1.0, 1.0], [1.0, 1.0]], [[1.0], [3.0, 1.0]]]
    both = shards.assign(shards.assign(df, tree, name="a"), other, name="b").groupBy("a", "b").count().collect()
    # shard 3, and with it its rack (2, 3) and region (0 to 3), has lost weight: what moves leaves one of these, and nothing moves into them
    assert all(r.a == r.b or r.a < 4 and (r.b > 3 or r.a > 1 and r.b < 2 or r.a == 3 and r.b == 2) for r in both) and any(r.a != r.b for r in both)
    got = Counter({r.a: 0 for r in both})
    for r in both:
        got[r.a] += r["count"]
    for s, w in enumerate([1, 1, 1, 2, 1, 3, 1]):
        assert abs(got[s] / 20_000 - w / 10) < 0.02


def test_quality_base_columns_by_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = quality.OUT

    def base(batches):
        for batch in batches:
            counts = quality.base_counts(quality.Texts(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(counts[c]) for c in out)], names=["doc_id", *out])

    rows = df.mapInArrow(base, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long").collect()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        w = BLANK.findall(t)
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        threes = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_quality_base_rule(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(49))), (2, " ".join(f"w{i}" for i in range(50))), (3, "a b c " * 30), (4, " ".join(f"w{i}" for i in range(60)) + " a b c" * 20), (5, " ".join(f"w{i}" for i in range(59)) + " a b c" * 20)]
    out = quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in out} == {1: (True, False), 2: (False, True), 3: (True, False), 4: (False, True), 5: (True, False)}


def test_licence_base_columns_by_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(10**6, "cc by CC BY cc-by,cc by by cc"), (10**6 + 1, "All rights reserved all rights\nreserved general public general public license"), (10**6 + 2, None), (10**6 + 3, "ccc by cc bye")]
    df = df.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in licences.scan_licences(df).collect():
        w = ALNUM.findall(low(texts[r.doc_id]))
        starts, labels = [], set()
        for phrase, label in licences.BASE.items():
            p = phrase.split()
            own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += own
            labels |= {label} if own else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_tokens_of_many_pieces(spark):
    """The automaton against the library on texts made of the vocabulary's own pieces."""
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library, rng = Tokenizer.from_file(path), random.Random(6)
    tokens = [t for t in library.get_vocab() if t.isascii() and t.isalpha()]
    rows = [(i, "".join(rng.choice(tokens) for _ in range(rng.randint(1, 12)))) for i in range(3000)]
    for r in bpe.tokenize(spark.createDataFrame(rows, "doc_id long, text string"), path, ids=True).collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids


def test_spans_lie_at_their_source(spark):
    """Every span's words stand at its source coordinate, under a smaller doc_id."""
    rng = random.Random(2)
    passages = [" ".join(f"p{k}w{i}" for i in range(rng.randint(13, 60))) for k in range(6)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(9)) for _ in range(6))) for i in range(40)]
    rows += [(50, passages[0] + " " + passages[0]), (51, passages[0][: len(passages[0]) // 2] + " fork " + passages[0])]
    words = {i: t.split(" ") for i, t in rows}
    spans = debruijn.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(spans) > 40
    for s in spans:
        assert s.source < s.doc_id and words[s.doc_id][s.start : s.end] == words[s.source][s.source_start : s.source_start + s.end - s.start]


def test_messages_without_ids_and_with_ties(spark):
    rows = [(None, 1, "a", "hello there"), (None, 2, "b", "> hello there\nyes"), (1, 1, "a", "hello there"), (1, None, "b", "first"), (1, 2, "c", "> hello there\n> first"), (1, 2, "c", "> first"), (1, 3, None, None)]
    out = quotes.link_quotes(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn, r.n_quotes, r.n_linked): (r.parent_turn, r.position) for r in out}
    assert got[None, 2, 1, 1] == (1, 1) and got[1, None, 0, 0] == (None, 0) and got[1, 3, 0, 0][0] == 2
    long = [(7, i, "u", f"line {i} " + "word " * 50 + (f"\n> line {i - 1} " + "word " * 50 if i else "")) for i in range(400)]
    chain = quotes.link_quotes(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.parent_turn == (r.turn - 1 if r.turn else None) and r.position == r.turn for r in chain)


