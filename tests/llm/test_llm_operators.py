"""The corpus operators against brute force on small tables, and on empty, null and repeated rows with clashing columns."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, debruijn, html, licences, near, quality, queries, quotes, secrets, shards, winnow

SCHEMA = "doc_id long, text string, n_words long, kept string, shard string, findings string"


def texts(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "an", "re", "é", "on", "er"]) for _ in range(rng.randint(1, 3)))
    out = [" ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 30, 200]))) for _ in range(n)]
    for i in range(0, n, 5):  # near copies, copies, shared passages
        w = out[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
        out.append(out[i].upper() + "\n")
        out.append(word() + " " + " ".join(out[(i * 7) % n].split(" ")[:25]) + " " + word())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts())) + [(900, None), (901, ""), (902, "  \n"), (903, "one"), (904, "ONE"), (5, texts()[5])]
    return rows, frame(spark, rows).repartition(3)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def blank_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 50)])
def test_near_duplicates(docs, k, num):
    rows, df = docs
    sets = {}
    for i, t in rows:
        w = blank_words(low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    at = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    at[a] = at[b] = min(at[a], at[b])
        if all(at[at[i]] == at[i] for i in at):
            break
    got = near.near_duplicates(df, k, num, 100).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), at[i]) for i, s in sets.items()}


def test_heavy_sets_alone_give_the_same(spark, docs, monkeypatch):
    _, df = docs
    both = {(r.doc_id, r.component_id) for r in near.near_duplicates(df, 3, 90, 100).collect()}
    monkeypatch.setattr(near, "boundary", lambda *a: 0)
    assert {(r.doc_id, r.component_id) for r in near.near_duplicates(df, 3, 90, 100).collect()} == both


def test_cut_repeats(docs):
    rows, df = docs
    first, words = {}, {i: blank_words(t) for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j : j + 13]), i)
    for r in debruijn.cut_repeats(df).collect():
        w = words[r.doc_id]
        gone = {q for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < r.doc_id for q in range(j, j + 13)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)


def test_decontaminate(spark, docs):
    rows, df = docs
    rows = rows + [(950, ("once upon " * 30 + "ONE two ") * 40), (951, " ".join(rows[4][1].split(" ")[2:12]) + " é"), (951, None)]
    df = frame(spark, rows).repartition(3)
    items = [(1, " ".join(rows[4][1].split(" ")[:14])), (2, rows[0][1]), (3, "one"), (4, None), (5, ""), (6, "nowhere to be found"), (7, "once upon " * 8), (8, rows[0][1]), (None, "two"), (1, "upon once, upon!")]
    items += [(i, " ".join(rows[i][1].split(" ")[i % 7 : i % 7 + 3 + i % 9])) for i in range(10, 40)]
    windows = {}
    for i, t in items:
        if i is None:
            continue
        w = alnum_words(t)
        for j in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + min(10, len(w))]), set()).add(str(i))
    held = spark.createDataFrame(items, "item_id long, text string")
    got = winnow.decontaminate(df, held).collect()
    assert len(got) == len(rows) and sum(r.contaminated for r in got) > 20
    columns = ["doc_id", *winnow.NEW]
    assert sorted(map(repr, winnow.measure(df, held).select(*columns).collect())) == sorted(map(repr, winnow.decontaminate(df, held).select(*columns).collect()))
    for r in got:
        w, hit, found = alnum_words(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        if hit:
            assert alnum_words(r.clean_text) == [x for q, x in enumerate(w) if q not in hit]


def test_tokens_match_the_library(spark, docs):
    from tokenizers import Tokenizer

    rows, df = docs
    path = queries.vocabulary_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    odd = ["<|endoftext|>", "a<|endoftext|> b", " " * 50, "x\x1c\x85 'll we're 12éé中文 \n\n a", "aaaa" * 100] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600)])) for _ in range(40)) for _ in range(200)]
    odd = list(enumerate(odd, 2000))
    for r in bpe.tokenize(frame(spark, rows + odd), path, ids=True).collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == library.decode(want, skip_special_tokens=False) == (r.text or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_shards(docs):
    rows, df = docs
    wide = df.sparkSession.range(3000).selectExpr("id as doc_id", "string(id) as text").union(df.select("doc_id", "text"))
    got = shards.shard(wide).collect()
    assert len(got) == 3000 + len(rows) and {r.shard for r in got} == set(range(40))
    assert all(r.grown_shard in (r.shard, 40) for r in got) and any(r.grown_shard == 40 for r in got)
    for s in range(40):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own))) and 45 <= len(own) <= 115
    assert {r["size"] for r in got if r.doc_id == 900} >= {16}


def test_licences():
    phrases = licences.automaton()
    n, n_base, first, last, base, labels, score, _ = licences.scan("cc by cc by, General  Public\nLicense. CC-BY", phrases)
    assert (n, n_base, first, last, base) == (9, 4, 0, 7, "cc-by,gpl") and 0 < score <= 1
    assert licences.scan(None, phrases)[:7] == (0, 0, None, None, "", "", 0.0)
    assert licences.scan("SPDX-License-Identifier: (MIT OR GPL-2.0) AND BSD-3-Clause\n", phrases)[5].split(",") == ["spdx-permissive", "spdx:bsd-3-clause", "spdx:gpl-2.0", "spdx:mit"]
    value = licences.evaluate
    assert not value("MIT AND GPL-2.0").permissive and value("MIT OR GPL-2.0").permissive and value("GPL-2.0 WITH Classpath-exception-2.0").permissive
    assert value("MIT OR") is None and value("(MIT") is None and value("") is None


def test_secrets(spark):
    rows = [(1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y and card 4845168114407329 end'), (2, "see /static/assets/v12/index.html.json or mail7.example.com now"), (3, None), (4, "")]
    got = {r.doc_id: r for r in secrets.find(frame(spark, rows)).collect()}
    assert got[1].redacted == 'x token = "[SECRET]" y and card 4845168114407329 end'
    assert got[2].redacted == rows[1][1] and got[3].redacted is None and got[4].redacted == "" and got[3].findings == []


def test_secrets_of_any_length_and_sign(spark):
    made = [("password = ", "abc123def456", " end"), ('x token: "', "abc123def456", '"'), ('password = "', "correctHorseBatteryStaple", '" y'), ("password: ", "Tr0ub4dor&3xyz", ", and more"), ("db postgres://admin:", "S3cr3tPassw0rdLong99", "@host/x"), ("API_KEY=", "9f8e7d6c5b4a39281706f5e4d3c2b1a0", " next"), ("Authorization: Bearer ", "abc123def456", "")]
    plain = ["the key: a good idea, token: the word", 'password = os.environ["PW"]', "https://git@github.com/a/b", "commit 9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c next"]
    rows = list(enumerate([b + c + a for b, c, a in made] + plain))
    got = [r.redacted for r in secrets.find(frame(spark, rows)).orderBy("doc_id").collect()]
    assert got == [f"{b}[SECRET]{a}" for b, _, a in made] + plain
    two = secrets.find(frame(spark, [(1, "a?token=abc123def&password=hunter2x")])).first()  # each value alone
    assert [f.candidate for f in two.findings] == ["abc123def", "hunter2x"]


def test_secrets_that_a_scan_can_meet(spark):
    held = secrets.labelled(600, seed=99)
    out = secrets.find(frame(spark, [(i, b + c + a) for i, (b, c, a, _) in enumerate(held)])).orderBy("doc_id").collect()
    assert all(any(f.candidate in c or c in f.candidate for f in r.findings) for (_, c, _, y), r in zip(held, out) if y)
    assert sum((c in r.redacted) for (_, c, _, y), r in zip(held, out) if y) <= 6
    assert sum(r.redacted != b + c + a for (b, c, a, y), r in zip(held, out) if not y) <= 6


def test_secrets_held_out(spark):
    forest = secrets.train(secrets.made_findings(spark))
    got = secrets.held_out(secrets.made_findings(spark, 1500, seed=77), forest)
    assert got["recall"] >= 0.95 and got["precision"] >= 0.95, got


def test_secrets_with_clashing_columns_and_repeats(spark):
    rows = [('token = "abc123def456"', "mine", "his", 1, 2)] * 2 + [("", "mine", "his", 1, 2), (None, "mine", "his", 1, 2)]
    out = secrets.find(spark.createDataFrame(rows, "text string, pieces string, found string, findings int, redacted int")).collect()
    assert [(r.redacted, r.pieces, r.found) for r in out] == [('token = "[SECRET]"', "mine", "his")] * 2 + [("", "mine", "his"), (None, "mine", "his")]


def test_secrets_trained_on_given_findings(spark):
    """Findings of another kind than the made ones: what they call a secret is one."""
    rng = random.Random(3)
    rows = [("id code ", "Z" + "".join(rng.choice("0123456789") for _ in range(19)), " end", 1) for _ in range(150)] + [("id code ", "".join(rng.choice("0123456789") for _ in range(20)), " end", 0) for _ in range(150)]
    forest = secrets.train(spark.createDataFrame(rows + [(None, "a", "b", 1), ("a", "b", "c", None)], secrets.FINDINGS))
    assert secrets.find(frame(spark, [(1, "id code Z0123456789012345678 end 01234567890123456789 x")]), forest).first().redacted == "id code [SECRET] end 01234567890123456789 x"


def test_html():
    model = html.train()
    held = html.labelled_pages(200, seed=99)
    exact = right = wrong = missed = 0
    for p, words in held:
        own, got = [w for w, mine in words if mine], html.extract(p, model).split()
        exact += own == got
        right += len(set(own) & set(got))
        wrong += len(set(got) - set(own))
        missed += len(set(own) - set(got))
    assert exact >= 150 and right / (right + wrong) > 0.99 and right / (right + missed) > 0.98
    page = '<body><nav><a>m</a></nav><article><h1>T &amp; U</h1><p>Hello <b>wide\n world</b><br>x<aside>ad words</aside><p>bye</article><script>var a="<p>"</script></body>'
    assert html.extract(page, model) == "T & U\n\nHello wide world x\n\nbye"
    assert html.extract(None, model) == html.extract("", model) == html.extract("<p></p>", model) == ""


def test_html_of_any_layout():
    model, some = html.train(), " ".join(f"word{i}" for i in range(50))
    assert html.extract(f'<div class="foo"><p>{some}</p></div>', model) == some
    assert html.extract(f'<div class="story"><h2>T</h2><p>{some}</p></div>', model) == f"T\n\n{some}"
    assert html.extract(some, model) == some
    assert html.extract(f"<article><p>{some}</p><pre>code x = 1</pre></article>", model) == f"{some}\n\ncode x = 1"
    assert html.extract(f'<div><a href="x">Home</a> <a href="y">About us</a></div><div id="q"><p>{some}.</p></div><div class="comments"><p>{some}. says a reader.</p></div>', model) == some + "."
    long = "".join(f"<p>{some} {i}.</p>" for i in range(4000))
    assert html.extract(f"<article>{long}</article>", model).count("\n\n") == 3999


def test_pages_repeated_null_and_with_clashing_columns(spark):
    rows = [(1, "<article><p>one two three</p></article>", "mine", 7, "z")] * 2 + [(2, None, "mine", 7, "z"), (3, "", "mine", 7, "z")]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int, features string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars, r.features) for r in out) == [(1, "one two three", 13, "z")] * 2 + [(2, "", 0, "z"), (3, "", 0, "z")]


def test_quality(spark, docs):
    rng = random.Random(2)
    nice, junk = ["the", "and", "walk", "house", "green", "river", "stone", "light"], ["zxq###", "***", "$$$kk", "%%%"]
    def made(i):
        bad, rude = i % 7 == 0, i % 5 == 0
        w = [f"{rng.choice(junk if bad and rng.random() < 0.5 else nice)}{rng.randrange(99)}" for _ in range(80)]
        return (i, " ".join(w + ["idiot", "moron"] * rude)), (i, int(not bad), int(rude))
    rows, labels = zip(*(made(i) for i in range(600)))
    out = quality.apply_rules(frame(spark, list(rows) + [(900, None), (901, "")]), spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")).collect()
    truth = {i: q == 1 and t == 0 for i, q, t in labels}
    assert sum(r.kept == truth.get(r.doc_id, False) for r in out) / len(out) > 0.97
    r = next(x for x in out if x.doc_id == 900)
    assert (r.n_words, r.base_failed, r.kept) == (0, True, False)
    assert all(quality.apply_rules(frame(spark, list(rows[:20])), spark.createDataFrame([], "doc_id long, quality int, toxic int")).select("kept").toPandas().kept)


def test_quotes(spark):
    rows = [(1, 0, "user", "What is the plan for today?\nAnd who comes along?"), (1, 1, "bot", "We walk."), (1, 2, "user", "Ann wrote:\n> What is the  PLAN for today?\nStill very open."), (1, 3, "bot", "> > what is the plan for today?\n> Still very open.\nIndeed"), (2, 0, "user", None), (2, 0, "user", None), (None, None, None, "> lost quote here")]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[1, t].parent_turn, got[1, t].n_quotes, got[1, t].n_linked, got[1, t].clean_text) for t in range(4)] == [(None, 0, 0, rows[0][3]), (0, 0, 0, "We walk."), (0, 1, 1, "Still very open."), (2, 2, 2, "Indeed")]  # the direct parent is the quote of the lowest level
    assert got[2, 0].clean_text == "" and got[None, None].n_linked == 0


def test_quotes_of_lines_out_of_longer_messages(spark):
    start = "One line.\nSecond line here.\nThird line of it.\n\nYes, agreed\nLast line ends."
    rows = [
        (1, 0, start),
        (1, 1, "Unrelated, but long enough to be a turn."),
        (1, 2, "Something else."),
        (1, 3, "> Second line here.\n> Third line of it.\nMine one\nMine two\n> yes, agreed\nMine three"),  # two lines; a short one
        (1, 4, "> Mine one\n> Mine two\nok"),  # a passage of an interleaved reply
        (1, 5, "> Third line\n> of it.\n>\n> Yes, agreed Last line ends.\nno"),  # wrapped anew, over a blank line
        (1, 6, "> One line.\n> Third line of it.\n> ok\nnot successive"),  # no such run
        (1, 7, "> ok\n> \n\n> line here.\nshort"),  # ok is turn 4; the part of a line is none
        (1, 8, "> later\nown"),  # only earlier turns count
        (1, 9, "later"),
    ]
    got = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert {t: (r.parent_turn, r.n_quotes, r.n_linked) for t, r in got.items() if t > 2} == {3: (0, 2, 2), 4: (3, 1, 1), 5: (0, 1, 1), 6: (5, 1, 0), 7: (4, 2, 1), 8: (7, 1, 0), 9: (8, 0, 0)}


def test_quotes_probe_of_levels(spark):
    rows = [(1, 0, "u", "What is the plan for this?"), (1, 1, "u", "Still very open, I fear"), (1, 2, "u", "> > What is the plan for this?\n> Still very open, I fear\nso?"), (1, 3, "u", "> What is the plan for this?\nNone yet."), (1, 4, "u", "last"), (1, 2, "u", "> > What is the plan for this?\n> Still very open, I fear\nso?")]
    got = {r.turn: (r.parent_turn, r.position) for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0), 1: (0, 1), 2: (1, 2), 3: (0, 3), 4: (3, 4)}


def preorder(parents):
    kids = {}
    for t, p in sorted(parents.items()):
        kids.setdefault(p, []).append(t)
    out, todo = [], kids.get(None, [])[::-1]
    while todo:
        out.append(todo.pop())
        todo += kids.get(out[-1], [])[::-1]
    return {t: i for i, t in enumerate(out)}


def test_quotes_made_from_the_conversations(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SPAN", 2)
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    rows, want, rng, said = [], {}, random.Random(5), {}
    for r in talk:
        before, text = said.setdefault(r.conv_id, {}), r.text
        want[r.conv_id, r.turn] = max(before, default=None)
        if before and rng.random() < 0.6:
            t = rng.choice(sorted(before))
            line = rng.choice([x for x in before[t].split("\n") if x.strip()] or [""])
            if line:
                text = "> " + line + "\n" + r.text
                want[r.conv_id, r.turn] = max(u for u, x in before.items() if " ".join(line.lower().split()) in [" ".join(y.lower().split()) for y in x.split("\n")])
        before[r.turn] = r.text
        rows.append((r.conv_id, r.turn, r.role, text))
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in out} == want and sum(r.n_linked for r in out) > 20
    for c in {c for c, _ in want}:
        assert {r.turn: r.position for r in out if r.conv_id == c} == preorder({t: p for (d, t), p in want.items() if d == c})


def test_quotes_against_brute_force(spark):
    rng = random.Random(8)
    norm = lambda t: " ".join(t.lower().split())
    convs, rows = [], []
    for c in range(12):
        own = []
        for t in range(14):
            mine = [" ".join(rng.choice(["ab", "Cd", "e", "ok"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 5))]
            quote = []
            if t and rng.random() < 0.8:
                src = own[rng.randrange(t)]
                s = rng.randrange(len(src))
                quote = src[s : s + rng.randint(1, 3)] + (["zz"] if rng.random() < 0.2 else [])
            own.append(mine)
            rows.append((c, t, "u", "\n".join(["> " + q for q in quote] + mine)))
            convs.append((c, t, norm(" ".join(quote)) if quote else None))
    said = {(c, t): [x for x in text.split("\n") if not x.startswith(">")] for c, t, _, text in rows}
    runs = {k: {norm(" ".join(v[i:j])) for i in range(len(v)) for j in range(i + 1, len(v) + 1)} for k, v in said.items()}
    want = {(c, t): max((u for u in range(t) if q in runs[c, u]), default=None) if q else None for c, t, q in convs}
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, r.n_linked) for r in out} == {(c, t): (w if w is not None else (t - 1 if t else None), int(w is not None)) for (c, t), w in want.items()}
    assert sum(w is not None for w in want.values()) > 80
    for c in range(12):
        assert {r.turn: r.position for r in out if r.conv_id == c} == preorder({r.turn: r.parent_turn for r in out if r.conv_id == c})


def test_empty_tables(spark):
    none = frame(spark, [])
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    runs = [near.near_duplicates(none), debruijn.cut_repeats(none), winnow.decontaminate(none, items), bpe.tokenize(none, queries.vocabulary_path()), shards.shard(none), licences.scan_licences(none), secrets.findings(none), quality.apply_rules(none, labels), html.main_text(none.withColumn("html", F.col("text"))), quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))]
    assert [r.count() for r in runs] == [0] * len(runs)


def test_word_features():
    features, rows = quality.word_features(quality.Texts(pa.array(["sternly ###", "sternest", None, "", "a ### a", "ab#", "ab"]), lower=True))
    of = [set(features[rows == i].tolist()) for i in range(7)]
    assert [len(x) for x in of] == [5, 4, 0, 0, 3, 2, 1]  # each word, pair, run of signs and start of 4, 5 or 6 bytes once
    assert len(of[0] & of[1]) == 2 and len(of[0] & of[4]) == 1 and of[6] < of[5]


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op9_substring_dedup"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf).select(*columns).collect())) == sorted(want.fetchall())
