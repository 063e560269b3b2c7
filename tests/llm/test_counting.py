"""Phrase mining, clustering and token counts against brute force and the library, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import lloyd, phrases, queries, tokens

tokenizers = pytest.importorskip("tokenizers")


def brute_phrases(rows, least, top):
    """The contract, word by word."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    out = []
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in often.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(a, longer[lang, w[i : i + m]])
    for (lang, w), a in often.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        if 100 * longer[lang, w] < 80 * a:
            out.append((lang, score, a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]]))
    out.sort(key=lambda x: (x[0], -x[1], -x[2], x[3].encode()))
    rank, got = Counter(), set()
    for lang, score, a, w, left, rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            got.add((lang, rank[lang], w, a, left, rest, n[lang], score))
    return got


def test_phrases_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["a", "A", "b", "c\x01", "c", "new", "york", "city", "é", "中", "\x1f"]
    rows = [(rng.choice(["en", "fr", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n"]) for _ in range(rng.choice([0, 1, 3, 40, 200])))) for _ in range(120)]
    rows += [("en", None), (None, None), ("en", ""), ("de", "new york city " * 30_000), ("de", "x" * 100_000)]
    df = spark.createDataFrame([(lang, t, 1, 2) for lang, t in rows], "lang string, text string, f long, key long").repartition(4)
    for least, top in ((3, 2000), (20, 7)):
        want = brute_phrases(rows, least, top)
        assert len(want) > 5
        got = phrases.collocations(df, least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    # blocks, flushes and parts of a few words give the same
    monkeypatch.setattr(phrases, "BLOCK", 500)
    monkeypatch.setattr(phrases, "FLUSH", 64)
    got = phrases.collocations(df.where("lang <> 'de'"), least=3, top=50).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert {tuple(r) for r in got} == brute_phrases([r for r in rows if r[0] != "de" and r[0] is not None], 3, 50)


def test_no_phrases(spark):
    for rows in ([], [(None, None)], [("en", "one two three")]):
        assert phrases.collocations(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_radix_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, high, 5000).astype(np.uint32) for high in (3, 70_000, 2**32)]
    order = phrases.radix_order(keys)
    assert [tuple(int(k[i]) for k in keys) for i in order] == sorted(zip(*(k.tolist() for k in keys)))
    distinct, counts = phrases.run_lengths([keys[0]], None)
    assert dict(zip(distinct[0].tolist(), counts.tolist())) == Counter(keys[0].tolist())


def brute_lloyd(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-lloyd.MOST, min(lloyd.MOST, x)) for x in q]) for i, q in kept]
    centroids = [q for _, q in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign(cs):
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cs)) for _, q in kept]

    for _ in range(rounds):
        own = assign(centroids)
        for j in range(len(centroids)):
            mine = [q for (_, q), (_, c) in zip(kept, own) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign(centroids)
    cap = lambda x: min(x, lloyd.LAST_LONG)
    return Counter((i, j, cap(d), cap(sum(x for x, y in own if y == j)), cap(sum(x for x, _ in own)), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own))


@pytest.mark.parametrize("kind", ["plain", "ties", "huge", "few"])
def test_lloyd_by_brute_force(spark, kind):
    rng = random.Random(7)
    size = {"few": 5}.get(kind, 150)
    value = {"ties": lambda: float(rng.randrange(2)), "huge": lambda: rng.uniform(-1, 1) * 10.0 ** rng.randrange(300)}.get(kind, lambda: rng.gauss(0, 1))
    rows = [(i % 140, [value() for _ in range(64)]) for i in range(size)] + [(None, [0.5] * 64)] * 2
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [math.nan]), (905, [-math.inf] + [1.0] * 63), (906, [1.0] * 65)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, vec array<double>, q int, cluster int").repartition(3)
    got = lloyd.cluster(df).collect()
    assert Counter(tuple(r) for r in got) == brute_lloyd(rows + odd)


def test_lloyd_of_nothing(spark):
    assert lloyd.cluster(spark.createDataFrame([(1, None)], "vec_id long, vec array<float>")).collect() == []


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.vocabulary_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.WordVocabulary(queries.vocabulary_path("word_bpe_49k.json")))


def odd_texts(n, seed=2):
    rng = random.Random(seed)
    parts = ["'", "re", "ve", "'s", "t", "ll", " ", "  ", "é", "é", "Σ", "ΑΣ", "ß", "İ", "1", "23", "!", "...", "<|", "endoftext", "|>", "<|endoftext|>", "<|startoftext|>", "The", "running", "中文", "՘", "\n", "\x1c", "\x85", "ǆ", "😀", "‍"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_token_counts_as_the_library(spark, library):
    texts = odd_texts(400) + [None, "", " ", "x" * 50_000, "ab́" * 20_000, "word " * 3000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(1, texts[1], 5)], "doc_id long, text string, n_tokens long").repartition(3)
    got = tokens.count_tokens(df, queries.vocabulary_path("word_bpe_49k.json")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048), texts[r.doc_id][:80]


def test_every_prefix_as_the_library(counter, library):
    plain = tokenizers.Tokenizer.from_file(queries.vocabulary_path("word_bpe_49k.json"))
    plain.normalizer = tokenizers.normalizers.Sequence([])
    for text in odd_texts(150, 3):
        parts = counter.parts(text)
        counter.learn({p for _, pieces in parts for p in pieces or ()})
        normal = "".join(x for x, _ in parts)
        if "՘" in text:  # not in this Python's tables: the library's own decide, for whole texts
            continue
        want = [len(plain.encode(normal[:i], add_special_tokens=False).ids) for i in range(len(normal) + 1)]
        assert counter.prefixes(text).tolist() == want, text
        for limit in range(0, want[-1]):
            assert counter.fitting(parts, limit) == max(i for i, n in enumerate(want) if n <= limit), (text, limit)


def test_one_long_piece_as_many_short_ones(counter):
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"abcdeinorst") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for a, b in zip(counter.vocabulary.counts(pieces), pieces):
        assert a.tolist() == counter.vocabulary._alone(b, True).tolist()


def test_prefix_column(spark, counter):
    df = spark.createDataFrame([(1, "The cats' running!"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.count_tokens(df, queries.vocabulary_path("word_bpe_49k.json"), limit=2, prefixes=True).collect()}
    assert got[1].prefix_tokens == counter.prefixes("The cats' running!").tolist() and got[2].prefix_tokens == [0]
    assert got[1].over_limit and got[1].prefix_tokens[got[1].fit_chars] <= 2 and (got[2].n_bytes, got[2].n_tokens, got[2].fit_chars) == (0, 0, 0)
