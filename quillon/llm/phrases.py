"""Phrase collocations by sorting packed n-grams of dictionary ids.

1. Texts are cut into pieces and words; a block holds some megabytes of one language: its distinct words, their counts, and its text as
   numbers of these words, 0 where a piece ends. Counts of all blocks make the dictionary: the words that occur `least` times, with ids in
   the order of language and word. Blocks get their words' ids by joins on the word and on the block (the dictionary is never sent whole
   to a task); a rarer word becomes a 0 too: pieces break there.
2. For n = 2, 3, 4 a task packs n ids of 32 bits into a key of fixed width, sorts its keys by 16-bit digits (radix) and counts runs. Keys are
   dealt out by ranges whose bounds come from a sample of known size; a range is sorted and counted again where it meets. An n-gram of which
   an (n - 1)-gram is rare is rare itself: a filter of the frequent shorter ones, of bounded size, lets only the others be packed. It may let
   more through, which costs work and no results.
3. Keys of frequent phrases are joined with the counts of their parts, scored, and left out under longer phrases that hold nearly all
   of their places. The first of each language are taken from the first of parts of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import collected_filter, passes
from .frames import discard, stash
from .kernels import Texts, Words, mix, slices

#: Bytes of text in a block (a longer text is a block of its own), and keys that a task packs before it counts them.
BLOCK, FLUSH = 6 << 20, 1 << 21
#: Bytes that end a piece, and bytes that are in no word.
ENDS = np.zeros(256, bool)
ENDS[[10, 11, 12, 13, *b".,;:!?"]] = True
WORD = ~ENDS
WORD[[9, 32]] = False
#: Keys in the sample that gives the ranges' bounds, about; bits of a filter at most (128 MB).
SAMPLE, FILTER_MOST = 200_000, 30
LONGEST = 4


def _block(texts: list[pa.Array]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of some texts, their counts, and the texts as numbers from 1 of these words, with a 0 before each piece."""
    found = Words(Texts(pa.concat_arrays(texts), lower=True), WORD)
    if not len(found):
        return [], np.empty(0, np.int64), np.empty(0, np.int32)
    _, first, local, counts = np.unique(found.hashes(), return_index=True, return_inverse=True, return_counts=True)
    raw = found.texts.bytes
    ended = np.cumsum(ENDS[raw], dtype=np.int32)[found.starts]
    new = np.r_[True, ended[1:] != ended[:-1]]
    heads = found.offsets[:-1]
    new[heads[heads < len(found)]] = True
    at = np.arange(len(found)) + np.cumsum(new)
    out = np.zeros(int(at[-1]) + 1, np.int32)
    out[at] = local + 1
    whole = raw.tobytes()
    return [whole[s:e] for s, e in zip(found.starts[first].tolist(), found.ends[first].tolist())], counts, out


BLOCKS = "block long, lang string, words array<string>, counts array<long>, places binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[pa.Array]] = {}
    number, size = TaskContext.get().partitionId() << 33, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number
        for lang, texts in held.items():
            words, counts, places = _block(texts)
            if words:
                row = [[number], [lang], [[w.decode() for w in words]], [counts.tolist()], [places.tobytes()]]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()))], names=["block", "lang", "words", "counts", "places"])
                number += 1
        held.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            lang, text = part.column("lang"), part.column("text")
            for x in lang.unique().to_pylist():
                own = text.filter(pc.equal(lang, x))
                size += own.nbytes + 64
                held.setdefault(x, []).append(own)
            if size > BLOCK:
                yield from flush()
                size = 0
    yield from flush()


def _dictionary(blocks: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, f) of the words that occur `least` times in their language; ids from 1 follow language and word."""
    counted = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f")).where(F.col("f") >= least)
    ranged = stash(counted.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").withColumn("m", F.monotonically_increasing_id()))
    # a row for each part, not for each word
    parts = sorted((r.p, r.n) for r in ranged.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    if sum(n for _, n in parts) >= 1 << 32:
        raise ValueError("more than 2**32 - 1 frequent words")
    before, at = [], 1
    for p, n in parts:
        before.append((int(p), at))
        at += n
    starts = ranged.sparkSession.createDataFrame(before, "p long, start long")
    return ranged.withColumn("p", F.shiftright("m", 33)).join(F.broadcast(starts), "p").select((F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("id"), "lang", "word", "f")


def _coded(blocks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(places binary): each block with the words' ids in the dictionary, 0 where a piece ends or a word is rare."""
    words = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    # ids of a block's frequent words: no more than its distinct words
    ids = words.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, n, at, id_ in zip(batch.column("places"), batch.column("n").to_pylist(), batch.column("at"), batch.column("id")):
                to = np.zeros(n + 1, np.uint32)
                to[at.values.to_numpy(zero_copy_only=False) + 1] = id_.values.to_numpy(zero_copy_only=False)
                own = to[np.frombuffer(places.as_buffer(), np.int32)]
                # no two zeros in a row, and none at the end
                keep = own > 0
                keep[:-1] |= own[1:] > 0
                yield pa.record_batch([pa.array([own[keep].tobytes()], pa.binary())], names=["places"])

    return blocks.select("block", "places", F.size("words").alias("n")).join(ids, "block").select("places", "n", "at", "id").mapInArrow(run, "places binary")


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of keys given as columns of 32-bit ids, most significant first: stable passes over 16-bit digits (NumPy sorts those by
    counting), least digit first. Digits that are the same everywhere are skipped."""
    order = np.arange(len(keys[0]))
    for column in reversed(keys):
        for shift in (0, 16):
            digit = (column >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in their order, each with the sum of its counts (1 each without)."""
    order = radix_order(keys)
    keys = [x[order] for x in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], starts) if counts is not None and len(starts) else np.diff(np.r_[starts, len(order)])
    return [x[starts] for x in keys], sums.astype(np.int64)


def key_hash(keys: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(keys[0]), np.uint64)
    for x in keys:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out


def _ngrams(batches: Iterator[pa.RecordBatch], n: int, shorter) -> Iterator[list[np.ndarray]]:
    """Keys of n ids, FLUSH at once about, of places without a break whose two n-grams of n - 1 ids pass the filter (n > 2)."""
    held, size = [], 0
    for batch in batches:
        for places in batch.column(0):
            ids = np.frombuffer(places.as_buffer(), np.uint32)
            # a long text is packed in stretches that overlap by n - 1 words
            for start in range(0, max(len(ids) - n + 1, 0), FLUSH):
                own = ids[start : start + FLUSH + n - 1]
                m = len(own) - n + 1
                good = np.ones(m, bool)
                for j in range(n):
                    good &= own[j : j + m] > 0
                if shorter is not None:
                    ok = passes(shorter.value, key_hash([own[j : j + m + 1] for j in range(n - 1)]))
                    good &= ok[:-1] & ok[1:]
                at = np.flatnonzero(good)
                held.append([own[at + j] for j in range(n)])
                size += len(at)
                if size >= FLUSH:
                    yield [np.concatenate(x) for x in zip(*held)]
                    held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _first_two(keys: list[np.ndarray]) -> np.ndarray:
    return keys[0].astype(np.uint64) << np.uint64(32) | keys[1]


def _sampled(n: int, shorter, share: int):
    """The first two ids of each distinct key of a flush whose hash falls into one of `share` parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _ngrams(batches, n, shorter):
            own = np.unique(_first_two(keys)[key_hash(keys) % np.uint64(share) == 0])
            yield pa.record_batch([pa.array(own.view(np.int64))], names=["k"])

    return run


def _dealt(n: int, shorter, bounds):
    """(part, keys, counts): sorted keys of a flush with their counts, cut at the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _ngrams(batches, n, shorter):
            keys, counts = run_lengths(keys, None)
            part = np.searchsorted(bounds.value, _first_two(keys), side="right")
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            packed, ends = np.stack(keys, axis=1), np.r_[starts, len(part)]
            binary = lambda x, w: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * w).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])
            yield pa.record_batch([pa.array(part[starts].astype(np.int32)), binary(packed, 4 * n), binary(counts, 8)], names=["part", "keys", "counts"])

    return run


def _counted(n: int, least: int):
    """Rows of _dealt sorted by part in; the keys that occur `least` times, their counts and hashes out. It holds the distinct keys of a part."""

    def merged(held: list) -> tuple[list[np.ndarray], np.ndarray]:
        return run_lengths([np.concatenate(x) for x in zip(*(k for k, _ in held))], np.concatenate([c for _, c in held]))

    def frequent(held: list) -> pa.RecordBatch:
        keys, counts = merged(held)
        often = np.flatnonzero(counts >= least)
        keys = [x[often] for x in keys]
        # big-endian, so that parts of the key are keys, and Spark orders them as numbers
        raw = np.stack(keys, axis=1).astype(">u4").tobytes()
        return pa.record_batch([pa.Array.from_buffers(pa.binary(), len(often), [None, pa.py_buffer((np.arange(len(often) + 1) * 4 * n).astype(np.int32).tobytes()), pa.py_buffer(raw)]), pa.array(counts[often]), pa.array(key_hash(keys).view(np.int64))], names=["key", "f", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        for batch in batches:
            for part, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if part != last and held:
                    yield frequent(held)
                    held, size = [], 0
                last = part
                raw = np.frombuffer(keys.as_buffer(), np.uint32).reshape(-1, n)
                held.append(([raw[:, j].copy() for j in range(n)], np.frombuffer(counts.as_buffer(), np.int64).copy()))
                size += len(raw)
                if size > 2 * FLUSH:
                    held = [merged(held)]
                    size = len(held[0][1])
        if held:
            yield frequent(held)

    return run


def _frequent(coded: DataFrame, n: int, least: int, words: int, parts: int, shorter) -> DataFrame:
    """(key binary, f, h) of the n-grams that occur `least` times."""
    spark = coded.sparkSession
    sample = coded.mapInArrow(_sampled(n, shorter, max(1, words // SAMPLE)), "k long").distinct().toPandas()["k"].to_numpy(np.int64).view(np.uint64)
    sample.sort()
    bounds = np.unique(sample[np.linspace(0, len(sample) - 1, min(parts, len(sample))).astype(int)]) if len(sample) else sample
    dealt = coded.mapInArrow(_dealt(n, shorter, spark.sparkContext.broadcast(bounds)), "part int, keys binary, counts binary")
    return stash(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_counted(n, least), "key binary, f long, h long"))


def frequent_phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs(lang, text): totals (lang, n), the dictionary (id, lang, word, f), and phrases (n, key, f): words and phrases of 2 to 4 words
    that occur `least` times, key being the ids in 4 big-endian bytes each."""
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = stash(given.mapInArrow(_blocks, BLOCKS))
    totals = stash(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")))
    dictionary = stash(_dictionary(blocks, least))
    coded = stash(_coded(blocks, dictionary))
    discard(blocks)
    words = totals.agg(F.sum("n")).first()[0] or 0
    parts = min(1 << 16, max(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), words >> 21))
    levels, shorter = [], None
    for n in range(2, LONGEST + 1):
        found = _frequent(coded, n, least, words, parts, shorter)
        levels.append(found.select(F.lit(n).alias("n"), "key", "f"))
        if n < LONGEST:
            shorter = docs.sparkSession.sparkContext.broadcast(collected_filter(found.select("h"), FILTER_MOST))
    phrases = dictionary.select(F.lit(1).alias("n"), F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "f")
    for x in levels:
        phrases = phrases.unionByName(x)
    return totals, dictionary, phrases


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, scale: int = 2_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs(lang, text, ...): for each lang its first `top` phrases of 2 to 4 words that occur
    `least` times, by score, a and phrase. a is the phrase's count, n that of all words of the language; l and r are the counts of the
    parts before and after the cut whose floor(scale * a / (l + r)), the score, is the lowest (ties: the earlier cut). A phrase of which a
    longer one, itself counted `least` times, holds `share` hundredths of the places is left out.

    A null lang is `und`; a null or empty text has no words. Repeated rows count as often as they stand there; doc_id and other columns are not
    read. A word in two languages is two words. An empty table gives no rows."""
    totals, dictionary, phrases = frequent_phrases(docs, least)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    part = lambda c, start, n: F.expr(f"substring({c}, {start}, {n})")
    long = phrases.where("n > 1").select("n", "key", F.col("f").alias("a"))
    known = phrases.select("key", "f")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select("key", "a", "k", part("key", "1", "4 * k").alias("first"), part("key", "4 * k + 1", "4 * (n - k)").alias("rest"))
    sides = cuts.join(known.select(F.col("key").alias("first"), F.col("f").alias("l")), "first").join(known.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    scored = sides.withColumn("score", F.expr(f"cast(a as decimal(20,0)) * {scale} div (cast(l as decimal(20,0)) + r)")).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # each longer phrase names the phrases inside it
    inside = long.where("n > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n") - 1))).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("m"))))
    longer = inside.groupBy(part("key", "4 * p + 1", "4 * m").alias("key")).agg(F.max("a").alias("longer"))
    kept = stash(scored.join(longer, "key", "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * share)).select("key", "a", "x.l", "x.r", "x.score"))
    # words by id: at most four rows for each key
    places = kept.select("key", F.explode(F.sequence(F.lit(0), F.expr("length(key) div 4 - 1"))).alias("p")).select("key", "p", F.conv(F.hex(part("key", "4 * p + 1", "4")), 16, 10).cast("long").alias("id"))
    told = places.join(dictionary.select("id", "lang", "word"), "id").groupBy("key").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("p", "word"))).alias("w")).select("key", "lang", F.concat_ws(" ", F.col("w.word")).alias("phrase"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language is cut to its first in each of some parts, then to the first of these
    salt = F.pmod(F.xxhash64("key"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parted = kept.join(told, "key").withColumn("salt", salt)
    ahead = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
