"""Benchmark decontamination by winnowing.

Of each run of `window` words, the k-gram with the least hash is kept as a fingerprint, so any shared span of `window` words has
a fingerprint on both sides. Fingerprints of texts are joined with those of the items in Spark; each comes with the words around
it (as many as a window can reach on either side), so a joined pair is extended word by word without fetching a text again, and
a span of at least `window` words counts. An item of fewer words is one fingerprint of its own length.

A filter of the items' fingerprints, built by the tasks, keeps most other fingerprints from being shuffled; it is sized from
their number up to FILTER_MOST bits (beyond, it lets more through, and the join still decides). Texts are known by their md5,
so copies of one text are one side of the join, and both sides are salted: a passage that a third of all texts hold, or that
many items hold, is dealt to SALTS tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import collected_filter, passes
from .frames import fresh, stash
from .kernels import ALNUM, Texts, Words, grams, mix, slices, starts_of_grams

GRAM = 8
SALTS = 8
FILTER_MOST = 29
#: Spans of so many texts at most are broadcast to the rows; beyond, the rows are shuffled to them.
BROADCAST_BYTES = 64 << 20


def fingerprints(hashes: np.ndarray, offsets: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions of the kept k-grams: the least of each window - k + 1 successive ones of a row, the last of equal ones."""
    at, _ = starts_of_grams(offsets, window)
    if not len(at):
        return at
    values = grams(hashes, k)
    best, where = values[at], at.copy()
    for j in range(1, window - k + 1):
        here = values[at + j]
        less = here <= best
        best[less], where[less] = here[less], (at + j)[less]
    return np.unique(where)


def _keys(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Join keys of the n-grams at these places; n is part of the key."""
    return mix(grams(hashes, n)[at] + np.uint64(n)) if len(at) else np.empty(0, np.uint64)


def _around(hashes: np.ndarray, offsets: np.ndarray, at: np.ndarray, before: int, after: int, none: int) -> np.ndarray:
    """The hashes of `before` words in front of each place and `after` from it on; `none` beyond the row's ends."""
    rows = np.searchsorted(offsets, at, side="right") - 1
    where = at[:, None] + np.arange(-before, after)
    inside = (where >= offsets[rows][:, None]) & (where < offsets[rows + 1][:, None])
    out = np.full(where.shape, none, np.uint64)
    out[inside] = hashes[where[inside]]
    return out


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in values], pa.binary())


def item_prints(items: DataFrame, window: int, k: int) -> DataFrame:
    """(h, words, need, tid): the items' fingerprints, each with the words around it and how many must agree; tid is the md5 of the
    item's text. Items that are null or have no words have none; equal texts are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(Texts(part.column("text"), lower=True), ALNUM)
                hashes, offsets, counts = words.hashes(), words.offsets, words.counts
                at = fingerprints(hashes, offsets, window, k)
                found = [(at, _keys(hashes, at, k), np.full(len(at), window, np.int32))]
                for n in range(1, window):
                    at = offsets[:-1][counts == n]
                    found.append((at, _keys(hashes, at, n), np.full(len(at), n, np.int32)))
                at, keys, need = (np.concatenate(x) for x in zip(*found))
                rows = np.searchsorted(offsets, at, side="right") - 1
                yield pa.record_batch([pa.array(keys.view(np.int64)), _packed(_around(hashes, offsets, at, window - k, window, 1)), pa.array(need), part.column("tid").take(pa.array(rows))], names=["h", "words", "need", "tid"])

    texts = items.where("text is not null").select(F.md5("text").alias("tid"), "text").dropDuplicates(["tid"])
    return texts.mapInArrow(run, "h long, words binary, need int, tid string").distinct()


def _scan(window: int, k: int, lengths: list[int], bits):
    """Each text's number of words (pos null), and its fingerprints that pass the filter, with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(Texts(part.column("text"), lower=True), ALNUM)
                hashes, offsets = words.hashes(), words.offsets
                found = []
                at = fingerprints(hashes, offsets, window, k)
                for n, places in [(k, at), *((n, starts_of_grams(offsets, n)[0]) for n in lengths)]:
                    keys = _keys(hashes, places, n)
                    keep = passes(bits.value, keys)
                    found.append((places[keep], keys[keep]))
                at, keys = (np.concatenate(x) for x in zip(*found))
                rows = np.searchsorted(offsets, at, side="right") - 1
                tids = part.column("tid")
                out = {"tid": pa.concat_arrays([tids, tids.take(pa.array(rows))]), "n_words": pa.array([*words.counts.tolist(), *[None] * len(at)], pa.int64())}
                out |= {"pos": pa.array([*[None] * len(part), *(at - offsets[rows]).tolist()], pa.int32()), "h": pa.array([*[None] * len(part), *keys.view(np.int64).tolist()], pa.int64())}
                out["words"] = pa.concat_arrays([pa.nulls(len(part), pa.binary()), _packed(_around(hashes, offsets, at, window - k, window, 0))])
                yield pa.record_batch(list(out.values()), names=list(out))

    return run, "tid string, n_words long, pos int, h long, words binary"


def _extended(window: int, k: int):
    """Joined pairs in; the spans of words that agree around the fingerprint out, if they are long enough."""
    before, width = window - k, 2 * window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, width) for c in ("words", "item_words"))
            same = x == y
            right = np.cumprod(same[:, before:], axis=1).sum(axis=1)
            left = np.cumprod(same[:, :before][:, ::-1], axis=1).sum(axis=1)
            keep = left + right >= batch.column("need").to_numpy()
            pos = batch.column("pos").to_numpy()
            start, end = (pos - left)[keep], (pos + right)[keep]
            yield pa.record_batch([batch.column("tid").filter(pa.array(keep)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), batch.column("item").filter(pa.array(keep))], names=["tid", "start", "end", "item"])

    return run, "tid string, start int, end int, item string"


def hits(docs: DataFrame, items: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(tid, n_words) of each distinct text of docs, tid being its md5; and (tid, spans, n_hit, n_items, items_sha256) of those texts
    in which an item's window occurs: spans are the hit words from start to before end, in order, without overlap."""
    k = min(GRAM, window)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    prints = stash(item_prints(items, window, k))
    lengths = [r.need for r in prints.where(f"need < {window}").select("need").distinct().collect()]  # fewer than `window` numbers
    bits = docs.sparkSession.sparkContext.broadcast(collected_filter(prints.select("h"), FILTER_MOST))
    run, schema = _scan(window, k, sorted(lengths), bits)
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").select(F.md5("text").alias("tid"), "text")
    seen = stash(texts.mapInArrow(run, schema))
    salted = prints.select("h", F.col("words").alias("item_words"), "need", F.col("tid").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = seen.where("pos is not null").distinct().withColumn("salt", F.pmod(F.xxhash64("tid", "pos"), F.lit(SALTS)).cast("int"))
    run, schema = _extended(window, k)
    spans = stash(found.join(salted, ["h", "salt"]).select("tid", "pos", "words", "item_words", "need", "item").mapInArrow(run, schema))
    # spans of one text: as many as it has words at most, times the distinct items' texts that hold them
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))), F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    cover = spans.groupBy("tid").agg(merged.alias("spans")).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
    names = items.where("text is not null").select(F.md5("text").alias("item"), "item_id").distinct()
    named = spans.select("tid", "item").distinct().join(names, "item").groupBy("tid").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    named = named.select("tid", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    return seen.where("pos is null").select("tid", "n_words").distinct(), stash(cover.join(named, "tid"))


NEW = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
NONE_SHA256 = hashlib.sha256(b"").hexdigest()


def _judged() -> list:
    zero = F.lit(0).cast("long")
    return [F.coalesce("n_words", zero).alias("n_words"), F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.lit(NONE_SHA256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")]


def measure(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs less `text`, with n_words, n_hit, n_items, items_sha256 and contaminated: no text is shuffled.

    A null or empty text has no words and is not contaminated; items without an id, a text or words never occur; an item of fewer
    than `window` words is one window of its own; an item repeated is one, an item_id with several texts occurs if one does.
    Repeated rows of docs come out as often as they came in. Columns of docs with the new names are replaced."""
    tid, held = fresh([*docs.columns, *NEW], "tid", "held")
    counts, found = hits(docs, items, window)
    facts = counts.join(found.drop("spans"), "tid", "left").withColumnRenamed("tid", "_t")
    kept = [c for c in docs.columns if c not in (*NEW, "text")]
    rows = docs.select(*kept, F.md5("text").alias(tid))
    facts = facts.select(F.col("_t").alias(tid), F.struct("n_words", "n_hit", "n_items", "items_sha256").alias(held))
    return rows.join(facts, tid, "left").select(*kept, f"{held}.*").select(*kept, *_judged())


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and clean_text (the whole text less hit words' spans, or
    null if nothing is hit); columns of docs with these names are replaced. For edge cases see measure()."""
    tid, facts, words_hit = fresh([*docs.columns, *NEW, "clean_text"], "tid", "facts", "spans")
    _, found = hits(docs, items, window)
    kept = [c for c in docs.columns if c not in (*NEW, "clean_text")]
    held = found.select(F.col("tid").alias(tid), F.struct("spans", "n_hit", "n_items", "items_sha256").alias(facts))
    if (found.agg(F.sum(F.size("spans") * 8 + 150)).first()[0] or 0) <= BROADCAST_BYTES:
        held = F.broadcast(held)
    rows = docs.select(*kept, F.md5("text").alias(tid)).join(held, tid, "left").select(*kept, F.col(f"{facts}.spans").alias(words_hit), *(f"{facts}.{c}" for c in ("n_hit", "n_items", "items_sha256")))
    n = len(kept)
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("clean_text", T.StringType())])
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in slices(batch, f"c{at}"):
                words = Words(Texts(part.column(at)), ALNUM_ANY)
                spans, clean = part.column(n), [None] * len(part)
                n_hit, n_items, digest = (part.column(n + i) for i in (1, 2, 3))
                for row in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    raw, first, base = part.column(at)[row].as_py().encode(), int(words.offsets[row]), int(words.texts.offsets[row])
                    pieces, to = [], 0
                    for s in spans[row].as_py():
                        pieces.append(raw[to : int(words.starts[first + s["start"]]) - base])
                        to = int(words.ends[first + s["end"] - 1]) - base
                    clean[row] = b"".join([*pieces, raw[to:]]).decode()
                hit = n_hit.fill_null(0)
                yield pa.record_batch([*part.columns[:n], pa.array(words.counts.astype(np.int64)), hit, n_items.fill_null(0), digest.fill_null(NONE_SHA256), pa.array(hit.to_numpy() > 0), pa.array(clean, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


#: The same words in a text that is not lower-cased.
ALNUM_ANY = ALNUM.copy()
ALNUM_ANY[65:91] = True
