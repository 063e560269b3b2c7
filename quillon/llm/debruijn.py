"""Substring deduplication on a De Bruijn graph of words.

A window of `width` words is an edge from the node of its first width - 1 words to the node of its last. Edges are partitioned by
minimizer (the least hash among the window's 7-word runs), so successive edges of a text travel as one row, a run, with the nodes at
its ends. An edge is known by two 64-bit fingerprints, its minimizer's and its own; a node by one. A document is a row's doc_id and text.

1. Candidates. Minimizers that occur more than once are found from packed lists of hashes and set bits of a filter, which only lets too
   much through. Of equal whole texts a task sends the edges of one copy, and one edge over the whole text for each.
2. Within a partition, runs are sorted by document: the first occurrence of an edge is its source coordinate (least doc_id and place).
   Edges that also stand under a smaller doc_id come out as pieces: runs of them with successive source coordinates.
3. Compaction. Nodes are grouped to tell which have one edge in and one out; pieces are joined with these nodes, and pieces that
   follow each other over such a node, in the document and in the source alike, are compacted to one nonbranching path.
4. Each path is a long repeated span with its source coordinate. The words there are read once for each distinct one: their SHA-256 goes with
   the span to its document, and only words that give the same are cut. Paths, not windows, are what is verified and cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import collected_filter, passes
from .frames import fresh, stash
from .kernels import BLANK, Texts, Words, grams, mix, slices, starts_of_grams

RUN = 7
#: Bits of a filter at most (128 MB); beyond some 60 million repeated hashes it lets more through.
FILTER_MOST = 30
#: Hashes that a task holds before it packs them.
FLUSH = 1 << 21
_KEEP, _SHIFT = np.uint64((1 << 48) - 1), np.uint64(16)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
    for batch in batches:
        for part in slices(batch.filter(batch.column("doc_id").is_valid()), "text"):
            yield part.column("doc_id").to_numpy(), part.column("tid").to_numpy(), Words(Texts(part.column("text")), BLANK)


def _minimizers(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    runs = grams(hashes, RUN)
    best = runs[at] if len(at) else runs[:0]
    for j in range(1, width - RUN + 1):
        best = np.minimum(best, runs[at + j])
    return best


def _whole(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A hash of each row's whole sequence of words."""
    place = (np.arange(len(hashes)) - np.repeat(words.offsets[:-1], words.counts)).astype(np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + place * np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
    return mix(total[words.offsets[1:]] - total[words.offsets[:-1]] + words.counts.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))


class Windows:
    """The windows of some rows: the row, the place in all words, and the edge of each. Of equal sequences of words only the copy with the
    least id that this task has met so far has any, and other texts of that id."""

    def __init__(self, ids: np.ndarray, tids: np.ndarray, words: Words, width: int, minimizers: np.ndarray | None, seen: dict[int, tuple[int, int]]):
        self.ids, self.words, self.hashes = ids, words, words.hashes()
        n = words.counts
        self.long = np.flatnonzero(n >= width)
        self.whole = _whole(words, self.hashes)
        take = np.zeros(len(n), bool)
        for i in self.long.tolist():
            least, text = seen.get(int(self.whole[i]), (1 << 63, 0))
            if least > ids[i] or least == ids[i] and text != tids[i]:
                seen[int(self.whole[i])] = int(ids[i]), int(tids[i])
                take[i] = True
        if len(seen) > 80_000:
            seen.clear()
        at, rows = starts_of_grams(words.offsets, width)
        keep = take[rows]
        self.at, self.rows = at[keep], rows[keep]
        if minimizers is not None:
            keep = passes(minimizers, _minimizers(self.hashes, self.at, width) << _SHIFT)
            self.at, self.rows = self.at[keep], self.rows[keep]
        self.edges = grams(self.hashes, width)[self.at] if minimizers is not None and len(self.at) else np.empty(0, np.uint64)


def _packed(pick: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int):
    """(bucket, 48 bits of each hash) of pick's hashes and doc_ids: a hash that a task has met under two doc_ids stands there twice."""

    def flush(values: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        v, d = np.concatenate(values) & _KEEP, np.concatenate(docs)
        order = np.lexsort((d, v))
        v, d = v[order], d[order]
        new = np.r_[True, v[1:] != v[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
        # sorted by doc_id, a hash has one place at most where the first doc_id gives way to another
        other = np.r_[False, (d[1:] != d[first[1:]]) & (d[:-1] == d[first[1:]]) & ~new[1:]]
        v = v[new | other]
        bucket = (v >> np.uint64(32)).astype(np.int64) * buckets >> 16
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        data = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
        ends = np.r_[starts, len(v)] * 6
        yield pa.record_batch([pa.array(bucket[starts].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])], names=["bucket", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, docs, n = [], [], 0
        for v, d in pick(batches):
            values.append(v)
            docs.append(d)
            n += len(v)
            if n > FLUSH:
                yield from flush(values, docs)
                values, docs, n = [], [], 0
        if n:
            yield from flush(values, docs)

    return run


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed hashes in, bucket by bucket; those that stand there more than once out. It holds one bucket."""

    def repeated(held: list[bytes]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 6)
        v = np.sort(np.pad(raw, ((0, 0), (0, 2))).view(np.uint64).reshape(-1))
        again = np.unique(v[1:][v[1:] == v[:-1]])
        return pa.record_batch([pa.array((again << _SHIFT).view(np.int64))], names=["h"])

    last, held = None, []
    for batch in batches:
        for bucket, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != last and held:
                yield repeated(held)
                held = []
            last = bucket
            held.append(hashes)
    if held:
        yield repeated(held)


def _repeated(docs: DataFrame, pick) -> np.ndarray:
    """The filter of pick's hashes that occur more than once."""
    spark = docs.sparkSession
    buckets = min(1 << 16, 32 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    lists = docs.mapInArrow(_packed(pick, buckets), "bucket int, hashes binary").repartition("bucket").sortWithinPartitions("bucket")
    return collected_filter(stash(lists.mapInArrow(_twice, "h long")), FILTER_MOST)


def _pick_minimizers(width: int):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen: dict[int, tuple[int, int]] = {}
        for ids, tids, words in _parts(batches):
            w = Windows(ids, tids, words, width, None, seen)
            values = _minimizers(w.hashes, w.at, width)
            if len(values):
                new = np.r_[True, (values[1:] != values[:-1]) | (w.rows[1:] != w.rows[:-1])]
                yield values[new], ids[w.rows[new]]

    return pick


RUNS = "h long, doc long, pos int, span int, edges binary, u long, v long, tid long"
PIECES = "doc_id long, start int, end int, source long, at int, u long, v long, tid long, stid long"


def _runs(width: int, minimizers):
    """Successive edges from word pos on under minimizer h, of span words each, with the nodes that the first leaves and the last enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for ids, tids, words in _parts(batches):
            w = Windows(ids, tids, words, width, minimizers.value, seen)
            whole, none = w.whole[w.long], pa.nulls(len(w.long), pa.int64())
            yield pa.record_batch([pa.array(mix(whole).view(np.int64)), pa.array(ids[w.long]), pa.array(np.zeros(len(w.long), np.int32)), pa.array(words.counts[w.long].astype(np.int32)), pa.array([x.tobytes() for x in whole], pa.binary()), none, none, pa.array(tids[w.long])], names=["h", "doc", "pos", "span", "edges", "u", "v", "tid"])
            at, rows = w.at, w.rows
            if not len(at):
                continue
            values, nodes = _minimizers(w.hashes, at, width), grams(w.hashes, width - 1)
            first = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (at[1:] != at[:-1] + 1) | (rows[1:] != rows[:-1])])
            last = np.r_[first[1:], len(at)] - 1
            packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.r_[first, len(at)] * 8).astype(np.int32).tobytes()), pa.py_buffer(w.edges.tobytes())])
            columns = [values[first].view(np.int64), ids[rows[first]], (at[first] - words.offsets[rows[first]]).astype(np.int32), np.full(len(first), width, np.int32)]
            yield pa.record_batch([*map(pa.array, columns), packed, pa.array(nodes[at[first]].view(np.int64)), pa.array(nodes[at[last] + 1].view(np.int64)), pa.array(tids[rows[first]])], names=["h", "doc", "pos", "span", "edges", "u", "v", "tid"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by h, doc, tid, pos in; out come the pieces of them that a smaller doc_id holds, with their source coordinates, and the nodes
    of a piece's ends where it begins or ends with its run. Only the distinct edges of one minimizer are held."""
    last_h, last_edges, last_docs, last_at, last_tids = None, np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    for batch in batches:
        if not len(batch):
            continue
        h, doc, pos, span = (batch.column(i).to_numpy() for i in range(4))
        tid = batch.column(7).to_numpy()
        lists = batch.column(4).to_pylist()
        lengths = np.array([len(x) // 8 for x in lists])
        edges = np.frombuffer(b"".join(lists), np.uint64)
        row = np.repeat(np.arange(len(h)), lengths)
        start = np.cumsum(lengths) - lengths
        word = (pos[row] + np.arange(len(row)) - start[row]).astype(np.int64)
        order = np.lexsort((edges, h[row]))  # stable: of equal edges the first has the least coordinate
        same = np.r_[False, (edges[order][1:] == edges[order][:-1]) & (h[row[order]][1:] == h[row[order]][:-1])]
        heads, group = order[~same], np.cumsum(~same) - 1
        least, place, text = doc[row[heads]].copy(), word[heads].copy(), tid[row[heads]].copy()
        if last_h is not None and h[0] == last_h:
            mine = np.flatnonzero(h[row[heads]] == last_h)
            where = np.minimum(np.searchsorted(last_edges, edges[heads[mine]]), len(last_edges) - 1)
            known = last_edges[where] == edges[heads[mine]]
            least[mine[known]], place[mine[known]], text[mine[known]] = last_docs[where[known]], last_at[where[known]], last_tids[where[known]]
        source, at, stid = (np.empty(len(row), np.int64) for _ in range(3))
        source[order], at[order], stid[order] = least[group], place[group], text[group]
        tail = np.flatnonzero(h[row[heads]] == h[-1])
        now = [edges[heads[tail]], least[tail], place[tail], text[tail]]
        if last_h is not None and h[-1] == last_h:
            now = [np.concatenate(x) for x in zip([last_edges, last_docs, last_at, last_tids], now)]
        by = np.argsort(now[0], kind="stable")
        one = np.r_[True, now[0][by][1:] != now[0][by][:-1]]
        last_h, (last_edges, last_docs, last_at, last_tids) = h[-1], (x[by][one] for x in now)
        again = np.flatnonzero(doc[row] > source)
        if len(again):
            r, x, s, t, k = row[again], word[again], source[again], at[again], stid[again]
            cut = np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1] + 1) | (s[1:] != s[:-1]) | (k[1:] != k[:-1]) | (t[1:] != t[:-1] + 1)]
            final = np.r_[np.flatnonzero(cut)[1:] - 1, len(again) - 1]
            f, e = again[cut], again[final]
            u = _only(batch.column(5), row[f], f == start[row[f]])
            v = _only(batch.column(6), row[e], e == start[row[e]] + lengths[row[e]] - 1)
            yield pa.record_batch([pa.array(doc[row[f]]), pa.array(word[f].astype(np.int32)), pa.array((word[e] + span[row[e]]).astype(np.int32)), pa.array(source[f]), pa.array(at[f].astype(np.int32)), u, v, pa.array(tid[row[f]]), pa.array(stid[f])], names=["doc_id", "start", "end", "source", "at", "u", "v", "tid", "stid"])


def _only(column: pa.Array, rows: np.ndarray, where: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(where), column.take(pa.array(rows)), pa.scalar(None, column.type))


def pieces(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, start, end, source, at, u, v, tid, stid) of docs(doc_id, tid, text): see _pieces."""
    minimizers = docs.sparkSession.sparkContext.broadcast(_repeated(docs, _pick_minimizers(width)))
    runs = docs.mapInArrow(_runs(width, minimizers), RUNS)
    return runs.repartition("h").sortWithinPartitions("h", "doc", "tid", "pos").mapInArrow(_pieces, PIECES)


def compacted(found: DataFrame, width: int) -> DataFrame:
    """Pieces to (doc_id, tid, start, end, source, stid, source_start): pieces that follow each other over a node with one edge in and one out, and
    whose source coordinates follow each other, are one."""
    place = "struct<source:bigint,stid:bigint,at:int>"
    leave = found.where("u is not null").select(F.col("u").alias("node"), F.struct("source", "stid", "at").alias("out"), F.lit(None).cast(place).alias("into"))
    enter = found.where("v is not null").select(F.col("v").alias("node"), F.lit(None).cast(place).alias("out"), F.struct("source", "stid", (F.col("at") + F.col("end") - F.col("start") - (width - 1)).alias("at")).alias("into"))
    # `into` is where an edge that follows in the source would start
    nodes = leave.unionByName(enter).groupBy("node").agg(F.min("out").alias("out"), F.max("out").alias("out_"), F.min("into").alias("into"), F.max("into").alias("into_"))
    through = nodes.where("out = out_ and into = into_ and out = into").select(F.col("node").alias("u"), F.lit(True).alias("through"))
    told = lambda df: df.select("doc_id", "tid", "start", "end", "source", "stid", (F.col("at") - F.col("start")).alias("shift"), F.coalesce("through", F.lit(False)).alias("through"))
    # pieces that begin inside a run have no node: they stay out of the join, where all of them would meet in one task
    joined = told(found.where("u is not null").join(through, "u", "left")).unionByName(told(found.where("u is null").withColumn("through", F.lit(False))))
    along = Window.partitionBy("doc_id", "tid", "source", "stid", "shift").orderBy("start", "end")
    begins = F.when(F.col("through") & (F.lag("end").over(along) == F.col("start") + width - 1), 0).otherwise(1)
    paths = joined.withColumn("begins", begins).withColumn("path", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return paths.groupBy("doc_id", "tid", "source", "stid", "shift", "path").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "tid", "start", "end", "source", "stid", (F.col("start") + F.col("shift")).alias("source_start"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text): tid is a hash of the text, which tells rows of one doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")


def repeated_spans(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, tid, start, end, source, stid, source_start): nonbranching paths of docs(doc_id, text) whose windows also start under a smaller
    doc_id, with their source coordinate (tid and stid: xxhash64 of the texts). Spans of one document may touch or overlap; together they
    cover all such windows. Null doc_ids and texts have none; each text of a doc_id has its own spans."""
    if width <= RUN:
        raise ValueError(f"width must be over {RUN}")
    return compacted(stash(pieces(keyed(docs), width)), width)


def _span_digest(raw: bytes, words: Words, row: int, start: int, end: int) -> bytes:
    """SHA-256 of the words start to end of a row."""
    at = slice(int(words.offsets[row]) + start, int(words.offsets[row]) + end)
    return hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist())])).digest()


def _id_hash(ids: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array(_id_hash(np.unique(batch.column(0).to_numpy())).view(np.int64))], names=["h"])


def verified(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans with `digest`, the SHA-256 of the words at their source coordinate. Only documents that are some span's source are read for it (a
    filter of bounded size lets few others through), and each distinct coordinate once."""
    wanted = spans.select("source", "stid", "source_start", (F.col("end") - F.col("start")).alias("n")).distinct()
    wanted = stash(wanted.groupBy("source", "stid").agg(F.collect_list(F.struct("source_start", "n")).alias("ranges")))
    sources = docs.sparkSession.sparkContext.broadcast(collected_filter(wanted.select("source").mapInArrow(_hashed_ids, "h long"), FILTER_MOST))

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(batch.column("doc_id").is_valid()), "text", 1 << 22):
                yield part.filter(pa.array(passes(sources.value, _id_hash(part.column("doc_id").to_numpy()))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, out = Words(Texts(part.column("text")), BLANK), []
                raw = words.texts.bytes.tobytes()
                for i, (source, stid, ranges) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("tid").to_pylist(), part.column("ranges").to_pylist())):
                    out += [(source, stid, x["source_start"], x["n"], _span_digest(raw, words, i, x["source_start"], x["source_start"] + x["n"])) for x in ranges]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=["source", "stid", "source_start", "n", "digest"])

    texts = keyed(docs).mapInArrow(among, "doc_id long, tid long, text string")
    found = texts.join(wanted.withColumnsRenamed({"source": "doc_id", "stid": "tid"}), ["doc_id", "tid"]).select("doc_id", "tid", "text", "ranges")
    digests = found.mapInArrow(read, "source long, stid long, source_start int, n int, digest binary").groupBy("source", "stid", "source_start", "n").agg(F.min("digest").alias("digest"))
    return spans.withColumn("n", F.col("end") - F.col("start")).join(digests, ["source", "stid", "source_start", "n"]).select("doc_id", "tid", "start", "end", "digest")


def cut_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept_text (the kept words joined by one space); columns of these names
    are replaced, all others are kept. A window of a document goes if it also starts in a document with a smaller doc_id; rows of one doc_id
    are documents of their own that do not count against each other. A null doc_id is cut nowhere, a null text is empty. Repeated rows
    come out as often as they came in."""
    new = ("n_words", "n_removed", "kept_sha256", "kept_text")
    docs = docs.select(*[c for c in docs.columns if c not in new])
    held, tid, key = fresh([*docs.columns, *new], "spans", "tid", "key")
    spans = verified(stash(repeated_spans(docs, width)), docs).groupBy(F.col("doc_id").alias(key), F.col("tid").alias(tid)).agg(F.collect_list(F.struct("start", "end", "digest")).alias(held))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(Texts(part.column("text")), BLANK)
                raw = words.texts.bytes.tobytes()
                n, kept = words.counts, []
                removed = np.zeros(len(part), np.int64)
                for i, ranges in enumerate(part.column(held).to_pylist()):
                    gone = np.zeros(int(n[i]), bool)
                    for x in ranges or ():
                        if _span_digest(raw, words, i, x["start"], x["end"]) == x["digest"]:
                            gone[x["start"] : x["end"]] = True
                    removed[i] = gone.sum()
                    at = words.offsets[i] + np.flatnonzero(~gone)
                    kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist())]))
                yield pa.record_batch([*part.drop_columns([held]).columns, pa.array(n.astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept])], names=schema.names)

    text = docs.withColumn(tid, F.xxhash64(F.col("text").cast("string")))
    joined = text.join(spans, (text["doc_id"].cast("long") == spans[key]) & (text[tid] == spans[tid]), "left")
    return joined.select(*(text[c] for c in docs.columns), held).mapInArrow(run, schema)
