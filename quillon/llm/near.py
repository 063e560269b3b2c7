"""N-gram Jaccard join: a size-aware heavy-light set similarity join.

A document's set is its distinct k-word shingles (64-bit fingerprints). Equal sets become one class first. Then

* light classes (small sets) enumerate fixed-size subsets: the set itself and the set less up to d words' shingles, d being
  the most that a partner can lack. Equal subsets show a shared part of known size, so links need no further check;
* heavy classes scan inverted lists. Only the rarest shingles of a set are listed (as many as a linked partner can lack,
  plus one), rarity coming from a fixed-size count sketch over all documents: it only orders, so it cannot lose a link.
  In each list, every set is first paired with the set that has the fewest rarer shingles (of near copies, the one most
  like the others), its neighbour in that order and a neighbour in a random order - linear in the list. Those pairs pass an exact upper bound (counts of shingles by hash range) and are then verified on whole
  sets. Only lists whose sets still lie in several components are then paired across those components;
* the boundary is the size with the least estimated number of rows: subsets against list entries and their partners.

Pairs across the boundary are found among subsets: every set near enough in size to a light one enumerates as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import components, stash
from .kernels import BLANK, Texts, Words, mix, shingle_sets, slices

#: Count sketch: buckets (a fixed 4 MB, whatever the input), and rows it is cut into.
SKETCH_BITS, SKETCH_ROWS = 20, 256
RANGES = 256
#: No more than this many rows from one light set.
MOST_SUBSETS = 200


def most_lacking(n: int, num: int, den: int) -> int:
    """How many elements a set of n and a partner at similarity >= num/den can lack of their union, together."""
    return n * den // num - n


def prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Rarest elements to list: one more than a set of n can lack of a linked partner."""
    return n - -(-n * num // den) + 1


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(rows, minlength=n).astype(np.int64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values), out=total[1:])
    ends = np.cumsum(counts)
    return counts, total[ends] - total[ends - counts]


def _class_of(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return mix(sums + counts.astype(np.uint64)).view(np.int64)


def _profile(k: int):
    """Each row's class and range counts, then the task's share of the sketch."""
    fields = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("ranges", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                values, rows = shingle_sets(Words(Texts(part.column("text"), lower=True), BLANK), k)
                counts, sums = _sums(values, rows, len(part))
                sketch += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                ranges = np.bincount(rows * RANGES + (values & np.uint64(RANGES - 1)).astype(np.int64), minlength=len(part) * RANGES).reshape(len(part), RANGES)
                ranges = np.minimum(ranges, 65535).astype(np.uint16)
                yield pa.record_batch([part.column("doc_id"), part.column("th"), pa.array(counts), pa.array(_class_of(sums, counts)), pa.array([x.tobytes() for x in ranges], pa.binary()), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())], schema=fields)
        if sketch.any():
            pieces = sketch.reshape(SKETCH_ROWS, -1)
            none = pa.nulls(SKETCH_ROWS, pa.int64())
            yield pa.record_batch([none, none, none, none, pa.nulls(SKETCH_ROWS, pa.binary()), pa.array(np.arange(SKETCH_ROWS, dtype=np.int32)), pa.array([x.astype(np.int32).tobytes() for x in pieces], pa.binary())], schema=fields)

    return run, "doc_id long, th long, n long, cls long, ranges binary, piece int, counts binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the pieces that the task is dealt, one by one; it holds one sum for each piece number."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            more = np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)
            total[piece] = total[piece] + more if piece in total else more
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()], pa.binary())], names=["piece", "counts"])


def boundary(sizes: dict[int, int], order: np.ndarray, num: int, den: int) -> int:
    """The largest light size: the one with the least rows, subsets of the light sets plus list entries and their partners of the rest.

    sizes: classes of each small size. A list entry of a set of s is about its rarest of s shingles; its partners are taken
    from the sketch's quantile for that, less the sketch's usual load."""
    filled = np.sort(order[order > 0])
    usual = float(np.median(filled)) if len(filled) else 0.0
    subsets = lambda s: sum(comb(s, i) for i in range(most_lacking(s, num, den) + 1))

    def listed(s: int) -> float:
        p = int(prefix(np.array([s]), num, den)[0])
        low = float(filled[int((len(filled) - 1) * min(1.0, p / (s + 1)))]) if len(filled) else 0.0
        return p * (2 + max(0.0, low - usual + np.sqrt(usual)))

    best, least, light, heavy = 0, None, 0.0, sum(n * listed(s) for s, n in sizes.items())
    for s in range(1, 65):
        top = s * den // num  # sizes up to here must enumerate, too
        if subsets(top) > MOST_SUBSETS:
            break
        light = sum(n * subsets(z) for z, n in sizes.items() if z <= top)
        heavy -= sizes.get(s, 0) * listed(s)
        if least is None or light + heavy <= least:
            best, least = s, light + heavy
    return best


def _entries(k: int, num: int, den: int, light: int, order):
    """Subset keys of light sets and list entries of heavy ones. lacking: elements left out of a subset; -1 for list entries.
    place: how many shingles of the set are rarer than the listed one; for subsets the size of the set."""
    fields = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("lacking", pa.int32()), ("place", pa.int32())])
    reach = light * den // num

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, seen = order.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                values, rows = shingle_sets(Words(Texts(part.column("text"), lower=True), BLANK), k)
                counts, sums = _sums(values, rows, len(part))
                classes = _class_of(sums, counts)
                fresh = np.zeros(len(part), bool)
                for i, c in enumerate(classes.tolist()):
                    if c not in seen and counts[i]:  # copies met by one task give their entries once
                        fresh[i] = True
                        seen.add(c)
                if len(seen) > 200_000:
                    seen.clear()
                ends = np.cumsum(counts)
                keys, of, lacking = [], [], []
                for i in np.flatnonzero(fresh & (counts <= reach)):
                    own = mix(values[ends[i] - counts[i] : ends[i]]).tolist()
                    for d in range(min(most_lacking(int(counts[i]), num, den), len(own) - 1) + 1):
                        for left in combinations(own, d):
                            keys.append((int(sums[i]) - sum(left) + (len(own) - d) * 0x9E3779B97F4A7C15) % 2**64)
                            of.append(i)
                            lacking.append(d)
                if keys:
                    at = np.array(of)
                    yield pa.record_batch([pa.array(mix(np.array(keys, np.uint64)).view(np.int64)), pa.array(classes[at]), pa.array(counts[at].astype(np.int32)), pa.array(np.array(lacking, np.int32)), pa.array(counts[at].astype(np.int32))], schema=fields)
                heavy = (fresh & (counts > light))[rows]
                v, r = values[heavy], rows[heavy]
                if len(v):
                    at = np.lexsort((v, load[(v >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], r))
                    v, r = v[at], r[at]
                    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    place = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
                    take = place < prefix(counts[r], num, den)
                    v, r, place = v[take], r[take], place[take]
                    yield pa.record_batch([pa.array(v.view(np.int64)), pa.array(classes[r]), pa.array(counts[r].astype(np.int32)), pa.array(np.full(len(r), -1, np.int32)), pa.array(place.astype(np.int32))], schema=fields)

    return run, "key long, cls long, n int, lacking int, place int"


def _bounded(num: int, den: int):
    """Keeps pairs that can still be linked: the sets share at most the sum over hash ranges of the lesser count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, RANGES) for c in ("ranges_a", "ranges_b"))
            shared = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = (den * shared >= num * (n - shared)) | (x == 65535).any(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run, "a long, b long"


def _verified(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 19):
                (v, r), (w, s) = (shingle_sets(Words(Texts(part.column(c), lower=True), BLANK), k) for c in ("text_a", "text_b"))
                n = np.bincount(r, minlength=len(part)) + np.bincount(s, minlength=len(part))
                values, rows = np.concatenate([v, w]), np.concatenate([r, s])
                at = np.lexsort((values, rows))
                values, rows = values[at], rows[at]
                twice = (values[1:] == values[:-1]) & (rows[1:] == rows[:-1])
                shared = np.bincount(rows[1:][twice], minlength=len(part))
                yield part.select(["a", "b"]).filter(pa.array(den * shared >= num * (n - shared)))

    return run, "a long, b long"


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text, ...).

    Two rows link when |A and B| * den >= num * |A or B|. Rows whose text is null or has no word link with nothing and are their
    own component. Rows of one doc_id that have words are one node, whatever their texts: each text's links count. component_id
    is the smallest doc_id reachable by links; a null doc_id is never that, unless nothing else is there. Repeated rows come out
    as often as they came in. Extra columns are not looked at. Nodes are classes of equal sets, so copies give no pairs; a class
    that many others are paired with (a hub) has its text joined once for each pair, and adaptive skew joins split its rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    run, schema = _profile(k)
    seen = stash(texts.mapInArrow(run, schema))
    rows = seen.where("piece is null").select("doc_id", "th", "n", "cls")
    # of each class the least doc_id (nulls last), the hash of a text under it, and its counts by hash range
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")
    classes = stash(seen.where("piece is null and n > 0").groupBy("cls", "n").agg(least, F.first("ranges").alias("ranges")).select("cls", "n", "rep.doc_id", "rep.th", "ranges"))
    pieces = seen.where("piece is not null").select("piece", "counts").repartition("piece").mapInArrow(_summed, "piece int, counts binary").collect()  # 2**SKETCH_BITS counts in all
    order = np.zeros((SKETCH_ROWS, (1 << SKETCH_BITS) // SKETCH_ROWS), np.int32)
    for x in pieces:
        order[x.piece] = np.frombuffer(x.counts, np.int32)
    order = order.reshape(-1)
    sizes = {int(x.n): int(x["count"]) for x in classes.where("n <= 80").groupBy("n").count().collect()}
    light = boundary(sizes, order, num, den)
    spark = docs.sparkSession
    run, schema = _entries(k, num, den, light, spark.sparkContext.broadcast(order))
    entries = texts.select("text").mapInArrow(run, schema)
    by_place = Window.partitionBy("key", "lacks").orderBy("place", "n", "cls")
    marked = entries.withColumn("lacks", F.expr("case when lacking < 0 then -1 else n - lacking end"))
    marked = marked.withColumns({"first": F.first(F.struct("cls", "n")).over(by_place.rowsBetween(Window.unboundedPreceding, 0)), "prev": F.lag(F.struct("cls", "n")).over(by_place), "next": F.lead("cls").over(by_place)})
    marked = stash(marked.where("first.cls <> cls or next <> cls").where("not (prev is not null and prev.cls = cls)"))
    exact = marked.where("lacks >= 0 and first.cls <> cls").where(f"{den} * lacks >= {num} * (n + first.n - lacks)").selectExpr("cls as a", "first.cls as b")
    lists = marked.where("lacks < 0")
    at_random = Window.partitionBy("key").orderBy(F.xxhash64("key", "cls"))
    near = lambda c: f"{den} * {c}.n >= {num} * n and {num} * {c}.n <= {den} * n"
    shuffled = lists.withColumn("other", F.lag(F.struct("cls", "n")).over(at_random)).select("cls", "n", F.explode(F.array("first", "prev", "other")).alias("p"))
    tried = shuffled.where("p.cls <> cls").where(near("p")).selectExpr("least(cls, p.cls) as a", "greatest(cls, p.cls) as b")

    def verified(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of classes that are linked indeed."""
        pairs = pairs.distinct()
        for c in "ab":
            pairs = pairs.join(classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("ranges").alias(f"ranges_{c}")), c)
        run, schema = _bounded(num, den)
        pairs = stash(pairs.select("a", "b", "n_a", "n_b", "ranges_a", "ranges_b").mapInArrow(run, schema))
        # one text of each class in some pair is dealt out
        used = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        keys = classes.join(used, "cls", "left_semi").select("cls", F.col("doc_id").alias("d"), F.col("th").alias("h"))
        wanted = stash(texts.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).groupBy("cls").agg(F.first("text").alias("text")))
        for c in "ab":
            pairs = pairs.join(wanted.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}")), c)
        run, schema = _verified(k, num, den)
        return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)

    links = stash(exact.distinct().unionByName(verified(tried)))
    first = stash(components(links))
    # lists whose sets are still apart
    several = lists.select("key", "cls", "n", "place").join(first.withColumnsRenamed({"node": "cls", "component": "top"}), "cls", "left").withColumn("at", F.coalesce("top", "cls"))
    apart = several.groupBy("key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("members")).where("lo < hi and members > 2").select("key")
    several = stash(several.join(apart, "key"))
    p, q = several.alias("p"), several.alias("q")
    # if it is the first that both list, the pair shares at most it and the lesser rest; an earlier one, if any, finds the pair itself
    still = f"{num + den} * least(p.n - p.place, q.n - q.place) >= {num} * (p.n + q.n)"
    across = p.join(q, F.expr(f"p.key = q.key and p.at < q.at and {den} * p.n >= {num} * q.n and {num} * p.n <= {den} * q.n and {still}")).selectExpr("least(p.cls, q.cls) as a", "greatest(p.cls, q.cls) as b")
    more = stash(verified(across.distinct().join(tried.distinct(), ["a", "b"], "left_anti")))
    named = rows.where("n > 0 and doc_id is not null").select("doc_id", "cls")
    twice = named.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("hi")).where("a < hi").select("doc_id", "a")
    same_id = stash(named.join(twice, "doc_id").selectExpr("a", "cls as b"))
    final = first if more.isEmpty() and same_id.isEmpty() else components(links.unionByName(more).unionByName(same_id))
    of_class = classes.join(final.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", "doc_id", F.coalesce("component", "cls").alias("component"))
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.join(least, "component").select("cls", "n", "component_id")
    return rows.join(of_class, ["cls", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
