"""Plain Lloyd clustering of vectors in whole numbers.

Components become integers once and the kept vectors are written once. In each round the centroids, k rows of integers, go to the tasks;
mapInPandas computes the squared differences to each centroid, takes the least (of equals the lowest number) and sums its batches'
vectors by centroid; a groupBy merges the sums, and k rows come to the driver. All arithmetic is exact: NumPy's 64 bits where no
square can pass them, Python's integers elsewhere, decimals in the merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, stash

SCALE = 1024
#: A component's integer is held at 2**62 at most: only there could it leave a long.
MOST = 1 << 62
#: Up to this size of component, the squared distance of two vectors of up to 2**14 components fits 63 bits.
SMALL = 1 << 23
LAST_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, vec: str = "vec", size: int = 64, name: str = "q") -> DataFrame:
    """The rows whose array has exactly `size` components, none null or not finite, with floor(1024 * x) of each as array<long>."""
    (x,) = fresh(vectors.columns, "x")
    good = F.expr(f"size({vec}) = {size} and forall({vec}, {x} -> {x} is not null and not isnan({x}) and abs(double({x})) < double('infinity'))")
    # 1024 * x is exact unless it passes the largest double, which is over the bound anyway
    whole = F.transform(vec, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long"))
    return vectors.where(good).withColumn(name, whole)


def first_centroids(kept: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors of kept(vec_id, q) with the least sha256 of `seed:vec_id`, in that order; of equal ids the least vector."""
    rows = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256).alias("h"), "q").orderBy("h", "q").limit(k)
    return [list(r.q) for r in rows.collect()]


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid and its squared distance: int64 where that is exact, else Python's integers."""
    exact = max(int(q.max(initial=0)), -int(q.min(initial=0)), *(abs(int(c)) for c in centroids.flat)) <= SMALL and q.shape[1] <= 1 << 14
    if not exact:
        q, centroids = q.astype(object), centroids.astype(object)
    best, distance = np.zeros(len(q), np.int32), None
    for i, c in enumerate(centroids):
        diff = q - c
        d = np.einsum("ij,ij->i", diff, diff) if exact else (diff * diff).sum(axis=1)
        if distance is None:
            distance = d
        else:
            closer = (d < distance).astype(bool)
            best[closer], distance = i, np.where(closer, d, distance)
    return best, distance


def _stacked(frame: pd.DataFrame, name: str) -> np.ndarray:
    return np.stack(frame[name].to_numpy()).astype(np.int64, copy=False)


def _array(centroids: list[list[int]]) -> np.ndarray:
    return np.array(centroids, np.int64)


def partial_sums(kept: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int], int]]:
    """For each centroid that has any vector: their count, their sums by component, and the sum of their distances."""
    held = kept.sparkSession.sparkContext.broadcast(_array(centroids))
    width = len(centroids[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one row for each centroid and part: as text, since Python's sums may pass 64 bits
        count, sums, far = [0] * len(centroids), [[0] * width for _ in centroids], [0] * len(centroids)
        for frame in frames:
            if not len(frame):
                continue
            q = _stacked(frame, "q")
            best, distance = nearest(q, held.value)
            for i in np.unique(best).tolist():
                own = best == i
                count[i] += int(own.sum())
                # halves of 31 and 33 bits sum without leaving 64 bits
                low, high = (q[own] & 0x7FFFFFFF).sum(axis=0).tolist(), (q[own] >> 31).sum(axis=0).tolist()
                sums[i] = [s + a + (b << 31) for s, a, b in zip(sums[i], low, high)]
                far[i] += sum(map(int, distance[own].tolist())) if distance.dtype == object else int(distance[own].sum(dtype=object))
        own = [i for i, n in enumerate(count) if n]
        yield pd.DataFrame({"cluster": pd.Series(own, dtype="int32"), "n": pd.Series([count[i] for i in own], dtype="int64"), "sums": [[str(s) for s in sums[i]] for i in own], "far": [str(min(far[i], 10**37)) for i in own]})

    parts = kept.select("q").mapInPandas(run, "cluster int, n long, sums array<string>, far string")
    number = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    merged = parts.select("cluster", "n", "far", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), number("s").alias("s"), number("far").alias("far")).collect()
    out: dict[int, tuple[int, list[int], int]] = {}
    for r in merged:
        out.setdefault(r.cluster, (int(r.n), [0] * width, int(r.far)))[1][r["at"]] = int(r.s)
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", size: int = 64) -> DataFrame:
    """One row for each kept row of vectors(vec_id, vec): vec_id, cluster, distance (squared), cluster_inertia and inertia (distance
    summed over the cluster and over all), centroid_sha256 (of the final centroid's components in decimal, joined by commas).

    A vector with another number of components, with a null or a component that is not finite, is left out, as is a null vector. Repeated rows
    are clustered and given out as often as they come; a null vec_id is an id like any other. With fewer vectors than k there are as many
    centroids as vectors; of an empty table nothing comes out. Integers are held between -2**62 and 2**62, and a distance or a sum over 2**63 - 1
    is given as that. Two tasks' results for the same rows are the same, so lost ones are simply done again."""
    kept = stash(quantised(vectors.select("vec_id", F.col("vec").alias("vec")), size=size).select("vec_id", "q"))
    schema = T.StructType([kept.schema["vec_id"], *(T.StructField(c, t) for c, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType())))])
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        return kept.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        before, centroids = centroids, [list(c) for c in centroids]
        for i, (n, sums, _) in partial_sums(kept, before).items():
            centroids[i] = [s // n for s in sums]
        if centroids == before:
            break  # every further round would leave them as they are
    own = {i: far for i, (_, _, far) in partial_sums(kept, centroids).items()}
    total = min(sum(own.values()), LAST_LONG)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    held = kept.sparkSession.sparkContext.broadcast((_array(centroids), [min(own.get(i, 0), LAST_LONG) for i in range(len(centroids))], digests))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        final, inertia, names = held.value
        for frame in frames:
            if not len(frame):
                continue
            best, distance = nearest(_stacked(frame, "q"), final)
            if distance.dtype == object:
                distance = np.array([min(int(d), LAST_LONG) for d in distance], np.int64)
            yield pd.DataFrame({"id": frame["id"], "cluster": best, "distance": distance, "cluster_inertia": np.array(inertia, np.int64)[best], "inertia": np.full(len(best), total, np.int64), "centroid_sha256": np.array(names, object)[best]})

    # pandas has no whole numbers beside nulls: ids go through as text
    told = kept.select(F.col("vec_id").cast("string").alias("id"), "q").mapInPandas(run, T.StructType([T.StructField("id", T.StringType()), *schema.fields[1:]]))
    return told.select(F.col("id").cast(schema["vec_id"].dataType).alias("vec_id"), *schema.names[1:])
