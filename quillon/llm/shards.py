"""Sharding by a weighted hash tree of regions, racks and shards.

A row descends level by level: each child draws -ln(u) / weight, u a hash of the row's id and the child's place, and the
least draw wins. A child's draw depends on nothing but its own place and weight, so a changed weight moves rows only into or
out of its subtree, at each level. A shard that is added as a region of its own therefore takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import fresh

Tree = list[list[list[float]]]
#: Rows of one shard are numbered in so many parts, so that no task sorts a whole shard.
PARTS = 4096


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
    """Shards of weight 1, filled up rack by rack and region by region."""
    left, tree = shards, []
    while left:
        region = []
        for _ in range(racks):
            if left:
                region.append([1.0] * min(per_rack, left))
                left -= len(region[-1])
        tree.append(region)
    return tree


def _choose(place: Column, weights: Column) -> Column:
    """The index of the child with the least draw; children without weight have none."""

    def draw(weight: Column, i: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.concat_ws("/", place, i.cast("string"))), 11).cast("double") + 0.5) / float(2**53)
        return F.when(weight > 0, F.struct((-F.log(u) / weight).alias("draw"), i.alias("i")))

    return F.array_min(F.transform(weights, draw))["i"]


def _deep(values: list) -> Column:
    return F.array(*(_deep(v) if isinstance(v, list) else F.lit(v) for v in values))


def assign(docs: DataFrame, tree: Tree, id_column: str = "doc_id", name: str = "shard", salt: str = "s") -> DataFrame:
    """docs with the column `name`: the number of its shard, counted through the tree; a column of that name is replaced, all others
    are kept. A null id is an id like any other; rows of one id go to one shard. Children without weight get nothing."""
    racks, shards = max(map(len, tree)), max(len(k) for r in tree for k in r)
    regions = [F.lit(float(sum(map(sum, r)))) for r in tree]
    rack_weights = [[float(sum(r[i])) if i < len(r) else 0.0 for i in range(racks)] for r in tree]
    leaf_weights = [[[float(r[i][j]) if i < len(r) and j < len(r[i]) else 0.0 for j in range(shards)] for i in range(racks)] for r in tree]
    numbers, n = [], 0
    for r in tree:
        numbers.append([[0] * shards for _ in range(racks)])
        for i, k in enumerate(r):
            for j in range(len(k)):
                numbers[-1][i][j], n = n, n + 1
    leaf_weights, numbers = ([k for r in x for k in r] for x in (leaf_weights, numbers))
    key = F.concat(F.lit(salt + ":"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    at_region, at_flat, at_leaf = fresh([*docs.columns, name], "region", "flat", "leaf")
    out = docs.withColumn(at_region, _choose(key, F.array(*regions)))
    region = F.col(at_region)
    out = out.withColumn(at_flat, region * racks + _choose(F.concat_ws("/", key, region.cast("string")), F.get(_deep(rack_weights), region)))
    flat = F.col(at_flat)
    out = out.withColumn(at_leaf, _choose(F.concat_ws("/", key, F.lit("k"), flat.cast("string")), F.get(_deep(leaf_weights), flat)))
    return out.withColumn(name, F.get(F.get(_deep(numbers), flat), F.col(at_leaf)).cast("int")).drop(at_region, at_flat, at_leaf)


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs(doc_id, text, ...), under the law `key`.

    size is the text's UTF-8 bytes (null: none) plus 16; the checksum of a null text is that of an empty one. slot numbers a
    shard's rows without gaps, equal rows in any order. grown_shard is the shard once there is one more, as a region of its own.
    Extra columns are not looked at. What is broadcast has one row for each shard and part, 40 * 4096 at most, whatever the input."""
    tree = even_tree(shards)
    rows = docs.select(F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = assign(assign(rows, tree), [*tree, [[1.0]]], name="grown_shard")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    counts = rows.groupBy("shard", "part").count()  # shards * PARTS rows at most
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("place", F.row_number().over(own)).join(F.broadcast(before), ["shard", "part"], "left").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
