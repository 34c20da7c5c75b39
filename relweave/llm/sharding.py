"""Hierarchical weighted hash tree.

A row descends region, rack and shard. At every level each child draws
-ln(u) / weight, where u is a hash of (key, level, child) mapped into (0, 1);
the smallest draw wins, so a child is taken with probability weight / sum of
weights. A child's draw depends on that child alone: when a weight changes, each
level moves rows only into the child that holds it (weight raised) or out of
it (weight lowered), and within a subtree whose weights stay the same nothing
moves but what enters or leaves it.

Law: `key`. The key and the tree decide, rows with equal keys (null is a key
too) share a shard. `grow` brings a new shard as a region of its own, which
leaves all older weights as they are, so a grown tree takes rows only into the
new shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.common import staged

#: Rows of one numbering group; groups of a shard are numbered side by side.
ROWS_PER_GROUP = 25_000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class HashTree:
    """Leaves with weights; a rack's and a region's weight is the sum of its leaves'. Leaves of no weight take no rows."""

    leaves: tuple[Leaf, ...]

    def __post_init__(self):
        if not any(x.weight > 0 for x in self.leaves):
            raise ValueError("a tree needs a leaf with a positive weight")
        if len({x.shard for x in self.leaves}) != len(self.leaves):
            raise ValueError("a shard number occurs twice")

    @staticmethod
    def uniform(n_shards: int, racks: int = 2, shards_per_rack: int = 4) -> HashTree:
        """n_shards leaves of weight 1, filled rack by rack and region by region."""
        rack = [i // shards_per_rack for i in range(n_shards)]
        return HashTree(tuple(Leaf(f"g{k // racks}", f"k{k}", i) for i, k in enumerate(rack)))

    def grow(self, weight: float = 1.0) -> HashTree:
        """One more shard, as a region of its own."""
        n = max(x.shard for x in self.leaves) + 1
        return HashTree((*self.leaves, Leaf(f"g+{n}", f"k+{n}", n, weight)))

    def reweighted(self, shard: int, weight: float) -> HashTree:
        return HashTree(tuple(Leaf(x.region, x.rack, x.shard, weight if x.shard == shard else x.weight) for x in self.leaves))

    def children(self, depth: int) -> dict[str, dict[str, float]]:
        """Parent id -> child id -> weight, of depth 0 (regions), 1 (racks) or 2 (shards)."""
        out: dict[str, dict[str, float]] = {}
        for x in self.leaves:
            path = ["", x.region, f"{x.region}/{x.rack}", str(x.shard)]
            if x.weight > 0:
                level = out.setdefault(path[depth], {})
                level[path[depth + 1]] = level.get(path[depth + 1], 0.0) + x.weight
        return out


def _draw(key: Column, depth: int, child: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(depth), child["id"]), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(2.0**53)) / child["w"]


def _descend(tree: HashTree, key: Column, depth: int, parent: Column) -> Column:
    """Id of the child with the smallest draw below `parent`."""
    table = tree.children(depth)
    pairs = []
    for at, below in sorted(table.items()):
        pairs += [F.lit(at), F.array(*[F.struct(F.lit(c).alias("id"), F.lit(w).alias("w")) for c, w in sorted(below.items())])]
    return F.array_min(F.transform(F.element_at(F.create_map(*pairs), parent), lambda c: F.struct(_draw(key, depth, c).alias("draw"), c["id"].alias("id"))))["id"]


def place(df: DataFrame, tree: HashTree, key: str = "doc_id", prefix: str = "") -> DataFrame:
    """Adds {prefix}region, {prefix}rack and {prefix}shard. Columns of these names are replaced."""
    out = df.withColumn(f"{prefix}region", _descend(tree, F.col(key), 0, F.lit("")))
    out = out.withColumn(f"{prefix}rack", _descend(tree, F.col(key), 1, F.col(f"{prefix}region")))
    return out.withColumn(f"{prefix}shard", _descend(tree, F.col(key), 2, F.col(f"{prefix}rack")).cast("int"))


def shard(docs: DataFrame, tree: HashTree, grown: HashTree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard, region, rack.

    size: UTF-8 bytes of the text plus 8 (null text: 8). text_crc32: null for a
    null text. slot: 0, 1, 2, ... within the shard, in no promised order.
    grown_shard: the shard in `grown`, null without it. Empty input: no rows.
    Equal rows are all placed, each with a slot. Other columns are not read.

    The placed rows, without their texts, are staged once. Slots come from
    numbering groups of about ROWS_PER_GROUP rows of a shard, offset by the
    sizes of the groups before: no shard is ever gathered in one task.
    """
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
    )
    placed = place(slim, tree, "doc_id")
    placed = place(placed, grown, "doc_id", "grown_") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = placed.drop("grown_region", "grown_rack").withColumn("salt", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    placed = staged(placed, "sharded")

    groups = max(8, math.ceil(placed.count() / (len(tree.leaves) * ROWS_PER_GROUP)))
    grouped = placed.withColumn("grp", F.pmod("salt", F.lit(groups)).cast("int"))
    before = Window.partitionBy("shard").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.groupBy("shard", "grp").count().select("shard", "grp", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "grp").orderBy("doc_id", "text_crc32", "size", "salt")
    numbered = grouped.withColumn("slot", F.row_number().over(within) - 1).join(starts, ["shard", "grp"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("slot")).alias("slot"), "grown_shard", "region", "rack")
