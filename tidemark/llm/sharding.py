"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, racks and shards, each shard with a weight; an inner node weighs what its
shards weigh together. A row descends from the root: at each level every child draws
`-ln(u) / weight`, u being a hash of the child's name and the row's key, and the smallest draw
wins. A child's draw depends on nothing but its own name, weight and the key. When a weight
changes, rows therefore move only into or out of subtrees whose weights changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, read_table


@dataclass(frozen=True)
class Tree:
    """`regions`: for each region its racks, for each rack its shards as (number, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: no weight elsewhere changes, so rows move
        only into it."""
        return Tree((*self.regions, (((self.shards, float(weight)),),)))


def founding_tree(shards: int, racks_in_region: int = 2, shards_in_rack: int = 4) -> Tree:
    """A tree of equal weights; the last rack and region may be smaller."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    racks = [tuple((s, 1.0) for s in range(a, min(a + shards_in_rack, shards))) for a in range(0, shards, shards_in_rack)]
    return Tree(tuple(tuple(racks[a : a + racks_in_region]) for a in range(0, len(racks), racks_in_region)))


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight with 52 bits of hash in u, which is never 0 or 1."""
    bits = F.xxhash64(name, key).bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    return -F.ln((bits + 0.5) / float(1 << 52)) / weight


def _winner(key: Column, children: Column) -> Column:
    """children: array of (name, node, weight); ties, which have chance 2^-52, go to the smaller name."""
    drawn = F.transform(
        children,
        lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("d"), c["name"].alias("name"), c["node"].alias("node")),
    )
    return F.array_min(drawn)["node"]


def _child(name: str, node: int, weight: float) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(node).alias("node"), F.lit(float(weight)).alias("weight"))


def place(key: Column, tree: Tree) -> tuple[Column, Column, Column]:
    """The region, rack and shard of a key. A null key is a key like any other."""
    weigh = lambda rack: sum(w for _, w in rack)
    top = F.array(*[_child(f"g{g}", g, sum(map(weigh, region))) for g, region in enumerate(tree.regions)])
    racks, shards, number = [], [], 0
    for g, region in enumerate(tree.regions):
        inner = []
        for rack in region:
            inner.append(_child(f"r{number}", number, weigh(rack)))
            shards += [F.lit(number), F.array(*[_child(f"s{s}", s, w) for s, w in rack])]
            number += 1
        racks += [F.lit(g), F.array(*inner)]
    region = _winner(key, top)
    rack = _winner(key, F.element_at(F.create_map(*racks), region))
    shard = _winner(key, F.element_at(F.create_map(*shards), rack))
    return region, rack, shard


def shard_documents(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Law `key`: the key and the tree decide a row's shard.

    Returns one row per input row: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law,
    region, rack, shard, slot (gapless from 0 in each shard) and grown_shard (its shard once the tree
    has one more). Null and empty texts have size 16 and checksum 0. Rows with the same id share a
    shard and get different slots. Slots are numbered in buckets of each shard, so no task holds a
    whole shard.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col("doc_id")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = (
        rows.withColumn("__tm_region", place(key, tree)[0])
        .withColumn("__tm_rack", place(key, tree)[1])
        .withColumn("shard", place(key, tree)[2].cast("int"))
        .withColumn("grown_shard", place(key, tree.grown())[2].cast("int"))
    )
    slots = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
        F.col("__tm_region").alias("region"), F.col("__tm_rack").alias("rack"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards: 5 regions of 2 racks of 4."""
    return shard_documents(read_table(spark, sf_dir, "documents"), founding_tree(40))
