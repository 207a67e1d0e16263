"""Sharding by a hierarchical weighted hash tree.

A row descends region → rack → shard. At each level every child draws ``-ln(u) / weight`` with ``u``
hashed from the row's key and the child's name, and the smallest draw wins. A child is chosen in
proportion to its weight, and when a weight changes, only draws of the nodes above that shard change:
rows move into (or out of) that subtree and nowhere else.

Which shards receive rows when one is added:

* ``grown`` hangs the new shard in a region of its own. Every other draw stays, so each row that moves
  goes to the new shard.
* A shard hung into an existing rack raises the weight of that rack and region. Rows of other regions
  can only move into that region, where they descend anew.

Keys decide alone: rows with equal keys, also null ones, share a shard. Text has no say except for
the reported size and checksum; a null text has size 16 and checksum 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canasta.llm.shared import numbered, unit, written

#: Leaves a tree may have; it travels inside the plan as a literal.
MAX_SHARDS = 4096
#: Rows of one shard that are numbered together.
NUMBERED_TOGETHER = 200_000


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def balanced(shards: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """``shards`` equal shards, ``per_rack`` to a rack and ``racks`` to a region."""
    return [Shard(s // (per_rack * racks), s // per_rack, s) for s in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` and one more shard, in a region and rack of its own."""
    return [
        *tree,
        Shard(
            max(s.region for s in tree) + 1,
            max(s.rack for s in tree) + 1,
            max(s.shard for s in tree) + 1,
            weight,
        ),
    ]


def _children(pairs: list[tuple[int, int, float]]) -> Column:
    """parent → its children with their summed weights, as one literal map."""
    weights: dict[int, dict[int, float]] = {}
    for parent, child, weight in pairs:
        own = weights.setdefault(parent, {})
        own[child] = own.get(child, 0.0) + weight
    return F.map_from_arrays(
        F.array(*map(F.lit, weights)),
        F.array(
            *(
                F.array(*(F.struct(F.lit(c).alias("node"), F.lit(w).alias("weight")) for c, w in own.items()))
                for own in weights.values()
            )
        ),
    )


def _draw(children: Column, parent: Column, level: str, key: Column) -> Column:
    """The child of ``parent`` with the smallest draw."""
    draws = F.transform(
        F.element_at(children, parent),
        lambda c: F.struct((-F.ln(unit(key, F.lit(level), c["node"])) / c["weight"]).alias("draw"), c["node"].alias("node")),
    )
    return F.array_min(draws)["node"]


def place(df: DataFrame, key: str, tree: list[Shard], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row in ``out``; row-local, no shuffle."""
    if not 0 < len(tree) <= MAX_SHARDS:
        raise ValueError(f"a tree has 1 to {MAX_SHARDS} shards")
    if any(not s.weight > 0 for s in tree):
        raise ValueError("weights are positive")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    regions = _children([(0, s.region, s.weight) for s in tree])
    racks = _children([(s.region, s.rack, s.weight) for s in tree])
    shards = _children([(s.rack, s.shard, s.weight) for s in tree])
    return (
        df.withColumn("_region", _draw(regions, F.lit(0), "region", name))
        .withColumn("_rack", _draw(racks, F.col("_region"), "rack", name))
        .withColumn(out, _draw(shards, F.col("_rack"), "shard", name))
        .drop("_region", "_rack")
    )


def shard_documents(
    docs: DataFrame, tree: list[Shard], doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every row of ``docs`` in its shard, with a gapless slot per shard.

    Slots are numbered in buckets of a hash of the id, whose number follows the row count, so that no
    task sees a whole shard. Texts stay in the scan; only ids, sizes and checksums are written.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    placed = place(narrow, "doc_id", tree)
    placed = placed.withColumn("law", F.lit("key"))
    placed = written(place(placed, "doc_id", grown(tree), "grown_shard"), "shards")
    buckets = 1 + placed.count() // (NUMBERED_TOGETHER * len(tree))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    order = ["doc_id", "size", "text_crc32"]
    slots = numbered(placed, ["shard"], bucket, order, "slot")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
