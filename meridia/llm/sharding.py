"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight from a hash of (key, child), and
the least draw wins, so a child is taken in proportion to its weight. If a child's weight rises, rows move only into it;
if it falls, only out of it. So a change moves rows only through the subtrees on whose paths weights change. A shard that
opens a region of its own (as the 25th with 4 shards a rack and 3 racks a region) takes rows only into itself.

Cases: a null key is one key like any other; null text has size 8 and the CRC-32 of no bytes; repeated rows share a shard
and have slots of their own; an empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm._rank import running_total

Rack = list[tuple[int, float]]
#: Pieces of a shard that are numbered apart.
PIECES = 256


def layout(shards: int, per_rack: int = 4, racks_per_region: int = 3, weights: dict[int, float] | None = None) -> list[list[Rack]]:
    """Regions of racks of (shard, weight), filled in order of the shard number. Weights are 1 where none is given."""
    if shards < 1 or per_rack < 1 or racks_per_region < 1:
        raise ValueError("shards, per_rack and racks_per_region must be at least 1")
    leaves = [(s, float((weights or {}).get(s, 1.0))) for s in range(shards)]
    if any(w <= 0 for _, w in leaves):
        raise ValueError("weights must be positive")
    racks = [leaves[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [racks[i : i + racks_per_region] for i in range(0, len(racks), racks_per_region)]


def _children(nodes: list[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(i).alias("to")) for n, w, i in nodes])


def _pick(key: Column, children: Column) -> Column:
    """`to` of the child with the least draw; ties go to the least `to`."""

    def draw(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["to"].alias("to"))

    return F.array_min(F.transform(children, draw))["to"]


def shard_of(key: Column, tree: list[list[Rack]]) -> Column:
    """The shard of a key in a tree of layout(). Each level's pick points to the children of the next."""
    regions, racks, shards = [], [], []
    for i, region in enumerate(tree):
        regions.append((f"region {i}", float(sum(w for rack in region for _, w in rack)), i))
        racks.append([(f"rack {i} {j}", float(sum(w for _, w in rack)), len(shards) + j) for j, rack in enumerate(region)])
        shards += [[(f"shard {s}", w, s) for s, w in rack] for rack in region]
    region = _pick(key, _children(regions))
    rack = _pick(key, F.get(F.array(*map(_children, racks)), region))
    return _pick(key, F.get(F.array(*map(_children, shards)), rack)).cast("int")


def hash_tree(docs: DataFrame, tree: list[list[Rack]], grown: list[list[Rack]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot (gapless from 0 in each shard) and grown_shard (the shard in the tree `grown`)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_of(F.col(key), tree).alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(PIECES)).cast("int").alias("_piece"),
    )
    return running_total(rows, "shard", "_piece", [key, "text_crc32", "size"], F.lit(1), "slot").drop("_piece")
