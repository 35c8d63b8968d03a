"""Sharding by a hierarchical tree of weighted hash draws.

A row descends from the root over region and rack to a shard. At each node
every child draws -ln(u) / weight, where u is a hash of (row, child) in (0, 1),
and the smallest draw wins: a child gets rows in proportion to its weight. A
child's draw depends on the row, the child's name and its own weight only, so
a change of weights moves rows to or from the changed child and leaves the
draws between the others as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import salted_rank

RACKS = 3
SHARDS_PER_RACK = 4


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a shard has a number and no children."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def tree(shards: int, base: int) -> Node:
    """Regions of 12 shards up to `base`; each shard beyond stands by itself.

    A shard that joins later is a region of its own: only the root's draws
    change, and only towards the new region. Inside an old region it would
    draw rows of other regions to its neighbours too.
    """
    if not 0 < base <= shards:
        raise ValueError("base must be between 1 and shards")
    per_region = RACKS * SHARDS_PER_RACK
    regions = []
    for start in range(0, base, per_region):
        racks = []
        stop = min(start + per_region, base)
        for first in range(start, stop, SHARDS_PER_RACK):
            own = tuple(
                Node(f"shard/{i}", 1.0, shard=i) for i in range(first, min(first + SHARDS_PER_RACK, stop))
            )
            racks.append(Node(f"rack/{first}", float(len(own)), own))
        regions.append(Node(f"region/{start}", sum(r.weight for r in racks), tuple(racks)))
    for i in range(base, shards):
        rack = Node(f"rack/{i}", 1.0, (Node(f"shard/{i}", 1.0, shard=i),))
        regions.append(Node(f"region/{i}", 1.0, (rack,)))
    return Node("root", sum(r.weight for r in regions), tuple(regions))


def _draw(key: Column, child: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 12).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / child.weight


def descend(key: Column, node: Node) -> Column:
    """The shard that a key reaches from a node."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]
    winner = F.least(*draws)["i"]
    out = descend(key, node.children[-1])
    for i, child in reversed(list(enumerate(node.children[:-1]))):
        out = F.when(winner == i, descend(key, child)).otherwise(out)
    return out


def place(df: DataFrame, key: str, node: Node, name: str = "shard") -> DataFrame:
    """Add the shard of each row. A NULL key hashes like any other value."""
    return df.withColumn(name, descend(F.col(key), node))


def shard_documents(docs: DataFrame, shards: int = 24, base: int | None = None) -> DataFrame:
    """Documents with size, text checksum, shard, slot and next shard.

    `base`: the shard count at which the tree was laid out (default: `shards`).
    Size is the text's UTF-8 bytes plus 8; a NULL text has none, and checksum
    0. Slots number a shard's rows from 0 without gaps. Repeated rows share a
    shard and get slots of their own; ties in doc_id are broken by size and
    checksum, and by nothing where these agree too. An empty table gives no
    rows. Columns other than doc_id and text are not read.
    """
    base = shards if base is None else base
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(place(rows, "doc_id", tree(shards, base)), "doc_id", tree(shards + 1, base), "grown_shard")
    ordered = placed.withColumn("_order", F.struct("doc_id", "size", "text_crc32"))
    return salted_rank(ordered, "shard", "_order", "slot", docs.count()).drop("_order").select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard"
    )
