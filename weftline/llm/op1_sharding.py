"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child of the node
reached so far draws ``-ln(u) / weight``, where ``u`` hashes the key with the
child's name, and the smallest draw wins.  A child's draw depends on nothing but
the key, its name and its weight, so a change of weights moves rows only into or
out of the subtrees whose weights change: a heavier child draws smaller numbers
and takes rows from its siblings, which trade none among themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.columns import unit
from weftline.session import materialize

#: 24 shards: 2 regions of 3 racks of 4 shards.
REGIONS, RACKS, SHARDS = 2, 3, 4
BASE = REGIONS * RACKS * SHARDS


@dataclass(frozen=True)
class Node:
    """A subtree; ``weight`` is what its parent deals to it, the sum of its children's by default."""

    name: int
    weight: float
    children: tuple["Node", ...] = field(default=())


def subtree(name: int, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def topology(n_shards: int) -> Node:
    """The tree for a shard count, of three levels under the root.

    Whole base regions come first.  Each further shard is a rack and a region of
    its own, so one more shard is a new subtree beside the old ones: no old
    weight changes, and the rows that move all move into it.
    """
    regions, left = [], n_shards
    for r in range(min(REGIONS, n_shards // (RACKS * SHARDS))):
        racks = [subtree(r * RACKS + k, [Node((r * RACKS + k) * SHARDS + s, 1.0) for s in range(SHARDS)]) for k in range(RACKS)]
        regions.append(subtree(r, racks))
        left -= RACKS * SHARDS
    first = n_shards - left
    for s in range(first, n_shards):
        regions.append(subtree(1000 + s, [subtree(1000 + s, [Node(s, 1.0)])]))
    return subtree(0, regions)


def _levels(root: Node) -> list[list[Node]]:
    """The inner nodes of each level, in order."""
    out, level = [], [root]
    while level and level[0].children:
        out.append(level)
        level = [c for n in level for c in n.children]
    return out


def _draw(key: Column, depth: int):
    """A child's draw, with the name that settles equal draws."""
    return lambda c: F.struct((-F.log(unit(F.xxhash64(key, F.lit(depth), c["name"]))) / c["weight"]).alias("draw"), c["name"].alias("name"), c["place"].alias("place"))


def descend(key: Column, root: Node) -> list[Column]:
    """The names chosen at each level below ``root`` for the hashed ``key`` (a long)."""
    chosen, place = [], F.lit(0)
    for depth, level in enumerate(_levels(root)):
        at, rows = 0, []
        for node in level:
            rows.append("array(" + ",".join(f"named_struct('name',{c.name},'weight',{c.weight}D,'place',{at + i})" for i, c in enumerate(node.children)) + ")")
            at += len(node.children)
        kids = F.get(F.expr("array(" + ",".join(rows) + ")"), place)
        best = F.array_min(F.transform(kids, _draw(key, depth)))
        chosen.append(best["name"])
        place = best["place"]
    return chosen


def assign(df: DataFrame, key: str = "doc_id", tree: Node | None = None, names: tuple[str, ...] = ("region", "rack", "shard")) -> DataFrame:
    """``df`` with the path of each row in the tree; no shuffle.

    Rows of equal keys go together; a null key is a key as any other.  Existing
    columns with these names are replaced.
    """
    root = tree or topology(BASE)
    path = descend(F.xxhash64(F.col(key), F.lit("shard")), root)
    return df.withColumns(dict(zip(names, path, strict=True)))


def with_slots(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Gapless ``slot`` numbers from 0 in each group, without gathering a group in one task.

    Rows are numbered within (group, input partition), whose size the input
    split bounds, and the counts of the earlier partitions are added.  The input
    is written first, so that both uses see the same partitions.
    """
    held = materialize(df.withColumn("_part", F.spark_partition_id()), "slots")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy(group, "_part").count().select(group, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = held.withColumn("_n", F.row_number().over(local))
    return numbered.join(offsets, [group, "_part"]).withColumn("slot", F.col("_offset") + F.col("_n") - 1).drop("_part", "_n", "_offset")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", tree: Node | None = None) -> None:
    """The table laid out as region/rack/shard folders; large shards stay split over files.

    A null key is a key as any other; rows of one key, repeated ones too, share a folder.
    An empty table gives no folder.  Columns named as the levels are an error, as their
    folders' names would replace them.
    """
    if clash := {"region", "rack", "shard"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} have the names of folders")
    assign(df, key, tree).write.partitionBy("region", "rack", "shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = BASE) -> DataFrame:
    """The digest of the sharding of ``docs`` under the law ``key``.

    Nulls: a null text has 8 bytes and checksum 0; a null doc_id is a key as any
    other.  Repeated rows share a shard and take different slots.  An empty table
    gives no rows.  Of ``docs`` only doc_id and text are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign(narrow, "doc_id", topology(n_shards))
    grown = assign(placed, "doc_id", topology(n_shards + 1), ("_r", "_k", "grown_shard"))
    slotted = with_slots(grown.select("doc_id", "size", "text_crc32", "region", "rack", "shard", "grown_shard"), "shard", ["doc_id", "size", "text_crc32"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
