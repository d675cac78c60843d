"""Label propagation in which a node sees what its neighbours have just become, for graphs of any size.

The nodes get colours so that no two neighbours have the same.  The nodes of one colour
can move at once, as none of them votes on another; then those of the next colour, which
see where the first have moved.  So a round gives what moving the nodes one after the
other gives, in the order of colours, whatever the order within a colour.

Colours are given greedily, nodes of more neighbours first and a hash between equal
ones: a node waits for the neighbours before it and takes the smallest colour that none
of them has.  Nodes go by number in the order of their ids; votes come from packed
neighbourhoods, so that a round moves each vote once.  No group holds more than a node's colours, of which there are never more
than one more than the most neighbours that a node has before it.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.session import drop_scratch, materialize, shuffle_width

logger = logging.getLogger(__name__)


def colours(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """(id, colour) of all nodes; ``both`` holds (id, nbr) from both ends.  ``mark`` of the nodes, else their hash, parts equal degrees."""
    degree = both.groupBy("id").agg(F.count("*").alias("d"))
    mark = F.col("mark") if "mark" in nodes.columns else F.xxhash64("id")
    ranked = degree.join(nodes.select("id", mark.alias("mark")).distinct(), "id").select("id", F.struct("d", "mark", "id").alias("rank"))
    near = ranked.select(F.col("id").alias("nbr"), F.col("rank").alias("theirs"))
    pairs = both.where("id < nbr").select("id", "nbr").join(ranked, "id").join(near, "nbr")
    later = F.col("theirs") > F.col("rank")
    before = materialize(pairs.select(F.when(later, F.col("id")).otherwise(F.col("nbr")).alias("id"), F.when(later, F.col("nbr")).otherwise(F.col("id")).alias("nbr")), "before")
    waits = nodes.select("id").distinct().join(before.groupBy("id").agg(F.count("*").alias("waits")), "id", "left")
    open_ = materialize(waits.select("id", F.coalesce("waits", F.lit(0)).alias("waits"), F.array().cast("array<int>").alias("seen")), "open")
    done = []
    while True:
        free = F.filter(F.sequence(F.lit(0), F.size("seen")), lambda c: ~F.array_contains("seen", c))[0]
        front = materialize(open_.where("waits = 0").select("id", free.alias("colour")), "colours")
        if front.isEmpty():
            break
        done.append(front)
        told = before.join(front.select(F.col("id").alias("nbr"), "colour"), "nbr").groupBy("id").agg(F.count("*").alias("n"), F.collect_set("colour").alias("new"))
        left = open_.where("waits > 0").join(told, "id", "left")
        after = materialize(left.select("id", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), F.when(F.col("new").isNull(), F.col("seen")).otherwise(F.array_union("seen", "new")).alias("seen")), "open")
        drop_scratch(open_)
        open_ = after
    drop_scratch(before)
    out = done[0] if done else nodes.select("id", F.lit(0).alias("colour")).limit(0)
    for front in done[1:]:
        out = out.unionByName(front)
    return out


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 15, seeded: bool = False, coloured: DataFrame | None = None) -> DataFrame:
    """(workspace, id, community) of every node; edges of unknown ends and loops don't count.

    With ``seeded`` the nodes' present communities are the seeds.  A node takes the label
    of the largest summed weight among its neighbours, the larger of equal ones.  It ends
    with the first round in which no node moves.
    """
    width = max(16, shuffle_width(nodes.sparkSession))
    own = nodes.where("id is not null").groupBy("id").agg(F.min("workspace").alias("workspace"), F.min("community").cast("long").alias("seed") if seeded else F.lit(None).cast("long").alias("seed"))
    ids = materialize(graph.numbered(own, "id", "n").select("n", "id", "workspace", "seed", F.xxhash64("id").alias("mark")), "ids")
    linked = _linked(ids, edges)
    both = linked.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("nbr"), "w"), F.struct(F.col("b").alias("id"), F.col("a").alias("nbr"), "w"))).alias("x")).select("x.*")
    named = coloured.join(ids, "id").select("n", "colour") if coloured is not None else colours(ids.select(F.col("n").alias("id"), "mark"), both).select(F.col("id").alias("n"), "colour")
    coloured = materialize(named, "coloured")
    classes = sorted(r[0] for r in coloured.select("colour").distinct().collect())
    rows = both.withColumnRenamed("id", "n").join(coloured, "n").groupBy("colour", "nbr", F.shiftright("n", graph.PACK).alias("_part")).agg(F.collect_list(F.struct("n", "w")).alias("near"))
    packed = materialize(rows.select("nbr", "near", "colour"), "packed", ("colour",))
    drop_scratch(linked)
    start = ids.join(coloured, "n").select("n", "colour", F.coalesce("seed", F.abs("mark") + F.lit(1 << 32)).alias("label"))
    labels = {c: materialize(start.where(F.col("colour") == c).select("n", "label"), "labels") for c in classes}
    due = set(classes)  # those next to which something has moved since they voted; any other would vote as before
    for turn in range(rounds):
        moved = 0
        for c in classes:
            if c not in due:
                continue
            due.discard(c)
            every = None
            for k in classes:
                if k != c:
                    every = labels[k] if every is None else every.unionByName(labels[k])
            if every is None:
                break
            votes = packed.where(F.col("colour") == c).join(every.select(F.col("n").alias("nbr"), "label"), "nbr").select("label", F.inline("near")).repartition(width, "n")
            best = votes.groupBy("n", "label").agg(F.sum("w").alias("w")).groupBy("n").agg(F.max(F.struct("w", "label")).alias("m")).select("n", F.col("m.label").alias("wish"))
            after = materialize(labels[c].join(best, "n", "left").select("n", F.coalesce("wish", "label").alias("label"), (F.coalesce("wish", "label") != F.col("label")).alias("moved")), "labels")
            changes = after.where("moved").count()
            moved += changes
            logger.info("round %d, colour %d: %d nodes have moved", turn, c, changes)
            if changes:
                due |= {k for k in classes if k != c}
                drop_scratch(labels[c])
                labels[c] = after.select("n", "label")
            else:
                drop_scratch(after)
        if not due:
            break
    else:
        logger.warning("label propagation ended after %d rounds with %d moves in the last", rounds, moved)
    drop_scratch(packed)
    found = None
    for table in labels.values():
        found = table if found is None else found.unionByName(table)
    if found is None:
        return nodes.select("workspace", "id", F.lit(None).cast("int").alias("community")).limit(0)
    # numbers stand in the order of ids, so the smallest number of a community is its smallest id
    final = graph.compact(found.select(F.col("n").alias("id"), "label")).withColumnRenamed("id", "n")
    return ids.select("workspace", "id", "n").join(final, "n").select("workspace", "id", "community")


def _linked(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, w): each pair of linked node numbers once, the smaller first, with the weights of all its edges added up."""
    end = lambda side: ids.select(F.col("id").alias(side), F.col("n").alias(f"_{side}"))
    known = edges.where("source != target").select("source", "target", graph.edge_weight(F.col("type")).alias("w")).join(end("source"), "source").join(end("target"), "target")
    pair = known.select(F.least("_source", "_target").alias("a"), F.greatest("_source", "_target").alias("b"), "w")
    return materialize(pair.groupBy("a", "b").agg(F.sum("w").alias("w")), "linked")
