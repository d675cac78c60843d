"""Graph operators over ``nodes`` (id, workspace, label, kind, file_path, language, community, ...) and ``edges`` (source, target, type).

Everything is joins on keys and aggregations; nothing gathers a graph on the
driver.  Caps that belong to an operator carry a total order.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as T
from weftline.operators import block_lpa
from weftline.session import drop_scratch, materialize, shuffle_width

logger = logging.getLogger(__name__)

#: Nodes from which on a clustering that has nearly come to rest goes on with its active nodes alone.
FRONTIER = 1 << 20
#: Nodes whose votes one row of the packed neighbourhoods holds at most, as a power of two.
PACK = 16
#: Nodes of a neighbourhood that is shown.
HOOD = 40
#: Weights of edge types for clustering; any other type weighs 1.
EDGE_WEIGHTS = {"IMPLEMENTS": 3.0, "CALLS": 2.0, "TYPE_REF": 1.5}


def edge_weight(type_: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in EDGE_WEIGHTS.items():
        out = F.when(type_ == name, F.lit(weight)).otherwise(out)
    return out


def find_symbols(nodes: DataFrame, name: str, workspace: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes whose label is or holds ``name``: the exact and alphabetically first, then imports behind the others."""
    own = nodes if workspace is None else nodes.where(F.col("workspace") == workspace)
    exact = F.col("label") == name
    top = own.where(exact | F.contains("label", F.lit(name))).orderBy(exact.desc(), "label", "id").limit(limit)
    return top.orderBy(exact.desc(), F.col("kind") == "import", "id")


def suffix_matches(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(T.suffix_match(F.col("label"), F.lit(name)))


def references(nodes: DataFrame, edges: DataFrame, symbol: str, workspace: str | None = None) -> DataFrame:
    """Edges into the nodes that match a symbol, with the node they come from; the workspace limits the targets."""
    targets = suffix_matches(nodes if workspace is None else nodes.where(F.col("workspace") == workspace), symbol)
    hit = edges.join(targets.select(F.col("id").alias("target")), "target", "left_semi")
    callers = nodes.select(F.col("id").alias("source"), F.col("label").alias("caller"), F.col("file_path").alias("caller_file"))
    return hit.join(callers, "source").select("source", "caller", "caller_file", "target", "type")


def resolve_edges(nodes: DataFrame, extracted: DataFrame) -> DataFrame:
    """Endpoints of extracted edges: a known id, else the label in the same file, else in the workspace, the smallest id first.

    Sources of exactly three parts, ``workspace:file:name``, are looked up by label
    too.  Edges without a target are dropped.  A label may be very common, so the
    smallest id a (workspace, label) and a (workspace, file, label) is found before
    the joins, which then have one row a key on that side.
    """
    by_file = nodes.groupBy("workspace", "file_path", "label").agg(F.min("id").alias("file_id"))
    by_space = nodes.groupBy("workspace", "label").agg(F.min("id").alias("space_id"))

    def looked_up(df: DataFrame, ws: str, file: str, label: str, out: str) -> DataFrame:
        f = by_file.select(F.col("workspace").alias("_fw"), F.col("file_path").alias("_ff"), F.col("label").alias("_fl"), F.col("file_id").alias(f"_{out}_file"))
        s = by_space.select(F.col("workspace").alias("_sw"), F.col("label").alias("_sl"), F.col("space_id").alias(f"_{out}_space"))
        joined = df.join(f, (F.col(ws) == F.col("_fw")) & (F.col(file) == F.col("_ff")) & (F.col(label) == F.col("_fl")), "left").drop("_fw", "_ff", "_fl")
        joined = joined.join(s, (F.col(ws) == F.col("_sw")) & (F.col(label) == F.col("_sl")), "left").drop("_sw", "_sl")
        return joined.withColumn(out, F.coalesce(f"_{out}_file", f"_{out}_space")).drop(f"_{out}_file", f"_{out}_space")

    parts = F.split("source_id", ":")
    marked = extracted.withColumns({"_file": F.get(parts, F.lit(1)), "_name": F.when(F.size(parts) == 3, F.get(parts, F.lit(2)))})
    found = looked_up(looked_up(marked, "workspace", "_file", "target_label", "_target"), "workspace", "_file", "_name", "_source")
    out = found.select("workspace", F.coalesce(F.when(F.col("_name").isNotNull(), F.col("_source")), "source_id").alias("source"), F.coalesce("target_id", "_target").alias("target"), F.col("edge_type").alias("type"), "category")
    return out.where(F.col("target").isNotNull())


def neighbours(edges: DataFrame, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    """(id): the seeds and every node one edge away, each once; two equi-joins instead of an OR.

    With ``cap`` (HOOD in a neighbourhood that is shown) so many: sources first, then
    targets, then seeds without an edge, each by id.
    """
    ends = edges.join(seeds.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    starts = edges.join(seeds.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
    if cap is None:
        return ends.unionByName(starts).unionByName(seeds.select("id")).distinct()
    # a seed is the source of its outgoing edges and the target of its incoming ones
    own = seeds.select("id").distinct()
    out_of = own.join(edges.select(F.col("source").alias("id")), "id", "left_semi")
    into = own.join(edges.select(F.col("target").alias("id")), "id", "left_semi")
    tiers = [(starts, 0), (out_of, 0), (ends, 1), (into, 1), (own, 2)]
    every = reduce(DataFrame.unionByName, [df.select("id", F.lit(n).alias("tier")) for df, n in tiers])
    return every.groupBy("id").agg(F.min("tier").alias("tier")).orderBy("tier", "id").limit(cap).select("id")


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, cap: int = HOOD) -> tuple[DataFrame, DataFrame]:
    """The nodes one hop around the seeds, ``cap`` at most, and the edges that touch a seed; the whole graph where none is known."""
    near = materialize(nodes.join(neighbours(edges, seeds, cap), "id", "left_semi"), "near")
    if near.isEmpty():
        return nodes, edges
    ids = seeds.select("id").distinct()
    out_of = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(*edges.columns)
    into = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    return near, out_of.unionByName(into.select(*edges.columns))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, cap: int | None = None) -> DataFrame:
    """(id, depth): every node within ``hops`` edges of a seed, with its least depth.

    Only the nodes found last are joined with the edges; each step is written, and dropped
    behind the last.  With ``cap`` the first by (depth, id) stay.
    """
    fronts = [materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "hops")]
    for depth in range(1, hops + 1):
        seen = reduce(DataFrame.unionByName, fronts)
        near = neighbours(edges, fronts[-1].select("id")).join(seen.select("id"), "id", "left_anti")
        fronts.append(materialize(near.withColumn("depth", F.lit(depth)), "front"))
    out = materialize(reduce(DataFrame.unionByName, fronts), "hops")
    for front in fronts:
        drop_scratch(front)
    return out if cap is None else out.orderBy("depth", "id").limit(cap)


def symbol_subgraph(nodes: DataFrame, edges: DataFrame, symbol: str, workspace: str | None = None, cap: int = 60) -> tuple[DataFrame, DataFrame]:
    """Two hops around a symbol's matches, with all edges met; the whole graph where the symbol is unknown."""
    roots = materialize(find_symbols(nodes, symbol, workspace).select("id"), "roots")
    if roots.isEmpty():
        return nodes, edges
    one = neighbours(edges, roots)
    touched = edges.join(one.select(F.col("id").alias("source")), "source", "left_semi").unionByName(edges.join(one.select(F.col("id").alias("target")), "target", "left_semi")).distinct()
    kept = k_hop(edges, roots, 2, cap)
    return nodes.join(kept.select("id"), "id", "left_semi"), touched


def inter_galaxy(nodes: DataFrame, edges: DataFrame, limit: int | None = 200) -> DataFrame:
    """Edges between communities, ordered for the cut."""
    place = nodes.where(F.col("community").isNotNull()).select("id", "community")
    a, b = place.select(F.col("id").alias("source"), F.col("community").alias("source_community")), place.select(F.col("id").alias("target"), F.col("community").alias("target_community"))
    crossing = edges.join(a, "source").join(b, "target").where("source_community != target_community").select("source", "target", "type", "source_community", "target_community")
    return crossing if limit is None else crossing.orderBy("source", "target", "type").limit(limit)


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Members, internal edges, incoming and outgoing crossings, instability and role of each community.

    Edges are counted by pairs of communities first, so what is shuffled after the
    joins is one row a pair of communities.
    """
    place = nodes.where(F.col("community").isNotNull()).select("id", "community")
    a, b = place.select(F.col("id").alias("source"), F.col("community").alias("s")), place.select(F.col("id").alias("target"), F.col("community").alias("t"))
    pairs = edges.select("source", "target").join(a, "source").join(b, "target").groupBy("s", "t").count()
    sides = pairs.select(F.explode(F.array(F.struct(F.col("s").alias("c"), F.when(F.col("s") == F.col("t"), F.col("count")).otherwise(0).alias("i"), F.lit(0).cast("long").alias("a"), F.when(F.col("s") != F.col("t"), F.col("count")).otherwise(0).alias("e")), F.struct(F.col("t").alias("c"), F.lit(0).cast("long").alias("i"), F.when(F.col("s") != F.col("t"), F.col("count")).otherwise(0).alias("a"), F.lit(0).cast("long").alias("e")))).alias("x"))
    summed = sides.groupBy(F.col("x.c").alias("community")).agg(F.sum("x.i").alias("internal_edges"), F.sum("x.a").alias("afferent"), F.sum("x.e").alias("efferent"))
    members = place.groupBy("community").agg(F.count("*").alias("node_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    both = members.join(summed, "community", "left").select("community", "node_count", zero("internal_edges"), zero("afferent"), zero("efferent"))
    out = both.withColumn("external_edges", F.col("afferent") + F.col("efferent")).withColumn("instability", T.instability(F.col("afferent"), F.col("efferent")))
    return out.withColumn("role", T.role(F.col("instability")))


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the most frequent value of each group, the smallest of several."""
    counts = df.groupBy(group, value).count()
    best = counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(value))
    return best


def describe(nodes: DataFrame, symbols: int = 8) -> DataFrame:
    """Dominant folder, languages, first labels and name of each community; labels by rank, so no list is longer."""
    own = nodes.where(F.col("community").isNotNull()).withColumn("dir", T.parent_directory(F.col("file_path")))
    folder = dominant(own, "community", "dir")
    order = Window.partitionBy("community").orderBy("label")
    first = own.select("community", "label").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= symbols)
    labels = first.groupBy("community").agg(F.sort_array(F.collect_list("label")).alias("key_symbols"))
    langs = own.groupBy("community").agg(F.sort_array(F.collect_set("language")).alias("languages"))
    name = F.concat(F.coalesce(F.nullif(F.col("dir"), F.lit("")), F.lit("root")), F.lit(" ("), F.get("key_symbols", F.lit(0)), F.lit(")"))
    return folder.join(labels, "community").join(langs, "community").withColumn("name", name)


def boundary(nodes: DataFrame, edges: DataFrame, symbol: str, workspace: str | None = None) -> DataFrame:
    """One row: the symbol's first match, its callers inside and outside its community, the boundary status and risk."""
    first = find_symbols(nodes, symbol, workspace).limit(1).select(F.col("id").alias("target"), F.col("label").alias("symbol"), F.col("community").alias("own"))
    calls = edges.join(first, "target").join(nodes.select(F.col("id").alias("source"), F.col("community").alias("theirs")), "source")
    inside = F.coalesce(F.col("theirs") == F.col("own"), F.lit(False))
    counts = calls.groupBy("target").agg(F.count_if(inside).alias("internal_callers"), F.count_if(~inside).alias("cross_callers"), F.count_distinct(F.when(~inside, F.col("theirs"))).alias("foreign"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    row = first.join(counts, "target", "left").select("target", "symbol", F.col("own").alias("community"), zero("internal_callers"), zero("cross_callers"), zero("foreign"))
    crossing = F.col("cross_callers") > 0
    status = F.when(crossing, "BOUNDARY_CROSSING").when(F.col("internal_callers") > 0, "INTERNAL_ONLY").otherwise("ISOLATED")
    risk = F.when(crossing & ((F.col("cross_callers") >= 3) | (F.col("foreign") > 1)), "HIGH").when(crossing, "MEDIUM").otherwise("LOW")
    return row.withColumn("status", status).withColumn("risk", risk).withColumn("advice", _advice())


def _advice() -> Column:
    """What to mind when a symbol of a boundary row is changed."""
    crossing = F.format_string("%d callers in %d other communities depend on %s: change them together with it; its %d own callers move with it.", "cross_callers", "foreign", "symbol", "internal_callers")
    inside = F.format_string("All %d callers of %s are in its own community: a change stays there.", "internal_callers", "symbol")
    alone = F.format_string("%s has no callers in the graph: an entry point, or not in use.", "symbol")
    return F.when(F.col("status") == "BOUNDARY_CROSSING", crossing).when(F.col("status") == "INTERNAL_ONLY", inside).otherwise(alone)


def induced(nodes: DataFrame, edges: DataFrame, community: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of one community and the edges with both ends among them."""
    own = nodes.where(F.col("community") == community)
    ids = own.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return own, inner


def provenance(worktree: DataFrame, parent: DataFrame, is_worktree: bool = True) -> DataFrame:
    """Whether each symbol (file_path, label, kind) of a worktree is its own or its parent's."""
    if not is_worktree:
        return worktree.withColumn("provenance", F.lit("trunk_root"))
    keys = ["file_path", "label", "kind"]
    there = parent.select(*keys).distinct().withColumn("_there", F.lit(True))
    return worktree.join(there, keys, "left").withColumn("provenance", F.when(F.col("_there"), "trunk_inherited").otherwise("branch_delta")).drop("_there")


def branch_diff(worktree: DataFrame, parent: DataFrame) -> DataFrame:
    """(file_path, label, kind, change): symbols that only one side has."""
    keys = ["file_path", "label", "kind"]
    a, b = worktree.select(*keys).distinct().withColumn("_w", F.lit(1)), parent.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = a.join(b, keys, "full_outer")
    return both.where("_w is null or _p is null").select(*keys, F.when(F.col("_p").isNull(), "added").otherwise("removed").alias("change"))


def vote_community(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community): the weighted vote of each node's neighbours, the largest community of several."""
    place = nodes.where(F.col("community").isNotNull()).select("id", "community")
    w = edge_weight(F.col("type")).alias("w")
    votes = edges.select(F.col("source").alias("me"), F.col("target").alias("id"), w).unionByName(edges.select(F.col("target").alias("me"), F.col("source").alias("id"), w))
    sums = votes.join(place, "id").groupBy("me", "community").agg(F.sum("w").alias("w"))
    return sums.groupBy(F.col("me").alias("id")).agg(F.max(F.struct("w", "community")).alias("m")).select("id", "m.community")


def adjacency(edges: DataFrame, buckets: int) -> DataFrame:
    """(id, nbr, w, bucket): every edge from both ends, parallel ones added up, written by the bucket of ``id``."""
    w = edge_weight(F.col("type")).alias("w")
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("nbr"), w).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("nbr"), w)).where("id != nbr")
    summed = both.groupBy("id", "nbr").agg(F.sum("w").alias("w")).withColumn("bucket", bucket_of("id", buckets))
    return materialize(summed.repartition(buckets, "bucket"), "adjacency", ("bucket",))


def bucket_of(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _within(table: DataFrame, ids: DataFrame, buckets: int) -> DataFrame:
    """The rows of a table written by bucket whose ``id`` is among ``ids``; other buckets are not read."""
    held = [r[0] for r in ids.select(bucket_of("id", buckets)).distinct().collect()]  # ``buckets`` numbers at most
    return table.where(F.col("bucket").isin(held)).join(ids, "id", "left_semi")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 15, seeds: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """(id, community): weighted label propagation for graphs of any size.

    Labels begin at the seed or at a number of their own; the neighbours' summed
    weights choose a label, the larger of equal ones.  So that two nodes don't swap
    labels for ever, a node moves only in rounds that its hash picks.  It ends when
    none wants to move, or after 4 * ``rounds`` with a warning.  Communities get compact
    numbers, seeds keep theirs.

    Rounds go over blocks of nodes; where one node has too many neighbours for a block
    (``block_lpa``), by rows, and when few of many nodes are left, by an active set.
    ``changed`` (id) names the nodes whose neighbourhood is not that of the seeds'
    clustering: then, too, only an active set votes.
    """
    buckets = max(16, shuffle_width(nodes.sparkSession))
    ids = nodes.select("id").distinct()
    own = ids.join(seeds.select("id", F.col("community").cast("long").alias("label")), "id", "left") if seeds is not None else ids.withColumn("label", F.lit(None).cast("long"))
    begun = own.select("id", F.coalesce("label", F.abs(F.xxhash64("id")) + F.lit(1 << 32)).alias("label"))
    if changed is not None and seeds is not None:
        active = changed.select("id").unionByName(own.where("label is null").select("id")).distinct()
        return compact(_frontier(materialize(begun, "labels"), adjacency(edges, buckets), materialize(active, "active"), 0, 4 * rounds, buckets))
    begun = materialize(begun, "begun")
    weighed = edges.select("source", "target", edge_weight(F.col("type")).alias("w"))
    found = block_lpa.propagate(begun, weighed, [1.0, *EDGE_WEIGHTS.values()], 4 * rounds, buckets)
    return compact(_by_rows(begun, edges, 4 * rounds, buckets) if found is None else found)


def _by_rows(begun: DataFrame, edges: DataFrame, last: int, buckets: int) -> DataFrame:
    """(id, label) after the rounds, in which every vote is a row."""
    labels = materialize(numbered(begun, "id", "n").select(F.col("n").cast("int").alias("n"), "id", "label"), "labels")
    packed = _packed(labels.select("id", "n"), edges)
    total, wanting = labels.count(), 0
    for turn in range(last):
        # labels are many, so no join sends them through the driver; votes go to their node's partition once
        votes = packed.join(labels.select(F.col("n").alias("nbr"), "label").hint("merge"), "nbr").select("label", F.inline("near")).repartition(buckets, "n")
        best = votes.groupBy("n", "label").agg(F.sum("w").alias("w")).groupBy("n").agg(F.max(F.struct("w", "label")).alias("m")).select("n", F.col("m.label").alias("wish"))
        wants = F.coalesce("wish", "label") != F.col("label")
        moved = labels.join(best.hint("merge"), "n", "left").select("n", "id", F.when(wants & _turn(turn), F.col("wish")).otherwise(F.col("label")).alias("label"), wants.alias("wants"), (wants & _turn(turn)).alias("moved"))
        moved = materialize(moved, "labels")
        wanting = moved.where("wants").count()
        drop_scratch(labels)
        labels = moved.select("n", "id", "label")
        if not wanting:
            drop_scratch(packed)
            return labels.select("id", "label")
        if total >= FRONTIER and wanting * 8 < total and _reach(packed, moved) * 8 < total:
            drop_scratch(packed)
            both = adjacency(edges, buckets)
            near = _within(both, moved.where("moved").select("id"), buckets).select(F.col("nbr").alias("id"))
            active = near.unionByName(moved.where("wants and not moved").select("id")).distinct()
            return _frontier(labels.select("id", "label"), both, materialize(active, "active"), turn + 1, last, buckets)
    drop_scratch(packed)
    logger.warning("label propagation ended after %d rounds, %d nodes want to move", last, wanting)
    return labels.select("id", "label")


def _packed(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(nbr, near): for every node number those that it votes for, (n, w), parallel edges apart; a row has 2 ** PACK numbers at most to name."""
    end = lambda side: ids.select(F.col("id").alias(side), F.col("n").alias(f"_{side}")).hint("merge")
    w = edge_weight(F.col("type")).cast("float").alias("w")
    known = edges.where("source != target").select("source", "target", w).join(end("source"), "source").join(end("target"), "target")
    both = known.select(F.explode(F.array(F.struct(F.col("_target").alias("nbr"), F.col("_source").alias("n"), "w"), F.struct(F.col("_source").alias("nbr"), F.col("_target").alias("n"), "w"))).alias("x")).select("x.*")
    rows = both.groupBy("nbr", F.shiftright("n", PACK).alias("_part")).agg(F.collect_list(F.struct("n", "w")).alias("near"))
    return materialize(rows.select("nbr", "near"), "packed")


def _reach(packed: DataFrame, moved: DataFrame) -> int:
    """Nodes next to those that moved, some counted more than once."""
    who = moved.where("moved").select(F.col("n").alias("nbr"))
    return packed.select("nbr", F.size("near").alias("d")).join(who, "nbr", "left_semi").agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]


def _turn(turn: int) -> Column:
    """Whether a node may move in a round."""
    return F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0


def _frontier(labels: DataFrame, both: DataFrame, active: DataFrame, first: int, last: int, buckets: int) -> DataFrame:
    """The labels after the rounds from ``first`` on, in which only active nodes vote: any other would vote as before.

    Active are the neighbours of those that moved, and those that want to and may not
    yet.  Only the buckets that hold them are read of the edges, only their
    neighbours' buckets of the labels; what moves is kept beside the labels.
    """
    base = materialize(labels.withColumn("bucket", bucket_of("id", buckets)).repartition(buckets, "bucket"), "labels", ("bucket",))
    moves: DataFrame | None = None

    def current(wanted: DataFrame) -> DataFrame:
        found = _within(base, wanted, buckets).select("id", "label")
        return found if moves is None else found.join(moves.select("id", F.col("label").alias("_l")), "id", "left").select("id", F.coalesce("_l", "label").alias("label"))

    for turn in range(first, last):
        links = materialize(_within(both, active, buckets).select("id", "nbr", "w"), "links")
        near = current(links.select(F.col("nbr").alias("id")).unionByName(active).distinct())
        votes = links.join(near.select(F.col("id").alias("nbr"), "label"), "nbr").groupBy("id", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("id").agg(F.max(F.struct("w", "label")).alias("m")).select("id", F.col("m.label").alias("wish"))
        ballot = materialize(near.join(best, "id").where("wish != label").select("id", "wish", _turn(turn).alias("moves")), "ballot")
        drop_scratch(links)
        drop_scratch(active)
        wanting = ballot.count()
        logger.info("round %d: %d nodes want to move", turn, wanting)
        if not wanting:
            break
        moved = ballot.where("moves").select("id", F.col("wish").alias("label"))
        before = moves
        moves = materialize(moved if before is None else before.join(moved.select("id"), "id", "left_anti").unionByName(moved), "moves")
        if before is not None:
            drop_scratch(before)
        reached = _within(both, moved.select("id"), buckets).select(F.col("nbr").alias("id"))
        active = materialize(reached.unionByName(ballot.where("not moves").select("id")).distinct(), "active")
        drop_scratch(ballot)
    else:
        logger.warning("label propagation ended after %d rounds, %d nodes want to move", last, wanting)
    if moves is None:
        return base.select("id", "label")
    return base.join(moves.select("id", F.col("label").alias("_l")), "id", "left").select("id", F.coalesce("_l", "label").alias("label"))


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """``df`` with numbers from 0 in the order of a column: counted within ranges, shifted by the ranges before."""
    ranged = materialize(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    shift = ranged.groupBy("_p").count().select(F.col("_p").alias("_q"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return ranged.withColumn("_r", local).join(shift, F.col("_p") == F.col("_q")).withColumn(out, F.col("_s") + F.col("_r")).drop("_p", "_q", "_s", "_r")


def compact(labels: DataFrame) -> DataFrame:
    """(id, community): labels below 2^32 stay, new ones count on from the largest of those."""
    kept = labels.where(F.col("label") < 1 << 32).agg(F.coalesce(F.max("label") + 1, F.lit(0)).alias("next"))
    fresh = labels.where(F.col("label") >= 1 << 32).groupBy("label").agg(F.min("id").alias("first"))
    named = numbered(fresh, "first", "n").crossJoin(F.broadcast(kept)).select("label", (F.col("next") + F.col("n")).cast("int").alias("number"))
    return labels.join(named, "label", "left").select("id", F.coalesce("number", F.col("label").cast("int")).alias("community"))
