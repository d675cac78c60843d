"""Label propagation: colour by colour against one node after the other, and by active nodes against all of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from scans import scanned

from weftline.operators import block_lpa, coloured_lpa, graph
from weftline.operators.graph import EDGE_WEIGHTS


def random_graph(spark, seed, n=60, m=150):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(n)]
    links = [(r.choice(names), r.choice(names), r.choice(["CALLS", "IMPORTS", "IMPLEMENTS"])) for _ in range(m)]
    links += [(names[0], x, "CALLS") for x in names[1:25]]  # a hub
    nodes = spark.createDataFrame([(x, "w", None) for x in [*names, "alone"]], "id string, workspace string, community int")
    return nodes, spark.createDataFrame(links, "source string, target string, type string"), [*names, "alone"], links


def weights(links):
    w = {}
    for a, b, t in links:
        if a != b:
            for x, y in ((a, b), (b, a)):
                w.setdefault(x, {}).setdefault(y, 0.0)
                w[x][y] += EDGE_WEIGHTS.get(t, 1.0)
    return w


def classes(found):
    out = {}
    for i, c in found.items():
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_colours_and_the_sequential_run(spark, seed):
    """Neighbours differ in colour; a round is what moving nodes singly by colour gives, in any order within a colour."""
    nodes, edges, names, links = random_graph(spark, seed)
    w = weights(links)
    both = graph.adjacency(edges, 16)
    colour = {r["id"]: r["colour"] for r in coloured_lpa.colours(nodes, both).collect()}
    assert set(colour) == set(names) and all(colour[a] != colour[b] for a in w for b in w[a])
    start = {r["id"]: r["l"] for r in nodes.select("id", (F.abs(F.xxhash64("id")) + F.lit(1 << 32)).alias("l")).collect()}
    labels, r = dict(start), random.Random(seed)
    for _ in range(15):
        before = dict(labels)
        order = sorted(names, key=lambda x: (colour[x], r.random()))
        for x in order:
            votes = {}
            for y, k in w.get(x, {}).items():
                votes[labels[y]] = votes.get(labels[y], 0.0) + k
            if votes:
                labels[x] = max((k, c) for c, k in votes.items())[1]
        if labels == before:
            break
    got = {r["id"]: r["community"] for r in coloured_lpa.communities(nodes, edges).collect()}
    assert classes(got) == classes(labels)


def test_active_nodes_give_what_all_give(spark):
    """From communities at rest on, after a change: voting by those whose neighbourhood changed is the whole vote."""
    nodes, edges, names, links = random_graph(spark, 7, 80, 120)
    rest = graph.label_propagation(nodes, edges).withColumn("community", F.col("community").cast("int"))
    rest = spark.createDataFrame(rest.collect(), rest.schema)
    fresh = [("n3", "n70", "IMPLEMENTS"), ("n3", "n71", "IMPLEMENTS"), ("new", "n5", "CALLS")]
    more = edges.unionByName(spark.createDataFrame(fresh, edges.schema))
    grown = nodes.unionByName(spark.createDataFrame([("new", "w", None)], nodes.schema))
    whole = {r["id"]: r["community"] for r in graph.label_propagation(grown, more, seeds=rest).collect()}
    changed = spark.createDataFrame([(x,) for x in ("n3", "n70", "n71", "n5", "new")], "id string")
    part = {r["id"]: r["community"] for r in graph.label_propagation(grown, more, seeds=rest, changed=changed).collect()}
    assert part == whole


def test_rows_read_follow_the_change(spark, monkeypatch):
    """A chain of 4,000 pairs and one new edge: few buckets of the edges are opened, whatever the graph's size."""
    n = 4000
    nodes = spark.range(2 * n).select(F.col("id").cast("string").alias("id"), F.lit("w").alias("workspace"))
    edges = spark.range(n).select((F.col("id") * 2).cast("string").alias("source"), (F.col("id") * 2 + 1).cast("string").alias("target"), F.lit("CALLS").alias("type"))
    seeds = nodes.select("id", F.floor(F.col("id").cast("long") / 2).cast("int").alias("community"))
    asked, within = [], graph._within
    monkeypatch.setattr(graph, "_within", lambda table, ids, buckets: asked.append((ids.count(), buckets)) or within(table, ids, buckets))
    changed = spark.createDataFrame([("10",), ("11",)], "id string")
    found = graph.label_propagation(nodes, edges, seeds=seeds, changed=changed)
    assert found.join(seeds.withColumnRenamed("community", "c"), "id").where("c <> community").count() == 0
    assert asked and all(count <= 4 for count, _ in asked)
    both = graph.adjacency(edges, 16)
    files, rows, _ = scanned(within(both, spark.createDataFrame([("10",), ("11",)], "id string"), 16))
    assert files <= 2 and rows < 2 * n / 4 and scanned(both)[0] >= 8


def test_empty_graphs(spark):
    nodes = spark.createDataFrame([], "id string, workspace string, community int")
    edges = spark.createDataFrame([], "source string, target string, type string")
    assert coloured_lpa.communities(nodes, edges).count() == 0 and graph.label_propagation(nodes, edges).count() == 0
    one = spark.createDataFrame([("a", "w", None), ("b", "w", 3)], nodes.schema)
    got = {r["id"]: r["community"] for r in coloured_lpa.communities(one, edges, seeded=True).collect()}
    assert got["b"] == 3 and got["a"] not in (None, 3)


def test_packed_neighbourhoods_name_every_link_once(spark, monkeypatch):
    """Parallel edges count, loops and unknown ends don't; a hub's neighbours are divided over rows."""
    monkeypatch.setattr(graph, "PACK", 2)
    ids = spark.range(20).select(F.col("id").cast("string").alias("id"), F.col("id").cast("int").alias("n"))
    ends = [("0", str(i)) for i in range(1, 20)] + [("0", "1"), ("2", "2"), ("3", "gone")]
    packed = graph._packed(ids, spark.createDataFrame([(*e, "CALLS") for e in ends], "source string, target string, type string"))
    rows = packed.collect()
    assert max(len(r["near"]) for r in rows) <= 5 and sum(r["nbr"] == 0 for r in rows) == 5
    assert sorted((r["nbr"], x["n"], x["w"]) for r in rows for x in r["near"]) == sorted((a, b, 2.0) for s, t in ends[:20] for a, b in ((int(s), int(t)), (int(t), int(s))))


def test_colours_vote_by_number_and_only_when_due(spark, monkeypatch):
    """Pairs of linked nodes: the first colour moves once, then nobody is next to a node that moved; votes name numbers, not ids."""
    made, rows, own = [], {}, coloured_lpa.materialize

    def written(df, tag, *by):
        made.append(tag)
        out = own(df, tag, *by)
        rows[tag] = out.collect()
        return out

    monkeypatch.setattr(coloured_lpa, "materialize", written)
    nodes = spark.createDataFrame([(f"n{i}", "w", None) for i in range(8)], "id string, workspace string, community int")
    edges = spark.createDataFrame([(f"n{i + back}", f"n{i + 1 - back}", "CALLS") for i in range(0, 8, 2) for back in (0, 1)], "source string, target string, type string")
    found = {r["id"]: r["community"] for r in coloured_lpa.communities(nodes, edges).collect()}
    assert classes(found) == [[f"n{i}", f"n{i + 1}"] for i in range(0, 8, 2)]
    assert made.count("labels") == 4
    assert sorted((r["nbr"], x["n"], x["w"]) for r in rows["packed"] for x in r["near"]) == [(n, n ^ 1, 4.0) for n in range(8)]


def test_blocks_move_as_rows_do(spark, monkeypatch):
    """Over several blocks, with parallel edges, loops and unknown ends; by rows go nodes too large for a block and ids of one hash."""
    nodes, edges, names, links = random_graph(spark, 5)
    edges = edges.unionByName(spark.createDataFrame([("n1", "gone", "CALLS"), ("lost", "gone", None), (None, "n2", "CALLS"), ("n3", "n3", "CALLS")], edges.schema))
    turns = nodes.select(F.xxhash64("id").alias("k"), *[graph._turn(t).alias(str(t)) for t in (0, 1, 59)]).toPandas()
    assert all((block_lpa.may_move(turns["k"].to_numpy(), t) == turns[str(t)]).all() for t in (0, 1, 59))
    begun = spark.createDataFrame(nodes.select("id", (F.abs(F.xxhash64("id")) + F.lit(1 << 32)).alias("label")).collect())
    weighed = edges.select("source", "target", graph.edge_weight(F.col("type")).alias("w"))
    monkeypatch.setattr(block_lpa, "FEWEST", 100)
    by_blocks = lambda df: block_lpa.propagate(df, weighed, [1.0, *EDGE_WEIGHTS.values()], 3, 4)
    assert block_lpa._blocks(weighed.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b")), 4) == 4
    assert sorted(map(tuple, by_blocks(begun).collect())) == sorted(map(tuple, graph._by_rows(begun, edges, 3, 4).collect()))
    assert by_blocks(begun.unionByName(begun.limit(1))) is None
    monkeypatch.setattr(block_lpa, "VOTES", 2)
    monkeypatch.setattr(block_lpa, "CLASSES", 16)
    assert by_blocks(begun) is None


def test_rounds_send_no_votes(spark, monkeypatch):
    """A block asks for a neighbour's label once, however many of its nodes vote on it; no vote is a row of a round."""
    rows, own = {}, block_lpa.materialize

    def written(df, tag, *by):
        out = own(df, tag, *by)
        rows.setdefault(tag, out.collect())
        return out

    monkeypatch.setattr(block_lpa, "materialize", written)
    nodes = spark.createDataFrame([(f"n{i}", "w", None) for i in range(31)], "id string, workspace string, community int")
    edges = spark.createDataFrame([("n0", f"n{i}", "CALLS") for i in range(1, 31)], "source string, target string, type string")
    found = graph.label_propagation(nodes, edges).collect()
    assert len(found) == 31 and len({r["community"] for r in found}) == 1
    assert len(rows["sent"]) == 2 and len(block_lpa._array(rows["held"][0]["route"], np.int32)) == 31
