"""Small graphs with known answers."""

from pyspark.sql import functions as F

from weftline.operators import condense, sequential_lpa, graph, rag, store, vectors

NODE = "id string, workspace string, label string, kind string, file_path string, language string, community int, text string"


def graph_of(spark, names, links, community=None):
    nodes = spark.createDataFrame([(n, "test", n, "function", f"src/{n}.rs", "rust", (community or {}).get(n), f"fn {n}()") for n in names], NODE)
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in links], "source string, target string, type string")
    return nodes, edges


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["community"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def test_hops(spark):
    _, edges = graph_of(spark, "", [("n2", "n1"), ("n1", "n3"), ("n3", "n4")])
    seed = spark.createDataFrame([("n1",)], "id string")
    assert {r["id"]: r["depth"] for r in graph.k_hop(edges, seed, 1).collect()} == {"n1": 0, "n2": 1, "n3": 1}
    assert {r["id"] for r in graph.k_hop(edges, seed, 2).collect()} == {"n1", "n2", "n3", "n4"}


def test_condense_stays_in_budget(spark):
    names = ["root"] + [f"n{i}" for i in range(20)]
    nodes, edges = graph_of(spark, names, [("root", n) for n in names[1:]])
    nodes = nodes.withColumn("text", F.repeat(F.lit("a long line of code\n"), 30))
    row = condense.condense(nodes, edges, "ROOT").first()
    assert row["tokens"] <= 1500 and len(row["markdown"].encode()) <= 6000
    assert "root CALLS n0" in row["markdown"] and row["callees"] == sorted(names[1:]) and row["callers"] == []


def test_communities(spark):
    for run in (lambda n, e: graph.label_propagation(n, e), sequential_lpa.communities):
        triangle = run(*graph_of(spark, "abc", [("a", "b"), ("b", "c"), ("a", "c")])).collect()
        assert groups(triangle) == [["a", "b", "c"]] and min(r["community"] for r in triangle) == 0
        assert groups(run(*graph_of(spark, "abxy", [("a", "b"), ("x", "y")])).collect()) == [["a", "b"], ["x", "y"]]
        assert len(groups(run(*graph_of(spark, "abc", [])).collect())) == 3


def test_seeds_keep_their_number(spark):
    nodes, edges = graph_of(spark, "abxy", [("a", "b"), ("x", "y")], {"a": 7, "b": 7})
    for rows in (sequential_lpa.communities(nodes, edges, seeded=True).collect(), graph.label_propagation(nodes, edges, seeds=nodes.select("id", "community")).collect()):
        by = {r["id"]: r["community"] for r in rows}
        assert by["a"] == by["b"] == 7 and by["x"] == by["y"] != 7


def test_coupling_without_edges(spark):
    nodes, edges = graph_of(spark, "ab", [], {"a": 0, "b": 1})
    rows = graph.coupling(nodes, edges).collect()
    assert [(r["instability"], r["role"]) for r in rows] == [(0.5, "Domain Service")] * 2


def test_sequential_mode_rests(spark):
    """The result is one where no node wants to move, whatever rows the edges come in; parallel edges add up."""
    import numpy as np

    rng = np.random.default_rng(1)
    a, b, w = rng.integers(0, 30, 80), rng.integers(0, 30, 80), rng.integers(1, 4, 80).astype(float)
    a, b, w = a[a != b], b[a != b], w[a != b]
    label = sequential_lpa.propagate(a, b, w, np.arange(30) + 100, 50)
    mixed = rng.permutation(len(a))
    assert (label == sequential_lpa.propagate(a[mixed], b[mixed], w[mixed], np.arange(30) + 100, 50)).all()
    votes = np.zeros((30, 200))
    np.add.at(votes, (a, label[b]), w)
    np.add.at(votes, (b, label[a]), w)
    for v in np.flatnonzero(votes.sum(1)):
        assert votes[v, label[v]] == votes[v].max()
    assert sequential_lpa.compact(np.array([7, sequential_lpa.FRESH + 5, 7, sequential_lpa.FRESH + 2])).tolist() == [7, 8, 7, 9]
    nodes, edges = graph_of(spark, "abcd", [("a", "b"), ("a", "b"), ("c", "b"), ("c", "d"), ("a", "zz")])
    assert sequential_lpa.communities(nodes, edges).count() == 4


def test_boundary(spark):
    nodes, edges = graph_of(spark, "tuvw", [("u", "t"), ("v", "t")], {"t": 0, "u": 0, "v": 1, "w": 1})
    row = graph.boundary(nodes, edges, "t").first()
    assert (row["internal_callers"], row["cross_callers"], row["status"], row["risk"]) == (1, 1, "BOUNDARY_CROSSING", "MEDIUM")
    assert graph.boundary(nodes, edges, "w").first()["status"] == "ISOLATED"


def test_unknown_symbol_gives_the_graph(spark):
    nodes, edges = graph_of(spark, "abc", [("a", "b")])
    assert graph.symbol_subgraph(nodes, edges, "nothing")[0].count() == 3
    assert {r["id"] for r in graph.symbol_subgraph(nodes, edges, "a")[0].collect()} == {"a", "b"}


def test_resolution_prefers_the_file(spark):
    nodes = spark.createDataFrame([("w:a.rs:f:1", "w", "f", "a.rs"), ("w:b.rs:f:9", "w", "f", "b.rs"), ("w:a.rs:T:3", "w", "T", "a.rs")], "id string, workspace string, label string, file_path string")
    extracted = spark.createDataFrame([("w", "w:b.rs:g:1", "f", None, "CALLS", "E"), ("w", "w:c.rs:g:1", "f", None, "CALLS", "E"), ("w", "w:a.rs:T", "f", None, "DECLARES", "E"), ("w", "w:a.rs:g:1", "gone", None, "CALLS", "E"), ("w", "w:a.rs:g:1", "x", "w:known", "CALLS", "E")], "workspace string, source_id string, target_label string, target_id string, edge_type string, category string")
    got = {(r["source"], r["target"]) for r in graph.resolve_edges(nodes, extracted).collect()}
    assert got == {("w:b.rs:g:1", "w:b.rs:f:9"), ("w:c.rs:g:1", "w:a.rs:f:1"), ("w:a.rs:T:3", "w:a.rs:f:1"), ("w:a.rs:g:1", "w:known")}


def test_store(spark):
    nodes, edges = graph_of(spark, "abc", [("a", "b"), ("b", "c"), ("a", "c")])
    n, e = store.delete_file(nodes, edges, "test", "src/b.rs")
    assert {r["id"] for r in n.collect()} == {"a", "c"} and [(r["source"], r["target"]) for r in e.collect()] == [("a", "c")]
    wanted = spark.createDataFrame([("test", "a", "pay-service", "CALLS", None), ("test", " ", "a", "CALLS", None)], "workspace string, source_symbol string, target_symbol string, type string, category string")
    n, e = store.add_relationships(nodes, edges.withColumn("workspace", F.lit("test")), wanted)
    assert "test:virtual:pay-service" in {r["id"] for r in n.collect()}
    assert ("a", "test:virtual:pay-service") in {(r["source"], r["target"]) for r in e.collect()}


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("z", [0.0, 0.0])], "id string, embedding array<float>")
    got = [(r["id"], round(r["similarity"], 5)) for r in vectors.top_k(v, [1.0, 0.0], 5).collect()]
    assert got == [("a", 1.0), ("b", 0.6)]
    embedded = vectors.embed(spark.createDataFrame([("hello world",), (None,)], "text string"), dim=16).collect()
    assert all(len(r["embedding"]) == 16 for r in embedded)
    failing = vectors.embed(spark.createDataFrame([("x",)], "text string"), dim=4, embedder=lambda t: 1 / 0).first()
    assert failing["embedding"] == [0.0] * 4


def test_retrieval(spark):
    nodes, edges = graph_of(spark, "abc", [("a", "b")], {"a": 0, "b": 0, "c": 1})
    nodes = nodes.withColumn("embedding", F.when(F.col("id") == "a", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>"))
    row = rag.graph_context(nodes, edges, [1.0, 0.0], k=1).first()
    assert row["seeds"] == 1 and row["symbols"] == 2 and "a CALLS b" in row["context"]
