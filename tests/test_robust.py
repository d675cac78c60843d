"""Inputs that are not as they should be, and bounds that are checked."""

import pytest

from pyspark.sql import functions as F
from weftline.operators import condense, indexing, parsing, sessions, telemetry, vectors
from weftline.sources import files, transcripts


def test_neighbours_among_null_and_ragged_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = vectors.batch_knn(df, df.where("id in (1, 3, 5)"), 5).collect()
    assert [(r["query"], r["neighbour"]) for r in got] == [(1, 2), (1, 7)]
    assert vectors.batch_knn(df, df.where("id = 3"), 5).count() == 0
    with pytest.raises(ValueError, match="components"):
        vectors.batch_knn(df, df.where("id in (1, 4)"), 5)


def test_code_too_deep_to_parse_is_chunked(spark):
    deep = "x = " + "(" * 5000 + ")" * 5000
    calls = "x = " + "f(" * 3000 + ")" * 3000
    f = spark.createDataFrame([("w", "a.py", deep), ("w", "b.py", calls), ("w", "c.py", "def ok():\n    pass\n")], "workspace string, file_path string, content string")
    nodes = parsing.parse(f)[0].select("file_path", "label").collect()
    assert {(r["file_path"], r["label"]) for r in nodes} == {("a.py", "a.py"), ("b.py", "b.py"), ("c.py", "ok")}


def test_long_blocks_are_whole():
    body = "".join(f"    let a{i} = \"}}\"; // {{\n" for i in range(600))
    out = parsing.parse_code("w", "a.rs", f"fn long() {{\n{body}}}\nfn next() {{}}\n", "rust")
    assert [(n[2], n[6], n[7]) for n in out.nodes] == [("long", 1, 602), ("next", 603, 603)]


def test_scripts_of_all_forms():
    text = "export default class A<T extends B<C>> extends Base<T> {\n  constructor() { super(); }\n  static async load(a, b = {}) { return await go(a); }\n  get x() { return 1; }\n}\nconst f = x => x + 1;\nlet s = 'class No { }';\n/* function no() {\n} */\ntype U = { a: string };\nenum E { A }\n"
    out = parsing.parse_code("w", "a.ts", text, "typescript")
    assert [(n[2], n[3], n[6], n[7]) for n in out.nodes] == [("A", "class", 1, 5), ("constructor", "method", 2, 2), ("load", "method", 3, 3), ("x", "method", 4, 4), ("f", "function", 6, 6), ("U", "type", 10, 10), ("E", "enum", 11, 11)]
    assert ("w", "w:a.ts:A:1", "Base", None, "EXTENDS", "EXTRACTED") in out.edges and ("w", "w:a.ts:load:3", "go", None, "CALLS", "EXTRACTED") in out.edges


def test_a_hub_is_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(condense, "LISTED", 3)
    nodes = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit("f").alias("label"), F.lit("k").alias("kind"), F.lit("p").alias("file_path"), F.lit("t").alias("text"))
    edges = spark.range(1, 10).select(F.col("id").cast("string").alias("source"), F.lit("0").alias("target"), F.lit("CALLS").alias("type"))
    row = condense.condense(nodes, edges, "0").first()
    assert (row["callers"], row["n_callers"], row["callees"], row["n_callees"]) == (["1", "2", "3"], 9, [], 0)


def test_a_tree_is_listed_without_its_noise(spark, tmp_path):
    for name in ("src/a.py", "node_modules/b.py", ".git/c.py", "src/.hidden/d.py", "src/e.png", "big.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * (files.MAX_BYTES + 1 if name == "big.txt" else 5))
    assert [p.rsplit("/", 1)[-1] for p in files.listed(spark, f"file://{tmp_path}")] == ["a.py"]
    assert [r["file_path"] for r in files.read_tree(spark, f"file://{tmp_path}", "w").collect()] == ["src/a.py"]
    (tmp_path / "none").mkdir()
    assert files.read_tree(spark, f"file://{tmp_path}/none", "w").count() == 0


def test_only_some_folders_may_be_browsed(spark):
    listing = spark.createDataFrame([("/w/a/x", True)], "path string, is_dir boolean")
    assert files.browse(listing, "/w/a", ["/w"]).count() == 1
    for folder in ("/etc", "/w/../etc", "/wx"):
        with pytest.raises(PermissionError):
            files.browse(listing, folder, ["/w"])


def test_locations_that_are_not_there(spark, tmp_path):
    (tmp_path / "a" / "s1").mkdir(parents=True)
    (tmp_path / "a" / "s1" / "transcript.jsonl").write_text('{"step_index": 0, "type": "USER_INPUT"}\n')
    here, gone = (f"file://{tmp_path}/a", "p", "ide"), (f"file://{tmp_path}/b", "p", "cli")
    assert transcripts.existing(spark, [gone, here, here]) == [here]
    assert transcripts.read_all(spark, [gone, here]).count() == 1
    with pytest.raises(FileNotFoundError):
        transcripts.read_all(spark, [gone])


def test_parents_before_worktrees_and_names_behind_roots(spark):
    roots = spark.createDataFrame([("main", "/w", False), ("tree", "/w/tree", True), ("Other", "/o", False)], "workspace string, root_path string, is_worktree boolean")
    paths = spark.createDataFrame([("/W/tree/a",), ("/o",), ("/x/other",), ("/x/none",)], "path string")
    assert {r["path"]: r["workspace"] for r in telemetry.attribute_paths(paths, roots).collect()} == {"/W/tree/a": "main", "/o": "Other", "/x/other": "Other", "/x/none": None}


def test_changed_files_are_indexed_again(spark):
    tree = lambda b: spark.createDataFrame([("w", "a.py", "def first():\n    second()\n"), ("w", "b.py", b)], "workspace string, file_path string, content string").withColumn("file_hash", F.sha2("content", 256))
    from weftline.operators import graph

    nodes, extracted = indexing.index(tree("def second():\n    return 1\n"), 8)
    edges = graph.resolve_edges(nodes, extracted)
    nodes = nodes.withColumn("community", F.lit(3))
    new, links = indexing.reindex(nodes, edges, tree("def second():\n    third()\n\ndef third():\n    pass\n"), 8)
    assert {(r["label"], r["community"]) for r in new.collect()} == {("first", 3), ("second", 3), ("third", 3)}
    assert {(r["source"].split(":")[2], r["target"].split(":")[2]) for r in links.collect()} == {("first", "second"), ("second", "third")}


def test_one_bad_text_spoils_no_other(spark):
    """A batch that fails is embedded text by text; only the bad one, and one of the wrong length, get zeros."""

    def run(texts):
        if "bad" in texts:
            raise ValueError(texts)
        return [[1.0] if t == "short" else [float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("aa",), ("bad",), ("bbb",), ("short",), (None,)], "text string").coalesce(1)
    got = {r["text"]: r["embedding"] for r in vectors.embed(df, dim=2, embedder=run).collect()}
    assert got == {"aa": [2.0, 1.0], "bad": [0.0, 0.0], "bbb": [3.0, 1.0], "short": [0.0, 0.0], None: [0.0, 1.0]}


def test_neighbours_are_compared_in_bounded_blocks(spark, monkeypatch):
    """No product of queries and vectors is larger than ROWS by ROWS; equal ones of several blocks are told apart by their ids."""
    import numpy as np

    class Seen(np.ndarray):
        def __matmul__(self, other):
            assert self.shape[0] <= 8 and other.shape[1] <= 8, "a block is too large"
            return np.asarray(self) @ np.asarray(other)

    monkeypatch.setattr(vectors, "ROWS", 8)
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, [float("nan"), 1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(2)
    held, sent = vectors.np.linalg.norm, []
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: sent.append(v) or type("B", (), {"value": (v[0], v[1].view(Seen), v[2])})())
    frames = []
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: frames.append(list(run(iter([self.toPandas()])))) or spark.createDataFrame([r for f in frames[-1] for r in f.itertuples(index=False)], schema))
    got = {(r["query"], r["rank"]): (r["neighbour"], r["similarity"]) for r in vectors.batch_knn(df, df.where("id % 2 = 0"), 5).collect()}
    unit = lambda v: np.array(v) / held(v)
    for q in range(0, 60, 2):
        want = sorted((-round(float(unit(rows[q][1]) @ unit(rows[n][1])), 9), n) for n in range(60) if n != q)[:5]
        assert [(-round(got[q, i + 1][1], 9), got[q, i + 1][0]) for i in range(5)] == want
    assert len(got) == 150
