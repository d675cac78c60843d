"""Indexes against the scans that they stand for, and what they read."""

import random

import pytest
from pyspark.sql import functions as F
from scans import final_plan, scanned

from weftline import session
from weftline.indexes.adjacency import Adjacency
from weftline.indexes.grams import query_grams
from weftline.indexes.search import SearchIndex
from weftline.indexes.symbols import SymbolIndex
from weftline.operators import graph, sessions

STEP = "session_id string, step_index int, source string, type string, content string, created_at timestamp"


def steps(r, start, n):
    import datetime

    out = []
    for i in range(start, start + n):
        text = "".join(r.choice("abcdeXÉ .") for _ in range(r.randrange(0, 60)))
        kind = r.choice(["USER_INPUT", "PLANNER_RESPONSE", "ERROR_MESSAGE"])
        text = f"<USER_REQUEST>{text}</USER_REQUEST> hidden" if kind == "USER_INPUT" and r.random() < 0.5 else text
        when = None if r.random() < 0.1 else datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=r.randrange(500))
        out.append((f"s{i % 7}", i, "USER_EXPLICIT" if kind == "USER_INPUT" else "MODEL", kind, text if r.random() < 0.97 else None, when))
    return out


def test_search_equals_the_scan(spark, tmp_path):
    """Random texts in two appends, queries of any length and case, by kinds."""
    r = random.Random(4)
    first, more = steps(r, 0, 300), steps(r, 300, 200)
    index = SearchIndex(spark, str(tmp_path / "i")).append(spark.createDataFrame(first, STEP)).append(spark.createDataFrame(more, STEP))
    table = spark.createDataFrame(first + more, STEP)
    texts = [x[4] for x in first + more if x[4]]
    queries = ["hid", "", "zzz", "É"] + [t[k : k + m].swapcase() for t, k, m in ((r.choice(texts), r.randrange(20), r.randrange(1, 8)) for _ in range(12))]
    for i, q in enumerate(queries):
        kind = ["", "user", "errors"][i % 3]
        assert index.search(q, kind, 50).collect() == sessions.search(table, q, kind, 50).collect(), q


def test_search_reads_a_part(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"), F.lit(0).alias("step_index"), F.lit("MODEL").alias("source"), F.lit("PLANNER_RESPONSE").alias("type"), F.sha2(F.col("id").cast("string"), 256).alias("content"), F.lit(None).cast("timestamp").alias("created_at"))
    index = SearchIndex(spark, str(tmp_path / "i")).append(rows)
    wanted = rows.where("session_id = 's77'").first()["content"]
    files, read, got = scanned(index.matching(wanted[10:40]))
    assert [r["session_id"] for r in got] == ["s77"] and files < scanned(index.texts())[0] / 3 and read < 4000 * 62 / 8
    assert len(query_grams("ab")) == 0 and query_grams("abab") == ["aba", "bab"]


NODES = "id string, workspace string, label string, kind string, file_path string"


def labels(r, n):
    part = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
    out = [(f"n{i}", r.choice(["w", "v"]), r.choice(["::", "."]).join(part() for _ in range(r.randrange(1, 4))), r.choice(["function", "import"]), "f") for i in range(n)]
    return [*out, ("x1", "w", "", "function", "f"), ("x2", "w", "::a", "function", "f"), ("x3", "w", "a::", "function", "f"), ("x4", "v", "abcd", "import", "f")]


def test_symbols_equal_the_scan(spark, tmp_path):
    r = random.Random(8)
    nodes = spark.createDataFrame(labels(r, 400), NODES)
    index = SymbolIndex(spark, str(tmp_path / "s")).build(nodes)
    names = ["a", "ab", "abc", "abcd", "a::b", "b.c", "zzz", "zz", ""] + [r.choice(labels(r, 50))[2] for _ in range(8)]
    for i, name in enumerate(names):
        assert sorted(index.suffix(name).select("id").collect()) == sorted(graph.suffix_matches(nodes, name).select("id").collect()), name
        ws = [None, "w"][i % 2]
        assert index.find(name, ws).select("id").collect() == graph.find_symbols(nodes, name, ws).select("id").collect(), name
    got = {(r["id"], r["name"]) for r in index.prefix("ab").collect()}
    assert got == {(r["id"], r["name"]) for r in index.ends().where(F.startswith("name", F.lit("ab"))).collect()} and got


def test_symbols_read_a_part(spark, tmp_path):
    nodes = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("w").alias("workspace"), F.concat(F.lit("mod::"), F.sha2(F.col("id").cast("string"), 256)).alias("label"), F.lit("function").alias("kind"), F.lit("f").alias("file_path"))
    index = SymbolIndex(spark, str(tmp_path / "s")).build(nodes)
    name = nodes.where("id = '5'").first()["label"][5:]
    _, rows, got = scanned(index.suffix(name))
    assert [r["id"] for r in got] == ["5"] and rows < 40_000 / 10
    assert [r["id"] for r in index.find(name[10:40]).collect()] == ["5"]


@pytest.fixture(scope="module")
def links(spark):
    r = random.Random(2)
    rows = [(f"n{r.randrange(300)}", f"n{r.randrange(300)}", r.choice(["CALLS", "IMPORTS"])) for _ in range(350)]
    return spark.createDataFrame(rows + [("n0", f"n{i}", "CALLS") for i in range(200, 240)], "source string, target string, type string")


def test_hops_equal_the_joins(spark, tmp_path, links):
    index = Adjacency(spark, str(tmp_path / "a"), 16).build(links)
    for seeds in (["n0"], ["n5", "n7"], ["none"], []):
        df = spark.createDataFrame([(s,) for s in seeds], "id string")
        assert sorted(index.neighbours(df).collect()) == sorted(graph.neighbours(links, df).collect())
        for hops in (0, 1, 3):
            assert sorted(index.k_hop(df, hops).collect()) == sorted(graph.k_hop(links, df, hops).collect())
    nodes = spark.createDataFrame([(f"n{i}", f"label{i}", "f") for i in range(300)], "id string, label string, file_path string")
    got = index.references(spark.createDataFrame([("n210",)], "id string"), nodes)
    assert sorted(got.collect()) == sorted(graph.references(nodes, links, "label210").collect()) and got.count()


def test_hops_shuffle_no_edge(spark, tmp_path, links):
    index = Adjacency(spark, str(tmp_path / "a"), 16).build(links)
    seeds = spark.createDataFrame([("n0",)], "id string")
    out = index.touching(seeds, "out")
    files, rows, got = scanned(out)
    assert len(got) >= 40 and files == 1 and rows < links.count()
    plan = final_plan(index.touching(seeds, "into"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan


def test_a_hub_is_dealt_over_several_files(spark, tmp_path, links, monkeypatch):
    """Rows that a task writes follow neither the table nor a node's edges; hops are the same."""
    monkeypatch.setattr(session, "DEALT", 20)
    index = Adjacency(spark, str(tmp_path / "a"), 2).build(links)
    for side in ("out", "into"):
        sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/a/{side}").groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == links.count() and max(sizes) <= 80, sizes
    df = spark.createDataFrame([("n0",)], "id string")
    assert sorted(index.neighbours(df).collect()) == sorted(graph.neighbours(links, df).collect())
