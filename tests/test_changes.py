"""Changes in proportion: bucket rewrites, merged rollups, project matching by keys."""

import datetime
import os
import random

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline import session
from weftline.operators import rollups, sessions, store
from weftline.operators.buckets import BucketTable, GraphTables
from weftline.operators.substrings import holding
from weftline.plans import catalog


def times(path):
    return {os.path.join(top, n): os.stat(os.path.join(top, n)).st_mtime_ns for top, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_an_upsert_rewrites_its_buckets(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.lit(1).alias("n"))
    kept = BucketTable(spark, str(tmp_path / "t"), ("k",), 32).create(rows)
    new = spark.createDataFrame([(7, None, 9), (1000, "w", 2)], "k long, v string, n int")
    before = times(tmp_path / "t")
    touched = kept.upsert(new)
    after = times(tmp_path / "t")
    changed = {os.path.basename(os.path.dirname(p)) for p in before.keys() ^ after.keys() | {p for p in before.keys() & after.keys() if before[p] != after[p]}}
    assert changed == {f"bucket={b}" for b in touched} and len(touched) <= 2
    assert sorted(kept.read().collect()) == sorted(store.upsert(rows, new, ["k"]).collect())
    assert BucketTable(spark, str(tmp_path / "t"), ("k",), 32).read().count() == 501
    kept.delete(rows.select("k"))
    assert [tuple(r) for r in kept.read().collect()] == [(1000, "w", 2)]
    kept.delete(kept.read().select("k"))
    assert kept.read().count() == 0


def test_one_file_rewrites_its_buckets(spark, tmp_path):
    """Against whole tables on random graphs; buckets that the file and its neighbours don't have stay as they are."""
    r = random.Random(6)
    files = [f"f{i}.rs" for i in range(40)]
    nodes = [(f"w:{f}:s{k}", "w", f, f"s{k}") for f in files for k in range(3)]
    ids = [n[0] for n in nodes]
    edges = [(r.choice(ids[:60]), r.choice(ids[:60]), r.choice(["CALLS", "IMPORTS"])) for _ in range(80)] + [("w:f0.rs:s0", "lost", "CALLS")]
    n_df, e_df = spark.createDataFrame(nodes, "id string, workspace string, file_path string, label string"), spark.createDataFrame(edges, "source string, target string, type string")
    graph = GraphTables(spark, str(tmp_path / "g"), 64).create(n_df, e_df)
    new_nodes = [("w:f3.rs:s0", "w", "f3.rs", "s0"), ("w:f3.rs:new", "w", "f3.rs", "new"), ("w:g.rs:x", "w", "g.rs", "x")]
    new_edges = [("w:f3.rs:new", "w:f5.rs:s1", "CALLS"), ("w:f3.rs:s0", "w:f3.rs:new", "CALLS"), ("w:g.rs:x", "nowhere", "CALLS")]
    before = times(tmp_path / "g")
    done = graph.replace_files(spark.createDataFrame([("w", "f3.rs"), ("w", "g.rs")], "workspace string, file_path string"), spark.createDataFrame(new_nodes, n_df.schema), spark.createDataFrame(new_edges, e_df.schema))
    want_nodes = [n for n in nodes if n[2] != "f3.rs"] + new_nodes
    gone, there = {n[0] for n in nodes if n[2] == "f3.rs"}, {n[0] for n in want_nodes}
    want_edges = [e for e in edges if not {e[0], e[1]} & gone and e[1] != "lost"] + [e for e in new_edges if e[1] in there]
    assert sorted(map(tuple, graph.nodes.read().collect())) == sorted(want_nodes)
    assert sorted(map(tuple, graph.edges().collect())) == sorted(want_edges)
    assert sorted(map(tuple, graph.into.read().select("source", "target", "type").collect())) == sorted(want_edges)
    after = times(tmp_path / "g")
    changed = {tuple(os.path.relpath(p, tmp_path / "g").split("/")[:2]) for p in before.keys() ^ after.keys()}
    assert changed <= {(t, f"bucket={b}") for t, held in done.items() for b in held}
    assert len(done["nodes"]) <= 2 and len(done["out"]) < 20 > len(done["into"])


STEPS = "file string, session_id string, step_index int, source string, type string, status string, content string, created_at timestamp, tool_calls array<struct<name:string,args:string>>"


def random_steps(r, files):
    out = []
    for f in files:
        for i in range(r.randrange(1, 12)):
            user = r.random() < 0.4
            tools = [(r.choice("abc"), "{}") for _ in range(r.randrange(3))] if not user else None
            when = datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=r.randrange(999)) if r.random() < 0.9 else None
            out.append((f, f"s{int(f[1:]) % 5}", i + 100 * int(f[1:]), "USER_EXPLICIT" if user else "MODEL", "USER_INPUT" if user else r.choice(["PLANNER_RESPONSE", "ERROR_MESSAGE"]), r.choice(["DONE", "ERROR"]), f"text {r.random()}", when, tools))
    return out


def test_rollups_merge_to_the_whole(spark):
    """Sessions over several files; files that changed, are new and are lost."""
    r = random.Random(9)
    whole = {f: random_steps(r, [f]) for f in [f"f{i}" for i in range(14)]}
    old = {f: rows[: max(1, len(rows) // 2)] if f in ("f3", "f4") else rows for f, rows in whole.items() if f != "f13"}
    listing = [f for f in whole if f not in ("f0", "f7")]
    frame = lambda held: spark.createDataFrame([x for rows in held.values() for x in rows], STEPS)
    fresh = rollups.partials(frame({f: whole[f] for f in ("f3", "f4", "f13")}))
    parts = rollups.replaced(rollups.partials(frame(old)), fresh, spark.createDataFrame([(f,) for f in listing], "file string"))
    want = sessions.rollup(frame({f: whole[f] for f in listing}))
    got = rollups.merged(parts)
    assert got.columns == want.columns
    plain = lambda df: sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in row) for row in df.collect()), key=lambda x: x[0])
    assert plain(got) == plain(want)
    present = frame({f: whole[f] for f in listing})
    assert sorted(sessions.top_tools(rollups.tool_counts(parts)).collect()) == sorted(sessions.top_tools(sessions.tool_counts(present.where("type = 'PLANNER_RESPONSE'"))).collect())
    assert rollups.totals(parts).collect() == sessions.totals(want).collect()


def test_texts_that_hold_strings(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab/ü") for _ in range(n))
    texts, needles = [word(r.randrange(30)) for _ in range(80)] + [None, ""], [word(r.randrange(7)) for _ in range(60)] + [None, "", "zzz"]
    got = holding(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(x,) for x in needles], "needle string"))
    want = {(t, x) for t in texts for x in needles if t is not None and x is not None and x in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def pairwise_scores(steps, known):
    """The same scores by a nested loop over all known projects."""
    prompts = steps.where((F.col("type") == "USER_INPUT") & (F.col("source") == "USER_EXPLICIT"))
    mention = prompts.join(known, F.contains(F.lower("content"), F.lower("name"))).select("session_id", F.col("name").alias("project"), F.lit(10).alias("score"))
    stated = prompts.select("session_id", T.project_name(T.workspace_of(F.col("content"))).alias("project"), F.lit(15).alias("score")).where("project != 'Default'")
    args = ("Cwd", "DirectoryPath", "SearchPath", "TargetFile", "AbsolutePath", "TargetDirectory")
    calls = steps.where("type = 'PLANNER_RESPONSE'").select("session_id", F.explode("tool_calls").alias("c"))
    paths = calls.select("session_id", F.explode(F.array(*[F.get_json_object("c.args", f"$.{a}") for a in args])).alias("p")).where("p rlike '^[/~]'")
    inside = F.contains("p", F.concat(F.lit("/"), F.col("name"), F.lit("/"))) | F.endswith("p", F.concat(F.lit("/"), F.col("name"))) | F.contains("p", F.col("path"))
    tested = paths.join(known, inside, "left")
    hit = tested.where("name is not null").select("session_id", F.col("name").alias("project"), F.lit(20).alias("score"))
    other = tested.where("name is null").select("session_id", T.project_name(F.col("p")).alias("project"), F.when(F.col("p").rlike("/(" + "|".join(T.PROJECT_PARENTS) + ")/"), 25).otherwise(15).alias("score")).where("project != 'Default'")
    votes = mention.unionByName(stated).unionByName(hit).unionByName(other)
    return votes.where(T.valid_workspace(F.col("project"))).groupBy("session_id", "project").agg(F.sum("score").alias("score"))


def test_many_known_projects(spark):
    """100,000 of them, long and short, alike in their beginnings, some twice."""
    r = random.Random(1)
    names = [f"Proj{i}" for i in range(99_990)] + ["Ap", "Z", "Über", "proj77", "Twice", "Twice", "With Blank", "Sub/Dir"]
    known = spark.createDataFrame([(n, f"/home/u/{n.lower()}") for n in names], "name string, path string")
    said = ["look at PROJ123 and über", "nothing here", "ap in map, with blank", "Active Workspaces:\n- /home/Meta", "twice", None]
    where = ["/home/u/proj55/x.rs", "/x/Proj7", "/x/Proj7/y", "~/q/Sub/Dir/z", "/home/u/twice", "/elsewhere/knowledge/Deep/a", "relative/Proj9", "/home/u/proj99989"]
    rows = [(f"s{i}", i, "USER_INPUT", "USER_EXPLICIT", r.choice(said), None) for i in range(12)]
    rows += [(f"s{i % 12}", 100 + i, "PLANNER_RESPONSE", "MODEL", "", [("view", '{"Cwd": "%s", "TargetFile": "%s"}' % (r.choice(where), r.choice(where)))]) for i in range(30)]
    steps = spark.createDataFrame(rows, "session_id string, step_index int, type string, source string, content string, tool_calls array<struct<name:string,args:string>>")
    got = sessions.project_scores(steps, known)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairwise_scores(steps, known).collect())) and got.count() > 20


def test_steps_are_read_by_all_cores(spark, monkeypatch):
    """Steps made by a join of small tables are one task's rows; prompts and paths are dealt before costly work, and written once."""
    made, own = [], sessions.materialize
    monkeypatch.setattr(sessions, "materialize", lambda df, tag: made.append((tag, own(df, tag))) or made[-1][1])
    catalog.queries()["project_scores"](spark, "/root/testdata/sf0.1")
    assert {tag: len(df.inputFiles()) for tag, df in made} == dict.fromkeys(("prompts", "paths"), spark.sparkContext.defaultParallelism)


def test_buckets_of_many_rows_are_dealt(spark, tmp_path, monkeypatch):
    """All rows of one key are written by several tasks, at first and again; an upsert finds them all."""
    monkeypatch.setattr(session, "DEALT", 20)
    rows = spark.range(300).select(F.lit("one").alias("k"), F.col("id").alias("n"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    kept = BucketTable(spark, str(tmp_path / "t"), ("k",), 4).create(rows)
    sizes = lambda: [r["count"] for r in kept.read().groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes()) == 300 and max(sizes()) <= 100
    kept.rewrite(kept.touched(rows.select("k")), lambda old: old.where("n > 9"))
    assert sum(sizes()) == 290 and max(sizes()) <= 100
    assert sorted(r["n"] for r in kept.read().collect()) == list(range(10, 300))
