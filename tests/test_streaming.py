"""Event coalescing in batch and as streams, tails and change application."""

import uuid

from pyspark.sql import functions as F

from weftline.schemas import FILE_EVENTS
from weftline.streaming import events as ev
from weftline.streaming import sync

CASES = [
    (0, "create", "a.rs", None), (1, "modify", "a.rs", None),
    (2, "remove", "b.rs", None), (3, "create", "b.rs", None),
    (4, "create", "c.rs", None), (5, "remove", "c.rs", None),
    (6, "modify", "d.rs", None), (7, "rename_both", "d.rs", "e.rs"), (8, "modify", "e.rs", None),
    (9, "rename_from", "f.rs", None), (10, "rename_to", "g.rs", None),
    (11, "modify", "target/x.rs", None), (12, "modify", "y.png", None), (13, "access", "z.rs", None),
]
WANT = {("a.rs", "Created", None), ("b.rs", "Modified", None), ("e.rs", "Renamed", "d.rs"), ("f.rs", "Deleted", None), ("g.rs", "Created", None)}


def frame(spark):
    rows = spark.createDataFrame(CASES, "seq long, kind string, path string, new_path string")
    return rows.select(F.lit("ws").alias("workspace"), "seq", (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("seq") / 100)).alias("ts"), "kind", "path", "new_path")


def run(df, mode):
    name = f"t_{uuid.uuid4().hex[:8]}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_batch(spark):
    got = {(r["file_path"], r["kind"], r["old_path"]) for r in ev.coalesce_events(frame(spark)).collect()}
    assert got == WANT
    assert {(r["file_path"], r["kind"], r["old_path"]) for r in ev.windowed(frame(spark)).collect()} == WANT


def test_streams_agree(spark, tmp_path):
    frame(spark).coalesce(1).write.parquet(str(tmp_path / "e"))
    late = frame(spark).limit(1).withColumn("ts", F.col("ts") + F.expr("interval 1 hour")).withColumn("path", F.lit("later.rs"))
    late.write.mode("append").parquet(str(tmp_path / "e"))
    source = lambda: spark.readStream.schema(FILE_EVENTS).parquet(str(tmp_path / "e"))
    done = {(r["file_path"], r["kind"], r["old_path"]) for r in run(ev.windowed(source()), "append").collect()}
    assert done == WANT
    state = {r["file_path"]: (r["kind"], r["old_path"]) for r in run(ev.stateful(source()), "update").collect()}
    assert {(p, *s) for p, s in state.items() if s[0] and p != "later.rs"} == WANT


def test_tail_and_latest(spark):
    s = spark.createDataFrame([("s", 0, "USER_INPUT", "DONE", "x", 1), ("s", 1, "PLANNER_RESPONSE", "RUNNING", "y", 2), ("s", 1, "PLANNER_RESPONSE", "DONE", "z", 3), ("s", 2, "HIDDEN", "DONE", "h", 4)], "session_id string, step_index int, type string, status string, content string, arrival int")
    assert {r["content"] for r in sync.tail(s, 0).collect()} == {"y", "z"}
    assert {(r["step_index"], r["content"]) for r in sync.latest(s).collect()} == {(0, "x"), (1, "z"), (2, "h")}


def test_apply(spark):
    nodes = spark.createDataFrame([("1", "w", "a.rs", 4), ("2", "w", "b.rs", 5), ("3", "w", "c.rs", 6)], "id string, workspace string, file_path string, community int")
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1")], "source string, target string")
    deltas = spark.createDataFrame([("w", "a.rs", "Modified", None), ("w", "b.rs", "Deleted", None), ("w", "d.rs", "Renamed", "c.rs")], "workspace string, file_path string, kind string, old_path string")
    fresh = spark.createDataFrame([("9", "w", "a.rs")], "id string, workspace string, file_path string")
    n, e = sync.apply_changes(nodes, edges, deltas, fresh, edges.limit(0))
    assert {(r["id"], r["file_path"], r["community"]) for r in n.collect()} == {("3", "d.rs", 6), ("9", "a.rs", 4)}
    assert e.count() == 0


def test_status(spark):
    d = spark.createDataFrame([("w", "Deleted", 5)] + [("w", "Modified", 10)] * 9, "workspace string, kind string, duration_ms int")
    assert tuple(ev.status(d).first()) == ("w", 10, 9, 1, 9, True)
