"""Streams over real files: lines that files gain, events of a tree, timers, and a graph that follows its tree."""

import os
import random
import time
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from weftline.plans import catalog
from weftline.sources import live, transcripts
from weftline.streaming import events as ev
from weftline.streaming import timers, watch

SF = "/root/testdata/sf0.001"


def put(path, text, mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def standing(folder):
    """(file, at, line) of all whole lines below a folder."""
    out = []
    for top, _, names in os.walk(folder):
        for name in names:
            if name.endswith(".jsonl"):
                data, at = open(f"{top}/{name}", "rb").read(), 0
                for line in data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]:
                    if line:
                        out.append((os.path.relpath(f"{top}/{name}", folder), at, line.decode()))
                    at += len(line) + 1
    return sorted(out)


def test_a_tail_equals_the_whole_read(spark, tmp_path):
    """Files that grow, end within a line, are cut, replaced by longer ones, deleted and come back; over restarts, in shares of 30 bytes."""
    d, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(f"{d}/a.jsonl", "one\ntwo\nthr")
    put(f"{d}/s/b.jsonl", "é x\n" * 40)
    put(f"{d}/c.txt", "no\n")
    rows = []

    def poll():
        keep = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{out}/rows")
        run = live.tail_lines(spark, d, ".jsonl", split=30).writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
        run.awaitTermination()
        log = spark.read.parquet(f"{out}/rows")
        assert sorted((os.path.relpath(r["file"], d), r["at"], r["value"]) for r in live.present(log).collect()) == standing(d)
        rows.append(log.count())

    poll()
    put(f"{d}/a.jsonl", "ee\nfour")
    poll()
    assert rows[1] == rows[0] + 1  # nothing is read twice
    put(f"{d}/a.jsonl", "\nfive\n\n")
    put(f"{d}/s/b.jsonl", "cut\n", "w")
    poll()
    put(f"{d}/a.jsonl", "other text that is as long\nand longer than before\n", "w")
    os.remove(f"{d}/s/b.jsonl")
    poll()
    put(f"{d}/s/b.jsonl", "back\n")
    poll()
    poll()
    assert rows[-1] == rows[-2]


def test_offsets_tell_growth_from_replacement(tmp_path):
    """By checksums alone; a file whose time and size are as before is not opened."""
    file = f"{tmp_path}/x.jsonl"
    put(file, "a\n" * 5000)
    folder = live._Folder({"path": str(tmp_path)})
    before = folder.offsets(whole=False)[file]
    fs, _ = live.opened(str(tmp_path))
    put(file, "more\nand")
    grown = folder.offsets(whole=False)[file]
    assert grown[0] == 10_005 and live.continues(fs, file, before, grown)
    put(file, "a\n" * 2400 + "b\n" * 4000, "w")
    replaced = live._Folder({"path": str(tmp_path)}).offsets(whole=False)[file]
    assert replaced[0] > before[0] and not live.continues(fs, file, before, replaced)


def test_heartbeats_and_followed_steps(spark, tmp_path):
    d = f"{tmp_path}/logs"
    put(f"{d}/s1/transcript.jsonl", '{"step_index":0,"type":"USER_INPUT","content":"hi"}\nno json\n')
    put(f"{d}/s1/transcript_full.jsonl", '{"step_index":0,"type":"USER_INPUT","content":"full"}\n')
    name = f"t_{uuid.uuid4().hex[:8]}"
    beats = live.tail_lines(spark, d, heartbeat=300).writeStream.format("memory").queryName(name).trigger(processingTime="100 milliseconds").start()
    deadline = time.time() + 60
    while time.time() < deadline and spark.table(name).where("event = 'beat'").count() < 2:
        time.sleep(0.2)
    beats.stop()
    assert spark.table(name).where("event = 'beat'").count() >= 2
    name = f"t_{uuid.uuid4().hex[:8]}"
    run = transcripts.follow(spark, d).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r["session_id"], r["step_index"], r["content"], r["malformed"]) for r in spark.table(name).collect()} == {("s1", 0, "hi", False), ("s1", None, None, True)}


def test_events_of_a_tree():
    entry = lambda size, at, head=1: [size, size, at, head, 0]
    before = {"a": entry(1, 1), "b": entry(2, 2), "c": entry(3, 3), "e": entry(0, 5)}
    now = {"a": entry(1, 1), "b": entry(2, 9), "d": entry(3, 3), "f": entry(0, 5), "g": entry(7, 7)}
    assert live.tree_events(before, now) == [("modify", "b", None), ("rename_both", "c", "d"), ("remove", "e", None), ("create", "f", None), ("create", "g", None)]


# ---- timers


def run_watch(script, until, **limits):
    """(at, action, path, kind, old, changes) of (at, path, what, old) with a manual clock."""
    w = timers.Watch({}, limits=timers.Limits(**limits))
    out = []
    for at, path, what, old in script:
        out += w.change(at, path, what, old)
    return out + list(w.advance(until))


def loop(script, until, debounce=500, sweep=30_000, quiet=3_500):
    """The same, millisecond by millisecond."""
    pending, flushed, event, processed, changes, out, todo = {}, -(10**9), None, None, 0, [], sorted(script)
    next_sweep = todo[0][0] + sweep if todo else None

    def flush(at):
        nonlocal flushed, processed, changes
        done = [(at, "flush", p, *s, None) for p, s in sorted(pending.items()) if s[0]]
        pending.clear()
        flushed, changes = at, changes + len(done)
        processed = at if done else processed
        return done

    for now in range(todo[0][0], until + 1):
        due = bool(pending) and event + debounce == now
        if due:
            out += flush(now)
        if now == next_sweep:
            out.append((now, "sweep", None, None, None, None))
            next_sweep += sweep
            if changes and now - processed >= quiet:
                out.append((now, "recluster", None, None, None, changes))
                changes = 0
        while todo and todo[0][0] == now:
            _, path, what, old = todo.pop(0)
            kind, before = pending.get(path, ("", None))
            kind = ev._after(kind, what)
            pending[path] = kind, (old if what == "renamed" else before) if kind == "Renamed" else None
            event = now
            if now - flushed >= debounce:
                out += flush(now)
    return out


def test_flushes_of_a_manual_clock():
    """At once after a pause; then with the first change 500 ms later, or 500 ms after the last one."""
    one = lambda at, path="a.rs", what="modify": (at, path, what, None)
    flushes = lambda script: [x[:3] for x in run_watch(script, 20_000) if x[1] == "flush"]
    assert flushes([one(1000)]) == [(1000, "flush", "a.rs")]
    assert flushes([one(1000), one(1100), one(1300)]) == [(1000, "flush", "a.rs"), (1800, "flush", "a.rs")]
    assert flushes([one(1000), one(1400), one(1600, "b.rs")]) == [(1000, "flush", "a.rs"), (1600, "flush", "a.rs"), (1600, "flush", "b.rs")]
    assert flushes([one(1000), one(1100, "c.rs", "create"), one(1200, "c.rs", "remove")]) == [(1000, "flush", "a.rs")]
    last = run_watch([one(1000), one(29_000)], 70_000)
    # the sweep at 31 s comes 2 s after the last change, the next one finds it quiet
    assert [x for x in last if x[1] != "flush"] == [(31_000, "sweep", None, None, None, None), (61_000, "sweep", None, None, None, None), (61_000, "recluster", None, None, None, 2)]


def test_watch_against_a_loop():
    r = random.Random(5)
    for _ in range(60):
        script, at = [], 1000
        for _ in range(r.randrange(1, 40)):
            at += r.choice([0, 1, 90, 450, 499, 500, 501, 2500])
            what = r.choice(["create", "modify", "remove", "gone", "arrived", "renamed", "forget"])
            script.append((at, r.choice("abc"), what, "old" if what == "renamed" else None))
        script.sort(key=lambda x: x[0])
        until = at + r.randrange(9000)
        stable = sorted(script)
        assert run_watch(stable, until, sweep=4000, quiet=1500) == loop(stable, until, sweep=4000, quiet=1500)


def test_the_state_of_a_stream_is_the_watch(spark, tmp_path):
    """Event time over a whole table, in several batches, against the watch alone; batches don't show."""
    rows = catalog.queries()["watch_timeline"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/events.parquet")
    from weftline.plans import streaming_queries as q

    acts = ev.split_renames(q.quick_events(table)).withColumn("ms", F.unix_millis("ts")).orderBy("ms", "seq").collect()
    want, last = [], max(a["ms"] for a in acts)
    for ws in {a["workspace"] for a in acts}:
        own = [(a["ms"], a["path"], a["what"], a["old_path"]) for a in acts if a["workspace"] == ws]
        want += [(ws, *x) for x in run_watch(own, last + q.AFTER_MS) if x[1] != "sweep"]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    got = [(r["workspace"], round(r["at"].timestamp() * 1000), r["action"], r["file_path"], r["kind"], r["old_path"], r["changes"]) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key) and {w[2] for w in want} == {"flush", "recluster"}


def test_a_trigger_stores_its_changes_once():
    """However many rows it has: a path is read and written once."""
    ops = []

    class State:
        def __init__(self):
            self.held = {}

        def __getattr__(self, name):
            ops.append(name)
            return {"exists": lambda: bool(self.held), "get": lambda: self.held[0], "update": lambda v: self.held.update({0: v}), "iterator": lambda: iter([((k,), v) for k, v in self.held.items()]), "updateValue": lambda k, v: self.held.update({k[0]: v}), "removeKey": lambda k: self.held.pop(k[0])}[name]

    times, pending = State(), State()
    handle = SimpleNamespace(getValueState=lambda *a: times, getMapState=lambda *a: pending, listTimers=lambda: iter([]), registerTimer=ops.append, deleteTimer=ops.append)
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)
    p = timers.WatchProcessor(True, True, timers.Limits())
    p.init(handle)
    script = [(i * 7, "abc"[i % 3], "modify", None) for i in range(5000)]
    got = []
    for part in (script[:3001], script[3001:]):
        got += p.handleInputRows(("w",), iter([("w", i, a, b, c, o) for i, (a, b, c, o) in reversed(list(enumerate(part)))]), clock)
    got += p._rows(("w",), p._watch().advance(60_000))
    assert [(round(r["at"].timestamp() * 1000), r["action"], r["file_path"], r["kind"], r["old_path"], r["changes"]) for r in got] == run_watch(script, 60_000)
    assert len(ops) < 30


def test_more_events_are_more_files(spark, monkeypatch):
    """A trigger's events of a workspace are sorted in one task, so it gets no more of them than a number; the result stays."""
    from weftline.plans import streaming_queries as q

    want = sorted(map(str, q.watch_timeline(spark, SF).collect()))
    monkeypatch.setattr(q, "PART_ROWS", 100)
    path = q._in_parts(spark, SF)
    assert spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().count() > 8
    assert sorted(map(str, q.watch_timeline(spark, SF).collect())) == want


def test_a_graph_follows_its_tree(spark, tmp_path):
    """Files that change, come, go and move while the stream runs; the tables are then as if indexed from the present tree."""
    root = f"{tmp_path}/tree"
    put(f"{root}/a.py", "def one():\n    return two()\n")
    put(f"{root}/b.py", "def two():\n    return 2\n")
    put(f"{root}/c.py", "def three():\n    return one()\n")
    embed = lambda texts: [[1.0, 0.0]] * len(texts)
    graph = watch.LiveGraph(spark, root, "ws", 2, embed)
    labels = lambda: {(r["file_path"], r["label"]) for r in graph.nodes.collect()}
    assert ("a.py", "one") in labels() and graph.nodes.where("community is null").isEmpty()
    run = watch.start(graph, f"{tmp_path}/c", ".py", timers.Limits(debounce=200, sweep=2000, quiet=500))
    try:
        deadline = time.time() + 120
        while time.time() < deadline and not run.recentProgress:
            time.sleep(0.2)
        put(f"{root}/b.py", "def two():\n    return four()\n\ndef four():\n    return 4\n", "w")
        put(f"{root}/d.py", "def five():\n    return two()\n")
        os.remove(f"{root}/c.py")
        os.rename(f"{root}/a.py", f"{root}/z.py")
        want = {("z.py", "one"), ("b.py", "two"), ("b.py", "four"), ("d.py", "five")}
        while time.time() < deadline and not (want <= labels() and graph.clusterings > 1) and run.isActive:
            time.sleep(0.5)
    finally:
        run.stop()
    assert not run.exception() and want <= labels() and not {p for p, _ in labels()} & {"a.py", "c.py"}
    assert graph.clusterings > 1 and graph.nodes.where("community is null").isEmpty()
    names = {r["id"]: r["label"] for r in graph.nodes.collect()}
    assert {(names[e["source"]], names[e["target"]]) for e in graph.edges.where("type = 'CALLS'").collect()} >= {("two", "four"), ("five", "two")}


@pytest.mark.parametrize("name", ["live_transcripts"])
def test_live_query_has_sql(name):
    assert name in catalog.oracle_sql()


def test_many_small_files_are_few_tasks(tmp_path):
    """A task reads many small files; a large one is still read by several."""
    for i in range(1200):
        put(f"{tmp_path}/{i % 7}/{i}.jsonl", f"a{i}\nb\n")
    put(f"{tmp_path}/big.jsonl", "0123456789\n" * 500)
    reader = live.TailReader({"path": str(tmp_path), "split": "2000"})
    shares = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(shares) < 20 and max(sum(p[3] - p[2] for p in s.pieces) for s in shares) <= 2000
    rows = [(os.path.relpath(f, tmp_path), a, v) for s in shares for b in reader.read(s) for f, a, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
    assert sorted(rows) == standing(str(tmp_path)) and len(rows) == 2900
