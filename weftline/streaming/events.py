"""File events: admission, coalescing within a debounce window, and running status.

A rename touches two paths, so it is split first into what each path sees; then a
path's events are folded in order, in batch by an array fold and in a stream by
a stateful processor.  Both use the same table of transitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import extension

# Folders and extensions whose events are ignored.
EXCLUDED_DIRS = (".git", "node_modules", "target", "dist", "build", "vendor", "__pycache__", ".next", ".cache", ".idea", ".vscode", "venv", ".venv", "env", ".DS_Store")
EXCLUDED_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "webp", "ico", "svg", "pdf", "zip", "tar", "gz", "bz2", "xz", "7z", "exe", "bin",
    "dll", "dylib", "so", "a", "o", "obj", "wasm", "pyc", "pyo", "pyd", "class", "jar", "lock", "map", "rlib",
    "rmeta", "timestamp",
)
DEBOUNCE, QUIET_MS, SWEEP = "500 milliseconds", 3500, "30 seconds"
#: Changes after which the communities count as stale.
STALE_AFTER = 10


def admitted(kind: Column, path: Column) -> Column:
    known = kind.isin("create", "modify", "remove", "rename_both", "rename_from", "rename_to")
    return known & ~F.exists(F.split(path, "/"), lambda c: c.isin(*EXCLUDED_DIRS)) & ~extension(path).isin(*EXCLUDED_EXTENSIONS)


def split_renames(events: DataFrame) -> DataFrame:
    """(…, path, what, old_path): ``forget`` for a rename's old path, ``renamed`` for its new one; from and to are delete and create."""
    what = F.col("kind")
    both = F.array(F.struct(F.col("path").alias("path"), F.lit("forget").alias("what"), F.lit(None).cast("string").alias("old_path")), F.struct(F.col("new_path").alias("path"), F.lit("renamed").alias("what"), F.col("path").alias("old_path")))
    one = lambda name: F.array(F.struct(F.col("path").alias("path"), F.lit(name).alias("what"), F.lit(None).cast("string").alias("old_path")))
    acts = F.when(what == "rename_both", both).when(what == "rename_from", one("gone")).when(what == "rename_to", one("arrived")).when(what == "create", one("create")).when(what == "modify", one("modify")).when(what == "remove", one("remove"))
    return events.withColumn("_a", F.explode(acts)).drop("path", "kind", "new_path").select("*", "_a.*").drop("_a")


def next_state(state: Column, what: Column) -> Column:
    """The state of a path after an event; '' is none."""
    created = F.when(state == "Deleted", "Modified").otherwise("Created")
    modified = F.when(state.isin("Created", "Renamed"), state).otherwise("Modified")
    removed = F.when(state == "Created", "").otherwise("Deleted")
    return F.when(what == "forget", "").when(what == "renamed", "Renamed").when(what == "gone", "Deleted").when(what == "arrived", "Created").when(what == "create", created).when(what == "modify", modified).when(what == "remove", removed).otherwise(state)


def coalesce_events(events: DataFrame, groups: tuple[str, ...] = ("workspace",)) -> DataFrame:
    """(groups, file_path, kind, old_path): what a batch of events (seq, kind, path, new_path) comes to for each path.

    A path's events are gathered, not a workspace's; they are as many as one debounce
    window holds for one file.
    """
    acts = split_renames(events.where(admitted(F.col("kind"), F.col("path"))))
    ordered = acts.groupBy(*groups, F.col("path").alias("file_path")).agg(F.array_sort(F.collect_list(F.struct("seq", "what", "old_path"))).alias("_e"))
    start = F.struct(F.lit("").alias("kind"), F.lit(None).cast("string").alias("old_path"))

    def step(s: Column, e: Column) -> Column:
        kind = next_state(s["kind"], e["what"])
        old = F.when(e["what"] == "renamed", e["old_path"]).when(kind == "Renamed", s["old_path"])
        return F.struct(kind.alias("kind"), old.alias("old_path"))

    out = ordered.withColumn("_s", F.aggregate("_e", start, step))
    return out.where(F.col("_s.kind") != "").select(*groups, "file_path", "_s.kind", "_s.old_path")


def windowed(events: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """The same by debounce window on event time, for batches and streams: windows close after DEBOUNCE without an event of the workspace."""
    marked = events.where(admitted(F.col("kind"), F.col("path")))
    if marked.isStreaming:
        marked = marked.withWatermark("ts", lateness)
    acts = split_renames(marked)
    ordered = acts.groupBy("workspace", F.session_window("ts", DEBOUNCE).alias("w"), F.col("path").alias("file_path")).agg(F.array_sort(F.collect_list(F.struct("seq", "what", "old_path"))).alias("_e"))
    start = F.struct(F.lit("").alias("kind"), F.lit(None).cast("string").alias("old_path"))
    step = lambda s, e: F.struct(next_state(s["kind"], e["what"]).alias("kind"), F.when(e["what"] == "renamed", e["old_path"]).when(next_state(s["kind"], e["what"]) == "Renamed", s["old_path"]).alias("old_path"))
    out = ordered.withColumn("_s", F.aggregate("_e", start, step))
    return out.where(F.col("_s.kind") != "").select("workspace", F.col("w.end").alias("flushed_at"), "file_path", "_s.kind", "_s.old_path")


def quiescent(events: DataFrame, gap: str = f"{QUIET_MS} milliseconds", keys: tuple[str, ...] = ("workspace",)) -> DataFrame:
    """(keys, begin, quiet_at, changes): the points where a workspace had been idle for ``gap`` after changes, when it is clustered anew."""
    own = events.withWatermark("ts", "10 seconds") if events.isStreaming else events
    return own.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("changes")).select(*keys, F.col("w.start").alias("begin"), F.col("w.end").alias("quiet_at"), "changes")


def status(deltas: DataFrame) -> DataFrame:
    """Running status of each workspace from applied deltas (workspace, kind, duration_ms)."""
    gone = F.col("kind") == "Deleted"
    return deltas.groupBy("workspace").agg(F.count("*").alias("events"), F.count_if(~gone).alias("reindexed"), F.count_if(gone).alias("deleted"), F.floor(F.avg("duration_ms")).alias("average_ms"), (F.count("*") >= STALE_AFTER).alias("stale"))


_STATE = "kind string, old_path string"


def stateful(events: DataFrame) -> DataFrame:
    """The present kind of every path of a stream of events, in update mode: custom state, kept between batches.

    A path that came to nothing, or was deleted, is reported once and forgotten, so
    the state holds the paths with a pending change and not all that ever were.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kind, old = state.get if state.exists else ("", None)
        rows = pd.concat(list(batches)).sort_values("seq")
        for what, before in zip(rows["what"], rows["old_path"], strict=True):
            kind, old = _after(kind, what), before if what == "renamed" else old
        if kind in ("", "Deleted"):
            state.remove()
        else:
            state.update((kind, old if kind == "Renamed" else None))
        yield pd.DataFrame({"workspace": [key[0]], "file_path": [key[1]], "kind": [kind], "old_path": [old if kind == "Renamed" else None]})

    acts = split_renames(events.where(admitted(F.col("kind"), F.col("path")))).withColumnRenamed("path", "file_path")
    return acts.groupBy("workspace", "file_path").applyInPandasWithState(run, "workspace string, file_path string, kind string, old_path string", _STATE, "update", "NoTimeout")


def _after(state: str, what: str) -> str:
    """``next_state`` on values."""
    fixed = {"forget": "", "renamed": "Renamed", "gone": "Deleted", "arrived": "Created"}
    if what in fixed:
        return fixed[what]
    if what == "create":
        return "Modified" if state == "Deleted" else "Created"
    if what == "modify":
        return state if state in ("Created", "Renamed") else "Modified"
    return "" if state == "Created" else "Deleted"
