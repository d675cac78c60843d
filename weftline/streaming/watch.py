"""A graph that follows its source tree: events of the files, timers, and what each action does to the tables.

The tree is polled by ``sources.live``, ``timers`` decides when something is done, and each
trigger's actions are applied here: changed files are indexed again, renamed and deleted
ones move and go, a sweep removes what is gone without an event, and a clustering starts
at the present communities and at the nodes whose files changed.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import graph, indexing, store
from weftline.session import drop_scratch, materialize
from weftline.sources import files as source_files
from weftline.sources import live
from weftline.streaming import sync, timers


class LiveGraph:
    """The nodes and edges of a workspace below ``root``, kept as they are now.

    ``nodes`` and ``edges`` are written tables; each change writes new ones and drops
    those before.  ``done`` is the number of the last batch that was applied, so a
    batch that Spark hands over again is applied once.
    """

    def __init__(self, spark: SparkSession, root: str, workspace: str, dim: int = 384, embedder: Callable | None = None):
        self.spark, self.root, self.workspace, self.done, self.clusterings = spark, root.rstrip("/"), workspace, -1, 0
        self._index = functools.partial(indexing.index, dim=dim, embedder=embedder)
        self._reindex = functools.partial(indexing.reindex, dim=dim, embedder=embedder)
        nodes, extracted = self._index(source_files.read_tree(spark, root, workspace))
        self.nodes, self.edges = nodes, materialize(graph.resolve_edges(nodes, extracted), "edges")
        self.touched: DataFrame | None = None
        self.cluster()

    def _keep(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Set the tables, written; an end whose node is gone takes its edge along."""
        old = self.nodes, self.edges
        self.nodes, self.edges = materialize(nodes, "nodes"), materialize(edges, "edges")
        for table in old:
            drop_scratch(table)

    def _touch(self, files: DataFrame) -> None:
        """The nodes of these files, and what they are linked with, vote at the next clustering."""
        own = self.nodes.join(files, ["workspace", "file_path"], "left_semi").select("id")
        near = materialize(graph.neighbours(self.edges, own), "touched")
        self.touched = near if self.touched is None else materialize(self.touched.unionByName(near).distinct(), "touched")

    def apply(self, actions: DataFrame, batch: int) -> None:
        """What the actions of a trigger ask for; of several flushes of a path the last."""
        if batch <= self.done:
            return
        last = actions.where("action = 'flush'").groupBy("workspace", "file_path").agg(F.max_by(F.struct("kind", "old_path"), "at").alias("_d"))
        deltas = materialize(last.select("workspace", "file_path", "_d.*"), "deltas")
        asked = {r[0] for r in actions.select("action").distinct().collect()}
        if "flush" in asked:
            self.flush(deltas)
        if "sweep" in asked:
            self.sweep()
        if "recluster" in asked:
            self.cluster()
        drop_scratch(deltas)
        self.done = batch

    def flush(self, deltas: DataFrame) -> None:
        """Apply (workspace, file_path, kind, old_path)."""
        moved = deltas.where("kind in ('Deleted', 'Renamed')")
        before = self.nodes.join(deltas.select("workspace", "file_path"), ["workspace", "file_path"], "left_semi").select("id")
        near = materialize(graph.neighbours(self.edges, before), "touched")  # what a file that goes was linked with
        self.touched = near if self.touched is None else self.touched.unionByName(near).distinct()
        self._keep(*sync.apply_changes(self.nodes, self.edges, moved, self.nodes.limit(0).drop("community"), self.edges.limit(0)))
        changed = deltas.where("kind <> 'Deleted'").select("workspace", "file_path")  # a renamed file may have changed as well
        paths = [f"{self.root}/{r['file_path']}" for r in changed.select("file_path").collect()]  # of one trigger
        found = source_files.read_files(self.spark, self.root, self.workspace, paths)
        self._keep(*self._reindex(self.nodes, self.edges, found))
        self._touch(changed)

    def sweep(self) -> None:
        """Remove the files that are no longer there."""
        there = source_files.read_listing(self.spark, self.root, self.workspace)
        gone = source_files.missing(self.nodes.select("workspace", "file_path").distinct(), there)
        doomed = materialize(self.nodes.join(gone, ["workspace", "file_path"], "left_semi").select("id"), "gone")
        if not doomed.isEmpty():
            self._keep(*store.cascade(self.nodes, self.edges, doomed))

    def cluster(self) -> None:
        """Communities anew: from the present ones on, and at first from nothing."""
        seeds = self.nodes.where(F.col("community").isNotNull()).select("id", "community") if self.clusterings else None
        found = graph.label_propagation(self.nodes, self.edges, seeds=seeds, changed=self.touched)
        self._keep(store.set_communities(self.nodes, found), self.edges)
        self.touched, self.clusterings = None, self.clusterings + 1


def start(live_graph: LiveGraph, checkpoint: str, suffix: str = "", limits: timers.Limits = timers.Limits(), poll: str = "250 milliseconds") -> StreamingQuery:
    """Follow the tree until the query is stopped."""
    events = live.watch_tree(live_graph.spark, live_graph.root, suffix, workspace=live_graph.workspace)
    with timers.stateful(live_graph.spark):
        return sync.start_sync(timers.actions(events, limits=limits), live_graph.apply, checkpoint, {"processingTime": poll})
