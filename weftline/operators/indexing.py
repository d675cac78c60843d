"""Files to indexed rows: parsed, embedded, resolved; and the same for those that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import graph, parsing, vectors
from weftline.session import materialize
from weftline.sources import files as source_files
from weftline.streaming import sync


def index(files: DataFrame, dim: int = 384, embedder: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with hashes and vectors, and unresolved edges, of (workspace, file_path, content, file_hash)."""
    nodes, extracted = parsing.parse(files.select("workspace", "file_path", "content"))
    nodes = materialize(nodes, "parsed")
    hashed = nodes.join(files.select("workspace", "file_path", "file_hash"), ["workspace", "file_path"], "left")
    rich = hashed.withColumn("_rich", vectors.enriched_text(F.col("language"), F.col("kind"), F.col("label"), F.col("file_path"), F.col("text")))
    embedded = vectors.embed(rich, "_rich", "embedding", dim, embedder).drop("_rich").withColumn("community", F.lit(None).cast("int"))
    return materialize(embedded, "nodes"), extracted


def reindex(nodes: DataFrame, edges: DataFrame, files: DataFrame, dim: int = 384, embedder: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables after the files (workspace, file_path, content, file_hash) are indexed anew where their hash changed.

    Files of a known hash are not parsed.  New nodes take over the community that
    their file had; edges into a changed file are found again where its symbols are,
    and those from it are resolved against all nodes.
    """
    known = nodes.select("workspace", "file_path", "file_hash").distinct()
    stale = materialize(source_files.stale(files, known), "stale")
    fresh, extracted = index(stale, dim, embedder)
    deltas = stale.select("workspace", "file_path", F.lit("Modified").alias("kind"), F.lit(None).cast("string").alias("old_path"))
    new_nodes, kept = sync.apply_changes(nodes, edges, deltas, fresh, edges.limit(0))
    new_nodes = materialize(new_nodes, "nodes")
    # edges of unchanged sources into nodes that came back under their id
    back = edges.join(fresh.select(F.col("id").alias("target")), "target", "left_semi").join(fresh.select(F.col("id").alias("source")), "source", "left_anti").join(new_nodes.select(F.col("id").alias("source")), "source", "left_semi")
    resolved = graph.resolve_edges(new_nodes, extracted)
    return new_nodes, kept.unionByName(back.select(*edges.columns)).unionByName(resolved, allowMissingColumns=True)


def sweep(known: DataFrame, listing: DataFrame, events: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(files that are gone, workspaces to cluster anew): the periodic check of the known files and of the pending changes.

    A workspace is due when changes are pending and the last one is QUIET_MS or more before ``as_of``.
    """
    from weftline.streaming.events import QUIET_MS

    last = events.groupBy("workspace").agg(F.max("ts").alias("last_at"), F.count("*").alias("changes"))
    due = last.where(F.col("last_at") <= as_of - F.make_dt_interval(secs=F.lit(QUIET_MS / 1000)))
    return source_files.missing(known, listing), due
