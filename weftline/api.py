"""The engine's surface: one object for a code graph and one for transcripts, each method a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import coloured_lpa, condense, graph, indexing, listings, rag, sessions, store, telemetry, vectors
from weftline.session import materialize
from weftline.sources import files, transcripts


class CodeGraph:
    """Nodes, edges and telemetry of source trees.

    Methods return frames; those that change the graph return a new object, whose
    tables ``save`` writes by workspace.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, meta: DataFrame | None = None, calls: DataFrame | None = None):
        self.nodes, self.edges, self.meta, self.calls = nodes, edges, meta, calls

    @staticmethod
    def ingest(spark: SparkSession, root: str, workspace: str, known: DataFrame | None = None, dim: int = 384, embedder: Callable | None = None) -> "CodeGraph":
        """Scan, admit, parse, embed and resolve a tree; with ``known`` hashes only new and changed files.

        All edges are resolved after all nodes exist, so calls into files that come
        later in the tree are found too.
        """
        tree = files.read_tree(spark, root, workspace)
        if known is not None:
            tree = files.stale(tree, known)
        tree = materialize(tree, "tree")
        nodes, extracted = indexing.index(tree, dim, embedder)
        return CodeGraph(nodes, materialize(graph.resolve_edges(nodes, extracted), "edges"))

    def _own(self, workspace: str | None) -> DataFrame:
        return self.nodes if workspace is None else self.nodes.where(F.col("workspace") == workspace)

    def stats(self) -> DataFrame:
        """Counts of nodes over all, by language and by workspace, in one pass."""
        return self.nodes.groupingSets([[], ["language"], ["workspace"]], "language", "workspace").agg(F.count("*").alias("nodes"))

    def workspaces(self, fold: dict[str, str] | None = None) -> DataFrame:
        return listings.workspaces(self.nodes, self.meta, fold)

    def graph(self, workspace: str | None = None) -> tuple[DataFrame, DataFrame]:
        own = self._own(workspace)
        return own, self.edges.join(own.select(F.col("id").alias("source")), "source", "left_semi")

    def search(self, query: str | list[float], k: int = 10, workspace: str | None = None, embedder: Callable | None = None) -> DataFrame:
        vector = self._vector(query, embedder)
        return vectors.top_k(self._own(workspace), vector, k).join(self.nodes.drop("embedding"), "id").orderBy(F.desc("similarity"), "id")

    def _vector(self, query: str | list[float], embedder: Callable | None = None) -> list[float]:
        if not isinstance(query, str):
            return query
        dim = self.nodes.select(F.max(F.size("embedding"))).first()[0]
        return embedder([query])[0] if embedder else vectors.hashing_embedding(query, dim)

    def symbol(self, name: str, workspace: str | None = None) -> DataFrame:
        return graph.find_symbols(self.nodes, name, workspace)

    def references(self, symbol: str, workspace: str | None = None) -> DataFrame:
        return graph.references(self.nodes, self.edges, symbol, workspace)

    def condense(self, symbol: str, hops: int = 1, workspace: str | None = None) -> DataFrame:
        near, links = graph.symbol_subgraph(self.nodes, self.edges, symbol, workspace)
        return condense.condense(near, links, symbol, hops)

    def query(self, prompt: str | list[float], k: int = 5, workspace: str | None = None, embedder: Callable | None = None) -> DataFrame:
        return rag.graph_context(self.nodes, self.edges, self._vector(prompt, embedder), k, workspace)

    def relate(self, wanted: DataFrame, dim: int = 384) -> "CodeGraph":
        return CodeGraph(*store.add_relationships(self.nodes, self.edges, wanted, dim), self.meta, self.calls)

    def cluster(self, sequential: bool = False) -> "CodeGraph":
        """With new communities: colour by colour, so that nodes see what their neighbours have become, or in rounds."""
        if sequential:
            found = coloured_lpa.communities(self.nodes, self.edges, seeded=True).select("id", "community")
        else:
            found = graph.label_propagation(self.nodes, self.edges, seeds=self.nodes.select("id", "community"))
        fresh = self.nodes.drop("community").join(found, "id").select(*self.nodes.columns)
        return CodeGraph(fresh, self.edges, self.meta, self.calls)

    def galaxies(self, min_size: int = 1, role: str = "", text: str = "", sort_by: str = "nodes") -> DataFrame:
        """Community metrics; by folder where no node has a community."""
        if self.nodes.where("community is not null").isEmpty():
            return listings.folder_groups(self.nodes)
        return listings.filter_communities(listings.topology(self.nodes, self.edges)[0], role, text, min_size, sort_by)

    def boundary(self, symbol: str, workspace: str | None = None) -> DataFrame:
        return graph.boundary(self.nodes, self.edges, symbol, workspace)

    def topology(self) -> tuple[DataFrame, DataFrame]:
        return listings.topology(self.nodes, self.edges)

    def worktrees(self) -> DataFrame:
        return self.meta.where("is_worktree")

    def delete_file(self, workspace: str, path: str) -> "CodeGraph":
        return CodeGraph(*store.delete_file(self.nodes, self.edges, workspace, path), self.meta, self.calls)

    def purge(self, workspace: str) -> "CodeGraph":
        doomed = self.nodes.where(F.col("workspace") == workspace).select("id")
        meta = None if self.meta is None else self.meta.where(F.col("workspace") != workspace)
        return CodeGraph(*store.cascade(self.nodes, self.edges, doomed), meta, self.calls)

    def record_call(self, row: DataFrame) -> "CodeGraph":
        return CodeGraph(self.nodes, self.edges, self.meta, row if self.calls is None else self.calls.unionByName(row, allowMissingColumns=True))

    def call_summary(self) -> DataFrame:
        return telemetry.summary(self.calls)

    def save(self, path: str) -> None:
        store.write_partitions(self.nodes, f"{path}/nodes")
        edges = self.edges if "workspace" in self.edges.columns else self.edges.withColumn("workspace", F.lit("default"))
        store.write_partitions(edges, f"{path}/edges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "CodeGraph":
        return CodeGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


class Transcripts:
    """Sessions of agent transcripts."""

    def __init__(self, steps: DataFrame, known: DataFrame | None = None):
        self.all_steps, self._all = steps, None
        self.steps = steps.where("not malformed") if "malformed" in steps.columns else steps
        self.known = known if known is not None else steps.sparkSession.createDataFrame([], "name string, path string")

    @staticmethod
    def scan(spark: SparkSession, locations: list[tuple[str, str, str]], known: DataFrame | None = None, full: bool = False) -> "Transcripts":
        return Transcripts(materialize(transcripts.read_all(spark, locations, full), "steps"), known)

    def all(self) -> DataFrame:
        """One row a session, with project, workspace and file size; made once."""
        if self._all is None:
            self._all = materialize(self._make_all(), "sessions")
        return self._all

    def _make_all(self) -> DataFrame:
        rolled = sessions.rollup(self.steps)
        place = self.steps.groupBy("session_id").agg(F.first("provider").alias("provider"), F.first("runtime_mode").alias("runtime_mode"), F.max("size").alias("transcript_size_bytes"), F.min_by(T.workspace_of(F.col("content")), F.when(T.workspace_of(F.col("content")).isNotNull(), F.col("step_index"))).alias("stated"))
        best = sessions.best_projects(sessions.project_scores(self.steps, self.known))
        joined = rolled.join(place, "session_id").join(best, "session_id", "left").join(self.known.select(F.col("name").alias("project_name"), F.col("path")), "project_name", "left")
        none = F.array().cast("array<string>")
        return joined.withColumns({"workspace": F.coalesce("path", "stated", F.concat(F.lit("/"), F.col("project_name")), F.lit("")), "projects_touched": F.coalesce("projects_touched", none), "project_name": F.coalesce("project_name", F.lit("Default"))}).drop("path", "stated")

    def list(self, **filters) -> DataFrame:
        return sessions.list_sessions(self.all(), **filters)

    def detail(self, session_id: str) -> DataFrame:
        return sessions.detail(self.steps, session_id)

    def search(self, query: str, kind: str = "", limit: int = 100) -> DataFrame:
        return sessions.search(self.steps, query, kind, limit)

    def stats(self) -> DataFrame:
        return sessions.totals(self.all())

    def projects(self) -> DataFrame:
        return sessions.project_summaries(self.all(), self.known)

    def wip(self, workspace: str = "", session_id: str | None = None, limit: int = 5, force_latest: bool = False) -> dict[str, DataFrame]:
        """The status and candidates, and for a resolved session the parts of its digest."""
        every = self.all()
        status = sessions.wip_status(every, workspace, session_id, force_latest)
        own = self.steps.join(status.where("status = 'resolved'").select("session_id"), "session_id", "left_semi")
        return {
            "status": status,
            "candidates": sessions.wip_candidates(every, workspace, limit),
            "prompts": sessions.recent_prompts(own),
            "responses": sessions.recent_responses(own),
            "tool_calls": sessions.last_tool_calls(own),
            "files": sessions.latest_distinct(own),
            "commands": sessions.latest_distinct(own, (sessions.COMMAND_TOOL,), ("CommandLine",)),
            "errors": sessions.recent_errors(own),
        }

    def export(self, session_id: str, form: str = "markdown") -> DataFrame:
        own = self.steps.where(F.col("session_id") == session_id)
        return sessions.export_markdown(own) if form == "markdown" else sessions.export_json(own)
