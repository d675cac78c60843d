"""Listings, breakdowns and reports over sessions, steps, communities and workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as T
from weftline.operators import graph, telemetry

#: Lines that may be read at once of code and of documents, and the seconds for which a graph lookup counts as recent.
CODE_LINES, DOC_LINES, RECENT_S = 150, 450, 7200
#: Lines of a community's text that are joined at once.
BLOCK = 1000


def _has(c: Column, q: str) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.lower()))


def filter_sessions(sessions: DataFrame, workspace: str = "", language: str = "", graph_only: bool = False, tool_parts: tuple[str, ...] = (), text: str = "", sort_by: str = "date") -> DataFrame:
    """Sessions by workspace, language, graph use, parts of tool names and free text over id, prompt, workspace and tools.

    Columns: session_id, workspace, prompt, languages, tools, graph_calls, steps, tool_calls, created_at.
    """
    out = sessions
    if workspace:
        out = out.where(F.col("workspace") == workspace)
    if language:
        out = out.where(F.array_contains("languages", language))
    if graph_only:
        out = out.where(F.col("graph_calls") > 0)
    if tool_parts:
        out = out.where(F.exists("tools", lambda t: F.exists(F.array(*[F.lit(p.lower()) for p in tool_parts]), lambda p: F.contains(F.lower(t), p))))
    if text:
        out = out.where(_has(F.col("session_id"), text) | _has(F.col("prompt"), text) | _has(F.col("workspace"), text) | F.exists("tools", lambda t: F.contains(F.lower(t), F.lit(text.lower()))))
    keys = {"date": "created_at", "steps": "steps", "tools": "tool_calls", "graph": "graph_calls"}
    return out.orderBy(F.desc_nulls_last(keys[sort_by]), "session_id")


def filter_steps(steps: DataFrame, kind: str = "ALL", tool: str = "", text: str = "", descending: bool = False) -> DataFrame:
    """Steps by kind (PROMPTS, THOUGHTS, TOOLS, GRAPH, ERRORS, or a message filter), one tool, and text over content, thinking, tool names and arguments."""
    n_tools = F.coalesce(F.size("tool_calls"), F.lit(0))
    named = {
        "PROMPTS": F.col("type") == "USER_INPUT",
        "THOUGHTS": F.trim(F.coalesce("thinking", F.lit(""))) != "",
        "TOOLS": n_tools > 0,
        "GRAPH": F.coalesce(F.exists("tool_calls", lambda c: F.contains(F.lower(c["args"]), F.lit("graph"))), F.lit(False)),
        "ERRORS": (F.col("status") == "ERROR") | (F.col("type") == "ERROR_MESSAGE"),
    }
    out = steps.where(named.get(kind.upper(), T.message_filter(kind, F.col("type"), F.col("content"), n_tools)))
    if tool:
        out = out.where(F.exists("tool_calls", lambda c: c["name"] == tool))
    if text:
        in_tools = F.coalesce(F.exists("tool_calls", lambda c: F.contains(F.lower(F.concat_ws(" ", c["name"], c["args"])), F.lit(text.lower()))), F.lit(False))
        out = out.where(_has(F.col("content"), text) | _has(F.col("thinking"), text) | in_tools)
    return out.orderBy(F.desc("step_index") if descending else F.asc("step_index"))


def sort_messages(messages: DataFrame, mode: str = "step_asc") -> DataFrame:
    """The six orders of a timeline, ties by step."""
    length, tools = F.length(F.coalesce("content", F.lit(""))), F.coalesce(F.size("tool_calls"), F.lit(0))
    keys = {"step_asc": [], "step_desc": [F.desc("step_index")], "time_asc": [F.asc_nulls_last("created_at")], "time_desc": [F.desc_nulls_last("created_at")], "length": [length.desc()], "tools": [tools.desc()]}
    return messages.orderBy(*keys[mode], "step_index")


def filter_project_sessions(sessions: DataFrame, text: str = "", begin: str | None = None, end: str | None = None, sort_by: str = "newest") -> DataFrame:
    """Sessions of a project by text over id, prompt, workspace, touched projects and tool names, by UTC days, in one of six orders."""
    out = sessions
    if text:
        tools = F.coalesce(F.exists(F.map_keys("tool_calls_map"), lambda t: F.contains(F.lower(t), F.lit(text.lower()))), F.lit(False))
        touched = F.coalesce(F.exists("projects_touched", lambda t: F.contains(F.lower(t), F.lit(text.lower()))), F.lit(False))
        out = out.where(_has(F.col("session_id"), text) | _has(F.col("first_user_prompt_preview"), text) | _has(F.col("workspace"), text) | touched | tools)
    if begin:
        out = out.where(F.col("created_at") >= F.lit(begin).cast("timestamp"))
    if end:
        out = out.where(F.col("created_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    keys = {"newest": F.desc("created_at"), "oldest": F.asc("created_at"), "steps": F.desc("step_count"), "messages": F.desc("user_message_count"), "tools": F.desc("tool_call_count"), "errors": F.desc("error_count")}
    return out.orderBy(keys[sort_by], "session_id")


def sort_projects(projects: DataFrame, sort_by: str = "last_active") -> DataFrame:
    """Projects with sessions first, then by steps, messages, steps and tools together, or last activity."""
    keys = {"steps": F.col("steps"), "messages": F.col("messages"), "activity": F.col("steps") + F.col("tools"), "last_active": F.col("last_active")}
    return projects.orderBy((F.col("session_count") > 0).desc(), keys[sort_by].desc_nulls_last(), "project_name")


def filter_communities(communities: DataFrame, role: str = "", text: str = "", min_size: int = 0, sort_by: str = "nodes") -> DataFrame:
    """Communities by role, size and text over name, path or any key symbol, in one of four orders."""
    out = communities.where(F.col("node_count") >= min_size)
    if role:
        out = out.where(F.col("role") == role)
    if text:
        out = out.where(_has(F.col("name"), text) | _has(F.col("dir"), text) | F.exists("key_symbols", lambda s: F.contains(F.lower(s), F.lit(text.lower()))))
    keys = {"nodes": F.desc("node_count"), "stable": F.asc("instability"), "unstable": F.desc("instability"), "coupling": (F.col("afferent") + F.col("efferent")).desc()}
    return out.orderBy(keys[sort_by], "community")


def search_clusters(nodes: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """(community): those whose name or any member's label holds the text."""
    by_label = nodes.where(F.col("community").isNotNull() & _has(F.col("label"), text)).select("community")
    return names.where(_has(F.col("name"), text)).select("community").unionByName(by_label).distinct()


def community_summary(nodes: DataFrame, min_size: int = 1) -> DataFrame:
    """Size, distinct files, first five labels and name of each community of ``min_size`` members or more."""
    sizes = nodes.where(F.col("community").isNotNull()).groupBy("community").agg(F.count("*").alias("node_count"), F.count_distinct("file_path").alias("files"))
    named = graph.describe(nodes, 5).select("community", "key_symbols", F.concat(F.lit("Galaxy #"), F.col("community").cast("string"), F.lit(": "), F.col("name")).alias("name"))
    return sizes.where(F.col("node_count") >= min_size).join(named, "community")


def folder_groups(nodes: DataFrame, samples: int = 6) -> DataFrame:
    """Where there are no communities: nodes by parent folder with size, languages and first labels."""
    own = nodes.withColumn("dir", T.parent_directory(F.col("file_path")))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy("label"))
    first = own.select("dir", "label").distinct().withColumn("r", rank).where(F.col("r") <= samples).groupBy("dir").agg(F.sort_array(F.collect_list("label")).alias("samples"))
    return own.groupBy("dir").agg(F.count("*").alias("node_count"), F.sort_array(F.collect_set("language")).alias("languages")).join(first, "dir")


def topology(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The communities with their metrics and names, and the edges between them."""
    return graph.coupling(nodes, edges).join(graph.describe(nodes), "community"), graph.inter_galaxy(nodes, edges)


def cluster(nodes: DataFrame, edges: DataFrame, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes with new communities, seeded by the present ones, and the metrics of those of ``min_size`` members or more."""
    found = graph.label_propagation(nodes, edges, seeds=nodes.select("id", "community"))
    fresh = nodes.drop("community").join(found, "id").select(*nodes.columns)
    return fresh, topology(fresh, edges)[0].where(F.col("node_count") >= min_size)


def community_markdown(nodes: DataFrame, part: int | None = 1000) -> DataFrame:
    """(community, part, markdown): a title, the count, and a line for each symbol in the order of labels, ``part`` lines a row.

    With None a community is one row, part 0, put together from blocks of BLOCK lines.
    """
    own = nodes.where(F.col("community").isNotNull())
    place = F.row_number().over(Window.partitionBy("community").orderBy("label", "id")) - 1
    text = F.concat(F.lit("- "), F.col("label"), F.lit(" ("), F.col("kind"), F.lit(") "), F.col("file_path"))
    lines = own.select("community", "id", "label", place.alias("r"), text.alias("l")).withColumn("part", F.floor(F.col("r") / (part or BLOCK)))
    joined = lambda rows: F.array_join(F.transform(F.sort_array(F.collect_list(rows)), lambda x: x["l"]), "\n").alias("l")
    parts = lines.groupBy("community", "part").agg(joined(F.struct("r", "l")))
    if part is None:
        parts = parts.groupBy("community").agg(joined(F.struct("part", "l"))).withColumn("part", F.lit(0).cast("long"))
    sizes = own.groupBy("community").agg(F.count("*").alias("n"))
    head = F.concat(F.lit("# Galaxy "), F.col("community").cast("string"), F.lit("\n\n"), F.col("n").cast("string"), F.lit(" symbols\n\n"))
    return parts.join(sizes, "community").select("community", "part", F.concat(head, "l").alias("markdown"))


def report(df: DataFrame, samples: str = "samples", n: int = 4) -> DataFrame:
    """A table for a terminal: lists cut to ``n`` entries and joined."""
    return df.withColumn(samples, F.array_join(F.slice(samples, 1, n), ", "))


def step_counters(steps: DataFrame) -> DataFrame:
    """Prompts, thoughts, tools, graph calls and errors of each session."""
    n_tools = F.coalesce(F.size("tool_calls"), F.lit(0))
    graph_calls = F.coalesce(F.size(F.filter("tool_calls", lambda c: F.contains(F.lower(c["args"]), F.lit("graph")))), F.lit(0))
    return steps.groupBy("session_id").agg(F.count_if(F.col("type") == "USER_INPUT").alias("prompts"), F.count_if(F.trim(F.coalesce("thinking", F.lit(""))) != "").alias("thoughts"), F.sum(F.greatest(n_tools, F.lit(0))).alias("tools"), F.sum(F.greatest(graph_calls, F.lit(0))).alias("graph_calls"), F.count_if((F.col("status") == "ERROR") | (F.col("type") == "ERROR_MESSAGE")).alias("errors"))


def tool_names(steps: DataFrame) -> DataFrame:
    """(session_id, tools): the distinct tool names of each session, sorted."""
    return steps.select("session_id", F.explode("tool_calls.name").alias("t")).groupBy("session_id").agg(F.sort_array(F.collect_set("t")).alias("tools"))


def session_digest(steps: DataFrame, gates: tuple[str, ...] = ("graph",)) -> DataFrame:
    """The second scanner's rollup: all steps, tools, graph calls, errors, the first time and prompt line, and the first five tool names by alphabet."""
    calls = steps.select("session_id", F.explode("tool_calls").alias("c")).withColumn("k", telemetry.classify(T.main_argument(F.col("c.args")), gates))
    tools = calls.groupBy("session_id").agg(F.count("*").alias("tool_calls"), F.count("k").alias("graph_calls"), F.slice(F.sort_array(F.collect_set("c.name")), 1, 5).alias("tools"))
    main = steps.groupBy("session_id").agg(F.count("*").alias("steps"), F.count_if((F.col("status") == "ERROR") | (F.col("type") == "ERROR_MESSAGE")).alias("errors"), F.min("created_at").alias("created_at"), F.min_by(F.when(F.col("type") == "USER_INPUT", T.prompt_preview(F.col("content"))), F.when(F.col("type") == "USER_INPUT", F.col("step_index"))).alias("prompt"))
    return main.join(tools, "session_id", "left").fillna(0, ["tool_calls", "graph_calls"])


def analytics_totals(digests: DataFrame, capabilities: DataFrame, languages: DataFrame) -> DataFrame:
    """One row: sessions, steps, tools, graph calls, lookups, tokens saved, workspaces (one at least) and languages."""
    sums = digests.agg(F.count("*").alias("sessions"), F.sum("steps").alias("steps"), F.sum("tool_calls").alias("tool_calls"), F.greatest(F.lit(1), F.count_distinct("workspace")).alias("workspaces"))
    caps = capabilities.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("graph_calls"), F.coalesce(F.sum(F.when(F.col("lookup"), F.col("n"))), F.lit(0)).alias("lookups"))
    langs = languages.agg(F.count_distinct("language").alias("languages"))
    row = sums.crossJoin(caps).crossJoin(langs)  # one row each
    return row.withColumn("tokens_saved", telemetry.tokens_saved(F.col("graph_calls"), F.col("lookups")))


def tool_breakdown(tools: DataFrame, capabilities: DataFrame, categories: dict[str, str]) -> DataFrame:
    """(name, category, n): tools with the category of a table, and graph capabilities, most used first."""
    lookup = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]) if categories else None
    own = tools.groupBy(F.col("tool").alias("name")).agg(F.sum("n").alias("n")).withColumn("category", F.coalesce(lookup[F.col("name")], F.lit("other")) if lookup is not None else F.lit("other"))
    caps = capabilities.groupBy(F.col("capability").alias("name")).agg(F.sum("n").alias("n"), F.first("category").alias("category"))
    return own.unionByName(caps).orderBy(F.desc("n"), "name")


def language_breakdown(paths: DataFrame) -> DataFrame:
    """(language, n, percent) of the accepted files among ``path``."""
    n = paths.select(telemetry.language_of(F.col("path")).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("n"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over one row a language
    return n.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(whole), 1)).orderBy(F.desc("n"), "language")


def workspace_breakdown(digests: DataFrame, skip: tuple[str, ...] = ("default", "global")) -> DataFrame:
    """(workspace, sessions, tool_calls), most sessions first."""
    own = digests.where(~F.lower("workspace").isin(*skip))
    return own.groupBy("workspace").agg(F.count_distinct("session_id").alias("sessions"), F.sum("tool_calls").alias("tool_calls")).orderBy(F.desc("sessions"), F.desc("tool_calls"), "workspace")


def fleet_total(spaces: DataFrame) -> DataFrame:
    """(parent, nodes): the nodes of a workspace and its worktrees."""
    return spaces.groupBy(F.coalesce("parent_workspace", "name").alias("parent")).agg(F.sum("nodes").alias("nodes"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def workspaces(nodes: DataFrame, meta: DataFrame | None = None, fold: dict[str, str] | None = None) -> DataFrame:
    """(workspace, nodes, languages, files, root_path), by name; blank and reserved names are skipped, folded ones merged."""
    name = F.trim("workspace")
    for old, new in (fold or {}).items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    own = nodes.where(F.trim(F.coalesce("workspace", F.lit(""))) != "").withColumn("workspace", name).where(~F.col("workspace").isin("default", "global"))
    out = own.groupBy("workspace").agg(F.count("*").alias("nodes"), F.sort_array(F.collect_set("language")).alias("languages"), F.count_distinct("file_path").alias("files"))
    if meta is not None:
        out = out.join(meta.select("workspace", "root_path"), "workspace", "left").withColumn("root_path", F.coalesce("root_path", F.concat(F.lit("/"), "workspace")))
    return out.orderBy("workspace")


def may_read(path: Column, n_lines: Column, seconds_since_lookup: Column) -> Column:
    """Whether a read is allowed: short enough for its kind, or soon after a graph lookup."""
    document = T.extension(path).isin("md", "markdown", "txt", "rst")
    return F.coalesce(seconds_since_lookup <= RECENT_S, F.lit(False)) | (n_lines <= F.when(document, DOC_LINES).otherwise(CODE_LINES))
