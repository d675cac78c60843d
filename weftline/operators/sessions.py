"""Session operators over transcript steps: rollup, filters, search, statistics, work-in-progress digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as T
from weftline.operators.substrings import holding
from weftline.session import materialize, spread

WRITE_TOOLS = ("write_to_file", "replace_file_content", "multi_replace_file_content")
COMMAND_TOOL = "run_command"


def rollup(steps: DataFrame) -> DataFrame:
    """One row a session: counts, times, errors, tools by name and the first prompt.

    Steps (session_id, step_index, source, type, status, created_at, content,
    tool_calls array<struct<name, args>>).  Tools are counted by (session, name) before
    they are gathered, so a session's map is as long as its tool names are many.
    """
    agent, user = F.col("type") == "PLANNER_RESPONSE", (F.col("type") == "USER_INPUT") & (F.col("source") == "USER_EXPLICIT")
    n_tools = F.coalesce(F.size("tool_calls"), F.lit(0))
    main = steps.groupBy("session_id").agg(
        F.count("*").alias("step_count"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("last_message_at"),
        F.count_if(user).alias("user_message_count"),
        F.count_if(agent).alias("agent_response_count"),
        F.sum(F.when(agent & (n_tools > 0), n_tools).otherwise(0)).alias("tool_call_count"),
        F.count_if((F.col("status") == "ERROR") | (F.col("type") == "ERROR_MESSAGE")).alias("error_count"),
        F.min_by(F.when(user, T.user_prompt(F.col("content"))), F.when(user, F.col("step_index"))).alias("first_user_prompt_preview"),
    )
    tools = steps.where(agent).select("session_id", F.explode("tool_calls.name").alias("tool")).groupBy("session_id", "tool").count()
    maps = tools.groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "count")))).alias("tool_calls_map"))
    return main.join(maps, "session_id", "left")


def tool_counts(steps: DataFrame) -> DataFrame:
    """(session_id, tool, n) in long form."""
    return steps.select("session_id", F.explode("tool_calls.name").alias("tool")).groupBy("session_id", "tool").agg(F.count("*").alias("n"))


def project_scores(steps: DataFrame, known: DataFrame) -> DataFrame:
    """(session_id, project, score) from prompt mentions (10), metadata workspaces (15), known paths (20), parent folders (25) and derived names (15).

    ``known`` (name, path) may have any number of rows: what holds which name or path is
    found by keys.  Prompts and paths are taken out of the steps once, by all cores; a
    project made from a path is a generated column, as filters on it would make it again.
    """
    known = known.select("name", "path").withColumn("_row", F.monotonically_increasing_id())
    named = known.select("name", F.lower("name").alias("_name"), F.concat(F.lit("/"), "name", F.lit("/")).alias("_folder"), "path", "_row")
    prompts = steps.where((F.col("type") == "USER_INPUT") & (F.col("source") == "USER_EXPLICIT"))
    made = lambda path: F.explode(F.array(T.project_name(path)))
    prompts = materialize(spread(prompts.select("session_id", "content")).select("session_id", F.lower("content").alias("text"), made(T.workspace_of(F.col("content"))).alias("project")), "prompts")
    lower = prompts.select("session_id", "text")
    told = holding(lower, named.select(F.col("_name").alias("needle")))
    mention = lower.join(told, "text").join(named, F.col("needle") == F.col("_name")).select("session_id", F.col("name").alias("project"), F.lit(10).alias("score"))
    stated = prompts.where("project != 'Default'").select("session_id", "project", F.lit(15).alias("score"))
    args = ("Cwd", "DirectoryPath", "SearchPath", "TargetFile", "AbsolutePath", "TargetDirectory")
    calls = spread(steps.where("type = 'PLANNER_RESPONSE'").select("session_id", "tool_calls")).select("session_id", F.explode("tool_calls").alias("c"))
    paths = calls.select("session_id", F.explode(F.array(*[F.regexp_replace(F.get_json_object("c.args", f"$.{a}"), "^[\"']+|[\"']+$", "") for a in args])).alias("p")).where("p rlike '^[/~]'")
    paths = materialize(paths, "paths")
    # a folder's name is in a path, or at its end, where the path with a slash behind it holds the name between slashes
    closed = holding(paths.select(F.concat("p", F.lit("/")).alias("text")), named.select(F.col("_folder").alias("needle")))
    by_name = closed.join(named, F.col("needle") == F.col("_folder")).select(F.expr("left(text, length(text) - 1)").alias("_p"), "_row", "name")
    by_path = holding(paths.select(F.col("p").alias("text")), named.select(F.col("path").alias("needle"))).join(named, F.col("needle") == F.col("path")).select(F.col("text").alias("_p"), "_row", "name")
    inside = by_name.unionByName(by_path).distinct()
    hit = paths.join(inside, F.col("p") == F.col("_p")).select("session_id", F.col("name").alias("project"), F.lit(20).alias("score"))
    none = paths.join(inside.select("_p"), F.col("p") == F.col("_p"), "left_anti")
    other = none.select("session_id", made(F.col("p")).alias("project"), F.when(F.col("p").rlike("/(" + "|".join(T.PROJECT_PARENTS) + ")/"), 25).otherwise(15).alias("score")).where("project != 'Default'")
    votes = mention.unionByName(stated).unionByName(hit).unionByName(other)
    return votes.where(T.valid_workspace(F.col("project"))).groupBy("session_id", "project").agg(F.sum("score").alias("score"))


def best_projects(scores: DataFrame) -> DataFrame:
    """(session_id, project_name, projects_touched): the highest score, the first name of equal ones; all names by score."""
    order = F.struct((-F.col("score")).alias("s"), F.col("project").alias("p"))
    return scores.groupBy("session_id").agg(F.min(order)["p"].alias("project_name"), F.transform(F.sort_array(F.collect_list(order)), lambda x: x["p"]).alias("projects_touched"))


def matches_workspace(query: str) -> Column:
    """Case-insensitive substring of workspace, project or any project touched."""
    q = F.lit(query.lower())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    return has(F.col("workspace")) | has(F.col("project_name")) | F.coalesce(F.exists("projects_touched", lambda x: F.contains(F.lower(x), q)), F.lit(False))


def lifetime_overlaps(start: Column, end: Column, begin: Column | None = None, until: Column | None = None) -> Column:
    """Whether [start, end or start] meets [begin, until]; null bounds are open."""
    out = F.lit(True)
    if begin is not None:
        out &= begin.isNull() | (F.coalesce(end, start) >= begin)
    if until is not None:
        out &= until.isNull() | (start <= until)
    return out


def list_sessions(sessions: DataFrame, workspace: str = "", runtime: str = "", begin: Column | None = None, until: Column | None = None, sort_by: str = "date", descending: bool = True) -> DataFrame:
    """Filtered and sorted sessions; ``sort_by`` is date, steps, size or messages, with the id as tie-break."""
    out = sessions
    if workspace:
        out = out.where(matches_workspace(workspace))
    if runtime:
        out = out.where((F.lower("runtime_mode") == runtime.lower()) | (F.lower("provider") == runtime.lower()))
    out = out.where(lifetime_overlaps(F.col("created_at"), F.col("last_message_at"), begin, until))
    keys = {"date": F.coalesce("last_message_at", "created_at"), "steps": F.col("step_count"), "size": F.col("transcript_size_bytes"), "messages": F.col("user_message_count") + F.col("agent_response_count")}
    key = keys.get(sort_by, F.col("created_at"))
    down = descending or sort_by == "messages" or sort_by not in keys
    return out.orderBy(key.desc() if down else key.asc(), "session_id")


def searched_text() -> Column:
    """What a search looks through: prompts without their tags, other texts as they are."""
    return F.when((F.col("type") == "USER_INPUT") & (F.col("source") == "USER_EXPLICIT"), T.user_prompt(F.col("content"))).otherwise(F.col("content"))


def search(steps: DataFrame, query: str, kind: str = "", limit: int = 100) -> DataFrame:
    """The newest ``limit`` steps whose text holds the query; ``indexes.search`` finds them without reading all."""
    n_tools = F.coalesce(F.size("tool_calls"), F.lit(0)) if "tool_calls" in steps.columns else F.lit(0)
    found = steps.where(T.message_filter(kind, F.col("type"), F.col("content"), n_tools)).withColumn("body", searched_text())
    return newest(found.where((F.trim("body") != "") & (F.instr(F.lower("body"), query.lower()) > 0)), query, limit)


def newest(hits: DataFrame, query: str, limit: int) -> DataFrame:
    """The newest of the steps that hold a query, with previews; ``total_count`` counts the rows after the limit."""
    top = hits.orderBy(F.desc_nulls_last("created_at"), "session_id", "step_index").limit(limit)
    counted = F.count("*").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # over the limit's rows
    return top.select("session_id", "step_index", "type", "created_at", T.search_preview(F.col("body"), query).alias("preview"), counted.alias("total_count"))


def detail(steps: DataFrame, session_id: str) -> DataFrame:
    """The displayable messages of a session in order, with prompts cleaned and argument previews."""
    own = steps.where((F.col("session_id") == session_id) & F.col("type").isin(*T.DISPLAYABLE))
    body = F.when((F.col("type") == "USER_INPUT") & (F.col("source") == "USER_EXPLICIT"), T.user_prompt(F.col("content"))).otherwise(F.col("content"))
    tools = F.transform("tool_calls", lambda c: F.struct(c["name"].alias("name"), T.args_preview(c["args"]).alias("args_preview")))
    return own.select("step_index", "source", "type", "status", "created_at", body.alias("content"), (F.coalesce("thinking", F.lit("")) != "").alias("has_thinking"), tools.alias("tool_calls")).orderBy("step_index")


def export_markdown(steps: DataFrame) -> DataFrame:
    """(session_id, markdown): the displayable steps of each session under headings."""
    shown = steps.where(F.col("type").isin(*T.DISPLAYABLE))
    part = F.concat(F.lit("## "), F.col("step_index").cast("string"), F.lit(" "), F.col("type"), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    return shown.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step_index", part.alias("p")))), lambda x: x["p"]), "\n").alias("markdown"))


def export_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def totals(sessions: DataFrame) -> DataFrame:
    """One row: counts over all sessions and the range of their starts."""
    return sessions.agg(F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in ("step_count", "user_message_count", "agent_response_count", "tool_call_count", "error_count")], F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def project_summaries(sessions: DataFrame, known: DataFrame | None = None, prompts: int = 3) -> DataFrame:
    """Each project with its sessions, last activity and its most recent distinct prompts; known projects without sessions too."""
    last = F.coalesce("last_message_at", "created_at")
    main = sessions.groupBy("project_name").agg(F.count("*").alias("session_count"), F.max(last).alias("last_active"), F.sum("step_count").alias("steps"))
    newest = sessions.where(F.coalesce("first_user_prompt_preview", F.lit("")) != "").groupBy("project_name", F.col("first_user_prompt_preview").alias("prompt")).agg(F.max(last).alias("at"))
    rank = F.row_number().over(Window.partitionBy("project_name").orderBy(F.desc("at"), "prompt"))
    recent = newest.withColumn("r", rank).where(F.col("r") <= prompts).groupBy("project_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "prompt"))), lambda x: x["prompt"]).alias("recent_prompts"))
    out = main.join(recent, "project_name", "left")
    if known is not None:
        out = out.join(known.select(F.col("name").alias("project_name")), "project_name", "full_outer")
    out = out.withColumn("session_count", F.coalesce("session_count", F.lit(0)))
    return out.orderBy((F.col("session_count") > 0).desc(), F.desc("session_count"), F.desc_nulls_last("last_active"), "project_name")


def top_tools(counts: DataFrame, limit: int = 12) -> DataFrame:
    return counts.groupBy("tool").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tool").limit(limit)


def top_prompts(prompts: DataFrame, limit: int = 10, width: int = 120) -> DataFrame:
    """The most frequent prompts (column ``prompt``), trimmed, longer than 3, cut with dots."""
    bare = F.trim("prompt")
    cut = F.when(F.length(bare) > width, F.concat(F.left(bare, F.lit(width)), F.lit("..."))).otherwise(bare)
    return prompts.where(F.length(bare) > 3).select(cut.alias("prompt")).groupBy("prompt").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prompt").limit(limit)


def wip_candidates(sessions: DataFrame, workspace: str = "", limit: int = 5) -> DataFrame:
    """The newest sessions that match, with the number of all that do."""
    own = sessions.where(matches_workspace(workspace)) if workspace.strip() else sessions
    total = own.agg(F.count("*").alias("total_matches"))
    last = F.coalesce("last_message_at", "created_at")
    top = own.withColumn("last_active", last).orderBy(F.desc_nulls_last("last_active"), "session_id").limit(max(1, min(limit, 50)))
    return top.crossJoin(F.broadcast(total))  # one row


def wip_status(sessions: DataFrame, workspace: str = "", session_id: str | None = None, force_latest: bool = False) -> DataFrame:
    """(status, session_id): resolved, ambiguous_multi_session or not_found."""
    own = sessions.where(F.col("session_id") == session_id) if session_id else (sessions.where(matches_workspace(workspace)) if workspace.strip() else sessions)
    found = own.agg(F.count("*").alias("n"), F.max_by("session_id", F.struct(F.coalesce("last_message_at", "created_at"), "session_id")).alias("newest"))
    status = F.when(F.col("n") == 0, "not_found").when((F.col("n") > 1) & F.lit(not force_latest), "ambiguous_multi_session").otherwise("resolved")
    return found.select(status.alias("status"), F.when(status == "resolved", F.col("newest")).alias("session_id"), F.col("n").alias("matches"))


def last_of(steps: DataFrame, where: Column, n: int = 3) -> DataFrame:
    """The last ``n`` steps of each session for which ``where`` holds, oldest first by ``rank_from_end``."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("step_index")))
    return steps.where(where).withColumn("rank_from_end", rank).where(F.col("rank_from_end") <= n)


def recent_prompts(steps: DataFrame, n: int = 3) -> DataFrame:
    return last_of(steps, (F.col("type") == "USER_INPUT") & (F.trim("content") != ""), n)


def recent_responses(steps: DataFrame, n: int = 3, width: int = 1000) -> DataFrame:
    return last_of(steps, (F.col("type") == "PLANNER_RESPONSE") & (F.trim("content") != ""), n).withColumn("content", F.left("content", F.lit(width)))


def recent_errors(steps: DataFrame, n: int = 3, width: int = 250) -> DataFrame:
    return last_of(steps, (F.col("status") == "ERROR") | (F.col("type") == "ERROR_MESSAGE"), n).withColumn("content", F.left("content", F.lit(width)))


def last_tool_calls(steps: DataFrame, n: int = 5) -> DataFrame:
    """The last calls of each session: later steps first, the calls of a step in their order."""
    calls = steps.select("session_id", "step_index", F.posexplode("tool_calls").alias("pos", "call"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("step_index"), "pos"))
    return calls.withColumn("rank", rank).where(F.col("rank") <= n).select("session_id", "rank", "step_index", F.col("call.name").alias("tool"), T.args_preview(F.col("call.args"), 120).alias("args_preview"))


def latest_distinct(steps: DataFrame, tools: tuple[str, ...] = WRITE_TOOLS, keys: tuple[str, ...] = ("TargetFile", "AbsolutePath")) -> DataFrame:
    """(session_id, value, last_step): arguments of some tools, each once, the most recent first."""
    calls = steps.select("session_id", "step_index", F.explode("tool_calls").alias("c")).where(F.col("c.name").isin(*tools))
    value = F.coalesce(*[F.get_json_object("c.args", f"$.{k}") for k in keys])
    return calls.select("session_id", "step_index", value.alias("value")).where("value is not null").groupBy("session_id", "value").agg(F.max("step_index").alias("last_step")).orderBy("session_id", F.desc("last_step"), "value")


def continuation(last_prompt: Column, modified: Column) -> Column:
    """What a resumed session is told: its last prompt, cut to 100 characters and quoted, and how many files were changed."""
    cut = F.when(F.length(last_prompt) > 100, F.concat(F.left(last_prompt, F.lit(100)), F.lit("..."))).otherwise(last_prompt)
    quoted = cut
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(shown))
    told = F.format_string('Last prompt was: "%s". %d files modified.', quoted, modified)
    return F.when(last_prompt.isNull(), F.lit("Ready to resume work on active workspace.")).otherwise(told)


def project_totals(sessions: DataFrame, project: str) -> DataFrame:
    """One row: the sums over the sessions of one project."""
    return totals(sessions.where(F.col("project_name") == project))
