"""Sources, sinks, reports and the remaining scalars on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.api import CodeGraph
from weftline.functions import text as T
from weftline.operators import coloured_lpa, graph, listings, sessions, store, telemetry
from weftline.plans.registry import query
from weftline.plans.session_queries import _SESSIONS_SQL, _sessions
from weftline.plans.views import GRAPH_SQL, STEPS_SQL, calls, event_steps, steps, table, trade_edges, trade_nodes
from weftline.session import scratch_path
from weftline.sources import files as source_files
from weftline.sources import transcripts
from weftline.streaming import events as ev
from weftline.streaming import sync

_G, _S = "with recursive " + GRAPH_SQL, "with " + STEPS_SQL


def _str(c: str):
    return F.col(c).cast("string")


@query(_S + """select session_id, case when step_index % 5 <> 4 then step_index end as step_index, case when step_index % 5 <> 4 then type end as type, case when step_index % 5 not in (3, 4) then content end as content,
  step_index % 5 in (2, 4) as malformed from steps where content is not null""")
def transcript_lines(spark, d):
    """JSON lines: whole ones, some without content, some with a time that does not parse, some that are no JSON."""
    s = steps(spark, d).where("content is not null")
    n = F.col("step_index") % 5
    at = F.when(n == 2, "not a time").otherwise("2026-09-18T10:00:00Z")
    line = F.to_json(F.struct("step_index", "type", at.alias("created_at"), F.when(n != 3, F.col("content")).alias("content")))
    lines = s.select("session_id", F.when(n == 4, F.lit("not-a-valid-json-line")).otherwise(line).alias("value"))
    return transcripts.parse_lines(lines, ["session_id"]).select("session_id", "step_index", "type", "content", "malformed")


@query("""select conv_id::varchar as session_id, '/s/' || conv_id || case when conv_id % 3 = 0 then '/transcript_full.jsonl' when conv_id % 3 = 1 then '/transcript.jsonl' else '/transcript_full.jsonl' end as file from (select distinct conv_id from conversations)""")
def transcript_choice(spark, d):
    """Sessions with the short file, the full one, or both, where the full one is preferred."""
    c = table(spark, d, "conversations").select("conv_id").distinct()
    short, full = F.when(F.col("conv_id") % 3 != 0, transcripts.SHORT), F.when(F.col("conv_id") % 3 != 1, transcripts.FULL)
    named = c.select(_str("conv_id").alias("session_id"), F.explode(F.array_compact(F.array(short, full))).alias("name"))
    listed = named.withColumn("file", F.concat_ws("/", F.lit("/s"), "session_id", "name"))
    return transcripts.choose(listed, prefer_full=True).select("session_id", "file")


@query("""select conv_id::varchar as session_id, turn as step_index, case when conv_id % 2 = 0 then 0 else 1 end as priority from conversations""")
def first_location_wins(spark, d):
    s = steps(spark, d).select("session_id", "step_index")
    first = s.where("cast(session_id as long) % 2 = 0").withColumn("priority", F.lit(0))
    return transcripts.first_location(first.unionByName(s.withColumn("priority", F.lit(1)))).select("session_id", "step_index", "priority")


@query("""select 'Proj' || c_custkey as name, case when c_custkey % 2 = 0 then '/a/Proj' else '/b/Proj' end || c_custkey as path from customer""")
def known_project_folders(spark, d):
    """Folders below two parents, the first of which has every second name; hidden, skipped and deeper ones are none."""
    key = _str("c_custkey")
    c = table(spark, d, "customer")
    b = c.select(F.concat(F.lit("/b/Proj"), key).alias("path"))
    a = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("/a/Proj"), key).alias("path"))
    other = c.select(F.explode(F.array(F.concat(F.lit("/a/.h"), key), F.concat(F.lit("/a/_h"), key), F.lit("/a/src"), F.lit("/b/Library"), F.concat(F.lit("/c/Proj"), key), F.concat(F.lit("/a/x/Proj"), key))).alias("path"))
    return transcripts.known_projects(b.unionByName(a).unionByName(other), ["/a", "/b/"])


@query(_G + ", n as (select id from nodes where kind = 'supplier' or community % 2 = 0) select (select count(*) from n) as nodes, (select count(*) from edges where source in (select id from n)) as edges")
def graph_of_workspace(spark, d):
    nodes = trade_nodes(spark, d).withColumn("workspace", F.when((F.col("kind") == "supplier") | (F.col("community") % 2 == 0), "own").otherwise("other"))
    own, links = CodeGraph(nodes, trade_edges(spark, d)).graph("own")
    return own.agg(F.count("*").alias("nodes")).crossJoin(links.agg(F.count("*").alias("edges")))  # one row each


@query("select 'wt' || n_nationkey as worktree_name, '/w/wt' || n_nationkey as root_path, case when n_nationkey % 3 = 0 then null else 'b' || n_nationkey end as branch from nation where n_nationkey % 2 = 0")
def parent_worktree_entries(spark, d):
    n, key = table(spark, d, "nation"), _str("n_nationkey")
    entries = n.select(F.concat(F.lit("/repo/.git/worktrees/wt"), key, F.lit("/gitdir")).alias("path"), F.concat(F.lit("/w/wt"), key, F.lit("/.git\n")).alias("gitdir"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("0123abcd")).otherwise(F.concat(F.lit("ref: refs/heads/b"), key)).alias("head"))
    there = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("/w/wt"), key).alias("path"))
    return source_files.parent_worktrees(entries, there).select("worktree_name", "root_path", "branch")


@query("""with l as (select 'dir' || s_suppkey as name, s_suppkey % 3 as m from supplier union all select '.github', 9)
select name, case m when 0 then 'rust' when 1 then 'go,python' else '' end as languages, m in (0, 1) as is_codebase from l""")
def browse_folders(spark, d):
    """Folders with and without code markers; hidden and build folders aren't shown."""
    s = table(spark, d, "supplier")
    base = F.concat(F.lit("/root/dir"), _str("s_suppkey"))
    m = F.col("s_suppkey") % 3
    marks = F.when(m == 0, F.array(F.lit("/Cargo.toml"))).when(m == 1, F.array(F.lit("/go.mod"), F.lit("/pyproject.toml"))).otherwise(F.array(F.lit("/notes.txt")))
    inner = s.select(F.explode(F.transform(marks, lambda x: F.concat(base, x))).alias("path"), F.lit(False).alias("is_dir"))
    more = spark.createDataFrame([("/root/.github", True), ("/root/.git", True), ("/root/target", True), ("/root/file.txt", False), ("/elsewhere/x", True)], "path string, is_dir boolean")
    listing = s.select(base.alias("path"), F.lit(True).alias("is_dir")).unionByName(inner).unionByName(more)
    return source_files.browse(listing, "/root", ["/root"]).select("name", F.array_join("languages", ",").alias("languages"), "is_codebase")


@query("""select c_nationkey::varchar as workspace, case when c_nationkey % 2 = 0 then c_acctbal else c_custkey::double end as value from customer""")
def replace_galaxies(spark, d):
    """A table written by workspace, of which some workspaces are written again: the others stay."""
    path = scratch_path(spark, "galaxies")
    c = table(spark, d, "customer").select(_str("c_nationkey").alias("workspace"), "c_custkey", "c_acctbal")
    store.write_partitions(c.select("workspace", F.col("c_custkey").cast("double").alias("value")), path)
    store.write_partitions(c.where("cast(workspace as int) % 2 = 0").select("workspace", F.col("c_acctbal").alias("value")), path)
    return spark.read.schema("value double, workspace string").parquet(path).select("workspace", "value")


@query("select event_type as capability, count(*) * 2 as n, true as told from events group by 1")
def append_calls(spark, d):
    """Two appends of telemetry; one to where it can't go reports so and stops nothing."""
    path = scratch_path(spark, "calls")
    rows = calls(spark, d).select("capability", "workspace")
    told = [store.append(rows, path), store.append(rows, path), not store.append(rows, "nowhere://x/y")]
    return spark.read.parquet(path).groupBy("capability").agg(F.count("*").alias("n")).withColumn("told", F.lit(all(told)))


@query("select user_id::varchar as workspace, count(*) as n from events group by 1")
def pushed_events(spark, d):
    """A stream of events handed to a sink some rows at a time, which counts them by workspace, in the tasks that hold them."""

    def sink(rows):
        return rows.groupby("workspace", dropna=False).size().reset_index(name="n")

    path = scratch_path(spark, "receipts")
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    sync.push_from_tasks(source.select(_str("user_id").alias("workspace")), sink, "workspace string, n long", path, scratch_path(spark, "push"), trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema("workspace string, n long").parquet(path).groupBy("workspace").agg(F.sum("n").alias("n"))


@query("""with k as (select c_nationkey as community, c_name, row_number() over (partition by c_nationkey order by c_name) as r from customer)
select community, string_agg(c_name, ', ' order by c_name) as samples from k where r <= 4 group by community""")
def report_samples(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("community")).agg(F.sort_array(F.collect_list("c_name")).alias("samples"))
    return listings.report(c)


_DIGESTS_SQL = """
dg as (select user_id::varchar as session_id, 'Ws' || user_id % 7 as workspace, 'Prompt ' || user_id as prompt, case when user_id % 2 = 0 then 'Go' else 'Rust' end as language,
  count(*) as steps, count(*) filter (event_type = 'click') as graph_calls, max(event_type) as tool, min(ts) as created_at from events group by user_id)
"""


@query("with " + _DIGESTS_SQL + "select session_id, steps from dg where workspace = 'Ws3' and language = 'Go' and graph_calls > 0 and contains(lower(tool), 'vie') and contains(lower(prompt), 'pt 1')")
def filter_sessions(spark, d):
    e = table(spark, d, "events").withColumn("session_id", _str("user_id"))
    g = e.groupBy("session_id").agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "click").alias("graph_calls"), F.array(F.max("event_type")).alias("tools"), F.min("ts").alias("created_at"))
    n = F.col("session_id").cast("long")
    rows = g.withColumns({"workspace": F.concat(F.lit("Ws"), (n % 7).cast("string")), "prompt": F.concat(F.lit("Prompt "), "session_id"), "languages": F.when(n % 2 == 0, F.array(F.lit("Go"))).otherwise(F.array(F.lit("Rust"))), "tool_calls": F.col("steps")})
    return listings.filter_sessions(rows, "Ws3", "Go", True, ("VIE",), "PT 1", "steps").select("session_id", "steps")


_COUPLING_SQL = """
pairs as (select s.community as a, t.community as b from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target),
mt as (select c.community, c.node_count, (select count(*) from pairs where a = c.community and b = c.community) as internal_edges, (select count(*) from pairs where b = c.community and a <> b) as afferent, (select count(*) from pairs where a = c.community and a <> b) as efferent
  from (select community, count(*) as node_count from nodes group by community) c),
nm as (select community, min(label) as first, 'root (' || min(label) || ')' as name from nodes group by community)
"""


@query(_G + ", " + _COUPLING_SQL + "select community, node_count, internal_edges, afferent, efferent, name from mt join nm using (community)")
def topology_report(spark, d):
    return listings.topology(trade_nodes(spark, d), trade_edges(spark, d))[0].select("community", "node_count", "internal_edges", "afferent", "efferent", "name")


@query(_G + ", " + _COUPLING_SQL + "select community, node_count from mt join nm using (community) where node_count >= 3 and contains(lower(name), '#0000000') and case when afferent + efferent = 0 then 0.5 else efferent / (afferent + efferent) end > 0.65")
def filter_communities(spark, d):
    found = listings.topology(trade_nodes(spark, d), trade_edges(spark, d))[0]
    return listings.filter_communities(found, "Orchestrator / Leaf", "#0000000", 3, "coupling").select("community", "node_count")


@query("with p as (select user_id as job, event_type as phase, event_id as done, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as r, min(ts) over (partition by user_id) as started_at from events) select job, phase, done, started_at from p where r = 1")
def ingestion_progress(spark, d):
    jobs = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("phase"), F.col("event_id").alias("done"), F.struct("ts", "event_id").alias("at"))
    return sync.progress(jobs).select("job", "phase", "done", F.col("started_at.ts").alias("started_at"))


@query("with " + _SESSIONS_SQL + ", p as (select project_name, count(*) as session_count, sum(step_count)::bigint as steps from s group by 1 union all select 'Idle', 0, 1000000000) select project_name, session_count, steps, row_number() over (order by session_count > 0 desc, steps desc, project_name) as place from p")
def sort_projects(spark, d):
    p = sessions.project_summaries(_sessions(spark, d)).select("project_name", "session_count", "steps").unionByName(spark.createDataFrame([("Idle", 0, 10**9)], "project_name string, session_count long, steps long"))
    ordered = listings.sort_projects(p.withColumns({"messages": F.lit(0), "tools": F.lit(0), "last_active": F.lit(None).cast("timestamp")}), "steps")
    place = F.monotonically_increasing_id()  # the projects of an ordered list, a row each
    return ordered.coalesce(1).select("project_name", "session_count", "steps", (place + 1).alias("place"))


@query("select doc_id, replace(regexp_replace(text, '[\\x00-\\x09\\x0B-\\x1F\\x7F]', '', 'g'), chr(10), ' ') as stored from documents")
def stored_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stored_text(F.col("text")).alias("stored"))


@query("""select p_partkey, case p_size % 6 when 0 then 'Engine' when 1 then 'Tool' || p_partkey when 2 then 'dir' || p_partkey when 3 then null when 4 then null else 'Engine' end as workspace from part""")
def canonical_workspaces(spark, d):
    """A known part, the folder of a path, the folder of a file, a blocked word, a bare word, and a known part within marks."""
    key = _str("p_partkey")
    kind = F.col("p_size") % 6
    value = F.when(kind == 0, F.concat(F.lit("/x/ENGINE/"), key)).when(kind == 1, F.concat(F.lit("/x/Tool"), key, F.lit("/"))).when(kind == 2, F.concat(F.lit("/x/dir"), key, F.lit("/a.rs"))).when(kind == 3, "tmp").when(kind == 4, "word").otherwise("'my-engine';")
    return table(spark, d, "part").select("p_partkey", telemetry.canonical_workspace(value, (("engine", "Engine"),), ("tmp",)).alias("workspace"))


@query("""select p_partkey, case p_size % 5 when 0 then 'P' || p_partkey when 1 then 'Q' || p_partkey when 2 then 'Engine' when 3 then null else 'P' || p_partkey end as workspace from part""")
def command_workspaces(spark, d):
    """``PROJECT=``, ``workspace=``, a known word among others, none, and both, of which the first counts."""
    key = _str("p_partkey")
    kind = F.col("p_size") % 5
    line = F.when(kind == 0, F.concat(F.lit("make graph PROJECT='/x/P"), key, F.lit("' now"))).when(kind == 1, F.concat(F.lit("curl host/api?q=1&workspace=/y/Q"), key, F.lit("&k=2"))).when(kind == 2, "tool.sh symbol Thing 'engine', -x").when(kind == 3, "tool.sh symbol Thing --engine").otherwise(F.concat(F.lit("curl workspace=/y/Q PROJECT=/x/P"), key))
    return table(spark, d, "part").select("p_partkey", telemetry.command_workspace(line, (("engine", "Engine"),)).alias("workspace"))


@query("""with v as (select user_id::varchar as session_id, case event_type when 'click' then 'P' || event_id % 3 when 'view' then 'W' || event_id % 3 else 'F' || event_id % 3 end as workspace, case event_type when 'click' then 4 else 1 end as w from events),
s as (select session_id, workspace, sum(w) as w from v group by all) select session_id, arg_min(workspace, (-w, workspace)) as workspace from s group by session_id""")
def session_workspaces(spark, d):
    """The votes of commands, their folders and the paths of tools: a graph command with a project counts for both its rules."""
    e = table(spark, d, "events")
    n = (F.col("event_id") % 3).cast("string")
    args = F.when(F.col("event_type") == "click", F.to_json(F.struct(F.concat(F.lit("graph-symbol x PROJECT=/p/P"), n).alias("CommandLine")))).when(F.col("event_type") == "view", F.to_json(F.struct(F.lit("ls").alias("CommandLine"), F.concat(F.lit("/w/W"), n).alias("Cwd")))).otherwise(F.to_json(F.struct(F.concat(F.lit("/w/F"), n, F.lit("/a.py")).alias("AbsolutePath"))))
    tool = F.when(F.col("event_type").isin("click", "view"), "run_command").otherwise("view_file")
    s = e.select(_str("user_id").alias("session_id"), F.array(F.struct(tool.alias("name"), args.alias("args"))).alias("tool_calls"))
    return telemetry.vote(telemetry.workspace_votes(s, ("graph",)), "session_id", "workspace", "weight", "default")


@query("""select o_orderkey, case o_orderkey % 4 when 0 then o_orderdate::date::timestamp when 1 then o_orderdate::date::timestamp + interval 1 day - interval 1 microsecond when 2 then date_trunc('second', o_orderdate) end as at from orders""")
def parse_dates(spark, d):
    """The start of a day, its end, a timestamp of a known layout, and no date."""
    o = table(spark, d, "orders")
    kind, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    value = F.when(kind < 2, day).when(kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return o.select("o_orderkey", F.when(kind == 1, T.parse_date(value, True)).otherwise(T.parse_date(value)).alias("at"))


@query("select s_suppkey, 'Basic ' || base64((s_name || ':pass' || s_suppkey)::blob) as header from supplier")
def authorization_headers(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.basic_authorization(F.col("s_name"), F.concat(F.lit("pass"), _str("s_suppkey"))).alias("header"))


@query("select doc_id, case when doc_id % 3 = 0 then source || '/' || doc_id end as rel from documents")
def relative_paths(spark, d):
    """Below the root, at it, and beside it under a name that begins alike."""
    kind = F.col("doc_id") % 3
    path = F.when(kind == 0, F.concat(F.lit("/r/x/"), "source", F.lit("/"), _str("doc_id"))).when(kind == 1, "/r/x/").otherwise("/r/xy/a")
    return table(spark, d, "documents").select("doc_id", T.relative_path(path, "/r/x").alias("rel"))


@query("""select conv_id, turn, case when turn % 3 = 0 then 'Ready to resume work on active workspace.' else 'Last prompt was: "' || replace(replace(replace(replace(case when length(text) > 100 then left(text, 100) || '...' else text end, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '". ' || turn || ' files modified.' end as told from conversations""")
def continuations(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", sessions.continuation(F.when(F.col("turn") % 3 != 0, F.col("text")), F.col("turn").cast("long")).alias("told"))


@query(_S + ", f as (select min(session_id::bigint)::varchar as s from steps) select step_index, type, case when type = 'USER_INPUT' then trim(content, ' ' || chr(10) || chr(9) || chr(13)) else content end as content, 'p' || step_index as preview from steps, f where session_id = s and type in ('USER_INPUT', 'PLANNER_RESPONSE')")
def session_detail(spark, d):
    s = steps(spark, d)
    first = s.agg(F.min(F.col("session_id").cast("long"))).first()[0]
    calls_ = F.array(F.struct(F.lit("t").alias("name"), F.concat(F.lit("p"), _str("step_index")).alias("args")))
    full = s.withColumns({"status": F.lit("DONE"), "created_at": F.lit(None).cast("timestamp"), "thinking": F.lit(None).cast("string"), "tool_calls": calls_})
    return sessions.detail(full, str(first)).select("step_index", "type", "content", F.col("tool_calls")[0]["args_preview"].alias("preview"))


@query("select n_nationkey, n_name from nation")
def export_rows(spark, d):
    """Rows as JSON text, read again."""
    out = sessions.export_json(table(spark, d, "nation").select("n_nationkey", "n_name"))
    return out.select(F.inline(F.array(F.from_json("json", "n_nationkey int, n_name string"))))


_PROJECT_SQL = """
k as (select n_name as name, '/repos/' || n_name as path from nation),
c as (select c_custkey, c_nationkey, n_name, (select min(n_name) from nation) as first_name from customer join nation on n_nationkey = c_nationkey),
vt as (
  select c_custkey, k.name as project, 10 as score from c join k on contains(lower('work on ' || c.n_name), lower(k.name))
  union all select c_custkey, 'Meta' || c_nationkey, 15 from c where c_custkey % 2 = 0
  union all select c_custkey, k.name, 20 from c join k on contains('/repos/' || c.first_name || '/a.go', '/' || k.name || '/') or contains('/repos/' || c.first_name || '/a.go', k.path) where c_custkey % 3 = 0
  union all select c_custkey, 'Deep' || c_nationkey, 25 from c where c_custkey % 3 = 1
  union all select c_custkey, 'Leaf' || c_nationkey, 15 from c where c_custkey % 3 = 2
)
"""


@query("with " + _PROJECT_SQL + "select c_custkey::varchar as session_id, project, sum(score)::bigint as score from vt group by all")
def project_scores(spark, d):
    return _scores(spark, d)


def _scores(spark, d):
    """Prompts that mention a known project, some with metadata; tool paths in a known project, behind a parent folder, and elsewhere."""
    nation = table(spark, d, "nation")
    known = nation.select(F.col("n_name").alias("name"), F.concat(F.lit("/repos/"), "n_name").alias("path"))
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).crossJoin(nation.agg(F.min("n_name").alias("first_name")))  # one row
    n, key = _str("c_nationkey"), F.col("c_custkey")
    meta = F.when(key % 2 == 0, F.concat(F.lit("\nActive Workspaces:\n- /home/Meta"), n)).otherwise("")
    said = F.concat(F.lit("work on "), "n_name", meta)
    path = F.when(key % 3 == 0, F.concat(F.lit("/repos/"), "first_name", F.lit("/a.go"))).when(key % 3 == 1, F.concat(F.lit("/x/knowledge/Deep"), n, F.lit("/src/a.go"))).otherwise(F.concat(F.lit("/x/Leaf"), n, F.lit("/a.go")))
    none = F.lit(None).cast("array<struct<name:string,args:string>>")
    prompts = c.select(_str("c_custkey").alias("session_id"), F.lit(0).alias("step_index"), F.lit("USER_INPUT").alias("type"), F.lit("USER_EXPLICIT").alias("source"), said.alias("content"), none.alias("tool_calls"))
    tools = c.select(_str("c_custkey").alias("session_id"), F.lit(1).alias("step_index"), F.lit("PLANNER_RESPONSE").alias("type"), F.lit("MODEL").alias("source"), F.lit("").alias("content"), F.array(F.struct(F.lit("view_file").alias("name"), F.to_json(F.struct(path.alias("AbsolutePath"))).alias("args"))).alias("tool_calls"))
    return sessions.project_scores(prompts.unionByName(tools), known)


@query("with " + _PROJECT_SQL + ", s as (select c_custkey, project, sum(score) as score from vt group by all) select c_custkey::varchar as session_id, arg_min(project, (-score, project)) as project_name, string_agg(project, ',' order by score desc, project) as touched from s group by c_custkey")
def best_projects(spark, d):
    return sessions.best_projects(_scores(spark, d)).select("session_id", "project_name", F.array_join("projects_touched", ",").alias("touched"))


@query("with " + _SESSIONS_SQL + "select count(*) as sessions, sum(step_count)::bigint as step_count, sum(error_count)::bigint as error_count from s where project_name = 'Ws4'")
def project_totals(spark, d):
    return sessions.project_totals(_sessions(spark, d), "Ws4").select("sessions", "step_count", "error_count")


@query(_S + ", t as (select session_id, string_agg(content, chr(10) order by step_index) || chr(10) as body from steps where content is not null group by 1) select session_id, len(list_filter(string_split(body, chr(10)), lambda x: x <> '')) as n, strlen(body)::bigint as upto from t where session_id::bigint % 3 <> 2 union all select session_id, 1, strlen(body) + 4 from t where session_id::bigint % 3 = 2")
def polled_lines(spark, d):
    """Texts polled for the first time (0), after they were cut short (1), and after a line and a half came (2)."""
    s = steps(spark, d).where("content is not null").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("step_index", "content"))).alias("p"))
    body = s.select("session_id", F.concat(F.array_join("p.content", "\n"), F.lit("\n")).alias("body"), (F.col("session_id").cast("long") % 3).alias("m"))
    now = body.select("session_id", F.when(F.col("m") == 2, F.concat("body", F.lit("end\nhal"))).otherwise(F.col("body")).alias("content"))
    read = F.when(F.col("m") == 1, F.octet_length("body") + 100).when(F.col("m") == 2, F.octet_length("body"))
    return sync.new_lines(now, body.where("m > 0").select("session_id", read.alias("offset"))).select("session_id", F.size("lines").alias("n"), F.col("offset").alias("upto"))


@query("select p_partkey as file, p_size as size from part where p_partkey % 4 <> 0")
def changed_files(spark, d):
    """Known as it is (0), of another time (1), of another size (2), and new (3)."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.lit(5).alias("mtime"), F.col("p_size").alias("size"))
    m = F.col("file") % 4
    cache = p.where(m != 3).select("file", F.when(m == 1, 4).otherwise(5).alias("mtime"), F.when(m == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return transcripts.changed(p, cache).select("file", "size")


@query("select conv_id % 3 as kind, count(*) as n, sum(case when conv_id % 3 = 1 then 1 else 0 end)::bigint as fresh from conversations where conv_id % 3 <> 2 group by 1")
def rescanned_steps(spark, d):
    """Files that stay (0), that were read again (1) and that are gone (2)."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), "turn", F.lit(0).alias("fresh"))
    listing = c.where("file % 3 <> 2").select("file").distinct()
    again = c.where("file % 3 = 1").withColumn("fresh", F.lit(1))
    return transcripts.rescanned(c, again, listing).groupBy((F.col("file") % 3).alias("kind")).agg(F.count("*").alias("n"), F.sum("fresh").alias("fresh"))


@query("""with recursive e as (select (user_id % 3)::varchar as workspace, ts, event_id as seq, 'src/f' || (event_id % 5)::varchar || '.rs' as path, case event_type when 'purchase' then 'create' when 'error' then 'remove' when 'signup' then 'gone' else 'modify' end as what from events),
w as (select *, case when date_diff('microsecond', lag(ts) over p, ts) < 500000 then 0 else 1 end as fresh from e window p as (partition by workspace, path order by ts, seq)),
g as (select *, sum(fresh) over (partition by workspace, path order by ts, seq rows unbounded preceding) as g from w),
n as (select *, row_number() over (partition by workspace, path, g order by seq) as k, max(ts) over (partition by workspace, path, g) as last_at from g),
f(workspace, path, g, k, kind, last_at) as (
  select workspace, path, g, 0::bigint, '', last_at from n where k = 1
  union all select n.workspace, n.path, n.g, n.k, case n.what when 'create' then case when f.kind = 'Deleted' then 'Modified' else 'Created' end when 'modify' then case when f.kind in ('Created', 'Renamed') then f.kind else 'Modified' end
    when 'remove' then case when f.kind = 'Created' then '' else 'Deleted' end else 'Deleted' end, n.last_at from f join n on n.workspace = f.workspace and n.path = f.path and n.g = f.g and n.k = f.k + 1)
select workspace, path as file_path, last_at + interval 500 millisecond as flushed_at, arg_max(kind, k) as kind from f group by workspace, path, g, last_at having arg_max(kind, k) <> ''""")
def debounced_events(spark, d):
    from weftline.plans.streaming_queries import _file_events

    return ev.windowed(_file_events(spark, d)).select("workspace", "file_path", "flushed_at", "kind")


def _stars(spark, d):
    """A star for each brand: every part is joined to the first of its brand."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    name = lambda c: F.lpad(c.cast("string"), 12, "0")
    nodes = part.select(name(F.col("p_partkey")).alias("id"), F.lit("ws").alias("workspace"), F.lit(None).cast("int").alias("community"), F.col("p_brand").alias("brand"))
    hubs = part.groupBy("p_brand").agg(F.min("p_partkey").alias("hub"))
    edges = part.join(hubs, "p_brand").where("hub <> p_partkey").select(name(F.col("p_partkey")).alias("source"), name(F.col("hub")).alias("target"), F.lit("CALLS").alias("type"))
    return nodes, edges


_STARS = "select p_partkey::varchar as id, (select min(q.p_partkey) from part q where q.p_brand = p.p_brand)::varchar as first from part p"


def _named(found):
    """Communities by their smallest member, as numbers don't mean anything."""
    n = F.col("id").cast("long")
    first = found.groupBy("community").agg(F.min(n).alias("first"))
    return found.join(first, "community").select(n.cast("string").alias("id"), F.col("first").cast("string").alias("first"))


@query(_STARS)
def communities_of_stars(spark, d):
    return _named(graph.label_propagation(*_stars(spark, d)))


@query(_STARS)
def communities_of_stars_sequential(spark, d):
    return _named(coloured_lpa.communities(*_stars(spark, d)))


_SEEDED = "select p_brand as brand, 1 as communities, dense_rank() over (order by p_brand)::int + 99 as community from (select distinct p_brand from part)"


def _seeded(spark, d, only_changed: bool):
    """Every node of a star but its newest has the star's number already; the number stays and the newest takes it over."""
    nodes, edges = _stars(spark, d)
    brands = graph.numbered(nodes.select("brand").distinct(), "brand", "n")
    newest = nodes.groupBy("brand").agg(F.max("id").alias("_new"))
    seeds = nodes.join(brands, "brand").join(newest, "brand").select("id", F.when(F.col("id") != F.col("_new"), (F.col("n") + 100).cast("int")).alias("community"))
    changed = newest.select(F.col("_new").alias("id")) if only_changed else None
    found = graph.label_propagation(nodes, edges, seeds=seeds, changed=changed).join(nodes.select("id", "brand"), "id")
    return found.groupBy("brand").agg(F.count_distinct("community").cast("int").alias("communities"), F.min("community").alias("community"))


@query(_SEEDED)
def seeded_communities(spark, d):
    return _seeded(spark, d, False)


@query(_SEEDED)
def recluster_changed(spark, d):
    """The same where only the newest nodes, and what they reach, vote."""
    return _seeded(spark, d, True)


@query(_STARS.replace("p_partkey::varchar as id, ", "").replace("select (select", "select distinct (select").replace("::varchar as first", "::varchar as first, (select count(*) from part q where q.p_brand = p.p_brand) as node_count") + " where (select count(*) from part q where q.p_brand = p.p_brand) >= 3")
def cluster_job(spark, d):
    """Stars clustered anew, and the metrics of the communities of three members or more."""
    nodes, edges = _stars(spark, d)
    full = nodes.withColumns({"label": F.col("id"), "kind": F.lit("part"), "file_path": F.col("brand"), "language": F.lit("x")})
    fresh, metrics = listings.cluster(full, edges, 3)
    first = fresh.groupBy("community").agg(F.min(F.col("id").cast("long")).cast("string").alias("first"))
    return metrics.join(first, "community").select("first", "node_count")
