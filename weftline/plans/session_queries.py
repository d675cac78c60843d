"""Session, telemetry, scalar and maintenance operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import condense, sessions, telemetry
from weftline.plans.registry import query
from weftline.plans.views import EVENTS_SQL, STEPS_SQL, calls, event_steps, files, step_search, steps, table
from weftline.sources import files as source_files

_S, _E = "with " + STEPS_SQL, "with " + EVENTS_SQL
_AS_OF = "2024-02-01 00:00:00"


def _sessions(spark, d):
    """Users of the event table as sessions; workspaces by the remainder of their number."""
    rolled = sessions.rollup(event_steps(spark, d))
    ws = F.concat(F.lit("Ws"), (F.col("session_id").cast("long") % 7).cast("string"))
    return rolled.withColumns({"workspace": F.concat(F.lit("/w/"), ws), "project_name": ws, "projects_touched": F.array(ws), "runtime_mode": F.when(F.col("session_id").cast("long") % 2 == 0, "ide").otherwise("cli"), "provider": F.lit("any"), "transcript_size_bytes": F.col("step_count") * 10})


_SESSIONS_SQL = """
s as (select user_id::varchar as session_id, count(*) as step_count, min(ts) as created_at, max(ts) as last_message_at, count(*) filter (event_type <> 'error') as agent,
  count(*) filter (event_type = 'error') as error_count, 'Ws' || (user_id % 7)::varchar as project_name, case when user_id % 2 = 0 then 'ide' else 'cli' end as runtime_mode from events group by user_id)
"""


@query(_S + "select session_id, count(*) as step_count, count(*) filter (type = 'USER_INPUT') as user_message_count, count(*) filter (type = 'PLANNER_RESPONSE') as agent_response_count, trim(arg_min(content, step_index) filter (type = 'USER_INPUT' and length(content) <= 2000), ' ' || chr(10)) as first_prompt from steps group by session_id")
def session_rollup(spark, d):
    s = steps(spark, d).withColumns({"status": F.lit("DONE"), "created_at": F.lit(None).cast("timestamp"), "tool_calls": F.lit(None).cast("array<struct<name:string,args:string>>")})
    return sessions.rollup(s).select("session_id", "step_count", "user_message_count", "agent_response_count", F.col("first_user_prompt_preview").alias("first_prompt"))


@query("select user_id::varchar as session_id, event_type as tool, count(*) as n from events group by all")
def tool_map(spark, d):
    return sessions.tool_counts(event_steps(spark, d))


@query("with " + _SESSIONS_SQL + "select session_id, step_count, created_at, last_message_at, error_count from s order by step_count desc, session_id limit 25")
def session_list_sorted(spark, d):
    return sessions.list_sessions(_sessions(spark, d), sort_by="steps").limit(25).select("session_id", "step_count", "created_at", "last_message_at", "error_count")


@query("with " + _SESSIONS_SQL + "select session_id from s where contains(lower(project_name), 'ws3') and runtime_mode = 'ide'")
def session_filters(spark, d):
    return sessions.list_sessions(_sessions(spark, d), workspace="WS3", runtime="IDE").select("session_id")


@query("with " + _SESSIONS_SQL + "select session_id, created_at, last_message_at from s where last_message_at >= timestamp '2024-01-29 12:00:00' and created_at <= timestamp '2024-01-01 06:00:00'")
def lifetime_overlap(spark, d):
    s = _sessions(spark, d)
    hit = sessions.lifetime_overlaps(F.col("created_at"), F.col("last_message_at"), F.lit("2024-01-29 12:00:00").cast("timestamp"), F.lit("2024-01-01 06:00:00").cast("timestamp"))
    return s.where(hit).select("session_id", "created_at", "last_message_at")


@query(_S + """, hits as (select *, instr(lower(content), 'ation') as p from steps where contains(lower(content), 'ation') and type <> 'USER_INPUT'),
top as (select * from hits order by session_id, step_index limit 100)
select session_id, step_index, case when greatest(0, p - 101) > 0 then '...' else '' end || substr(content, greatest(0, p - 101) + 1, least(greatest(0, p - 101) + 200, length(content)) - greatest(0, p - 101)) || case when least(greatest(0, p - 101) + 200, length(content)) < length(content) then '...' else '' end as preview, (select count(*) from top) as total_count from top""")
def transcript_search(spark, d):
    """By the index; a scan gives the same, which tests hold it against."""
    hits = step_search(spark, d).matching("ation").where("type <> 'USER_INPUT'")
    return sessions.newest(hits, "ation", 100).select("session_id", "step_index", "preview", "total_count")


@query("""select doc_id, case when instr(lower(text), 'ring') = 0 then case when length(text) > 80 then left(text, 80) || '...' else text end
 else case when greatest(0, instr(lower(text), 'ring') - 41) > 0 then '...' else '' end || substr(text, greatest(0, instr(lower(text), 'ring') - 41) + 1, least(greatest(0, instr(lower(text), 'ring') - 41) + 80, length(text)) - greatest(0, instr(lower(text), 'ring') - 41)) || case when least(greatest(0, instr(lower(text), 'ring') - 41) + 80, length(text)) < length(text) then '...' else '' end end as preview from documents""")
def search_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.search_preview(F.col("text"), "ring", 80).alias("preview"))


@query(_S + "select type, count(*) as n from steps where type = 'PLANNER_RESPONSE' and trim(content) <> '' group by type")
def message_type_filter(spark, d):
    s = steps(spark, d)
    return s.where(T.message_filter("AGENT_RESPONSES", F.col("type"), F.col("content"), F.lit(0))).groupBy("type").agg(F.count("*").alias("n"))


@query(_S + "select session_id, step_index from steps where type = 'USER_INPUT' or (type = 'PLANNER_RESPONSE' and trim(content) <> '')")
def dialogue_only(spark, d):
    s = steps(spark, d)
    return s.where(T.message_filter("DIALOGUE", F.col("type"), F.col("content"), F.lit(0))).select("session_id", "step_index")


@query(_S + ", r as (select *, row_number() over (partition by session_id order by step_index desc) as k from steps where type = 'USER_INPUT' and trim(content) <> '') select session_id, step_index, k as rank_from_end, content from r where k <= 3")
def recent_prompts_top3(spark, d):
    return sessions.recent_prompts(steps(spark, d)).select("session_id", "step_index", "rank_from_end", "content")


@query("with r as (select user_id::varchar as session_id, event_id as step_index, event_type as tool, props as args_preview, row_number() over (partition by user_id order by event_id desc) as rank from events) select * from r where rank <= 5")
def last_tool_calls(spark, d):
    return sessions.last_tool_calls(event_steps(spark, d)).select("session_id", "step_index", "tool", "args_preview", "rank")


@query("with r as (select user_id::varchar as session_id, event_id as step_index, left(props, 250) as content, row_number() over (partition by user_id order by event_id desc) as rank_from_end from events where event_type = 'error') select * from r where rank_from_end <= 3")
def recent_errors(spark, d):
    return sessions.recent_errors(event_steps(spark, d)).select("session_id", "step_index", "content", "rank_from_end")


@query("select user_id::varchar as session_id, json_extract_string(props, '$.k') as value, max(event_id) as last_step from events where event_type in ('click', 'view') group by all having value is not null")
def latest_distinct_values(spark, d):
    return sessions.latest_distinct(event_steps(spark, d), ("click", "view"), ("k",))


@query("with " + _SESSIONS_SQL + "select session_id, last_message_at as last_active, (select count(*) from s where project_name = 'Ws2') as total_matches from s where project_name = 'Ws2' order by last_message_at desc, session_id limit 5")
def wip_candidates(spark, d):
    return sessions.wip_candidates(_sessions(spark, d), "ws2").select("session_id", "last_active", "total_matches")


@query("with " + _SESSIONS_SQL + "select 'resolved' as status, arg_max(session_id, (last_message_at, session_id)) as session_id, count(*) as matches from s where project_name = 'Ws2'")
def wip_status(spark, d):
    return sessions.wip_status(_sessions(spark, d), "ws2", force_latest=True)


@query("with " + _SESSIONS_SQL + "select project_name, count(*) as session_count, max(last_message_at) as last_active, sum(step_count)::bigint as steps from s group by 1 union all select 'Idle', 0, null, null")
def project_summaries(spark, d):
    known = spark.range(1).select(F.lit("Idle").alias("name")).unionByName(spark.range(1).select(F.lit("Ws1").alias("name")))
    return sessions.project_summaries(_sessions(spark, d), known).select("project_name", "session_count", "last_active", "steps")


@query("with " + _SESSIONS_SQL + "select count(*) as sessions, sum(step_count)::bigint as step_count, sum(agent)::bigint as agent_response_count, sum(error_count)::bigint as error_count, min(created_at) as first_at, max(created_at) as last_at from s")
def global_stats(spark, d):
    return sessions.totals(_sessions(spark, d)).select("sessions", "step_count", "agent_response_count", "error_count", "first_at", "last_at")


@query("with x as (select user_id, event_type as tool, count(*) as n from events where event_type <> 'error' group by all) select tool, sum(n)::bigint as n from x group by tool order by n desc, tool limit 12")
def top_tools(spark, d):
    return sessions.top_tools(sessions.tool_counts(event_steps(spark, d).where("type <> 'ERROR_MESSAGE'")))


@query(_S + ", p as (select trim(content, ' ') as c from steps where type = 'USER_INPUT' and step_index <= 1), q as (select case when length(c) > 120 then left(c, 120) || '...' else c end as prompt from p where length(c) > 3) select prompt, count(*) as n from q group by prompt order by n desc, prompt limit 10")
def top_prompts(spark, d):
    first = steps(spark, d).where("type = 'USER_INPUT' and step_index <= 1").select(F.col("content").alias("prompt"))
    return sessions.top_prompts(first)


@query("select event_type as tool, count(*) as n, round(count(*) * 100.0 / max(count(*)) over (), 1) as percent from events group by event_type")
def percent_of_max(spark, d):
    from pyspark.sql.window import Window

    n = table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over one row a tool
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.max("n").over(whole), 1))


@query("select lang, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 1) as percent from documents group by lang")
def share_of_total(spark, d):
    from pyspark.sql.window import Window

    n = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over one row a language
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(whole), 1))


@query(_E + "select capability, workspace, count(*) as calls, round(avg(duration_ms), 6) as mean_ms from calls group by all")
def api_call_summary(spark, d):
    return telemetry.summary(calls(spark, d)).withColumn("mean_ms", F.round("mean_ms", 6))


@query(_E + "select event_id as id, created_at, capability from calls order by created_at desc, event_id limit 20")
def api_recent_calls(spark, d):
    return telemetry.recent(calls(spark, d), 20).select("id", "created_at", "capability")


@query(_E + """, a as (select capability, workspace, count(*) as n from calls where event_id % 2 = 0 group by all), b as (select capability, workspace, count(*) as n from calls where event_id % 2 = 1 group by all)
select coalesce(a.capability, b.capability) as capability, coalesce(a.workspace, b.workspace) as workspace, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) as n from a full outer join b on a.capability = b.capability and a.workspace = b.workspace""")
def telemetry_blend(spark, d):
    c = calls(spark, d)
    half = lambda r: c.where(F.col("id") % 2 == r).groupBy("capability", "workspace").agg(F.count("*").alias("n"))
    return telemetry.blend(half(0), half(1), ["capability", "workspace"])


@query("with v as (select user_id, event_type, sum(case event_type when 'purchase' then 3 when 'click' then 2 else 1 end) as w from events group by all) select user_id, arg_min(event_type, (-w, event_type)) as choice from v group by user_id")
def workspace_vote(spark, d):
    weight = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    votes = table(spark, d, "events").select("user_id", F.col("event_type").alias("choice"), weight.alias("w"))
    return telemetry.vote(votes, "user_id", "choice", "w", "none")


@query("select user_id, (count(*) filter (event_type <> 'view') * 14500 + count(*) filter (event_type = 'view') * 8000) as saved from events group by user_id")
def tokens_saved(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("g"), F.count_if(F.col("event_type") == "view").alias("l"))
    return n.select("user_id", telemetry.tokens_saved(F.col("g"), F.col("l")).alias("saved"))


@query("""select event_id, case when secs < 60 then 'just now' when secs < 3600 then case when secs // 60 = 1 then '1 minute ago' else (secs // 60)::varchar || ' minutes ago' end
 when secs < 86400 then case when secs // 3600 = 1 then '1 hour ago' else (secs // 3600)::varchar || ' hours ago' end when secs // 86400 = 1 then 'yesterday' else (secs // 86400)::varchar || ' days ago' end as ago
 from (select event_id, greatest(0, date_diff('second', date_trunc('second', ts), timestamp '2024-01-30 12:00:00')) as secs from events)""")
def relative_time(spark, d):
    return table(spark, d, "events").select("event_id", T.relative_time(F.col("ts"), F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("ago"))


@query(f"select event_id, case when x <= 0 then 'today' when x = 1 then 'yesterday' when x <= 7 then 'past_7_days' else 'older' end as bucket from (select event_id, date_diff('day', ts::date, timestamp '{_AS_OF}'::date) as x from events)")
def date_bucket(spark, d):
    return table(spark, d, "events").select("event_id", T.date_bucket(F.col("ts"), F.lit(_AS_OF).cast("timestamp")).alias("bucket"))


@query("select event_id from events where ts::date >= date '2024-02-01' - 7")
def date_preset(spark, d):
    return table(spark, d, "events").where(T.date_preset(F.col("ts"), "7d", F.lit(_AS_OF).cast("timestamp"))).select("event_id")


@query("select lang, count(*) as n from documents group by lang")
def stats_by_language(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("select source, count(*) as n from documents group by source")
def stats_by_workspace(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("select lang, source, count(*) as n from documents group by grouping sets ((), (lang), (source))")
def stats_grouping_sets(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("weftline_documents")
    return spark.sql("select lang, source, count(*) as n from weftline_documents group by grouping sets ((), (lang), (source))")


@query("select source as workspace, count(*) as n, string_agg(distinct lang, ',' order by lang) as languages, count(distinct doc_id) as files from documents where trim(source) <> '' and source not in ('default', 'global') group by source")
def workspace_summary(spark, d):
    docs = table(spark, d, "documents").where("trim(source) <> '' and source not in ('default', 'global')")
    return docs.groupBy(F.col("source").alias("workspace")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"), F.count_distinct("doc_id").alias("files"))


@query("select distinct source as workspace, lang || '/' || doc_id || '.txt' as file_path, sha256(text) as file_hash from documents")
def file_hash_pairs(spark, d):
    return files(spark, d).select("workspace", "file_path", F.sha2("content", 256).alias("file_hash")).dropDuplicates(["workspace", "file_path", "file_hash"])


@query("select doc_id from documents where doc_id % 3 <> 0 or doc_id % 5 = 0")
def stale_files(spark, d):
    now = files(spark, d).withColumn("file_hash", F.sha2("content", 256))
    known = now.where("doc_id % 3 = 0").withColumn("file_hash", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("file_hash")))
    return source_files.stale(now, known).select("doc_id")


@query("select doc_id from documents where doc_id % 4 = 0")
def missing_files_antijoin(spark, d):
    f = files(spark, d)
    return source_files.missing(f, f.where("doc_id % 4 <> 0")).select("doc_id")


@query("with r as (select doc_id, lower(source) as k, lang, row_number() over (partition by lower(source), lang order by doc_id) as r from documents) select k, lang, doc_id from r where r = 1")
def dedup_first_wins(spark, d):
    return table(spark, d, "documents").groupBy(F.lower("source").alias("k"), "lang").agg(F.min("doc_id").alias("doc_id"))


@query("with r as (select source, doc_id, sum(octet_length(encode(text))) over (partition by source order by doc_id rows unbounded preceding) as used from documents) select source, doc_id, used::bigint as used from r where used <= 60000")
def budget_prefix(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    return condense.budget_prefix(docs, ["doc_id"], F.octet_length("text"), 60000, ["source"]).select("source", "doc_id", "used")


@query("select doc_id, case when doc_id % 2 = 0 then 'src' || (doc_id % 20)::varchar end as workspace from documents")
def normalize_workspace(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" /a/b/src"), (F.col("doc_id") % 20).cast("string"), F.lit("// "))).otherwise(F.lit("/"))
    return table(spark, d, "documents").select("doc_id", T.normalize_workspace(raw).alias("workspace"))


@query("select page_id, case when contains(url, '://') then regexp_extract(url, '^(.*)/[^/]*$', 1) else regexp_extract(url, '^(.*)/[^/]*$', 1) end as folder from pages")
def parent_directory(spark, d):
    return table(spark, d, "pages").select("page_id", T.parent_directory(F.col("url")).alias("folder"))


@query("with p as (select n_name, '/w/' || lower(n_name) as root from nation), x as (select s_suppkey, '/W/' || n_name || '/src/a.rs' as path, n_name from supplier join nation on n_nationkey = s_nationkey) select s_suppkey, n_name as workspace from x")
def path_attribution(spark, d):
    nation = table(spark, d, "nation")
    roots = nation.select(F.concat(F.lit("/w/"), F.lower("n_name")).alias("root_path"), F.col("n_name").alias("workspace"))
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("/W/"), "n_name", F.lit("/src/a.rs")).alias("path"))
    return telemetry.attribute_paths(s, roots).select("s_suppkey", "workspace")


@query("select event_id, case event_type when 'click' then 'symbol definition' when 'view' then 'vector search' when 'error' then null else 'general' end as capability from events")
def command_capability(spark, d):
    command = F.when(F.col("event_type") == "click", "make graph-symbol NAME=x").when(F.col("event_type") == "view", "tool search 'x'").when(F.col("event_type") == "error", "ls -l").otherwise("tool help")
    return table(spark, d, "events").select("event_id", telemetry.classify(command, ("tool",))["capability"].alias("capability"))
