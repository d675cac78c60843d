"""Scalars, maintenance and sources on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import graph, store
from weftline.operators.graph import describe
from weftline.plans.registry import query
from weftline.plans.views import GRAPH_SQL, steps, table, trade_edges, trade_nodes
from weftline.sources import files

_G = "with " + GRAPH_SQL


@query("select p_partkey, unnest(['a' || p_partkey, 'b_' || p_size]) as symbol from part")
def imported_symbols(spark, d):
    line = F.concat(F.lit("from x.y import a"), F.col("p_partkey").cast("string"), F.lit(", b_"), F.col("p_size").cast("string"), F.lit(" as z"))
    return table(spark, d, "part").select("p_partkey", F.explode(T.imported_symbols(F.lit("python"), line)).alias("symbol"))


@query("select p_partkey, 'run' || p_size as callee, 'T' || p_size as field from part")
def callee_and_field(spark, d):
    n = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", T.callee_name(F.concat(F.lit("a.b::run"), n)).alias("callee"), T.field_type(F.concat(F.lit("Vec<Option<T"), n, F.lit(">>"))).alias("field"))


@query("select doc_id, case when doc_id % 3 = 0 then 'Repo' || doc_id when doc_id % 3 = 1 then 'Proj' || doc_id else 'Default' end as project from documents")
def project_names(spark, d):
    n = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/home/knowledge/Repo"), n, F.lit("/src/a.go"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/home/Proj"), n, F.lit("/src/main.go"))).otherwise(F.lit("/Untitled-1"))
    return table(spark, d, "documents").select("doc_id", T.project_name(path).alias("project"))


@query("select doc_id, case doc_id % 4 when 0 then '/w/a' || doc_id when 1 then '/w/b' || doc_id when 2 then '/d' || doc_id end as workspace from documents")
def workspace_paths(spark, d):
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    content = F.when(kind == 0, F.concat(F.lit("Active Workspaces:\n- /w/a"), n, F.lit("\nx"))).when(kind == 1, F.concat(F.lit("Command Working Directory: /w/b"), n)).when(kind == 2, F.concat(F.lit("Active Document: /d"), n, F.lit("/x.txt"))).otherwise(F.lit("none"))
    return table(spark, d, "documents").select("doc_id", T.workspace_of(content).alias("workspace"))


@query("select doc_id, length(source) >= 2 and doc_id % 5 not in (0, 1, 2) as ok from documents")
def valid_workspaces(spark, d):
    kind = F.col("doc_id") % 5
    name = F.when(kind == 0, "src").when(kind == 1, F.concat(F.lit("."), F.col("source"))).when(kind == 2, F.concat_ws("/", "source", "source")).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", T.valid_workspace(name).alias("ok"))


@query(r"""select conv_id, turn, case when turn % 2 = 0 or length(x) <= 2000 then x else left(x, 2000) || '...' end as prompt from (select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as x from conversations)""")
def user_prompts(spark, d):
    tagged = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<USER_REQUEST>\n"), F.col("text"), F.lit("\n</USER_REQUEST> more"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.user_prompt(tagged).alias("prompt"))


@query("select item_id, regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi') as marked from benchmark")
def highlight(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.highlight(F.col("text"), "the").alias("marked"))


@query("select event_id, case when length(props) > 8 then left(props, 8) || '...' else props end as preview, json_extract_string(props, '$.k') as k from events")
def args_previews(spark, d):
    return table(spark, d, "events").select("event_id", T.args_preview(F.col("props"), 8).alias("preview"), F.get_json_object("props", "$.k").alias("k"))


@query("select page_id, 'node:⟨' || page_id || '⟩' as raw, page_id::varchar as id from pages")
def record_ids(spark, d):
    raw = F.concat(F.lit("node:⟨"), F.col("page_id").cast("string"), F.lit("⟩"))
    return table(spark, d, "pages").select("page_id", raw.alias("raw"), T.clean_record_id(raw).alias("id"))


@query(_G + "select min(community) as community from nodes where file_path = (select min(n_name) from nation)")
def file_community(spark, d):
    name = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return store.file_community(trade_nodes(spark, d), "trade", name)


@query("select 'c:' || c_custkey as id, case when c_custkey % 2 = 0 then 99 else c_nationkey end as community from customer")
def set_communities(spark, d):
    n = trade_nodes(spark, d).where("kind = 'customer'")
    assigned = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.lit(99).alias("community"))
    return store.set_communities(n, assigned).select("id", "community")


@query("select n_name as workspace, case when n_nationkey % 2 = 0 then '/new' else '/old' end as root_path from nation")
def replace_meta(spark, d):
    n = table(spark, d, "nation")
    old = n.select(F.col("n_name").alias("workspace"), F.lit("/old").alias("root_path"))
    return store.replace_rows(old, n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("workspace"), F.lit("/new").alias("root_path")), ["workspace"])


@query("select '/w/' || n_name as root_path from nation where n_nationkey % 3 = 0 and n_nationkey % 2 = 0")
def dead_worktrees(spark, d):
    n = table(spark, d, "nation")
    path = F.concat(F.lit("/w/"), "n_name")
    meta = n.select(path.alias("root_path"), (F.col("n_nationkey") % 3 == 0).alias("is_worktree"))
    return store.dead_worktrees(meta, n.where("n_nationkey % 2 = 1").select(path.alias("path"))).select("root_path")


@query(_G + ", x as (select min(id) as id from nodes where label = (select min(s_name) from supplier)) select x.id as source, 'trade:virtual:pay' as target, 'CALLS' as type, 'INFERRED' as category from x")
def add_relationship(spark, d):
    first = table(spark, d, "supplier").agg(F.min("s_name").alias("source_symbol"))
    wanted = first.select(F.lit("trade").alias("workspace"), "source_symbol", F.lit("pay").alias("target_symbol"), F.lit("CALLS").alias("type"), F.lit(None).cast("string").alias("category"))
    empty = trade_edges(spark, d).limit(0).withColumn("workspace", F.lit(None).cast("string"))
    return store.add_relationships(trade_nodes(spark, d), empty, wanted)[1].select("source", "target", "type", "category")


@query("select 'child:' || c_custkey as id, c_nationkey as community from customer")
def inherited_seeds(spark, d):
    nodes = table(spark, d, "customer").select(F.concat(F.lit("parent:"), F.col("c_custkey").cast("string")).alias("id"), F.lit("parent").alias("workspace"), F.col("c_nationkey").alias("community"))
    return store.inherit_seeds(nodes, "parent", "child")


@query("select 'wt' || n_nationkey as workspace, 'repo' as parent_workspace, 'b' || n_nationkey as branch, 'wt' || n_nationkey as worktree_name from nation")
def worktree_lineage(spark, d):
    n = F.col("n_nationkey").cast("string")
    pointers = table(spark, d, "nation").select(F.concat(F.lit("/x/wt"), n).alias("root_path"), F.concat(F.lit("gitdir: /y/repo/.git/worktrees/wt"), n).alias("content"), F.concat(F.lit("ref: refs/heads/b"), n).alias("head"))
    return files.worktree_meta(pointers).select("workspace", "parent_workspace", "branch", "worktree_name")


@query("select s_name as workspace, case when s_suppkey % 2 = 0 then '/b' || s_suppkey else '/a' || s_suppkey end as root from supplier")
def resolved_roots(spark, d):
    s = table(spark, d, "supplier")
    n = F.col("s_suppkey").cast("string")
    cand = s.select(F.col("s_name").alias("workspace"), F.explode(F.array(F.struct(F.concat(F.lit("/a"), n).alias("root"), F.lit(0).alias("preference")), F.struct(F.concat(F.lit("/b"), n).alias("root"), F.lit(1).alias("preference")))).alias("c")).select("workspace", "c.*")
    there = s.select(F.explode(F.array(F.concat(F.lit("/a"), n), F.concat(F.lit("/b"), n), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/b"), n, F.lit("/f.rs"))).otherwise(F.lit("/none")))).alias("path"))
    return files.resolve_root(cand, s.select(F.col("s_name").alias("workspace"), F.lit("f.rs").alias("file_path")), there)


@query(_G + ", l as (select distinct community, label from nodes), r as (select *, row_number() over (partition by community order by label) as r from l) select n.community, count(*) as n, (select string_agg(label, ',' order by label) from r where r.community = n.community and r.r <= 6) as labels from nodes n group by n.community")
def galaxy_aggregation(spark, d):
    nodes = trade_nodes(spark, d)
    sizes = nodes.groupBy("community").agg(F.count("*").alias("n"))
    return sizes.join(describe(nodes, 6).select("community", F.array_join("key_symbols", ",").alias("labels")), "community")


@query(_G + ", seed as (select id from nodes where label = (select min(s_name) from supplier)), hop as (select target as id from edges where source in (select id from seed) union select source from edges where target in (select id from seed) union select id from seed), two as (select target as id from edges where source in (select id from hop) union select source from edges where target in (select id from hop) union select id from hop), d as (select two.id, case when two.id in (select id from seed) then 0 when two.id in (select id from hop) then 1 else 2 end as depth from two) select id from d order by depth, id limit 60")
def symbol_subgraph(spark, d):
    name = table(spark, d, "supplier").agg(F.min("s_name")).first()[0]
    return graph.symbol_subgraph(trade_nodes(spark, d), trade_edges(spark, d), name)[0].select("id")


@query("select conv_id::varchar as session_id, string_agg('## ' || turn || ' ' || case role when 'user' then 'USER_INPUT' else 'PLANNER_RESPONSE' end || chr(10) || chr(10) || text || chr(10), chr(10) order by turn) as markdown from conversations where role <> 'system' group by conv_id")
def export_markdown(spark, d):
    from weftline.operators.sessions import export_markdown as export

    return export(steps(spark, d))
