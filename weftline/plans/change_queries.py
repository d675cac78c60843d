"""Changes in proportion to what changed: bucket rewrites and merged rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import rollups
from weftline.operators.buckets import BucketTable, GraphTables
from weftline.plans.registry import query
from weftline.plans.views import GRAPH_SQL, event_steps, table, trade_edges, trade_nodes
from weftline.session import scratch_path


@query("""select p_partkey, coalesce(n.nm, o.p_name) as p_name, coalesce(n.sz, o.p_size) as p_size from part o
left join (select p_partkey as pk, case when p_partkey % 4 = 0 then upper(p_name) end as nm, p_size + 1 as sz from part where p_brand = (select min(p_brand) from part)) n on n.pk = o.p_partkey""")
def upsert_buckets(spark, d):
    """The parts of one brand are updated; only the buckets that hold them are written anew."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    kept = BucketTable(spark, scratch_path(spark, "parts"), ("p_partkey",), 16).create(part.drop("p_brand"))
    first = part.agg(F.min("p_brand")).first()[0]
    new = part.where(F.col("p_brand") == first).select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    kept.upsert(new)
    return kept.read()


_FIRST = "(select min(n_name) from nation)"


@query("with " + GRAPH_SQL + f""", kept as (select e.* from edges e join nodes a on a.id = e.source join nodes b on b.id = e.target where a.file_path <> {_FIRST} and b.file_path <> {_FIRST}),
moved as (select 'new' || id as id from nodes where file_path = {_FIRST} and kind = 'supplier')
select source, target, type, count(*) as n from kept group by all union all select id, 's:1', 'CALLS', 1 from moved where exists (select 1 from nodes where id = 's:1' and file_path <> {_FIRST})""")
def replace_file(spark, d):
    """One nation's nodes are replaced by new ones that all call one supplier; the edges of the old nodes go."""
    nodes = trade_nodes(spark, d).select("id", "workspace", "file_path", "label", "kind")
    graph = GraphTables(spark, scratch_path(spark, "graph"), 16).create(nodes, trade_edges(spark, d).select("source", "target", "type"))
    first = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    own = nodes.where((F.col("file_path") == first) & (F.col("kind") == "supplier")).withColumn("id", F.concat(F.lit("new"), "id"))
    calls = own.select(F.col("id").alias("source"), F.lit("s:1").alias("target"), F.lit("CALLS").alias("type"))
    graph.replace_files(nodes.where(F.col("file_path") == first).select("workspace", "file_path").distinct(), own, calls)
    return graph.edges().groupBy("source", "target", "type").agg(F.count("*").alias("n"))


@query("""select user_id::varchar as session_id, count(*) as step_count, min(ts) as created_at, max(ts) as last_message_at, count(*) filter (event_type <> 'error') as agent_response_count, count(*) filter (event_type = 'error') as error_count, count(*) filter (event_type <> 'error')::bigint as tool_call_count
from events where user_id % 11 <> 3 group by user_id""")
def rollup_rescanned(spark, d):
    """Rollups by file after a rescan: some files had lost their latest steps before (changed), one in eleven is new, and one is gone now."""
    steps = event_steps(spark, d).withColumn("file", F.concat(F.lit("f"), (F.col("session_id").cast("long") % 11).cast("string")))
    n = F.col("session_id").cast("long") % 11
    middle = table(spark, d, "events").agg(F.expr("percentile(event_id, 0.5)")).first()[0]
    before = steps.where((n != 5) & ((n != 7) | (F.col("step_index") < middle)))
    listing = steps.where(n != 3).select("file").distinct()
    fresh = steps.where(n.isin(5, 7))
    parts = rollups.replaced(rollups.partials(before), rollups.partials(fresh), listing)
    return rollups.merged(parts).select("session_id", "step_count", "created_at", "last_message_at", "agent_response_count", "error_count", "tool_call_count")
