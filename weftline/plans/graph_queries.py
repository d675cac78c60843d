"""Graph, store and vector operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import coloured_lpa, condense, graph, rag, store, vectors
from weftline.plans.registry import query
from weftline.plans.views import GRAPH_SQL, part_symbols, table, trade_adjacency, trade_edges, trade_nodes, trade_symbols, vector_cells

_G = "with recursive " + GRAPH_SQL


@query(_G + """, pairs as (
  select s.community as a, t.community as b, count(*) as n from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target group by all
), sides as (
  select a as community, case when a = b then n else 0 end as i, 0 as ca, case when a <> b then n else 0 end as ce from pairs
  union all select b, 0, case when a <> b then n else 0 end, 0 from pairs
), m as (select community, count(*) as node_count from nodes group by all),
x as (select m.community, node_count, coalesce(sum(i), 0)::bigint as internal_edges, coalesce(sum(ca), 0)::bigint as afferent, coalesce(sum(ce), 0)::bigint as efferent from m left join sides using (community) group by all)
select *, afferent + efferent as external_edges, round(case when afferent + efferent = 0 then 0.5 else efferent / (afferent + efferent) end, 9) as instability,
  case when (case when afferent + efferent = 0 then 0.5 else efferent / (afferent + efferent) end) <= 0.25 then 'Core Foundation'
       when (case when afferent + efferent = 0 then 0.5 else efferent / (afferent + efferent) end) <= 0.65 then 'Domain Service' else 'Orchestrator / Leaf' end as role from x
""")
def galaxy_metrics(spark, d):
    return graph.coupling(trade_nodes(spark, d), trade_edges(spark, d)).withColumn("instability", F.round("instability", 9))


@query(_G + """, pairs as (select s.community as a, t.community as b from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target),
x as (select c.community, (select count(*) from pairs where b = c.community and a <> b) as ca, (select count(*) from pairs where a = c.community and a <> b) as ce from (select distinct community from nodes) c),
r as (select case when ca + ce = 0 then 0.5 else ce / (ca + ce) end as i from x)
select case when i <= 0.25 then 'Core Foundation' when i <= 0.65 then 'Domain Service' else 'Orchestrator / Leaf' end as role, count(*) as n from r group by 1
""")
def role_counts(spark, d):
    return graph.coupling(trade_nodes(spark, d), trade_edges(spark, d)).groupBy("role").agg(F.count("*").alias("n"))


@query(_G + """select e.source, e.target, e.type, s.community as source_community, t.community as target_community
from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target where s.community <> t.community order by source, target, type limit 200""")
def inter_galaxy_deps(spark, d):
    return graph.inter_galaxy(trade_nodes(spark, d), trade_edges(spark, d))


@query(_G + """, x as (select distinct e.source, e.target, e.type from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target where s.community = 3 and t.community = 3)
select * from x""")
def induced_subgraph(spark, d):
    return graph.induced(trade_nodes(spark, d), trade_edges(spark, d), 3)[1].select("source", "target", "type").distinct()


@query(_G + """, seed as (select 's:1' as id), h1 as (select target as id from edges where source = 's:1' union select source from edges where target = 's:1' union select id from seed) select id from h1""")
def one_hop(spark, d):
    seed = spark.range(1).select(F.lit("s:1").alias("id"))
    return trade_adjacency(spark, d).neighbours(seed)


@query(_G + """, seed(id) as (values ('s:1'), ('c:1')), touch as (select * from edges where source in (select id from seed) or target in (select id from seed)),
tiers as (select source as id, 0 as tier from touch union all select target, 1 from touch union all select id, 2 from seed),
near as (select id, min(tier) as tier from tiers group by id order by tier, id limit 40)
select id, (select count(*) from touch) as touching from near where id in (select id from nodes)""")
def capped_neighbourhood(spark, d):
    seeds = spark.createDataFrame([("s:1",), ("c:1",)], "id string")
    near, touching = graph.neighbourhood(trade_nodes(spark, d), trade_edges(spark, d), seeds)
    return near.select("id").crossJoin(touching.agg(F.count("*").alias("touching")))  # one row


@query(_G + """, u as (select distinct source as a, target as b from edges union select distinct target, source from edges),
hop(id, depth) as (select 'c:1', 0 union select u.b, hop.depth + 1 from hop join u on u.a = hop.id where hop.depth < 2)
select id, min(depth) as depth from hop group by id""")
def two_hop(spark, d):
    seed = spark.range(1).select(F.lit("c:1").alias("id"))
    return trade_adjacency(spark, d).k_hop(seed, 2)


@query(_G + """, u as (select distinct source as a, target as b from edges union select distinct target, source from edges),
hop(id, depth) as (select 'c:2', 0 union select u.b, hop.depth + 1 from hop join u on u.a = hop.id where hop.depth < 3)
select id, min(depth) as depth from hop group by id order by depth, id limit 60""")
def k_hop_capped(spark, d):
    return graph.k_hop(trade_edges(spark, d), spark.range(1).select(F.lit("c:2").alias("id")), 3, cap=60)


@query("""with t as (select p_partkey as id, p_name as label from part where p_name like '%a%' and contains(p_name, 'a')),
top as (select id, label, label = 'a' as exact from t order by exact desc, label, id limit 20) select id, label from top""")
def symbol_lookup(spark, d):
    return part_symbols(spark, d).find("a").select("id", "label")


@query("""with n as (select p_partkey as id, p_brand || '::' || p_type as label from part), m as (select min(p_type) as t from part)
select id, label from n, m where label = t or ends_with(label, '::' || t) or ends_with(label, '.' || t)""")
def suffix_match(spark, d):
    part = table(spark, d, "part")
    name = part.agg(F.min("p_type")).first()[0]
    return graph.suffix_matches(part.select(F.col("p_partkey").alias("id"), F.concat_ws("::", "p_brand", "p_type").alias("label")), name).select("id", "label")


@query(_G + """, t as (select id from nodes where label = (select min(s_name) from supplier))
select e.source, n.label as caller, e.target, e.type, count(*) as n from edges e join t on t.id = e.target join nodes n on n.id = e.source group by all""")
def references(spark, d):
    name = table(spark, d, "supplier").agg(F.min("s_name")).first()[0]
    matches = trade_symbols(spark, d).suffix(name)
    return trade_adjacency(spark, d).references(matches, trade_nodes(spark, d)).groupBy("source", "caller", "target", "type").agg(F.count("*").alias("n"))


@query("""with nodes as (select 'ws:' || p_brand || ':' || p_partkey as id, p_brand as file_path, p_type as label from part),
x as (select 'ws:' || p_brand || ':' || p_partkey as source, p_brand as file, p_type as want from part where p_partkey % 7 = 0
  union all select 'ws:none:' || p_partkey, 'none', p_type from part where p_partkey % 11 = 0 union all select 'ws:none:0', 'none', 'no such label')
select x.source, coalesce((select min(id) from nodes n where n.label = x.want and n.file_path = x.file), (select min(id) from nodes n where n.label = x.want)) as target
from x where exists (select 1 from nodes n where n.label = x.want)""")
def edge_resolution_ranked(spark, d):
    part = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    nodes = part.select(F.concat_ws(":", F.lit("ws"), "p_brand", key).alias("id"), F.lit("ws").alias("workspace"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("label"))
    want = lambda rows, file, label: rows.select(F.lit("ws").alias("workspace"), F.concat_ws(":", F.lit("ws"), file, key, F.lit("9")).alias("source_id"), label.alias("target_label"), F.lit(None).cast("string").alias("target_id"), F.lit("CALLS").alias("edge_type"), F.lit("EXTRACTED").alias("category"))
    wanted = want(part.where("p_partkey % 7 = 0"), F.col("p_brand"), F.col("p_type")).unionByName(want(part.where("p_partkey % 11 = 0"), F.lit("none"), F.col("p_type"))).unionByName(want(part.limit(1).withColumn("p_partkey", F.lit(0)), F.lit("none"), F.lit("no such label")))
    return graph.resolve_edges(nodes, wanted).select(F.regexp_replace("source", ":9$", "").alias("source"), "target")


@query(_G + """, f as (select id, label, community from nodes where label = (select min(s_name) from supplier)),
c as (select f.id, s.community = f.community as inside, s.community as theirs from edges e join f on f.id = e.target join nodes s on s.id = e.source),
x as (select f.id as target, f.label as symbol, f.community, (select count(*) from c where inside) as internal_callers, (select count(*) from c where not inside) as cross_callers, (select count(distinct theirs) from c where not inside) as foreign_galaxies from f)
select *, case when cross_callers > 0 then 'BOUNDARY_CROSSING' when internal_callers > 0 then 'INTERNAL_ONLY' else 'ISOLATED' end as status,
  case when cross_callers > 0 and (cross_callers >= 3 or foreign_galaxies > 1) then 'HIGH' when cross_callers > 0 then 'MEDIUM' else 'LOW' end as risk,
  case when cross_callers > 0 then cross_callers || ' callers in ' || foreign_galaxies || ' other communities depend on ' || symbol || ': change them together with it; its ' || internal_callers || ' own callers move with it.'
    when internal_callers > 0 then 'All ' || internal_callers || ' callers of ' || symbol || ' are in its own community: a change stays there.' else symbol || ' has no callers in the graph: an entry point, or not in use.' end as advice from x""")
def boundary_contract(spark, d):
    name = table(spark, d, "supplier").agg(F.min("s_name")).first()[0]
    return graph.boundary(trade_nodes(spark, d), trade_edges(spark, d), name).withColumnRenamed("foreign", "foreign_galaxies")


@query("""with c as (select source, lang, count(*) as n from documents group by all) select source, arg_min(lang, (-n, lang)) as lang from c group by source""")
def dominant_dir_mode(spark, d):
    return graph.dominant(table(spark, d, "documents").select("source", "lang"), "source", "lang")


@query(_G + """, l as (select community, label, row_number() over (partition by community order by label) as r from (select distinct community, label from nodes)),
k as (select community, string_agg(label, ',' order by label) as key_symbols, min(label) as first from l where r <= 8 group by community)
select community, key_symbols, 'root (' || first || ')' as name from k""")
def galaxy_names(spark, d):
    return graph.describe(trade_nodes(spark, d)).select("community", F.array_join("key_symbols", ",").alias("key_symbols"), "name")


@query(_G + """, w as (select source as me, target as other, case type when 'IMPLEMENTS' then 3.0 when 'CALLS' then 2.0 when 'TYPE_REF' then 1.5 else 1.0 end as w from edges),
v as (select me, other, w from w union all select other, me, w from w), s as (select v.me, n.community, sum(w) as w from v join nodes n on n.id = v.other group by all)
select me as id, arg_max(community, (w, community)) as community from s group by me""")
def neighbour_vote(spark, d):
    return graph.vote_community(trade_nodes(spark, d), trade_edges(spark, d))


@query("""with p as (select p_partkey, p_brand, p_type from part where p_partkey % 3 <> 0), w as (select p_partkey, p_brand, p_type from part where p_partkey % 5 <> 0)
select w.p_brand as file_path, w.p_type as label, w.p_partkey as k, case when exists (select 1 from p where p.p_brand = w.p_brand and p.p_type = w.p_type) then 'trunk_inherited' else 'branch_delta' end as provenance from w""")
def symbol_provenance(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("file_path"), F.col("p_type").alias("label"), F.lit("part").alias("kind"), F.col("p_partkey").alias("k"))
    return graph.provenance(part.where("k % 5 <> 0"), part.where("k % 3 <> 0")).select("file_path", "label", "k", "provenance")


@query("""with a as (select distinct p_brand as file_path, p_type as label from part where p_partkey % 2 = 0), b as (select distinct p_brand as file_path, p_type as label from part where p_partkey % 2 = 1)
select file_path, label, 'added' as change from a where not exists (select 1 from b where b.file_path = a.file_path and b.label = a.label)
union all select file_path, label, 'removed' from b where not exists (select 1 from a where b.file_path = a.file_path and b.label = a.label)""")
def branch_diff(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("file_path"), F.col("p_type").alias("label"), F.lit("part").alias("kind"), F.col("p_partkey").alias("k"))
    return graph.branch_diff(part.where("k % 2 = 0"), part.where("k % 2 = 1")).select("file_path", "label", "change")


@query(None)
def communities_lpa(spark, d):
    return graph.label_propagation(trade_nodes(spark, d), trade_edges(spark, d))


@query(None)
def communities_sequential(spark, d):
    """Nodes see what their neighbours have just become, colour by colour."""
    return coloured_lpa.communities(trade_nodes(spark, d), trade_edges(spark, d))


@query(_G + """, de as (select distinct source, target, type from edges),
hood as (select 's:1' as id, 0 as depth union all select distinct source, 1 from de where target = 's:1'),
near as (select id, depth from hood order by depth, id limit 60),
en as (select near.id, depth, '- ' || label || ' [' || kind || '] ' || file_path || chr(10) || label || ' ' || file_path || chr(10) as entry from near join nodes on nodes.id = near.id),
us as (select *, sum(strlen(entry)) over (order by depth, id rows unbounded preceding) as used from en),
sy as (select string_agg(entry, '' order by depth, id) as t from us where used <= 3794),
touching as (select * from de where source in (select id from near) or target in (select id from near)),
ln as (select source, type, target, '- ' || source || ' ' || type || ' ' || target || chr(10) as line from touching order by source, type, target limit 750),
lu as (select *, sum(strlen(line)) over (order by source, type, target rows unbounded preceding) as used from ln),
re as (select string_agg(line, '' order by source, type, target) as t, count(*) as shown from lu where used <= 2123),
to_ as (select count(*) as n from touching), ca as (select source, row_number() over (order by source) as r from de where target = 's:1'),
md as (select '# s:1' || chr(10) || sy.t || '## Relations' || chr(10) || re.t || case when shown < n then '(more relations were cut)' || chr(10) else '' end as markdown, shown, n from sy, re, to_)
select 's:1' as symbol, markdown, (strlen(markdown) // 4)::bigint as tokens, (select string_agg(source, ',' order by source) from ca where r <= 200) as callers, (select count(*) from ca) as n_callers, 0 as n_callees, shown < n as truncated, n - shown as edges_skipped from md""")
def condensed_context(spark, d):
    row = condense.condense(trade_nodes(spark, d), trade_edges(spark, d).distinct(), "s:1")
    return row.withColumn("callers", F.array_join("callers", ",")).drop("callees")


@query("""with c as (select e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as s from embeddings e, (select embedding from embeddings where vec_id = 0) q),
sd as (select vec_id, label, s from c order by s desc, vec_id::varchar limit 5),
sh as (select c.vec_id, c.label, sd.s, sd.vec_id is not null as seed from c left join sd on sd.vec_id = c.vec_id where c.vec_id in (select vec_id from sd) or c.vec_id - 1 in (select vec_id from sd) or c.vec_id + 1 in (select vec_id from sd)),
df as (select string_agg('- v' || vec_id || ' in g/' || label || chr(10) || 'text' || chr(10), '' order by not seed, s desc nulls last, vec_id::varchar) as t, count(*) filter (seed) as seeds, count(*) as symbols from sh),
ed as (select a.vec_id::varchar as source, b.vec_id::varchar as target from sh a join sh b on b.vec_id = a.vec_id + 1 order by source, target limit 25),
rl as (select string_agg(source || ' CALLS ' || target, chr(10) order by source || ' CALLS ' || target) as t, count(*) as n from ed),
gr as (select 'g (' || min('v' || vec_id) || ')' as name from embeddings where label in (select label from sd) group by label),
cm as (select string_agg(name, chr(10) order by name) as t, count(*) as n from gr),
tx as (select '## Definitions' || chr(10) || df.t || chr(10) || '## Relations' || chr(10) || coalesce(rl.t, '') || chr(10) || '## Communities' || chr(10) || cm.t as context, seeds, symbols, rl.n as n_relations, cm.n as n_communities from df, rl, cm)
select context, (strlen(context) // 4)::bigint as tokens, seeds, symbols, n_relations, n_communities from tx""")
def graph_rag_context(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit("ws").alias("workspace"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("label"), F.concat(F.lit("g/"), F.col("label").cast("string")).alias("file_path"), F.lit("text").alias("text"), F.lit("vec").alias("language"), F.col("label").alias("community"), "embedding")
    edges = v.select(F.col("id").alias("source"), (F.col("id").cast("long") + 1).cast("string").alias("target"), F.lit("CALLS").alias("type"))
    q = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]
    return rag.graph_context(v, edges, q)


_COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


@query(f"select e.vec_id, round({_COS}, 6) as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) q order by {_COS} desc, vec_id limit 10")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k(e, e.where("vec_id = 0").select("embedding").first()[0], 10, key="vec_id").withColumn("similarity", F.round("similarity", 6))


@query(f"select e.vec_id, round({_COS}, 6) as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) q order by {_COS} desc, vec_id limit 10")
def vector_cells_topk(spark, d):
    """The same from cells: the nearest, and those that may hold something nearer."""
    query = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]
    return vector_cells(spark, d).exact(query, 10).withColumn("similarity", F.round("similarity", 6))


@query(f"select e.vec_id, round({_COS}, 6) as similarity from embeddings e, (select embedding from embeddings where vec_id = 1) q where e.label = 3 order by {_COS} desc, vec_id limit 15")
def vector_topk_filtered(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k(e, e.where("vec_id = 1").select("embedding").first()[0], 15, key="vec_id", where=F.col("label") == 3).withColumn("similarity", F.round("similarity", 6))


@query(f"""with s as (select q.vec_id as query, e.vec_id as neighbour, {_COS} as c from embeddings q join embeddings e on e.vec_id <> q.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query order by c desc, neighbour) as rank from s) select query, neighbour, rank, round(c, 6) as similarity from r where rank <= 5""")
def vector_batch_knn(spark, d):
    """The queries are all vectors whose vec_id 20 divides, asked in blocks against all."""
    e = table(spark, d, "embeddings")
    return vectors.block_knn(e, e.where("vec_id % 20 = 0"), 5, key="vec_id").withColumn("similarity", F.round("similarity", 6))


@query("""select vec_id, case when label = 0 then 0.0 else round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) end as norm, 64 as dim from embeddings""")
def zero_vector_guard(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("label") != 0, F.col("embedding")))
    g = e.withColumn("v", vectors.guarded(F.col("embedding"), 64))
    return vectors.of_dimension(g, "v", 64).select("vec_id", F.round(vectors.norm(F.col("v")), 6).alias("norm"), F.size("v").alias("dim"))


@query("""select p_partkey, coalesce(n.nm, o.p_name) as p_name, coalesce(n.sz, o.p_size) as p_size from (select p_partkey, p_name, p_size from part where p_partkey % 2 = 0) o
full outer join (select p_partkey as pk, case when p_partkey % 4 = 0 then upper(p_name) end as nm, p_size + 1 as sz from part where p_partkey % 3 = 0) n on n.pk = o.p_partkey
where p_partkey is not null union all select p_partkey, case when p_partkey % 4 = 0 then upper(p_name) end, p_size + 1 from part where p_partkey % 3 = 0 and p_partkey % 2 = 1""")
def upsert_merge(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    new = part.where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    return store.upsert(part.where("p_partkey % 2 = 0"), new, ["p_partkey"])


@query(_G + """, doomed as (select id from nodes where kind = 'supplier' and file_path = 'NATION_3' or kind = 'supplier' and community = 3)
select source, target, count(*) as n from edges where source not in (select id from doomed) and target not in (select id from doomed) group by all""")
def cascade_delete(spark, d):
    nodes, edges = trade_nodes(spark, d), trade_edges(spark, d)
    _, left = store.cascade(nodes, edges, nodes.where("kind = 'supplier' and community = 3").select("id"))
    return left.groupBy("source", "target").agg(F.count("*").alias("n"))


@query("""with m as (select min(p_brand) as b from part) select p_partkey as id, case when p_brand = b then 'renamed' else p_brand end as file_path from part, m""")
def rename_file(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("ws").alias("workspace"), F.col("p_brand").alias("file_path"))
    old = part.agg(F.min("file_path")).first()[0]
    return store.rename_file(part, "ws", old, "renamed").select("id", "file_path")


@query("select source as workspace, count(*) as n from documents where source <> 'src3' group by source")
def purge_workspace(spark, d):
    nodes = table(spark, d, "documents").select(F.col("source").alias("workspace"), "doc_id")
    return store.purge({"nodes": nodes}, "src3")[0]["nodes"].groupBy("workspace").agg(F.count("*").alias("n"))


@query("""select n_name as name, (select string_agg(s.s_name, ',' order by s.s_name) from supplier s where s.s_nationkey = n.n_nationkey and s.s_suppkey % 2 = 0) as worktrees from nation n
union all select s_name, null from supplier where s_suppkey % 2 = 1""")
def nested_workspaces(spark, d):
    nation, s = table(spark, d, "nation"), table(spark, d, "supplier")
    tops = nation.select(F.col("n_name").alias("name"), F.lit(False).alias("is_worktree"), F.lit(None).cast("string").alias("parent_workspace"))
    trees = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.lit(True).alias("is_worktree"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise("gone").alias("parent_workspace"))
    return store.nest_worktrees(tops.unionByName(trees)).select("name", F.array_join("worktrees", ",").alias("worktrees"))
