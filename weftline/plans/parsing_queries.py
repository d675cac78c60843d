"""Parsers on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import parsing
from weftline.plans.registry import query
from weftline.plans.views import files, table

_LINES = "string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10))"


@query(f"""with l as (select doc_id, source, lang, {_LINES} as l from documents), b as (select doc_id, source, lang, l, unnest(generate_series(0, least(len(l) - 1, 999), 40)) as s from l where len(l) > 40)
select source || ':' || lang || '/' || doc_id || '.txt#L' || (s + 1) || '-L' || least(s + 40, len(l)) as id, (s + 1)::int as line_start, least(s + 40, len(l))::int as line_end, left(array_to_string(list_slice(l, s + 1, s + 40), chr(10)), 1000) as text from b""")
def fallback_chunks(spark, d):
    return parsing.chunks(files(spark, d)).select("id", "line_start", "line_end", "text")


@query(f"""with l as (select doc_id, source, lang, {_LINES} as l from documents), b as (select doc_id, source, lang, l, unnest(generate_series(0, least(len(l) - 1, 999), 40)) as s from l where len(l) > 40)
select source || ':' || lang || '/' || doc_id || '.txt' as source_id, source || ':' || lang || '/' || doc_id || '.txt#L' || (s + 1) || '-L' || least(s + 40, len(l)) as target_id, 'CONTAINS' as edge_type from b""")
def chunk_edges(spark, d):
    return parsing.fallback(files(spark, d))[1].select("source_id", "target_id", "edge_type")


@query("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as link from pages")
def link_edges(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(parsing.hrefs(F.col("html"))).alias("link"))


@query("select distinct page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as link from pages")
def link_edges_distinct(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(parsing.hrefs(F.col("html")))).alias("link"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
select doc_id, n::int as line, case when n % 5 = 0 then 2 else 1 end as level, trim(regexp_replace(trim(x), '^[*_`]+|[*_`]+$', '', 'g')) as label from l where (n = 1 or n % 5 = 0) and trim(x) <> '' and not starts_with(trim(x), '#') and not starts_with(trim(x), '```') and trim(regexp_replace(trim(x), '^[*_`]+|[*_`]+$', '', 'g')) <> ''""")
def heading_sections(spark, d):
    """All lines of every document; the first and every fifth become headings."""
    f = files(spark, d)
    lines = F.split("content", "\n")
    marked = F.transform(lines, lambda x, i: F.when((F.trim(x) == "") | F.startswith(F.trim(x), F.lit("#")), F.lit("")).when((i + 1) % 5 == 0, F.concat(F.lit("## "), x)).when(i == 0, F.concat(F.lit("# "), x)).otherwise(F.lit("")))
    heads = parsing.headings(f.withColumn("content", F.array_join(marked, "\n")))
    return heads.select(F.regexp_extract("file_path", r"(\d+)\.txt", 1).cast("long").alias("doc_id"), "line", "level", "label")


@query("""with f as (select p_partkey as k, 'CREATE TABLE IF NOT EXISTS t' || p_partkey || ' (a int);' || chr(10) || 'create view v' || p_partkey || ' as select 1' as x from part)
select 'ws:' || k || '.sql:t' || k as id, 't' || k as label, 'table' as kind, 1 as line_start from f union all select 'ws:' || k || '.sql:v' || k, 'v' || k, 'view', 2 from f""")
def sql_objects(spark, d):
    k = F.col("p_partkey").cast("string")
    f = table(spark, d, "part").select(F.lit("ws").alias("workspace"), F.concat(k, F.lit(".sql")).alias("file_path"), F.concat(F.lit("CREATE TABLE IF NOT EXISTS t"), k, F.lit(" (a int);\ncreate view v"), k, F.lit(" as select 1")).alias("content"))
    return parsing.sql(f)[0].where("kind <> 'sql'").select("id", "label", "kind", "line_start")


@query("""select 'ws:' || event_id || '.json:k' as id, 'k' as label, 'property' as kind from events where json_extract_string(props, '$.k') is not null""")
def json_properties(spark, d):
    f = table(spark, d, "events").select(F.lit("ws").alias("workspace"), F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("file_path"), F.col("props").alias("content"))
    return parsing.json(f)[0].where("kind = 'property'").select("id", "label", "kind")


@query("""select doc_id, length(text) > 50 and not contains(text, 'a/b') as admitted from (select doc_id, text from documents) """)
def file_admission(spark, d):
    from weftline.sources.files import admissible

    docs = table(spark, d, "documents")
    ext = F.when((F.length("text") > 50) & ~F.contains("text", F.lit("a/b")), "x/a.rs").otherwise("x/a.png")
    return docs.select("doc_id", admissible(ext, F.lit(100), F.col("text").cast("binary")).alias("admitted"))
