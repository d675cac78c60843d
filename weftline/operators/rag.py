"""Graph-augmented retrieval: vector seeds, their neighbourhood, definitions and relations within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.condense import RELATIONS, SYMBOL_BUDGET, snippet, tokens
from weftline.operators.graph import describe, neighbours
from weftline.operators.vectors import top_k
from weftline.session import materialize


def graph_context(nodes: DataFrame, edges: DataFrame, query: list[float], k: int = 5, workspace: str | None = None) -> DataFrame:
    """One row: the text, its token estimate and what it drew on.

    Seeds stand before neighbours; definitions are added until the text reaches the
    budget, so the last may pass it; relations have both ends among the nodes shown.
    """
    where = None if workspace is None else F.col("workspace") == workspace
    seeds = materialize(top_k(nodes.select("id", "workspace", "embedding"), query, k, where=where), "seeds")
    near = neighbours(edges, seeds.select("id")).join(seeds.select("id", "similarity"), "id", "left")
    shown = nodes.join(near, "id").withColumn("seed", F.col("similarity").isNotNull())
    body = F.when(F.col("seed"), F.left("text", F.lit(300))).otherwise(snippet(F.col("text"), 300))
    entry = F.concat(F.lit("- "), F.col("label"), F.lit(" in "), F.col("file_path"), F.lit("\n"), body, F.lit("\n"))
    # an entry has eight bytes at least, so no more than these can be shown; a hub's neighbours are not gathered
    shown = shown.orderBy((~F.col("seed")).cast("int"), F.desc_nulls_last("similarity"), "id").limit(SYMBOL_BUDGET // 8 + 1)
    order = Window.orderBy((~F.col("seed")).cast("int"), F.desc_nulls_last("similarity"), "id")
    before = F.coalesce(F.sum(F.octet_length("entry")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = shown.select("id", "seed", "similarity", "community", entry.alias("entry")).withColumn("before", before).withColumn("place", F.row_number().over(order)).where(F.col("before") < SYMBOL_BUDGET)
    kept = materialize(kept, "definitions")
    ids = kept.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "type", "target").distinct().orderBy("source", "type", "target").limit(RELATIONS)
    touched = kept.where("seed and community is not null").select("community").distinct()
    summaries = describe(nodes.join(touched, "community", "left_semi")).select("community", "name")
    parts = kept.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]), "").alias("definitions"), F.count_if("seed").alias("seeds"), F.count("*").alias("symbols"))
    links = inner.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "source", "type", "target"))), "\n").alias("relations"), F.count("*").alias("n_relations"))
    groups = summaries.agg(F.array_join(F.sort_array(F.collect_list("name")), "\n").alias("communities"), F.count("*").alias("n_communities"))
    row = parts.crossJoin(links).crossJoin(groups)  # one row each
    text = F.concat_ws("\n", F.lit("## Definitions"), "definitions", F.lit("## Relations"), "relations", F.lit("## Communities"), "communities")
    return row.select(text.alias("context"), tokens(text).alias("tokens"), "seeds", "symbols", "n_relations", "n_communities")
