"""Token-budgeted context: bounded neighbourhoods written as text within a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.graph import k_hop

#: Bytes for the symbols, bytes for all, relations listed at most.
SYMBOL_BUDGET, TOTAL_BUDGET, RELATIONS = 3800, 6000, 25
NODE_CAP, SNIPPET, LISTED = 60, 140, 200


def tokens(text: Column) -> Column:
    """Four bytes a token."""
    return F.floor(F.octet_length(text) / 4)


def budget_prefix(entries: DataFrame, order: list, size: Column, budget: int, group: list[str] | None = None) -> DataFrame:
    """The entries before the first that would pass the budget, in order, with the running ``used`` bytes.

    Later entries that would still fit are left out too: the list stops there.
    """
    place = Window.partitionBy(*(group or [])).orderBy(*order) if group else Window.orderBy(*order)
    return entries.withColumn("used", F.sum(size).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("used") <= budget)


def snippet(text: Column, limit: int = SNIPPET) -> Column:
    """The first line, cut with dots."""
    line = F.get(F.split(text, "\n"), F.lit(0))
    return F.when(F.length(line) > limit, F.concat(F.left(line, F.lit(limit - 3)), F.lit("..."))).otherwise(line)


def roots(nodes: DataFrame, symbol: str) -> DataFrame:
    return nodes.where((F.lower("label") == symbol.lower()) | (F.col("id") == symbol)).select("id")


def _listed(ends: DataFrame, name: str) -> DataFrame:
    """One row: the first LISTED of ``x`` in order, and how many there are; a hub's are not gathered."""
    first = ends.orderBy("x").limit(LISTED).agg(F.sort_array(F.collect_list("x")).alias(name))
    return first.crossJoin(ends.agg(F.count("*").alias(f"n_{name}")))  # one row each


def condense(nodes: DataFrame, edges: DataFrame, symbol: str, hops: int = 1) -> DataFrame:
    """One row: the Markdown around a symbol, its token estimate, direct callers and callees (the first LISTED and their number), and whether it was cut.

    At most NODE_CAP nodes by (depth, id); the text has at most TOTAL_BUDGET bytes.
    """
    start = roots(nodes, symbol)
    near = k_hop(edges, start, hops, NODE_CAP)
    bodies = nodes.join(near, "id")
    heading = f"# {symbol}\n"
    entry = F.concat(F.lit("- "), F.col("label"), F.lit(" ["), F.col("kind"), F.lit("] "), F.col("file_path"), F.lit("\n"), F.when(F.col("depth") == 0, F.col("text")).otherwise(snippet(F.col("text"))), F.lit("\n"))
    listed = bodies.select("id", "depth", entry.alias("entry"))
    kept = budget_prefix(listed, ["depth", "id"], F.octet_length("entry"), SYMBOL_BUDGET - len(heading))
    symbols = kept.agg(F.sort_array(F.collect_list(F.struct("depth", "id", "entry"))).alias("s"), F.coalesce(F.max("used"), F.lit(0)).alias("spent"))
    ids = near.select("id")
    touching = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")).select("source", "type", "target").distinct()
    line = F.concat(F.lit("- "), F.col("source"), F.lit(" "), F.col("type"), F.lit(" "), F.col("target"), F.lit("\n"))
    head = "## Relations\n"
    # a line has eight bytes at least, so no more than these can fit; a hub's edges are not gathered
    first = touching.orderBy("source", "type", "target").limit(TOTAL_BUDGET // 8)
    room = budget_prefix(first.withColumn("line", line), ["source", "type", "target"], F.octet_length("line"), TOTAL_BUDGET - SYMBOL_BUDGET - len(head) - 64)
    relations = room.agg(F.sort_array(F.collect_list(F.struct("source", "type", "target", "line"))).alias("r"), F.count("*").alias("shown"))
    total = touching.agg(F.count("*").alias("relations"))
    direct = _listed(edges.join(start.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("x")), "callers").crossJoin(_listed(edges.join(start.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("x")), "callees"))
    row = symbols.crossJoin(relations).crossJoin(total).crossJoin(direct)  # one row each
    body = F.concat(F.lit(heading), F.array_join(F.transform("s", lambda x: x["entry"]), ""), F.lit(head), F.array_join(F.transform("r", lambda x: x["line"]), ""))
    cut = F.col("shown") < F.col("relations")
    text = F.when(cut, F.concat(body, F.lit("(more relations were cut)\n"))).otherwise(body)
    return row.select(F.lit(symbol).alias("symbol"), text.alias("markdown"), tokens(text).alias("tokens"), "callers", "n_callers", "callees", "n_callees", cut.alias("truncated"), (F.col("relations") - F.col("shown")).alias("edges_skipped"))
