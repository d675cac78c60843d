"""Table maintenance on Parquet snapshots: every function returns the new state of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import suffix_match


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new``; null or absent fields of a new row keep the old value."""
    fresh = new.select(*[F.col(c).alias(f"_{c}") for c in new.columns])
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    both = old.join(fresh, on, "full_outer")
    return both.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns])


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_file(nodes: DataFrame, edges: DataFrame, workspace: str, file_path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without a file: edges that touch its nodes on either end go first."""
    return cascade(nodes, edges, nodes.where((F.col("workspace") == workspace) & (F.col("file_path") == file_path)).select("id"))


def cascade(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = doomed.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


def purge(tables: dict[str, DataFrame], workspace: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without a workspace, and the count of its nodes."""
    count = tables["nodes"].where(F.col("workspace") == workspace).agg(F.count("*").alias("purged"))
    return {k: t.where(~F.col("workspace").eqNullSafe(F.lit(workspace))) for k, t in tables.items()}, count


def rename_file(nodes: DataFrame, workspace: str, old: str, new: str) -> DataFrame:
    """The path of a file's nodes changes; ids and edges stay."""
    own = (F.col("workspace") == workspace) & (F.col("file_path") == old)
    return nodes.withColumn("file_path", F.when(own, F.lit(new)).otherwise(F.col("file_path")))


def set_communities(nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    fresh = assigned.select("id", F.col("community").alias("_c"))
    return nodes.join(fresh, "id", "left").withColumn("community", F.coalesce("_c", "community")).select(*nodes.columns)


def file_community(nodes: DataFrame, workspace: str, file_path: str) -> DataFrame:
    """The smallest community among a file's nodes."""
    return nodes.where((F.col("workspace") == workspace) & (F.col("file_path") == file_path)).agg(F.min("community").alias("community"))


def dead_worktrees(meta: DataFrame, existing: DataFrame) -> DataFrame:
    """Worktrees whose root is not among the existing paths."""
    return meta.where("is_worktree").join(existing.select(F.col("path").alias("root_path")), "root_path", "left_anti")


def add_relationships(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, dim: int = 384) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the wanted relations (workspace, source_symbol, target_symbol, type, category).

    Symbols are matched by label or its qualified end, the smallest id first; unknown
    ones become virtual nodes with a zero vector.  Blank symbols are refused.
    """
    asked = wanted.where((F.trim("source_symbol") != "") & (F.trim("target_symbol") != ""))
    names = asked.select("workspace", F.col("source_symbol").alias("symbol")).unionByName(asked.select("workspace", F.col("target_symbol").alias("symbol"))).distinct()
    ends = F.array_distinct(F.array(F.col("label"), F.regexp_extract("label", r"(?:^|::|\.)([^:.]+)$", 1)))
    by_end = nodes.select(F.col("workspace").alias("_w"), "id", "label", F.explode(ends).alias("_end"))
    found = names.join(by_end, (F.col("workspace") == F.col("_w")) & (F.regexp_extract("symbol", r"([^:.]+)$", 1) == F.regexp_extract("_end", r"([^:.]+)$", 1)) & suffix_match(F.col("label"), F.col("symbol"))).groupBy("workspace", "symbol").agg(F.min("id").alias("found"))
    known = names.join(found, ["workspace", "symbol"], "left").select("workspace", "symbol", F.coalesce("found", F.concat_ws(":", "workspace", F.lit("virtual"), "symbol")).alias("id"), F.col("found").isNull().alias("virtual"))
    extra = {"label": F.col("symbol"), "kind": F.when(F.contains("symbol", F.lit("/")), "endpoint").otherwise("virtual_service"), "file_path": F.lit("virtual"), "language": F.lit("virtual"), "text": F.col("symbol"), "embedding": F.array_repeat(F.lit(0.0).cast("float"), dim)}
    virtual = known.where("virtual").select(*[(extra[c] if c in extra else F.col(c) if c in ("id", "workspace") else F.lit(None).cast(nodes.schema[c].dataType)).alias(c) for c in nodes.columns])
    a = known.select("workspace", F.col("symbol").alias("source_symbol"), F.col("id").alias("source"))
    b = known.select("workspace", F.col("symbol").alias("target_symbol"), F.col("id").alias("target"))
    linked = asked.join(a, ["workspace", "source_symbol"]).join(b, ["workspace", "target_symbol"]).select("workspace", "source", "target", "type", F.coalesce("category", F.lit("INFERRED")).alias("category"))
    return nodes.unionByName(virtual), edges.unionByName(linked, allowMissingColumns=True)


def write_partitions(df: DataFrame, path: str) -> None:
    """Overwrite only the workspaces that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace").parquet(path)


def append(df: DataFrame, path: str) -> bool:
    """Add rows to a written table; whether it went well, as telemetry must not stop what it reports on."""
    try:
        df.write.mode("append").parquet(path)
    except Exception:
        return False
    return True


def nest_worktrees(spaces: DataFrame) -> DataFrame:
    """Top-level workspaces with their worktrees: (name, is_worktree, parent_workspace) rows nested by parent; orphans stay on top."""
    names = spaces.select(F.col("name").alias("parent_workspace")).distinct()
    child = spaces.where(F.coalesce("is_worktree", F.lit(False))).join(names, "parent_workspace", "left_semi")
    nested = child.groupBy(F.col("parent_workspace").alias("name")).agg(F.sort_array(F.collect_list(child["name"])).alias("worktrees"))
    return spaces.join(child.select("name"), "name", "left_anti").join(nested, "name", "left").orderBy("name")


def inherit_seeds(parent_nodes: DataFrame, parent: str, child: str) -> DataFrame:
    """(id, community) seeds of a child workspace: the parent's ids with its name once replaced."""
    at = F.instr("id", parent)
    renamed = F.when(at > 0, F.concat(F.substring("id", F.lit(1), at - 1), F.lit(child), F.substring("id", at + len(parent), F.length("id")))).otherwise(F.col("id"))
    return parent_nodes.where((F.col("workspace") == parent) & F.col("community").isNotNull()).select(renamed.alias("id"), "community")
