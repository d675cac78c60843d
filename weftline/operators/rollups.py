"""Rollups of transcripts by file, merged: a rescan makes anew what changed, and no more.

A file's partial row holds what merges: counts, extremes, the first prompt with its
step, and its tools with their counts.  Partials of changed files replace those before,
those of lost files go, and the merged rows are what ``sessions.rollup`` gives of all
steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import sessions

_SUMS = ("step_count", "user_message_count", "agent_response_count", "tool_call_count", "error_count")


def partials(steps: DataFrame) -> DataFrame:
    """A row for each (file, session_id) of steps that have ``file`` beside the columns that ``sessions.rollup`` reads."""
    agent, user = F.col("type") == "PLANNER_RESPONSE", (F.col("type") == "USER_INPUT") & (F.col("source") == "USER_EXPLICIT")
    n_tools = F.coalesce(F.size("tool_calls"), F.lit(0))
    keys = ["file", "session_id"]
    main = steps.groupBy(*keys).agg(
        F.count("*").alias("step_count"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("last_message_at"),
        F.count_if(user).alias("user_message_count"),
        F.count_if(agent).alias("agent_response_count"),
        F.sum(F.when(agent & (n_tools > 0), n_tools).otherwise(0)).alias("tool_call_count"),
        F.count_if((F.col("status") == "ERROR") | (F.col("type") == "ERROR_MESSAGE")).alias("error_count"),
        F.min(F.when(user, F.col("step_index"))).alias("first_prompt_at"),
        F.min_by(F.when(user, T.user_prompt(F.col("content"))), F.when(user, F.col("step_index"))).alias("first_prompt"),
    )
    tools = steps.where(agent).select(*keys, F.explode("tool_calls.name").alias("tool")).groupBy(*keys, "tool").count()
    maps = tools.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tool", "count"))).alias("tools"))
    return main.join(maps, keys, "left")


def replaced(old: DataFrame, fresh: DataFrame, listing: DataFrame) -> DataFrame:
    """The partials after a rescan: of the files still listed, those made anew in place of the old."""
    kept = old.join(listing.select("file"), "file", "left_semi").join(fresh.select("file").distinct(), "file", "left_anti")
    return kept.unionByName(fresh.select(*old.columns))


def merged(parts: DataFrame) -> DataFrame:
    """One row a session, as ``sessions.rollup`` has it."""
    main = parts.groupBy("session_id").agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min("created_at").alias("created_at"),
        F.max("last_message_at").alias("last_message_at"),
        F.min_by("first_prompt", "first_prompt_at").alias("first_user_prompt_preview"),
    )
    counts = tool_counts(parts).groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", F.col("n").alias("count"))))).alias("tool_calls_map"))
    order = ["session_id", "step_count", "created_at", "last_message_at", *_SUMS[1:], "first_user_prompt_preview", "tool_calls_map"]
    return main.join(counts, "session_id", "left").select(*order)


def tool_counts(parts: DataFrame) -> DataFrame:
    """(session_id, tool, n), for ``sessions.top_tools``; only agents' calls are counted, as in the rollup."""
    return parts.select("session_id", F.explode("tools").alias("t")).groupBy("session_id", F.col("t.tool").alias("tool")).agg(F.sum("t.count").alias("n"))


def totals(parts: DataFrame) -> DataFrame:
    """``sessions.totals`` of the merged rows."""
    return sessions.totals(merged(parts))
