"""Full-text search of transcript steps by postings, with the scan's results.

A step's searched text is cleaned and put in lower case once, when it is added.  A query
of three letters or more reads its rarest grams' postings, then the buckets of texts
that hold a candidate, and tests these for the query itself; a shorter one scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.indexes.grams import GramIndex
from weftline.operators import sessions
from weftline.operators.graph import bucket_of

#: Folders of texts by the hash of their step.
BUCKETS = 64


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.grams = spark, path.rstrip("/"), GramIndex(spark, f"{path.rstrip('/')}/grams")

    def append(self, steps: DataFrame) -> SearchIndex:
        """Add steps (session_id, step_index, source, type, content, created_at, tool_calls); a step comes once."""
        n_tools = F.coalesce(F.size("tool_calls"), F.lit(0)) if "tool_calls" in steps.columns else F.lit(0)
        made = F.col("created_at") if "created_at" in steps.columns else F.lit(None).cast("timestamp")
        rows = steps.select("session_id", "step_index", "type", made.alias("created_at"), n_tools.alias("n_tools"), "content", sessions.searched_text().alias("body"))
        rows = rows.where(F.trim("body") != "").withColumn("doc", F.xxhash64("session_id", "step_index")).withColumn("bucket", bucket_of("doc", BUCKETS))
        written = f"{self.path}/texts"
        rows.repartition(BUCKETS, "bucket").sortWithinPartitions("doc").write.mode("append").partitionBy("bucket").parquet(written)
        self.grams.append(rows.select("doc", F.lower("body").alias("text")))
        return self

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def matching(self, query: str) -> DataFrame:
        """The texts that hold the query, whatever its letters' case."""
        rows, found = self.texts(), self.grams.candidates(query.lower())
        if found is not None:
            held = [r[0] for r in found.select(bucket_of("doc", BUCKETS)).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(held)).join(found, "doc", "left_semi")
        return rows.where(F.instr(F.lower("body"), query.lower()) > 0)

    def search(self, query: str, kind: str = "", limit: int = 100) -> DataFrame:
        """What ``sessions.search`` gives of all steps added."""
        hits = self.matching(query).where(T.message_filter(kind, F.col("type"), F.col("content"), F.col("n_tools")))
        return sessions.newest(hits, query, limit)
