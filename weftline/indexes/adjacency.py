"""Edges written twice, by the bucket of either end: a hop reads the buckets of its frontier.

A frontier of at most FRONTIER nodes, which is counted, is sent to the tasks that read
these buckets, so no edge is shuffled; a larger one is joined as any table is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.graph import bucket_of
from weftline.session import dealt, drop_scratch, materialize

#: Nodes of a frontier that is broadcast.
FRONTIER = 100_000


class Adjacency:
    """Two tables below a folder: ``out`` by the bucket of the source, ``into`` by that of the target."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def build(self, edges: DataFrame) -> Adjacency:
        """Write all edges (source, target, ...)."""
        for side, end in (("out", "source"), ("into", "target")):
            rows = dealt(edges.withColumn("bucket", bucket_of(end, self.buckets)), self.buckets)
            rows.sortWithinPartitions("bucket", end).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{side}")
        return self

    def touching(self, seeds: DataFrame, side: str) -> DataFrame:
        """The edges out of, or into, the seeds (id)."""
        end = "source" if side == "out" else "target"
        ids = seeds.select(F.col("id").alias(end)).distinct()
        held = ids.groupBy(bucket_of(end, self.buckets).alias("bucket")).count().collect()  # ``buckets`` rows at most
        edges = self.spark.read.parquet(f"{self.path}/{side}").where(F.col("bucket").isin([r["bucket"] for r in held])).drop("bucket")
        if sum(r["count"] for r in held) <= FRONTIER:
            ids = F.broadcast(ids)
        return edges.join(ids, end, "left_semi")

    def neighbours(self, seeds: DataFrame) -> DataFrame:
        """(id): the seeds and every node one edge away."""
        ends = self.touching(seeds, "out").select(F.col("target").alias("id"))
        starts = self.touching(seeds, "into").select(F.col("source").alias("id"))
        return ends.unionByName(starts).unionByName(seeds.select("id")).distinct()

    def k_hop(self, seeds: DataFrame, hops: int, cap: int | None = None) -> DataFrame:
        """(id, depth): what ``graph.k_hop`` gives; the frontiers are written, and dropped behind the last."""
        seen = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "hops")
        fronts = [seen]
        for depth in range(1, hops + 1):
            known = reduce(DataFrame.unionByName, fronts)
            near = self.neighbours(fronts[-1].select("id")).join(known.select("id"), "id", "left_anti")
            fronts.append(materialize(near.withColumn("depth", F.lit(depth)), "front"))
        out = materialize(reduce(DataFrame.unionByName, fronts), "hops")
        for front in fronts:
            drop_scratch(front)
        return out if cap is None else out.orderBy("depth", "id").limit(cap)

    def references(self, targets: DataFrame, nodes: DataFrame) -> DataFrame:
        """What ``graph.references`` gives for the matches (id) of a symbol; callers are looked up where they are few."""
        hit = self.touching(targets, "into")
        callers = nodes.select(F.col("id").alias("source"), F.col("label").alias("caller"), F.col("file_path").alias("caller_file"))
        return hit.join(callers, "source").select("source", "caller", "caller_file", "target", "type")
