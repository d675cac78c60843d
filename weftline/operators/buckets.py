"""Tables in buckets by key, of which a change rewrites those that it touches.

``BucketTable`` is one table.  ``GraphTables`` holds a graph in three: nodes by their
file, and edges twice, by the file of either end, so what a changed file takes along is
in its own bucket and in those of the files it is linked with.

A rewrite makes the new rows of the touched buckets first, beside the table, and then
puts them in place, bucket by bucket; a job that fails before that has changed nothing,
and one that fails within it is finished by applying the same change again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from weftline.operators import store
from weftline.session import dealt, drop_scratch, materialize


class BucketTable:
    """Rows below a folder by the hash of their key; ``key`` may be several columns."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._schema: StructType | None = None

    @property
    def schema(self) -> StructType:
        if self._schema is None:
            self._schema = self.spark.read.parquet(self.path).drop("bucket").schema
        return self._schema

    def bucket(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*(columns or self.key)), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> BucketTable:
        dealt(rows.withColumn("bucket", self.bucket()), self.buckets).write.mode("overwrite").partitionBy("bucket").parquet(self.path)
        self._schema = rows.schema
        return self

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; other buckets are not opened."""
        whole = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(self.path)
        return (whole if touched is None else whole.where(F.col("bucket").isin(touched))).drop("bucket")

    def touched(self, keys: DataFrame, *columns: str) -> list[int]:
        """The buckets of some keys; as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.select(self.bucket(*columns)).distinct().collect())

    def rewrite(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Put what ``change`` makes of the rows of these buckets in their place."""
        if not touched:
            return
        new = materialize(change(self.read(touched)).withColumn("bucket", self.bucket()), "buckets")
        filled = {r[0] for r in new.select("bucket").distinct().collect()}
        if strange := filled - set(touched):
            raise ValueError(f"rows of the buckets {sorted(strange)} in a change of {touched}")
        dealt(new, len(touched)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for bucket in set(touched) - filled:  # an empty bucket is none
            place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
            place.getFileSystem(conf).delete(place, True)
        drop_scratch(new)

    def upsert(self, new: DataFrame) -> list[int]:
        """``store.upsert`` on the buckets of the new keys, which it gives back."""
        held = materialize(new, "upsert")
        touched = self.touched(held)
        self.rewrite(touched, lambda old: store.upsert(old, held, list(self.key)))
        drop_scratch(held)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """The rows without these keys."""
        held = materialize(keys.select(*self.key).distinct(), "delete")
        touched = self.touched(held)
        self.rewrite(touched, lambda old: old.join(held, list(self.key), "left_anti").select(*old.columns))
        drop_scratch(held)
        return touched


class GraphTables:
    """Nodes (id, workspace, file_path, ...) and edges (source, target, ...) that a changed file changes in its own buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        place = ("workspace", "file_path")
        self.nodes = BucketTable(spark, f"{path}/nodes", place, buckets)
        self.out = BucketTable(spark, f"{path}/out", ("source_ws", "source_file"), buckets)
        self.into = BucketTable(spark, f"{path}/into", ("target_ws", "target_file"), buckets)
        self.columns: list[str] = []

    def create(self, nodes: DataFrame, edges: DataFrame) -> GraphTables:
        """Edges of unknown ends are left out."""
        self.columns = edges.columns
        placed = materialize(self._placed(nodes, edges), "placed")
        self.nodes.create(nodes)
        self.out.create(placed)
        self.into.create(placed)
        drop_scratch(placed)
        return self

    def _placed(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Edges with the files of their ends."""
        end = lambda side: nodes.select(F.col("id").alias(side), F.col("workspace").alias(f"{side}_ws"), F.col("file_path").alias(f"{side}_file"))
        return edges.join(end("source"), "source").join(end("target"), "target").select(*edges.columns, "source_ws", "source_file", "target_ws", "target_file")

    def edges(self) -> DataFrame:
        return self.out.read().select(*self.columns)

    def replace_files(self, files: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> dict[str, list[int]]:
        """The files (workspace, file_path) with new nodes in place of their old ones, and the edges of these.

        Edges that touch an old node go, ``new_edges`` come, each with ends that are there
        then.  Gives the buckets of each table that were written anew.
        """
        files = materialize(files.select("workspace", "file_path").distinct(), "files")
        own = self.nodes.touched(files)
        fresh = materialize(new_nodes, "fresh")
        doomed = materialize(self.nodes.read(own).join(files, ["workspace", "file_path"], "left_semi").select("id"), "doomed")
        gone = materialize(self._of(self.out, files, "source", doomed).unionByName(self._of(self.into, files, "target", doomed)).distinct(), "gone")
        ends = new_edges.select(F.col("source").alias("id")).unionByName(new_edges.select(F.col("target").alias("id"))).distinct()
        self.nodes.rewrite(own, lambda old: old.join(files, ["workspace", "file_path"], "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns)))
        known = self._located(materialize(ends, "ends"))
        come = materialize(self._placed(known, new_edges.select(*self.columns)), "come")
        done = {"nodes": own}
        for name, table in (("out", self.out), ("into", self.into)):
            touched = sorted({*table.touched(gone), *table.touched(come)})
            key = ["source", "target"]
            table.rewrite(touched, lambda old, t=tuple(touched), table=table: old.join(gone.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(come.select(*old.columns)))
            done[name] = touched
        for df in (files, fresh, doomed, gone, come):
            drop_scratch(df)
        return done

    def _located(self, ids: DataFrame) -> DataFrame:
        """(id, workspace, file_path) of some ids: looked for where ids of the form ``workspace:file:...`` name it, then the rest everywhere."""
        parts = F.split("id", ":")
        named = ids.where(F.size(parts) > 2).select(F.get(parts, F.lit(0)).alias("workspace"), F.get(parts, F.lit(1)).alias("file_path"))
        near = self.nodes.read(self.nodes.touched(named, "workspace", "file_path")).select("id", "workspace", "file_path").join(ids, "id", "left_semi")
        near = materialize(near, "near")
        rest = materialize(ids.join(near, "id", "left_anti"), "rest")
        if rest.isEmpty():
            return near
        return near.unionByName(self.nodes.read().select("id", "workspace", "file_path").join(rest, "id", "left_semi"))

    def _of(self, table: BucketTable, files: DataFrame, side: str, doomed: DataFrame) -> DataFrame:
        """The edges with a doomed node on one side."""
        return table.read(table.touched(files, "workspace", "file_path")).join(doomed.select(F.col("id").alias(side)), side, "left_semi").select(*table.schema.names)
