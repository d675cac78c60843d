"""Symbols by name: a sorted table of the ends of labels, and postings of the labels.

``ends`` has a row for each place of a label where a name begins, at its start and
behind ``::`` and ``.``, in files cut by range and sorted by that end, so exact names,
qualified ends and beginnings of names are found in a file or two.  Names anywhere in a
label are found by postings, or, where they are too short or too common for that, by
reading the labels in their order until there are enough.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.indexes.grams import PAGES, GramIndex
from weftline.operators import graph
from weftline.session import shuffle_width

#: Files of ``labels`` read first where a name may stand in any label, and how many times as many then.
FIRST, TIMES = 1, 8


def label_ends(label: Column) -> Column:
    """The places, from 1, where a name begins in a label, at each of which it has a qualified end."""
    places = F.sequence(F.lit(1), F.length(label) + 1)
    behind = lambda i, mark: (i > len(mark)) & (F.substring(label, i - len(mark), F.lit(len(mark))) == mark)
    return F.when(F.contains(label, F.lit("::")) | F.contains(label, F.lit(".")), F.filter(places, lambda i: (i == 1) | behind(i, "::") | behind(i, "."))).otherwise(F.array(F.lit(1)))


class SymbolIndex:
    """The symbols of nodes (id, workspace, label, kind, ...) as they were when it was built."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.grams = spark, path.rstrip("/"), GramIndex(spark, f"{path.rstrip('/')}/grams")

    def build(self, nodes: DataFrame) -> SymbolIndex:
        width = shuffle_width(self.spark)
        own = nodes.select(*[c for c in ("id", "workspace", "label", "kind", "file_path") if c in nodes.columns])
        ends = own.select("*", F.explode(label_ends(F.col("label"))).alias("at")).withColumn("name", F.substring("label", F.col("at"), F.length("label")))
        ends.repartitionByRange(width, "name", "id").sortWithinPartitions("name", "id").write.mode("overwrite").options(**PAGES).parquet(f"{self.path}/ends")
        ranged = own.repartitionByRange(width, "label", "id").withColumn("part", F.spark_partition_id())
        ranged.sortWithinPartitions("label", "id").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/labels")
        spaces = own.select("workspace", "label").distinct() if "workspace" in own.columns else own.select(F.lit(None).cast("string").alias("workspace"), "label").distinct()
        self.grams.append(spaces.select(F.struct("workspace", "label").alias("doc"), F.col("label").alias("text")))
        return self

    @functools.cached_property
    def parts(self) -> list[int]:
        """The numbers of the labels' files, in the order of labels."""
        return sorted(r[0] for r in self.labels().select("part").distinct().collect())

    def ends(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ends")

    def labels(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/labels")

    def suffix(self, name: str) -> DataFrame:
        """What ``graph.suffix_matches`` gives: labels that are the name or end with it behind ``::`` or ``.``."""
        return self.ends().where(F.col("name") == name).drop("at", "name")

    def prefix(self, start: str) -> DataFrame:
        """The symbols of which a qualified end begins with ``start``, with that end."""
        after = start[:-1] + chr(ord(start[-1]) + 1) if start else ""
        own = self.ends().where(F.startswith("name", F.lit(start)))
        return own.where((F.col("name") >= start) & (F.col("name") < after)) if start else own

    def find(self, name: str, workspace: str | None = None, limit: int = 20) -> DataFrame:
        """What ``graph.find_symbols`` gives: the exact label first, then labels that hold the name, alphabetically, imports last.

        The exact ones are looked up.  The others are found by postings; where the name
        is shorter than a gram the labels' files are read in their order, some at first
        and all if these hold too few.
        """
        exact = self.ends().where((F.col("name") == name) & (F.col("at") == 1)).drop("at", "name")
        found = self.grams.candidates(name)
        if found is not None:
            own = found.select("doc.*").where(F.contains("label", F.lit(name)))
            own = own if workspace is None else own.where(F.col("workspace") == workspace)
            first = [r["label"] for r in own.select("label").distinct().orderBy("label").limit(limit).collect()]  # each has a symbol or more
            some = self.ends().where(F.col("name").isin(first) & (F.col("at") == 1)).drop("at", "name")
            return graph.find_symbols(some.unionByName(exact).distinct(), name, workspace, limit)
        take = FIRST
        while True:
            some = self.labels().where(F.col("part").isin(self.parts[:take])).drop("part")
            own = some if workspace is None else some.where(F.col("workspace") == workspace)
            if take >= len(self.parts) or own.where(F.contains("label", F.lit(name))).limit(limit).count() >= limit:
                return graph.find_symbols(some.unionByName(exact).distinct(), name, workspace, limit)
            take *= TIMES
