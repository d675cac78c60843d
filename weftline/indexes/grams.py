"""Postings of the three-letter stretches of texts: where a string may stand.

``postings`` holds (gram, doc), each once, in files cut by range and sorted, so a gram's
are in one file or a few whose statistics name it.  ``counts`` holds how many there are,
so that a lookup begins with the rarest.  What is added later comes in files of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import shuffle_width

N = 3
#: Grams of a query that are intersected, the rarest first; the rest is left to verification.
MOST = 4
#: Rows of a page: what is read of a sorted file is the pages whose range holds what is asked for.
PAGES = {"parquet.page.row.count.limit": 1000}


def grams(text: Column) -> Column:
    """The distinct stretches of N characters of a text."""
    return F.when(F.length(text) < N, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - N + 1), lambda i: F.substring(text, i, F.lit(N)))))


def query_grams(query: str) -> list[str]:
    return sorted({query[i : i + N] for i in range(len(query) - N + 1)})


class GramIndex:
    """The postings below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        """Add the texts of (doc, text); a doc comes once."""
        exploded = rows.select("doc", F.explode(grams(F.col("text"))).alias("gram"))
        # a gram of every text is cut over several files, so none of them is one task's alone
        exploded.repartitionByRange(shuffle_width(self.spark), "gram", "doc").sortWithinPartitions("gram", "doc").write.mode("append").options(**PAGES).parquet(f"{self.path}/postings")
        counts = self.spark.read.parquet(f"{self.path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").options(**PAGES).parquet(f"{self.path}/counts")

    def candidates(self, query: str) -> DataFrame | None:
        """(doc) of the texts that hold the query's rarest grams; None where the query is shorter than a gram."""
        wanted = query_grams(query)
        if not wanted:
            return None
        known = {r["gram"]: r["n"] for r in self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(wanted)).collect()}
        postings = self.spark.read.parquet(f"{self.path}/postings")
        if len(known) < len(wanted):  # one of them stands nowhere
            return postings.select("doc").where(F.lit(False))
        rarest = sorted(wanted, key=lambda g: (known[g], g))[:MOST]
        out = postings.where(F.col("gram") == rarest[0]).select("doc")
        for gram in rarest[1:]:
            out = out.join(postings.where(F.col("gram") == gram).select("doc"), "doc", "left_semi")
        return out
