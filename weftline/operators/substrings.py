"""Which texts hold which strings, by keys: an equi-join where a nested loop would test every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.indexes.grams import N, grams
from weftline.session import materialize


def _stretches(text: Column, n: int) -> Column:
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def holding(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text, needle): each pair of the different texts and strings of which the text holds the string.

    A string's key is that of its three-letter stretches which the fewest texts have; one of
    one or two letters is its own key.  Texts that have the key are tested for the string.
    """
    own = materialize(texts.select("text").where("text is not null").distinct().withColumn("tid", F.xxhash64("text")), "texts")
    wanted = materialize(needles.select("needle").where("needle is not null").distinct(), "needles")
    keys = own.select("tid", F.explode(F.concat(grams(F.col("text")), *[_stretches(F.col("text"), n) for n in range(1, N)])).alias("key"))
    long = wanted.where(F.length("needle") >= N).select("needle", F.explode(grams(F.col("needle"))).alias("key"))
    asked = keys.join(long.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    # a stretch that no text has is the rarest: its string is nowhere
    rarest = long.join(asked, "key", "left").groupBy("needle").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    by_key = rarest.unionByName(wanted.where(F.length("needle").between(1, N - 1)).select("needle", F.col("needle").alias("key")))
    pairs = keys.join(by_key, "key").select("tid", "needle").distinct().join(own, "tid").where(F.contains("text", F.col("needle"))).select("text", "needle")
    empty = wanted.where("needle = ''")
    return pairs.unionByName(own.select("text").join(F.broadcast(empty), F.lit(True)).select("text", "needle"))  # one row at most
