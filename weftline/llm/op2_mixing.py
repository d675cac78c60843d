"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target share of the words; a document of the source is
copied ``floor(r)`` times and once more with probability ``frac(r)``, where ``r``
is the target over the source's size.  The fractional copies are settled by the
pivotal method: of two documents a random transfer of words makes at least one
probability 0 or 1, keeps each document's expectation, and keeps the sum of
words of the pair.  Blocks of documents are folded so, each leaves at most one
fractional document, and those meet again in the next level of a tree whose
fan-in is bounded.  In the end one document a source is left and drawn by its own
probability, so every document keeps its expectation, and a source's words differ
from its target by less than that one document.

All of it is DataFrame expressions.  Draws hash what names a pair: id, source, size
and text hash, and a number among rows that agree in all four.  Such rows can be
exchanged, so reruns agree on any cluster, however rows are dealt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.columns import let, unit, words
from weftline.session import materialize, spread

#: Weights of the sources by rank, repeating.
CYCLE = (3, 1, 2)
#: All targets together, as a multiple of all words; and the most a source gets, as a multiple of its own.
SHARE, LIMIT = 1.5, 2
#: Documents meant to meet in one block, blocks that meet in the next level, and the most rows that one fold takes.
BLOCK, FAN_IN, FOLD = 32, 32, 64


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sharing the excess of capped sources by weight until none is above its cap
    ends at ``least(cap, level * weight)`` with one level for all; the sources
    are capped in the order of cap over weight, so prefix sums over that order
    find the level.  The two windows run over one row a source, not over rows.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in cycle]), F.col("_rank") % len(cycle))
    capped = ranked.withColumns({"_w": weight, "_cap": (F.col("source_size") * limit).cast("double")})
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = capped.withColumns({
        "_spent": F.coalesce(F.sum("_cap").over(prior), F.lit(0.0)),
        "_done": F.coalesce(F.sum("_w").over(prior), F.lit(0.0)),
        "_all_w": F.sum("_w").over(whole),
        "_pot": F.sum("source_size").over(whole) * F.lit(share),
    })
    #: The level if the sources before this one are capped and no other is.
    level = (F.col("_pot") - F.col("_spent")) / (F.col("_all_w") - F.col("_done"))
    open_level = F.min(F.when(level * F.col("_w") < F.col("_cap"), F.struct(F.col("_done"), level))).over(whole)
    found = summed.withColumn("_level", open_level["col2"])
    return found.select("source", "source_size", F.when(F.col("_level").isNull() | (F.col("_level") * F.col("_w") >= F.col("_cap")), F.col("_cap")).otherwise(F.col("_level") * F.col("_w")).alias("target"))


def _meet(state: Column, new: Column) -> Column:
    """One pivotal step between the carried document and the next one."""

    def transfer(m: Column) -> Column:
        # m: words the first lacks (gap1), has (has1); the second lacks (gap2), has (has2)
        up, down = F.least(m["gap1"], m["has2"]), F.least(m["has1"], m["gap2"])
        draw = unit(F.xxhash64(F.lit("pivot"), state["carry"]["key"], new["key"]))
        return F.when(
            draw * (up + down) < down,
            F.struct(
                F.when(m["gap1"] <= m["has2"], F.lit(1.0)).otherwise((m["has1"] + up) / m["a1"]).alias("p1"),
                F.when(m["has2"] <= m["gap1"], F.lit(0.0)).otherwise((m["has2"] - up) / m["a2"]).alias("p2"),
            ),
        ).otherwise(
            F.struct(
                F.when(m["has1"] <= m["gap2"], F.lit(0.0)).otherwise((m["has1"] - down) / m["a1"]).alias("p1"),
                F.when(m["gap2"] <= m["has1"], F.lit(1.0)).otherwise((m["has2"] + down) / m["a2"]).alias("p2"),
            )
        )

    def settle(after: Column) -> Column:
        first = F.struct(state["carry"]["key"].alias("key"), state["carry"]["doc"].alias("doc"), after["p1"].alias("p"))
        second = F.struct(new["key"].alias("key"), new["doc"].alias("doc"), after["p2"].alias("p"))
        whole1, whole2 = after["p1"].isin(0.0, 1.0), after["p2"].isin(0.0, 1.0)
        carry = F.when(whole1 & whole2, F.lit(None)).when(whole1, second).otherwise(first)
        done = F.when(whole1 & whole2, F.array(first, second)).when(whole1, F.array(first)).otherwise(F.array(second))
        return F.struct(carry.alias("carry"), F.concat(state["done"], done).alias("done"))

    a1, a2 = state["carry"]["doc"]["size"].cast("double"), new["doc"]["size"].cast("double")
    has1, has2 = a1 * state["carry"]["p"], a2 * new["p"]
    masses = F.struct(a1.alias("a1"), a2.alias("a2"), has1.alias("has1"), has2.alias("has2"), (a1 - has1).alias("gap1"), (a2 - has2).alias("gap2"))
    return let(let(masses, transfer), settle)


def _fold(rows: DataFrame, kind: str) -> DataFrame:
    """One level of the tree: (source, bucket, key, doc, p) folded by blocks of at most FOLD rows."""
    # The larger first, so that what is left over tends to be small.
    order = [F.col("doc.size").desc(), F.col("key"), F.col("doc")]
    block = Window.partitionBy("source", "bucket").orderBy(*order)
    cut = rows.withColumn("_n", F.row_number().over(block)).withColumn("_sub", F.floor((F.col("_n") - 1) / FOLD))
    item = F.struct("_n", F.struct("key", "doc", "p").alias("x"))
    lists = cut.groupBy("source", "bucket", "_sub").agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    items = F.transform("_rows", lambda r: r["x"])
    start = F.expr(f"named_struct('carry', cast(null as {kind}), 'done', cast(array() as array<{kind}>))")
    step = lambda s, x: F.when(s["carry"].isNull(), F.struct(x.alias("carry"), s["done"].alias("done"))).otherwise(_meet(s, x))
    return lists.select("source", "bucket", F.aggregate(items, start, step).alias("_out")).select("source", "bucket", "_out.carry", "_out.done")


def _distinct_keys(rows: DataFrame) -> DataFrame:
    """``rows`` (written, with ``key`` and ``_part``) with keys of their own for rows of one key.

    Such rows are numbered within (key, part of the table), shifted by the counts of
    the parts before, so however many there are none are gathered.
    """
    twice = materialize(rows.groupBy("key").count().filter("count > 1").select(F.col("key").alias("_k")), "keys")
    if twice.isEmpty():
        return rows.drop("_part")
    hit = rows.join(twice, F.col("key") == F.col("_k"), "left_semi")
    before = Window.partitionBy("_k").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    shift = hit.groupBy(F.col("key").alias("_k"), F.col("_part").alias("_q")).count().select("_k", "_q", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    nth = F.row_number().over(Window.partitionBy("key", "_part").orderBy(F.lit(0)))
    numbered = hit.withColumn("_nth", nth).join(shift, (F.col("key") == F.col("_k")) & (F.col("_part") == F.col("_q")))
    own = numbered.withColumn("key", F.xxhash64("key", F.col("_shift") + F.col("_nth")))
    return rows.join(twice, F.col("key") == F.col("_k"), "left_anti").drop("_part").unionByName(own.select(*[c for c in rows.columns if c != "_part"]))


def decide(sized: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``source_size``, ``target`` and the number of ``copies`` of every row of ``sized``.

    ``sized`` is a written table with doc_id, source, size and ``mark``, the text's hash;
    rows of no words get no copy.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("_docs"))
    plan = materialize(totals, "sources")
    goal = targets(plan.select("source", "source_size")).withColumnRenamed("source", "_source")
    docs_of = plan.select(F.col("source").alias("_s"), "_docs")
    goal = goal.join(docs_of, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ready = sized.join(goal, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("_base", F.floor(rate).cast("long")).withColumn("p", rate - F.floor(rate))
    doc = F.struct(*dict.fromkeys([*keep, "source", "size", "source_size", "target", "_base"]))
    key = F.xxhash64("doc_id", "source", "size", "mark")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_docs") / BLOCK))
    rows = materialize(ready.select(doc.alias("doc"), "source", F.when(F.col("size") > 0, F.col("p")).otherwise(F.lit(0.0)).alias("p"), key.alias("key"), blocks.alias("_blocks"), F.spark_partition_id().alias("_part")), "mix")
    kind = rows.select(F.struct("key", "doc", "p").alias("x")).schema["x"].dataType.simpleString()
    settled = [rows.filter("p = 0").select("doc", F.lit(0.0).alias("p"))]
    level = _distinct_keys(rows.filter("p > 0")).select("source", F.pmod(F.xxhash64("key", F.lit("block")), F.col("_blocks")).alias("bucket"), "key", "doc", "p")
    while True:
        folded = materialize(_fold(level, kind), "pivot")
        settled.append(folded.select(F.inline("done")).select("doc", "p"))
        carried = folded.filter("carry is not null").select("source", F.floor(F.col("bucket") / FAN_IN).alias("bucket"), "carry.*")
        most = carried.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            settled.append(carried.select("doc", F.when(unit(F.xxhash64(F.lit("last"), "key")) < F.col("p"), 1.0).otherwise(0.0).alias("p")))
            break
        level = carried.select("source", "bucket", "key", "doc", "p")
    every = reduce(DataFrame.unionByName, settled)
    copies = F.when(F.col("doc.size") > 0, F.col("doc._base") + F.col("p").cast("long")).otherwise(F.lit(0).cast("long"))
    return every.select("doc.*", copies.alias("copies")).drop("_base")


def _size() -> Column:
    return F.size(words(F.col("text"))).cast("long")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The digest of the mix, one row for each row of ``docs``.

    Nulls: a null text has no words and nothing is taken of it; the null source
    is a source as any other, ranked last; a null doc_id is kept.  Repeated rows
    are settled each on its own.  Sources without words have target 0.  An empty
    table gives no rows.  Of ``docs`` only doc_id, source and text are read.
    """
    sized = materialize(spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", _size().alias("size"), F.xxhash64("text").alias("mark")), "sized")
    done = decide(sized, ["doc_id"])
    return done.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0, 1 or 2 times).

    The rows are written once with a number of their own, by which decisions find
    them.  Nulls: a null text has no words and its row is not taken; the null source
    is the last; a null doc_id is kept.  Repeated rows are settled each on its own;
    copies of one row are equal rows of the result.  All columns are kept, of any
    name.  An empty table gives no rows.
    """
    row = F.struct(*docs.columns).alias("__wf_row")
    held = materialize(docs.select(row, "doc_id", "source", _size().alias("size"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("_row")), "numbered")
    copies = decide(held.drop("__wf_row"), ["_row"])
    taken = copies.filter("copies > 0").select(F.col("_row").alias("__wf_n"), F.col("copies").cast("int").alias("__wf_copies"))
    kept = held.select("__wf_row", "_row").join(taken, F.col("_row") == F.col("__wf_n"))
    return kept.withColumn("__wf_copy", F.explode(F.sequence(F.lit(1), F.col("__wf_copies")))).select("__wf_row.*")
