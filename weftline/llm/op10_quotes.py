"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotes; the number of marks is their level.
Consecutive lines of one level are a passage; its words are normalised and
hashed.  Passages of the first level name the message that is answered: the
earliest message of the conversation whose own words hold the passage as a whole,
as a paragraph or as a line.  Deeper levels repeat what that message quoted
itself and name no parent.  Conversations are ordered by thread and within a thread
by replies, depth first: a message is followed by its replies in the order of their
turns, each with its own replies; the quotes are left out.

Joins are on (conversation, hash) or (conversation, turn) with one row a key on one
side; the order of replies comes from doubled pointers, positions from a sort by
ranges, so a conversation or thread of any length is dealt over all tasks.  DataFrame
expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.columns import SPACE_CHARS, let
from weftline.session import drop_scratch, materialize, shuffle_width

#: A line's marks: white space and ``>`` by turns.
_MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: Words from which a single line can name its message.
LINE_WORDS = 3
#: Messages rendered in one row.
BLOCK = 256


def parsed(text: Column) -> Column:
    """(level, line without its marks) of every line."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 0)
        return let(marks, lambda m: F.struct((F.length(m) - F.length(F.replace(m, F.lit(">"), F.lit("")))).alias("level"), F.when(m == "", x).otherwise(F.substring(x, F.length(m) + 1, F.length(x))).alias("line")))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def normal(text: Column) -> Column:
    """Lower case, one space between words, none around."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def _runs(lines: Column, breaks) -> Column:
    """(level, text) of the runs of neighbouring lines of one level; a line for which ``breaks`` holds ends a run and is left out.

    A run is cut out by its first and last line, so the work grows with the lines.
    """

    def cut(x: Column) -> Column:
        at = lambda i: F.get(x, i)
        joined = lambda i, j: F.coalesce((at(i)["level"] == at(j)["level"]) & ~at(i)["off"] & ~at(j)["off"], F.lit(False))
        places = F.sequence(F.lit(0), F.size(x) - 1)
        first = F.filter(places, lambda i: ~at(i)["off"] & ~joined(i - 1, i))
        last = F.filter(places, lambda i: ~at(i)["off"] & ~joined(i, i + 1))
        run = lambda i, j: F.struct(at(i)["level"].alias("level"), F.array_join(F.transform(F.slice(x, i + 1, j - i + 1), lambda y: y["line"]), "\n").alias("text"))
        return F.zip_with(first, last, run)

    return let(F.transform(lines, lambda x: F.struct(x["level"].alias("level"), x["line"].alias("line"), breaks(x).alias("off"))), cut)


def own_text(lines: Column) -> Column:
    """The lines without marks, blank ones at both ends left out."""
    kept = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return F.btrim(kept, F.lit(SPACE_CHARS))


def _hash(text: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), text).alias("h"), F.xxhash64(F.lit(2), text).alias("g"))


def _spoken(own: Column) -> Column:
    """What of a message can be quoted: the whole, its paragraphs, its lines."""
    pieces = F.concat(F.array(own), F.split(own, r"\n[\x20\x09-\x0D]*\n"), F.filter(F.split(own, "\n"), lambda x: F.size(F.split(normal(x), " ")) >= LINE_WORDS))
    return F.array_distinct(F.filter(F.transform(pieces, normal), lambda x: x != ""))


def _quoted(lines: Column) -> Column:
    """(rank, normalised text) of the first-level passages: whole passages, then paragraphs, then lines."""
    first = F.filter(lines, lambda x: x["level"] >= 1)
    flat = lambda rank, texts: F.transform(F.array_distinct(F.filter(F.transform(texts, normal), lambda t: t != "")), lambda t: F.struct(F.lit(rank).alias("rank"), t.alias("t")))
    never = lambda x: F.lit(False)
    blank = lambda x: normal(x["line"]) == ""
    level1 = lambda runs: F.transform(F.filter(runs, lambda r: r["level"] == 1), lambda r: r["text"])
    single = F.transform(F.filter(first, lambda x: (x["level"] == 1) & (F.size(F.split(normal(x["line"]), " ")) >= LINE_WORDS)), lambda x: x["line"])
    return F.concat(flat(0, level1(_runs(lines, never))), flat(1, level1(_runs(lines, blank))), flat(2, single))


def link(messages: DataFrame) -> DataFrame:
    """Every message with ``content`` (no quotes), ``n_quotes`` (first-level passages), ``max_level`` and ``parent_turn``.

    Of several messages quoted the latest is answered, as found for a whole passage, else for a
    paragraph, else for a line; it has a smaller turn.
    """
    lines = parsed(F.col("text"))
    quoting = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?m)^[ \t]*>")
    none = F.expr("cast(array() as array<struct<rank:int,t:string>>)")
    read = messages.select("conv_id", "turn", "role", let(lines, lambda x: F.struct(own_text(x).alias("content"), F.coalesce(F.array_max(F.transform(x, lambda y: y["level"])), F.lit(0)).alias("max_level"), F.when(quoting, _quoted(x)).otherwise(none).alias("quoted"))).alias("_p"))
    held = materialize(read.select("conv_id", "turn", "role", "_p.*"), "messages")

    asked = held.filter(F.size("quoted") > 0).select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.rank", _hash(F.col("q.t")).alias("k")).distinct()
    asked = materialize(asked.select("conv_id", "turn", "rank", "k.h", "k.g"), "quotes")
    if asked.isEmpty():
        parents = None
    else:
        spoken = held.select("conv_id", "turn", F.explode(_spoken(F.col("content"))).alias("t")).select("conv_id", "turn", _hash(F.col("t")).alias("k"))
        wanted = asked.select(F.col("conv_id").alias("_c"), F.col("h").alias("_h"), F.col("g").alias("_g")).distinct()
        same = F.col("conv_id").eqNullSafe(F.col("_c"))
        found = spoken.select("conv_id", "turn", "k.h", "k.g").join(wanted, same & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left_semi")
        first = found.groupBy(F.col("conv_id").alias("_c"), F.col("h").alias("_h"), F.col("g").alias("_g")).agg(F.min("turn").alias("said"))
        hit = asked.join(first, same & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))).filter("said < turn")
        parents = hit.groupBy("conv_id", "turn").agg(F.min(F.struct("rank", (-F.col("said")).alias("back"), "said")).alias("m")).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("m.said").alias("parent_turn"))
        parents = materialize(parents, "parents")
    passages = F.size(F.filter("quoted", lambda q: q["rank"] == 0)).cast("long")
    out = held.withColumn("n_quotes", passages).drop("quoted")
    if parents is None:
        return out.withColumn("parent_turn", F.lit(None).cast(messages.schema["turn"].dataType))
    return out.join(parents, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t")


def _doubled(rows: DataFrame, value: str, add: bool) -> DataFrame:
    """Follow the pointers of written (_c, _t, ptr, ``value``) rows to their ends, by doubling.

    A row points to another one of its conversation; where that is no row, or has no
    pointer, it has arrived.  ``value`` is taken from the row pointed to, added to the
    own one or in its place where it is there.  Rows that have arrived don't join again.
    """
    held, open_, own = rows.withColumn("open", F.col("ptr").isNotNull()), True, False
    while open_:
        there = held.select(F.col("_c").alias("_uc"), F.col("_t").alias("_ut"), F.col("ptr").alias("_up"), F.col(value).alias("_uv"), F.col("open").alias("_uo"))
        joined = held.filter("open").join(there, F.col("_c").eqNullSafe(F.col("_uc")) & (F.col("ptr") == F.col("_ut")), "left")
        new = F.col(value) + F.coalesce("_uv", F.lit(0)) if add else F.coalesce("_uv", value)
        moved = joined.select("_c", "_t", F.coalesce("_up", "ptr").alias("ptr"), new.alias(value), F.coalesce("_uo", F.lit(False)).alias("open"))
        more = materialize(held.filter("not open").unionByName(moved), "pointers")
        open_ = not more.filter("open").isEmpty()
        if own:
            drop_scratch(held)
        held, own = more, True
    return held.drop("open")


def _ordered(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``_p``, the number of its range, and ``_g``, its place in the whole order; rows are written by ranges."""
    width = shuffle_width(df.sparkSession)
    held = materialize(df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ranges")
    placed = held.withColumn("_p", F.shiftright("_m", 33)).withColumn("_l", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    shift = placed.groupBy(F.col("_p").alias("_q")).count().select("_q", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))
    return placed.join(F.broadcast(shift), F.col("_p") == F.col("_q")).withColumn("_g", F.col("_s") + F.col("_l")).drop("_m", "_l", "_q", "_s")


def _roots(replies: DataFrame) -> DataFrame:
    """(_c, _t, root, depth) of the written replies (_c, _t, parent)."""
    found = _doubled(replies.select("_c", "_t", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("depth")), "depth", True)
    return found.withColumnRenamed("ptr", "root")


def _behind(replies: DataFrame) -> DataFrame:
    """(_c, _t, behind): how many messages of its thread stand behind each one, depth first, of the written replies.

    The next message is the first reply, else the next sibling, else that of the
    nearest message above that has one; the length of the chain of next ones counts.
    """
    sisters = _ordered(replies, ["_c", "parent", "_t"])
    following = sisters.select((F.col("_g") - 1).alias("_n"), F.col("_c").alias("_nc"), F.col("parent").alias("_np"), F.col("_t").alias("sister"))
    paired = sisters.join(following, (F.col("_g") == F.col("_n")) & F.col("_c").eqNullSafe(F.col("_nc")) & (F.col("parent") == F.col("_np")), "left")
    # without a next sibling a message points to its parent; at most one points to each
    exits = materialize(paired.select("_c", "_t", F.when(F.col("sister").isNull(), F.col("parent")).alias("ptr"), "sister"), "exits")
    exits = _doubled(exits, "sister", False).select(F.col("_c").alias("_ec"), F.col("_t").alias("_et"), "sister")
    down = replies.groupBy("_c", F.col("parent").alias("_t")).agg(F.min("_t").alias("child"))
    every = replies.select("_c", "_t").unionByName(down.select("_c", "_t")).distinct()
    first = down.select(F.col("_c").alias("_dc"), F.col("_t").alias("_dt"), "child")
    joined = every.join(first, F.col("_c").eqNullSafe(F.col("_dc")) & (F.col("_t") == F.col("_dt")), "left").join(exits, F.col("_c").eqNullSafe(F.col("_ec")) & (F.col("_t") == F.col("_et")), "left")
    chain = materialize(joined.select("_c", "_t", F.coalesce("child", "sister").alias("ptr")).withColumn("behind", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long")), "chain")
    return _doubled(chain, "behind", True).drop("ptr")


def threads(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, root_turn, depth, parent_turn, position, n_quotes, max_level, content.

    ``position`` counts from 0 in each conversation by root, then by replies, depth
    first.  Nulls: a null text is empty; null conversations are one; a message
    without turn starts its own thread behind the others.  Rows that share
    conversation and turn share their parent and are ordered by role, then a hash of
    the content; equal rows stand in any order.  An empty table gives no rows.  Other
    columns are not read.
    """
    linked = materialize(link(messages), "linked")
    replies = materialize(linked.filter("parent_turn is not null").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("parent_turn").alias("parent")).distinct(), "replies")
    if replies.isEmpty():
        named = linked.withColumns({"root_turn": F.col("turn"), "depth": F.lit(0).cast("long"), "_behind": F.lit(0).cast("long")})
    else:
        on = lambda c, t: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("turn") == F.col(t))
        behind = _behind(replies).select(F.col("_c").alias("_bc"), F.col("_t").alias("_bt"), F.col("behind").alias("_behind"))
        both = linked.join(_roots(replies), on("_c", "_t"), "left").join(behind, on("_bc", "_bt"), "left").drop("_c", "_t", "_bc", "_bt")
        named = both.withColumn("root_turn", F.coalesce("root", "turn")).withColumns({"depth": F.coalesce("depth", F.lit(0)).cast("long"), "_behind": F.coalesce("_behind", F.lit(0))})
    # the salt deals equal rows over ranges
    named = materialize(named.withColumns({"_h": F.xxhash64("content"), "_salt": F.rand(7)}), "named")
    order = [F.col("conv_id"), F.col("root_turn").asc_nulls_last(), F.col("_behind").desc(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("_h"), F.col("_salt")]
    placed = _ordered(named, order)
    starts = placed.groupBy(F.col("conv_id").alias("_sc"), F.col("_p").alias("_sp")).agg(F.min("_g").alias("_first"))
    starts = starts.withColumn("_start", F.min("_first").over(Window.partitionBy("_sc")))  # a row a range at most
    out = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("_sc")) & (F.col("_p") == F.col("_sp")))
    return out.select("conv_id", "turn", "role", "root_turn", "depth", "parent_turn", (F.col("_g") - F.col("_start")).alias("position"), "n_quotes", F.col("max_level").cast("long").alias("max_level"), "content")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, part, text): conversations as ``role: content`` paragraphs in order, BLOCK messages a row at most.

    Nulls and repeated rows as in ``threads``; a null role is ``unknown``, an empty
    message a paragraph of its role alone.  An empty table gives no rows.
    """
    line = F.struct("position", F.concat_ws(": ", F.coalesce("role", F.lit("unknown")), "content").alias("line"))
    parts = threads(messages).groupBy("conv_id", F.floor(F.col("position") / BLOCK).alias("part")).agg(F.array_sort(F.collect_list(line)).alias("_l"))
    return parts.select("conv_id", "part", F.array_join("_l.line", "\n\n").alias("text"))
