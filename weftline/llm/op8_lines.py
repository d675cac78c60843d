"""Line dedup by overlapping three-line windows.

The lines of a text that hold a word are hashed in windows of three consecutive
ones.  The first occurrence of a window, by doc_id and place, stays; every later
occurrence covers its three lines, and the lines covered by any are removed.  A
later occurrence that overlaps the first one in its own document covers only the
lines behind it.  Texts of fewer than three such lines have no window and stay.

With ``passages``, what stands on one or two lines counts too: a line, or two
consecutive ones, of more than LONG words, and the whole of a text of fewer than
three lines.

Only (hash, document, place) rows are shuffled for the counts, with partial
minima before the shuffle, and windows that occur once never reach the join.
DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import SPACE_CHARS, SPACE_RUN, let, placed
from weftline.session import materialize

SPAN = 3
#: Words above which one or two lines are a passage.
LONG = 50


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def filled(text: Column) -> Column:
    """(place among all lines, trimmed line) of the lines with a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), _bare(x).alias("line"))), lambda x: x["line"] != "")


def window_hashes(text: Column) -> Column:
    """A pair of 64-bit hashes for each window, in order."""

    def hashes(found: Column) -> Column:
        one = lambda i, seed: F.xxhash64(F.lit(seed), F.get(found, i)["line"], F.get(found, i + 1)["line"], F.get(found, i + 2)["line"])
        return F.when(F.size(found) < SPAN, F.array().cast("array<struct<h:bigint,g:bigint>>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(found) - SPAN), lambda i: F.struct(one(i, 1).alias("h"), one(i, 2).alias("g")))
        )

    return let(filled(text), hashes)


def passage_hashes(text: Column) -> Column:
    """A pair of 64-bit hashes, place and number of lines of each passage of fewer lines than a window."""

    def hashes(found: Column) -> Column:
        lines = F.size(found)

        def spans(n: int) -> Column:
            own = lambda i: [F.get(found, i + k)["line"] for k in range(n)]
            words = lambda i: sum((F.size(F.split(x, SPACE_RUN)) for x in own(i)), F.lit(0))
            size = lambda i: sum((F.length(x) for x in own(i)), F.lit(0))
            long = lambda i: (size(i) > 2 * LONG - n) & (words(i) > LONG)  # noqa: E731  words have a letter and, in a line, a blank between
            # a whole text has hashes of its own where its words are no passage
            one = lambda i, seed, at: F.struct(F.xxhash64(F.lit(seed), *own(i)).alias("h"), F.xxhash64(F.lit(seed + 1), *own(i)).alias("g"), at.alias("at"), F.lit(n).alias("n"))
            each = F.transform(F.sequence(F.lit(0), lines - n), lambda i: F.when(long(i), one(i, 3, i)).when(lines == n, one(i, 5, i)))
            return F.when(lines < n, F.array().cast("array<struct<h:bigint,g:bigint,at:int,n:int>>")).otherwise(F.filter(each, lambda x: x.isNotNull()))

        return F.concat(*[spans(n) for n in range(1, SPAN)])

    return let(filled(text), hashes)


def covered_lines(docs: DataFrame, passages: bool = False) -> DataFrame:
    """(_id, _mark, places): the filled lines to remove of every document that has any, by their number.

    A document is known by doc_id and the hash of its text; rows that agree in both
    are one document and keep or lose the same lines.
    """
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"), window_hashes(F.col("text")).alias("_w"))
    spread = keyed.filter(F.size("_w") > 0).select("_id", "_mark", F.posexplode("_w").alias("at", "w"))
    rows = spread.select("w.h", "w.g", "_id", "_mark", "at", F.lit(SPAN).alias("n"))
    if passages:
        short = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"), F.explode(passage_hashes(F.col("text"))).alias("w"))
        rows = rows.unionByName(short.select("w.h", "w.g", "_id", "_mark", "w.at", "w.n"))
    windows = materialize(rows, "windows")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_mark").alias("mark"), F.col("at").alias("at"))
    firsts = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = firsts.filter(F.col("first") != F.col("last")).select("h", "g", "first")
    later = windows.join(repeated, ["h", "g"]).filter(place != F.col("first"))
    same = F.col("_id").eqNullSafe(F.col("first.id")) & (F.col("_mark") == F.col("first.mark"))
    start = F.when(same, F.greatest(F.col("at"), F.col("first.at") + F.col("n"))).otherwise(F.col("at"))
    lines = later.select("_id", "_mark", F.explode(F.filter(F.sequence("at", F.col("at") + F.col("n") - 1), lambda x: x >= start)).alias("line"))
    return lines.groupBy("_id", "_mark").agg(F.array_sort(F.collect_set("line")).alias("places"))


def _without(text: Column, places: Column) -> Column:
    """The text without the filled lines of these numbers; other lines stay, blank ones too."""

    def keep(both: Column) -> Column:
        gone = F.transform(both["places"], lambda p: F.get(both["found"], p)["at"])
        return let(placed(gone, lambda p: F.lit(True), lambda p: p, "boolean"), lambda m: F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.get(m, i), F.lit(False))), "\n"))

    return let(F.struct(filled(text).alias("found"), places.alias("places")), keep)


def clean(docs: DataFrame, count_as: str | None = None, passages: bool = False) -> DataFrame:
    """``docs`` with repeated passages removed; ``count_as`` names a column for the number of removed lines.

    ``n_chars`` follows the text where there is such a column.  A text that loses all
    its lines is empty; the row stays.  Null texts stay null.
    """
    gone = covered_lines(docs, passages).select(F.col("_id").alias("__wf_id"), F.col("_mark").alias("__wf_gone"), F.col("places").alias("__wf_places"))
    marked = docs.select("*", F.xxhash64("text").alias("__wf_mark"))
    joined = marked.join(gone, F.col("doc_id").eqNullSafe(F.col("__wf_id")) & (F.col("__wf_mark") == F.col("__wf_gone")), "left")
    places = F.col("__wf_places")
    out = joined.withColumn("text", F.when(places.isNull(), F.col("text")).otherwise(_without(F.col("text"), places)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(places.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, *([F.coalesce(F.size(places), F.lit(0)).cast("long").alias(count_as)] if count_as else []))


def dedup_lines(docs: DataFrame, passages: bool = False) -> DataFrame:
    """doc_id, n_lines (with a word, before), n_removed and the text that is left, for every row of ``docs``.

    Nulls: a null text has no lines and stays null; a null doc_id counts as the last
    one.  Rows that agree in doc_id and text are one document.  An empty table gives
    no rows.  Of ``docs`` only doc_id and text are read.
    """
    counted = docs.select("doc_id", "text", F.size(filled(F.col("text"))).cast("long").alias("n_lines"))
    return clean(counted, "n_removed", passages).select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = r"""
with lines as (
  select doc_id, u.pos as pos, trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, u.line as line
  from documents, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'pos': i})) as t(u)
),
filled as (select *, row_number() over (partition by doc_id order by pos) - 1 as n from lines where bare <> ''),
windows as (
  select doc_id, n, bare as a, lead(bare, 1) over w as b, lead(bare, 2) over w as c
  from filled window w as (partition by doc_id order by n)
),
ranked as (
  select *, first_value(doc_id) over g as d0, first_value(n) over g as n0
  from windows where c is not null
  window g as (partition by a, b, c order by doc_id, n rows between unbounded preceding and unbounded following)
),
gone as (
  select distinct doc_id, n + k as n from ranked, (values (0), (1), (2)) v(k)
  where (doc_id <> d0 or n <> n0) and (doc_id <> d0 or n + k >= n0 + 3)
),
left_over as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as text
  from lines l left join filled f on f.doc_id = l.doc_id and f.pos = l.pos
  left join gone g on g.doc_id = f.doc_id and g.n = f.n
  where g.n is null group by l.doc_id
)
select d.doc_id, (select count(*) from filled f where f.doc_id = d.doc_id) as n_lines,
  (select count(*) from gone g where g.doc_id = d.doc_id) as n_removed,
  case when d.text is null then null else coalesce(l.text, '') end as text
from documents d left join left_over l on l.doc_id = d.doc_id
"""
