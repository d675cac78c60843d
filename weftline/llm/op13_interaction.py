"""Filter interaction audit: what each filter removes in every order of five filters.

A document is known by the set of filters that it fails, five bits.  A table of 32 by
120 entries, made once, gives for every such set and order the step at which the
document is removed.  Tasks index it with their documents and count, for each part,
order and step, the removed ones by label; these partial arrays are summed, and every
other figure of the audit follows from the sums.

The one filter that looks beyond a document, "identical to the text of a smaller
doc_id", needs the smallest id of every text.  Texts are known by a SHA-256 digest;
rows of one text, part and label are added up before and after the shuffle, so a text
that a third of all rows share is a few rows for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize, spread

#: The filters, each bit of a mask in this order.
FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
STEPS = len(FILTERS)
#: Labels of a document: bit 0 good, bit 1 toxic.
LABELS = 4

#: The thresholds of the filters A to C, and the characters of D.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, MARKS = 50, 65, 5, b"#$%&*|"

#: Parts that a task counts side by side before it hands on their arrays.
PARTS = 64

_CAPITAL, _LEAD, _MARK = np.zeros(256, bool), np.ones(256, bool), np.zeros(256, bool)
_CAPITAL[65:91], _LEAD[0x80:0xC0], _MARK[list(MARKS)] = True, False, True


def first_failures() -> np.ndarray:
    """[mask, order]: the step, from 0, whose filter removes a document that fails the filters of ``mask``; STEPS for none."""
    masks = np.arange(1 << STEPS)
    fails = masks[:, None, None] >> np.array(ORDERS)[None] & 1
    return np.where(fails.any(2), fails.argmax(2), STEPS).astype(np.int64)


def own_failures(texts: list[bytes]) -> np.ndarray:
    """The bits of the filters A to D for each text of UTF-8 bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)

    def count(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        return sums[ends] - sums[ends - sizes]

    words = [t.split() for t in texts]  # of bytes: at ASCII white space alone
    n = np.fromiter(map(len, words), np.int64, len(texts))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(texts))
    a, b = n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n
    c, d = 100 * count(_CAPITAL) > MAX_CAPITAL_PERCENT * count(_LEAD), count(_MARK) > 0
    return a | b << 1 | c << 2 | d << 3


def _slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with about ``limit`` bytes of text, one row at least, and their texts."""
    texts, start, held = batch.column("text"), 0, 0
    for i in range(len(batch) + 1):
        n = len(texts[i].as_buffer() or b"") if i < len(batch) else 0
        if i > start and (i == len(batch) or held + n > limit):
            yield batch.slice(start, i - start), [t or b"" for t in texts.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += n


def _mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in _slices(batch):
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), pa.array(own_failures(texts), pa.int32()), digests], ["doc_id", "part", "mask", "digest"])


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask of A to D, digest of the text) of every row."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.encode("text", "UTF-8").alias("text"))
    return spread(whole).mapInArrow(_mark, "doc_id long, part string, mask int, digest binary")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the bits of their labels; a document that several rows label has every bit that one of them sets."""
    bit = lambda name, at: F.coalesce(F.when(F.col(name) == 1, at).otherwise(0), F.lit(0))
    by_id = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(bit("quality", 1)).alias("_good"), F.max(bit("toxic", 2)).alias("_toxic"))
    known = rows.filter("doc_id is not null").join(by_id, F.col("doc_id") == F.col("_id"), "left")
    nameless = rows.filter("doc_id is null").select("*", F.lit(0).alias("label"))  # they would meet in one task of the join
    return known.select(*rows.columns, F.coalesce(F.col("_good") + F.col("_toxic"), F.lit(0)).alias("label")).unionByName(nameless)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask of A to E, label, n): how many documents of a part and label fail just these filters.

    Rows may repeat their first three columns; they are not added up across texts.
    """
    key = ["digest", "mask", "part", "label"]
    by_id = _labelled(materialize(marked(docs), "marks"), labels).groupBy(*key, "doc_id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*key).agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"))
    least = F.min("low").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    passing = F.when(F.col("least").isNull(), F.col("n")).when(F.col("low") == F.col("least"), F.col("n_low")).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    rows = by_text.withColumn("least", least).withColumn("passing", passing).select("part", "label", F.explode(both).alias("x"))
    return rows.select("part", F.col("x.mask").alias("mask"), "label", F.col("x.n").alias("n")).filter("n > 0")


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial arrays: for each part and order, documents by step (the last: kept to the end) and label."""
    table, orders = first_failures(), len(ORDERS)
    cells = (STEPS + 1) * LABELS
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for part, sums in held.items():
            flat = pa.ListArray.from_arrays(pa.array(np.arange(orders + 1) * cells, pa.int32()), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array([part] * orders, pa.string()), pa.array(np.arange(orders), pa.int32()), flat], ["part", "order", "removed"])
        held.clear()

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        mask, label, n = (batch.column(c).to_numpy() for c in ("mask", "label", "n"))
        of = parts.indices.to_numpy()
        rows = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(parts.dictionary)))
        for part, own in zip(parts.dictionary.to_pylist(), np.split(rows, ends[:-1]), strict=True):
            steps = table[mask[own]]  # a row of 120 first failures for each row
            at = (np.arange(orders)[None] * (STEPS + 1) + steps) * LABELS + label[own][:, None]
            sums = np.bincount(at.reshape(-1), np.repeat(n[own], orders), orders * cells)  # exact below 2**53
            held[part] = held.get(part, 0) + sums.astype(np.int64)
            if len(held) >= PARTS:
                yield from out()
    yield from out()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; other
    columns, of whatever names, are not read.  Nulls: a null text is an empty one, a null
    source the part "", together with the empty source; a null doc_id is larger than
    every other and has no label, so of a text whose ids are all null no row fails E; a
    null label is 0.  Rows that agree in doc_id and text are documents each, and none of
    them fails E for the other.  A doc_id that ``labels`` holds several times is good, or
    toxic, if one row says so.  An empty table gives no rows.
    """
    rows = failures(docs, labels).select("part", "mask", F.col("label").cast("int").alias("label"), "n")
    partial = rows.mapInArrow(_count, "part string, order int, removed array<long>")
    cells = [(s, k) for s in range(STEPS + 1) for k in range(LABELS)]
    sums = partial.groupBy("part", "order").agg(*[F.sum(F.get("removed", F.lit(s * LABELS + k))).alias(f"_{s}_{k}") for s, k in cells])

    def total(steps: Iterable[int], labels: Iterable[int] = range(LABELS)) -> Column:
        return sum((F.col(f"_{s}_{k}") for s in steps for k in labels), F.lit(0))

    good, toxic = [k for k in range(LABELS) if k & 1], [k for k in range(LABELS) if k & 2]
    names = F.array(*[F.lit("".join(FILTERS[f] for f in o)) for o in ORDERS])
    step = lambda s: F.struct(F.lit(s + 1).alias("step"), total(range(s + 1, STEPS + 1)).alias("kept"), total([s]).alias("removed"), total([s], good).alias("good_lost"), total([s], toxic).alias("toxic_lost"))
    flat = sums.select("part", F.get(names, F.col("order")).alias("filter_order"), F.explode(F.array(*map(step, range(STEPS)))).alias("x")).select("part", "filter_order", "x.*")
    # 120 rows for each part and filter: at its earliest a filter removes all that fail it, at its latest those that fail nothing else
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return flat.select(
        "part",
        "filter_order",
        "step",
        "kept",
        "removed",
        (F.max("removed").over(own) - F.col("removed")).alias("redundant"),
        F.min("removed").over(own).alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(own).alias("shapley"),
    )


ORACLE_SQL = r"""
with w as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as l from documents
),
least as (select text, min(doc_id) as low from w group by text),
d as (
  select part, coalesce(quality, 0) = 1 as good, coalesce(toxic, 0) = 1 as bad,
    {'A': len(l) < 50, 'B': 100 * len(list_distinct(l)) < 65 * len(l), 'C': 100 * length(regexp_replace(w.text, '[^A-Z]+', '', 'g')) > 5 * length(w.text),
     'D': regexp_matches(w.text, '[#$%&*|]'), 'E': coalesce(w.doc_id > low, false)} as f
  from w join least on least.text = w.text left join labels on labels.doc_id = w.doc_id
),
bits as (select part, good, bad, f.A::int + 2 * f.B::int + 4 * f.C::int + 8 * f.D::int + 16 * f.E::int as mask, count(*) as n from d group by all),
letters(x, k) as (values ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.k, b.k, c.k, d.k, e.k] as ks
  from letters a, letters b, letters c, letters d, letters e
  where b.k <> a.k and c.k not in (a.k, b.k) and d.k not in (a.k, b.k, c.k) and e.k not in (a.k, b.k, c.k, d.k)
),
steps as (select *, unnest([1, 2, 3, 4, 5]) as step from orders),
before as (select *, ks[step] as k, list_sum([0] || list_transform(ks[1:step - 1], lambda i: 1 << i)) as earlier from steps),
counted as (
  select part, filter_order, step, k,
    sum(n) filter ((mask & earlier) = 0 and (mask >> k) & 1 = 0) as kept, sum(n) filter ((mask & earlier) = 0 and (mask >> k) & 1 = 1) as removed,
    sum(n) filter ((mask & earlier) <> 0 and (mask >> k) & 1 = 1) as redundant, sum(n) filter (mask = 1 << k) as unique_fails,
    sum(n) filter ((mask & earlier) = 0 and (mask >> k) & 1 = 1 and good) as good_lost, sum(n) filter ((mask & earlier) = 0 and (mask >> k) & 1 = 1 and bad) as toxic_lost
  from bits, before group by part, filter_order, step, k
)
select part, filter_order, step::integer as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, sum(coalesce(removed, 0)) over (partition by part, k)::bigint as shapley
from counted
"""
