"""Best-fit packing planned on the histogram of lengths.

Lengths are 1 to the capacity, so the histogram has at most that many rows
however many documents there are.  The driver runs best-fit decreasing over the
counts: runs of sequences with equal free space are filled together, and the plan
is a list of segments (length, first rank, count, items a sequence, first
sequence, offset).  Documents then take planned places by joining on their rank
within their length; ranks are counted within input parts and shifted by the
counts of earlier parts, so no length is gathered in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.memory import tidy
from weftline.llm.tokens import encoder, in_slices
from weftline.session import materialize, spread

CAPACITY, END_ID = 2048, 0
#: A plan of more segments is joined by shuffling it.
BROADCAST_SEGMENTS = 100_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _local long"


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, rank, count, per, sequence, offset).

    The items of rank ``rank`` to ``rank + count - 1`` of a length go ``per`` at a time
    to the sequences from ``sequence`` on, the first of each at ``offset``.  Best fit puts
    an item where the least space is left that holds it; after that the same sequence
    has the least, so a sequence is filled with one length as far as it goes, and
    sequences of equal space are treated alike.
    """
    segments, spaces, runs, fresh = [], [], {}, 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                per = capacity // length
                space, first, count = capacity, fresh, -(-left // per)
                fresh += count
            else:
                space = spaces[at]
                first, count = runs[space].pop()
                per = space // length
                if not runs[space]:
                    del runs[space], spaces[at]
            full = min(count, left // per)
            steps = [(first, full, per)] if full else []
            if full < count and left - full * per:
                steps.append((first + full, 1, left - full * per))
            used = sum(n for _, n, _ in steps)
            if used < count:
                steps.append((first + used, count - used, 0))
            for start, n, each in steps:
                if each:
                    segments.append((length, rank, n * each, each, start, capacity - space))
                    rank, left = rank + n * each, left - n * each
                if rest := space - each * length:
                    if rest not in runs:
                        runs[rest] = []
                        insort(spaces, rest)
                    runs[rest].append((start, n))
    return segments


def _pieces(batches: Iterator[pa.RecordBatch], path: str, spaced: bool, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    enc, seen, part = encoder(path, spaced), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in in_slices(texts):
            rows = []
            for doc, got in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                whole = np.append(got, np.uint32(end)).astype("<u4")
                stop, start = len(whole) % capacity or capacity, 0
                piece = 0
                while start < len(whole):
                    n = stop - start
                    rows.append((doc, piece, start, n, zlib.crc32(whole[start:stop].tobytes()), part, int(seen[n])))
                    seen[n] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_local"])


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    They have a length of 1 to ``capacity``, a part number ``_part`` and a rank ``_local``
    from 0 within part and length, and must be a written table.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "_part").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    segments = plan(histogram, capacity)
    table = spark.createDataFrame(segments, "_length long, _rank long, _count long, _per long, _first long, _at long")
    if len(segments) <= BROADCAST_SEGMENTS:
        table = F.broadcast(table)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    ranked = pieces.join(offsets, ["length", "_part"]).withColumn("_r", F.col("_shift") + F.col("_local"))
    placed = ranked.join(table, (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_rank") + F.col("_count")))
    nth = F.col("_r") - F.col("_rank")
    return placed.withColumns({"sequence_id": F.col("_first") + F.floor(nth / F.col("_per")), "offset": F.col("_at") + nth % F.col("_per") * F.col("length")})


def cut_documents(docs: DataFrame, tokenizer: str, spaced: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of the encoded documents, written to the shared folder.

    A document longer than ``capacity`` ids is cut into pieces of ``capacity``, of which
    the first may be shorter.
    """
    rows = spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(tidy(lambda b: _pieces(b, tokenizer, spaced, END_ID, capacity)), _PIECES)
    return materialize(rows, "pieces")


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The places of all pieces of ``docs``.

    Nulls: a null text is an empty one, a piece of one end id; a null doc_id is
    kept.  Repeated rows are packed each on its own.  An empty table gives no rows.
    """
    placed = place(cut_documents(docs, tokenizer))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long"), F.col("offset").cast("long"))


def sequences(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(sequence_id, ids): the packed token sequences themselves.

    Pieces find their texts by the texts' hashes, so doc_id may be null or repeated.
    """
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    placed = place(cut_documents(keyed, tokenizer))
    texts = keyed.select(F.col("doc_id").alias("_id"), "text").dropDuplicates(["_id"])
    rows = placed.join(texts, F.col("doc_id") == F.col("_id")).select("sequence_id", "offset", "start", "length", "text")
    parts = rows.mapInArrow(tidy(lambda b: _slices(b, tokenizer)), "sequence_id long, offset long, ids array<long>")
    joined = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return joined.select("sequence_id", F.flatten("_p.ids").alias("ids"))


def _slices(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, False)
    for batch in batches:
        out = []
        texts = [t or "" for t in batch.column(4).to_pylist()]
        for got, start, n in zip(enc.encode(texts), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            out.append(np.append(got, np.uint32(END_ID))[start : start + n].astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["sequence_id", "offset", "ids"])
