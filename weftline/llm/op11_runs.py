"""Periodic runs of words, found by matching aligned power-of-two blocks.

A run is a stretch of words with smallest period q that no neighbour extends; runs of
at least MIN_LENGTH words and MIN_PERIODS periods are found, all of them.

The words of a text become numbers.  For each scale B, a power of two, the blocks of B
words at multiples of B are the keys of an Aho-Corasick automaton over number
sequences, which is run over the whole text.  A run of period q in [B, 2B) holds an
aligned block together with its copy q words on: the stretch whose words recur q words
later is 2q words at least, and an aligned block fits into any 2B - 1.  For periods
below 2 * BASE the smallest scale serves, as MIN_LENGTH leaves room there.  Pairs of
occurrences at such a distance are seeds, extended to both sides word by word, in
doubling slices.  Larger blocks are spelled in numbers of shorter stretches, doubled
from scale to scale, so that keys stay short: the automaton takes a step for every
border of what it has read.

Two rules keep that near to linear, on texts of one word only too.  A block can lie in
such a run only if each of its words recurs within 2B words, so other blocks are no
keys.  And occurrences of a block that overlap by half lie in a periodic stretch, as a
chain of even steps; a run of another period that holds such a block goes beyond the
stretch, so it matches the first occurrences of two chains or the last ones, and no
other pairs of them are seeds.

Texts are worked on one at a time in tasks; memory grows with the longest text of a
batch, by some hundred bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import let, words
from weftline.session import spread

MIN_LENGTH, MIN_PERIODS = 24, 3
#: The smallest scale: 2 * BASE - 1 words fit into MIN_LENGTH - q where q < BASE.
BASE = 8

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _extend(ids: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The longest stretch [start, end) around ``at`` where every word equals the one d places on; ids[at] does."""
    n, step, end = len(ids) - d, 64, at
    while end < n:
        stop = min(n, end + step)
        off = np.flatnonzero(ids[end:stop] != ids[end + d : stop + d])
        if len(off):
            end += int(off[0])
            break
        end, step = stop, step * 2
    start, step = at, 64
    while start > 0:
        stop = max(0, start - step)
        off = np.flatnonzero(ids[stop:start] != ids[stop + d : start + d])
        if len(off):
            start = stop + int(off[-1]) + 1
            break
        start, step = stop, step * 2
    return start, end


def _seeds(names: np.ndarray, blocks: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(place, distance) of pairs of occurrences of the aligned blocks at ``blocks``, at distances of this scale.

    ``names`` numbers the stretches of size / BASE words at every place, so a key has
    BASE numbers at any scale; the text is searched once for each offset of a stretch.
    """
    piece = size // BASE
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    keys: dict[tuple, int] = {}
    for key in map(tuple, names[blocks[:, None] + np.arange(BASE) * piece].tolist()):
        if key not in keys:
            keys[key] = len(keys)
            automaton.add_word(key, keys[key])
    automaton.make_automaton()
    rows = -(-len(names) // piece) + 1  # the last of each offset is a number of its own
    dealt = np.full(rows * piece, int(names.max()) + 1, np.int64)
    dealt[: len(names)] = names
    found: list[list[int]] = [[] for _ in keys]
    for end, key in automaton.iter(tuple(dealt.reshape(rows, piece).T.reshape(-1).tolist())):
        found[key].append((end % rows - BASE + 1) * piece + end // rows)
    low, high = (1 if size == BASE else size), 2 * size
    for places in found:
        if len(places) < 2:
            continue
        at = np.sort(places)
        breaks = np.flatnonzero(np.diff(at) > size // 2) + 1
        firsts, lasts = at[np.concatenate([[0], breaks])], at[np.concatenate([breaks - 1, [len(at) - 1]])]
        if low == 1:
            for i in np.flatnonzero(firsts < lasts).tolist():  # within a chain all steps are the block's own period
                k = int(np.searchsorted(at, firsts[i]))
                yield int(firsts[i]), int(at[k + 1] - at[k])
        for ends in (firsts, lasts):
            for k in range(1, 6):  # chains are more than half a block apart
                far = ends[k:] - ends[:-k]
                for i in np.flatnonzero((far >= low) & (far < high)).tolist():
                    yield int(ends[i]), int(far[i])


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(ids)
    if n < MIN_LENGTH:
        return []
    order = np.argsort(ids, kind="stable")
    again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    gap = np.full(n, n, np.int64)  # to the next place of the same word
    gap[order[again]] = order[again + 1] - order[again]
    names, piece, runs, size = ids, 1, {}, BASE
    while size == BASE or size <= n // MIN_PERIODS:
        held = (gap < 2 * size)[: n // size * size].reshape(-1, size).all(1)
        blocks = np.flatnonzero(held) * size
        if len(blocks):
            while piece * BASE < size:
                names, piece = np.unique(names[:-piece] * (int(names.max()) + 1) + names[piece:], return_inverse=True)[1], piece * 2
            known: dict[int, list[tuple[int, int]]] = {}
            for at, d in _seeds(names, blocks, size):
                if any(s <= at < e for s, e in known.get(d, ())):
                    continue
                start, end = _extend(ids, at, d)
                known.setdefault(d, []).append((start, end))
                length = end + d - start
                # a multiple of a run's period gives the same stretch
                if length >= max(MIN_LENGTH, MIN_PERIODS * d) and runs.get((start, length), n) > d:
                    runs[start, length] = d
        size *= 2
    return sorted(((s, m, d) for (s, m), d in runs.items()), key=lambda r: (r[0], r[2]))


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in a run behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) > 0


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, texts = [], []
        for text in batch.column(batch.num_columns - 1):
            ws = (text.as_py() or b"").split()  # of bytes: at ASCII white space alone
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws))
            runs = find_runs(ids)
            if runs:
                ws = [w for w, gone in zip(ws, dropped_words(len(ws), runs).tolist(), strict=True) if not gone]
            found.append([{"start": s, "length": m, "period": d} for s, m, d in runs])
            texts.append(b" ".join(ws))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names[:-1], "runs", "collapsed"])


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, runs (by start, then period) and collapsed, the words that no run drops, joined by one space.

    Words are runs of other characters than ASCII white space.  A word is dropped where
    a run contains it behind the run's first period.
    """
    rows = docs.select(*keep, F.encode("text", "UTF-8").alias("__wf_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return spread(rows).mapInArrow(_scan, f"{kept}, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where about each tenth text ends in a run that its doc_id decides.

    With h the crc32 of the decimal doc_id and g = floor(h / 10): where h % 10 is 0 and
    the text has n > 0 words, each word i >= a becomes word a + (i - a) % p, for a = g %
    n and p = 1 + floor((n - a) / (3 + g % 8)).  A null doc_id plants nothing.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def rewrite(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    text = F.when((h % 10 == 0) & (F.size(words(F.col("text"))) > 0), let(words(F.col("text")), rewrite)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def run_documents(docs: DataFrame) -> DataFrame:
    """The digest of the runs of every row of ``docs``, once the planted ones are in.

    n_runs; start, length, period and exponent_milli of the run with the greatest
    length / period (exact; then the smallest start, then the smallest period), null
    without a run; the checksums of all runs and of the collapsed text.  Nulls: a null
    text has no words; a null doc_id plants no run.  Equal rows get equal results.  An
    empty table gives no rows.  Of ``docs`` only doc_id and text are read.
    """
    longer = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  runs come by start, then period
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, x: F.when(longer(x, best), x).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), (F.concat(r["period"].cast("string"), F.lit("\n")))))
    held = scan(planted(docs), ["doc_id"]).withColumn("best", best)
    return held.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
