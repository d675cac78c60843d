"""Suffix-array dedup of substrings of SPAN bytes, by two-stage suffix sorting.

A byte is removed where a string of SPAN bytes covers it that also starts in a document
of a smaller doc_id.  Equal strings have to meet in one task, so:

* Documents are held in packs of some megabytes.  Every window of SPAN bytes has an
  anchor, the string of ANCHOR bytes in it with the least hash; equal windows have
  equal anchors.  Consecutive windows of one anchor are a segment.
* Packs send the hashes of their anchors, each once, to buckets, which answer with
  those that stand in several packs or documents.  Most text goes no further.
* Packs send the segments of the anchors that are left, each distinct one once with the
  smallest and largest doc_id that has it, to the anchor's bucket.  An anchor of more
  than HOT segments, a frequent phrase in many contexts, is taken apart: its windows are
  segments of their own and dealt by their own hashes.  That is some fourteen times the
  rows, so it is kept for what a bucket could not hold: HOT segments are some 5 MB.
* A bucket sorts the suffixes of the distinct segments that have an anchor in common, in
  two stages: suffixes smaller than their successors are sorted directly, the others are
  induced by scanning the buckets of first bytes.  Neighbours with SPAN common bytes are
  equal windows, and the smallest doc_id of each such class goes back to the packs that
  asked.  Where all segments of an anchor are one text, as in copies, its windows are
  those of no other text, and nothing is left to sort.

A hash only brings candidates together; equality is decided on bytes.  What meets in a
bucket is a row a pack at most for each distinct segment, however many documents or
places hold it.  Memory follows PACK, the longest document and the number of buckets,
which is the shuffle width times BUCKETS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shingles import mix
from weftline.session import drop_scratch, materialize, shuffle_width, spread

#: Bytes of a match; bytes of an anchor, 8 or more.
SPAN, ANCHOR = 50, 24
#: Bytes of text in a pack, unless one document has more; segments above which an anchor is taken apart, a pack counting 32,767 at most.
PACK, HOT = 4 << 20, 1 << 16
#: Buckets for each shuffle partition.
BUCKETS = 8
#: Bytes hashed at once, so that the arrays stay in cache; fits into the low bits that hold a place.
_CHUNK, _PLACE = 1 << 16, np.uint64(17)
#: A null doc_id counts as this, the largest.
LAST = np.iinfo(np.int64).max

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


# ---- two-stage suffix sorting


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one big-endian number, zeros behind the end, and zeros for SPAN places more."""
    out = np.zeros(len(text) + SPAN + 16, np.uint64)
    out[: len(text)] = text
    for k in (1, 2, 4):
        out[:-k] = out[:-k] << np.uint64(8 * k) | out[k:]
    return out[: len(text) + SPAN + 8] if len(text) else out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For every suffix, whether it is smaller than the next shorter one; the last one is not."""
    n = len(text)
    place = np.arange(n)
    last = n - 1
    differs = np.full(n, last)
    differs[:-1] = np.where(text[:-1] != text[1:], place[:-1], last)
    at = np.minimum.accumulate(differs[::-1])[::-1]  # the first place from here on whose byte differs from the next
    return np.where(at < last, text[at] < text[np.minimum(at + 1, last)], False)


def _directly(places: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``places`` by the first SPAN bytes there, and some more."""
    out = places[np.argsort(words[places])]
    tied = words[out[1:]] == words[out[:-1]]
    open_ = np.concatenate([[False], tied]) | np.concatenate([tied, [False]])
    group = np.cumsum(~np.concatenate([[False], tied]))
    rest = out[open_]
    if len(rest):
        out[open_] = rest[np.lexsort([*(words[rest + k] for k in range((SPAN - 1) // 8 * 8, 0, -8)), group[open_]])]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of a text of bytes by their suffixes, as far as SPAN bytes tell them apart."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_successor(text)
    direct = np.flatnonzero(small)
    if len(direct):
        direct = _directly(direct, words_of(text))
    by_first = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix
    done = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        own = []
        while len(level):  # larger than their successors; behind those that a smaller byte follows come those that this byte follows
            own.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == c) & ~small[before]]
        own.append(direct[by_first[c] : by_first[c + 1]])
        bucket = np.concatenate(own)
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]  # these are larger than their successors, and their order is known now
        first = text[before]
        before, first = before[order := np.argsort(first, kind="stable")], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting[text[part[0]]].append(part)
    return np.concatenate(done)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For neighbours in ``order``, how many bytes they have in common, SPAN at most; zeros stand behind the end."""
    words = words_of(text)
    a, b = order[:-1], order[1:]
    out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, SPAN, 8):
        x = words[a[alive] + k] ^ words[b[alive] + k]
        same = np.full(len(x), 8)
        for j in range(8):
            same -= x >= np.uint64(1 << 8 * j)
        out[alive] += same
        alive = alive[x == 0]
    return np.minimum(out, SPAN)


# ---- packs, anchors, segments


def _squeezed(data: bytes) -> bytes:
    """Text as it is stored and sent: a third of its size."""
    return zstandard.ZstdCompressor(level=1).compress(data)


def _whole(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.binary()), pa.array([_squeezed(b"".join(texts))], pa.binary())], ["pack", "ids", "sizes", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py() or b""
                if texts and held + len(text) > size:
                    yield out()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc_id.as_py())
                texts.append(text)
                held += len(text)
        if texts:
            yield out()

    return run


class _Segments(NamedTuple):
    """Runs of windows with one anchor: its hash, the first and last window's place in the pack, the document."""

    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes at every place where so many are left."""
    power = lambda e: np.uint64(pow(int(_BASE), e, 1 << 64))
    part, size, out, done = _BYTES[data], 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if ANCHOR & size:
                if out is None:
                    out = part
                else:
                    m = len(data) - done - size + 1
                    out = out[:m] * power(size) + part[done : done + m]
                done += size
            if done == ANCHOR:
                return mix(out)
            m = len(part) - size
            part, size = part[:m] * power(size) + part[size : size + m], size * 2


def segments(data: np.ndarray, sizes: np.ndarray) -> _Segments:
    """The segments of a pack, by place."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    found = [_Segments(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    wide = SPAN - ANCHOR + 1
    for at in range(0, len(data) - SPAN + 1, _CHUNK):
        part = data[at : at + _CHUNK + SPAN - 1]
        n = len(part) - SPAN + 1
        hashes = _anchor_hashes(part)
        least = hashes >> _PLACE << _PLACE | np.arange(len(hashes), dtype=np.uint64)
        size = 1
        while size < wide:  # the least of ever wider windows, the first of equal ones
            step = min(size, wide - size)
            least, size = np.minimum(least[:-step], least[step:]), size + step
        anchor = (least & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)[:n]
        doc = owner[at : at + n]
        inside = np.flatnonzero(doc == owner[at + SPAN - 1 : at + SPAN - 1 + n])
        starts, anchor, doc = at + inside, anchor[inside], doc[inside]
        if not len(starts):
            continue
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:] - 1, [len(starts) - 1]])
        found.append(_Segments(hashes[anchor[head]], starts[head], starts[tail], doc[head].astype(np.int64)))
    return _Segments(*[np.concatenate(x) for x in zip(*found, strict=True)])


def _read(pack: dict) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bytes, sizes and ordering keys of the documents of a pack."""
    keys = np.array([LAST if i is None else i for i in pack["ids"]], np.int64)
    return _whole(pack["data"]), np.frombuffer(pack["sizes"], np.int64), keys


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(33)).astype(np.int64) % buckets


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs and the rows in it."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(bucket[rows[0]]), rows


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


# ---- anchors that stand in several documents

#: ``seen``: twice the segments of an anchor in the pack, and one if they are in several documents.
_SIGNED = "bucket long, pack long, hashes binary, seen binary"


def _sign(buckets: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.to_pylist():
                data, sizes, keys = _read(pack)
                found = segments(np.frombuffer(data, np.uint8), sizes)
                order = np.argsort(found.anchor)
                hashes, of = found.anchor[order], keys[found.doc[order]]
                heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
                if not len(heads):
                    continue
                count = np.diff(np.concatenate([heads, [len(hashes)]]))
                seen = (np.minimum(count, 0x7FFF) << 1 | (np.minimum.reduceat(of, heads) != np.maximum.reduceat(of, heads))).astype(np.uint16)
                hashes = hashes[heads]
                parts = [(b, hashes[rows].tobytes(), seen[rows].tobytes()) for b, rows in _by_bucket(_bucket(hashes, buckets))]
                yield _table({"bucket": ([p[0] for p in parts], pa.int64()), "pack": ([pack["pack"]] * len(parts), pa.int64()), "hashes": ([p[1] for p in parts], pa.binary()), "seen": ([p[2] for p in parts], pa.binary())})

    return run


_SHARED = "pack long, plain binary, hot binary"


def _shared(hot: int) -> Callable:
    """Of a bucket's anchors those that stand in several packs, or in several documents of one, back to each pack."""

    def run(rows: pa.Table) -> pa.Table:
        packs, found = rows["pack"].to_pylist(), [np.frombuffer(x, np.uint64) for x in rows["hashes"].to_pylist()]
        seen = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["seen"].to_pylist()])
        hashes, of = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
        order = np.argsort(hashes)
        heads = np.flatnonzero(np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]]))
        count = np.diff(np.concatenate([heads, [len(order)]]))
        shared = (count > 1) | (np.bitwise_or.reduceat(seen[order], heads) & 1).astype(bool)
        level = np.where(shared & (np.add.reduceat((seen[order] >> 1).astype(np.int64), heads) > hot), 2, shared.astype(np.int64))
        levels = np.empty(len(order), np.int64)
        levels[order] = np.repeat(level, count)
        out = [(packs[i], hashes[(of == i) & (levels == 1)].tobytes(), hashes[(of == i) & (levels == 2)].tobytes()) for i in np.unique(of[levels > 0]).tolist()] if len(found) < 64 else _dealt(packs, hashes, of, levels)
        return pa.table({"pack": pa.array([x[0] for x in out], pa.int64()), "plain": pa.array([x[1] for x in out], pa.binary()), "hot": pa.array([x[2] for x in out], pa.binary())})

    return run


def _dealt(packs: list[int], hashes: np.ndarray, of: np.ndarray, levels: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """As many rows as packs, in one pass over the anchors."""
    rows = np.flatnonzero(levels)
    out = []
    for own in np.split(rows, np.flatnonzero(np.diff(of[rows])) + 1):
        if len(own):
            out.append((packs[of[own[0]]], hashes[own[levels[own] == 1]].tobytes(), hashes[own[levels[own] == 2]].tobytes()))
    return out


# ---- equal windows among the segments of shared anchors


class _Cut(NamedTuple):
    """Segments to compare: the window they begin with, their document, the number of their text, where it goes and with which others it may share windows."""

    first: np.ndarray
    doc: np.ndarray
    text: np.ndarray
    texts: list[bytes]
    bucket: np.ndarray
    kin: np.ndarray


def _among(values: np.ndarray, parts: list[bytes] | None) -> np.ndarray:
    held = np.sort(np.frombuffer(b"".join(parts or []), np.uint64))
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values if len(held) else np.zeros(len(values), bool)


def _cut(pack: dict, data: bytes, sizes: np.ndarray, buckets: int) -> _Cut:
    """The segments of a pack whose anchors are shared; equal ones have one text, numbered as they come."""
    found = segments(np.frombuffer(data, np.uint8), sizes)
    apart = _among(found.anchor, pack["hot"])
    kept = apart | _among(found.anchor, pack["plain"])
    count = np.where(apart, found.last - found.first + 1, 1)[kept]
    each = np.repeat(apart[kept], count)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    anchor, first, last, doc = (np.repeat(x[kept], count) for x in found)
    first = np.where(each, first + step, first)
    end = np.where(each, first, last) + SPAN
    number: dict[bytes, int] = {}
    text = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip(first.tolist(), end.tolist(), strict=True)), np.int64, len(first))
    texts = list(number)
    place, kin = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint32)
    place[text], kin[text] = _bucket(anchor, buckets), anchor & np.uint64(0xFFFFFFFF)
    fresh = np.zeros(len(texts), bool)
    fresh[text[each]] = True
    rows = np.flatnonzero(fresh)
    digests = np.fromiter((xxhash.xxh3_64_intdigest(texts[i]) for i in rows.tolist()), np.uint64, len(rows))
    place[rows], kin[rows] = _bucket(digests, buckets), digests & np.uint64(0xFFFFFFFF)
    return _Cut(first, doc, text, texts, place, kin)


#: Rows of a bucket ask for its texts; a row without one keeps, for a pack, where its segments are.
_ASKED = "bucket long, pack long, number binary, least binary, most binary, sizes binary, kin binary, texts binary, place binary, doc binary, text binary"


def _ask(buckets: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.to_pylist():
                data, sizes, keys = _read(pack)
                cut = _cut(pack, data, sizes, buckets)
                least, most = np.full(len(cut.texts), LAST), np.full(len(cut.texts), np.iinfo(np.int64).min)
                np.minimum.at(least, cut.text, keys[cut.doc])
                np.maximum.at(most, cut.text, keys[cut.doc])
                asked = []
                for bucket, rows in _by_bucket(cut.bucket):
                    own = [cut.texts[i] for i in rows.tolist()]
                    lengths = np.fromiter(map(len, own), np.int32, len(own))
                    asked.append((bucket, pack["pack"], rows.astype(np.int32).tobytes(), least[rows].tobytes(), most[rows].tobytes(), lengths.tobytes(), cut.kin[rows].tobytes(), _squeezed(b"".join(own)), None, None, None))
                where = [_squeezed(x.astype(np.int32).tobytes()) for x in (cut.first, cut.doc, cut.text)]
                asked.append((None, pack["pack"], *[None] * 6, *where))
                names = [x.split()[0] for x in _ASKED.split(", ")]
                yield _table({name: (list(column), pa.binary() if i > 1 else pa.int64()) for i, (name, column) in enumerate(zip(names, zip(*asked, strict=True), strict=True))})

    return run


def equal_windows(texts: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, smallest key): the stretches of windows of each text that have one smallest key.

    ``least`` is the key of each text; a window has the smallest key of all texts that hold it.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    order = suffix_array(data)
    prefixes = common_prefixes(data, order)
    of = owner[order]
    window = order + SPAN <= ends[of]
    key = np.where(window, least[of], LAST)
    heads = np.flatnonzero(np.concatenate([[True], prefixes < SPAN]))
    smallest = np.empty(len(order), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.concatenate([heads, [len(order)]])))
    is_window = np.zeros(len(order), bool)
    is_window[order] = window
    places = np.flatnonzero(is_window)
    of, smallest = owner[places], smallest[places]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (smallest[1:] != smallest[:-1])]))
    tail = np.concatenate([new[1:] - 1, [len(places) - 1]])
    start = (ends - sizes)[of[new]]
    return of[new], places[new] - start, places[tail] - start, smallest[new]


def windows_by_kin(texts: list[bytes], least: np.ndarray, kin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``equal_windows`` of distinct texts of which only those of equal ``kin`` can share windows: one alone is not sorted."""
    _, group, count = np.unique(kin, return_inverse=True, return_counts=True)
    alone = count[group] == 1
    one, several = np.flatnonzero(alone), np.flatnonzero(~alone)
    last = np.fromiter((len(texts[i]) - SPAN for i in one.tolist()), np.int64, len(one))
    found = [(one, np.zeros(len(one), np.int64), last, least[one])]
    if len(several):
        of, *rest = equal_windows([texts[i] for i in several.tolist()], least[several])
        found.append((several[of], *rest))
    text, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], *(x[order] for x in rest)


_ANSWERED = "pack long, number binary, first binary, last binary, least binary"


def _answer(rows: pa.Table) -> pa.Table:
    """For each pack and text the windows of which a smaller document may have one."""
    number: dict[bytes, int] = {}
    of, packs = [], rows["pack"].to_pylist()
    for sizes, texts in zip(rows["sizes"].to_pylist(), map(_whole, rows["texts"].to_pylist()), strict=True):
        ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        of.append(np.fromiter((number.setdefault(texts[a:b], len(number)) for a, b in zip([0, *ends], ends, strict=False)), np.int64, len(ends)))
    asked = {c: [np.frombuffer(x, t) for x in rows[c].to_pylist()] for c, t in (("number", np.int32), ("least", np.int64), ("most", np.int64))}
    least, kin = np.full(len(number), LAST), np.zeros(len(number), np.uint32)
    for own, keys, group in zip(of, asked["least"], rows["kin"].to_pylist(), strict=True):
        np.minimum.at(least, own, keys)
        kin[own] = np.frombuffer(group, np.uint32)
    text, first, last, smallest = windows_by_kin(list(number), least, kin)
    begin = np.searchsorted(text, np.arange(len(number) + 1))
    out = []
    for pack, own, numbers, most in zip(packs, of, asked["number"], asked["most"], strict=True):
        count = begin[own + 1] - begin[own]
        run = np.repeat(begin[own] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        asker = np.repeat(np.arange(len(own)), count)
        wanted = smallest[run] < most[asker]
        run, asker = run[wanted], asker[wanted]
        if len(run):
            out.append((pack, numbers[asker].tobytes(), first[run].astype(np.int32).tobytes(), last[run].astype(np.int32).tobytes(), smallest[run].tobytes()))
    columns = ("pack", "number", "first", "last", "least")
    return pa.table({c: pa.array([x[i] for x in out], pa.binary() if i else pa.int64()) for i, c in enumerate(columns)})


# ---- what is left

_LEFT = "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.to_pylist():
            data, sizes, keys = _read(pack)
            change = np.zeros(len(data) + 1, np.int32)
            if pack["number"]:
                start, doc, text = (np.frombuffer(_whole(pack[c]), np.int32) for c in ("place", "doc", "text"))
                number, first, last = (np.frombuffer(b"".join(pack[c]), np.int32) for c in ("number", "first", "last"))
                least, order = np.frombuffer(b"".join(pack["least"]), np.int64), np.argsort(number, kind="stable")
                begin = np.searchsorted(number[order], np.arange(int(text.max()) + 2))
                count = begin[text + 1] - begin[text]
                at = order[np.repeat(begin[text] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
                own = np.repeat(np.arange(len(text)), count)
                gone = least[at] < keys[doc[own]]
                at, own = at[gone], own[gone]
                np.add.at(change, start[own] + first[at], 1)
                np.add.at(change, start[own] + last[at] + SPAN, -1)
            yield _left(pack["ids"], np.frombuffer(data, np.uint8), sizes, np.cumsum(change[:-1]) > 0)


def _left(ids: list[int | None], data: np.ndarray, sizes: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
    spans, kept, start = [], [], 0
    for size in sizes.tolist():
        own = removed[start : start + size]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).tolist() if own.any() else []
        spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        kept.append(data[start : start + size][~own].tobytes() if edges else data[start : start + size].tobytes())
        start += size
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return _table({"doc_id": (ids, pa.int64()), "n_bytes": (sizes, pa.int64()), "spans": (spans, kind), "kept": (kept, pa.binary())})


def deduplicate(docs: DataFrame, pack: int = PACK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (start, end) of removed bytes and kept, the bytes that stay, for every row of ``docs``.

    Kept bytes need not be UTF-8, as a match may begin within a character.  Nulls: a
    null text is empty; a null doc_id counts as the largest long, so it loses what any
    smaller document has, and no other row loses to it.  Rows of one doc_id never lose
    to each other, whether their texts are equal or not.  An empty table gives no rows.
    Of ``docs`` only doc_id and text are read.
    """
    buckets = shuffle_width(docs.sparkSession) * BUCKETS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    packs = materialize(spread(rows).mapInArrow(_pack(pack), "pack long, ids array<long>, sizes binary, data binary"), "packs")
    shared = materialize(packs.select("pack", "ids", "sizes", "data").mapInArrow(_sign(buckets), _SIGNED).groupBy("bucket").applyInArrow(_shared(hot), _SHARED), "anchors")
    anchors = shared.groupBy("pack").agg(F.collect_list("plain").alias("plain"), F.collect_list("hot").alias("hot"))
    asked = materialize(packs.join(anchors, "pack").mapInArrow(_ask(buckets), _ASKED), "segments")
    drop_scratch(shared)
    columns = [c.split()[0] for c in _ASKED.split(", ")]
    answered = materialize(asked.filter("bucket is not null").select(*columns[:8]).groupBy("bucket").applyInArrow(_answer, _ANSWERED), "windows")
    answers = answered.groupBy("pack").agg(*[F.collect_list(c).alias(c) for c in ("number", "first", "last", "least")])
    places = asked.filter("bucket is null").select("pack", *columns[8:])
    return packs.join(answers.join(places, "pack"), "pack", "left").mapInArrow(_finish, _LEFT)


def suffix_documents(docs: DataFrame, pack: int = PACK, hot: int = HOT) -> DataFrame:
    """The digest of ``deduplicate`` for every row of ``docs``; nulls, ties and empty tables as there."""
    return deduplicate(docs, pack, hot).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
