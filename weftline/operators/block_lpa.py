"""The rounds of label propagation over blocks of nodes, for graphs of any size.

A round by rows sends every vote through a shuffle.  Here nodes and their links are
dealt over blocks by the hash of their ids, and a block holds its links as arrays:

* A block says once which neighbours it has in every other block; that is a route.
* In a round each block sends along its routes the labels of the nodes asked for, each
  once however many of the block's nodes vote on it, and counts its own nodes' votes.

Only labels move from block to block, and the arrays of a block go to its task again.
Blocks have about VOTES votes, so a task's memory doesn't grow with the graph.  A node of
very many neighbours would make its block larger; then, and where two ids have one hash,
``propagate`` has no answer and the rounds have to go by rows.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import drop_scratch, materialize

logger = logging.getLogger(__name__)

#: Votes of a block, and the fewest for which another block is made; how many times VOTES a block may have.
VOTES, FEWEST, HUB = 1 << 21, 1 << 16, 4
#: Classes of hashes in which votes are counted beforehand; the most blocks.
CLASSES = 1 << 12
#: Edges that are dealt at a time.
_EDGES = 1 << 20
#: The label of an end that is no node.
NONE = np.iinfo(np.int64).min

_DEALT = "block int, voter binary, nbr binary, level binary"
_LINKED = "block int, other int, voter binary, count binary, slot binary, level binary, wanted binary"
_HELD = "block int, key binary, at binary, count binary, slot binary, level binary, other binary, route binary"
_SENT = "block int, other int, label binary, wanting long"


def propagate(begun: DataFrame, edges: DataFrame, levels: list[float], last: int, widest: int) -> DataFrame | None:
    """(id, label) after the rounds from (id, label), or None where they have to go by rows.

    ``edges`` are (source, target, w), each w one of ``levels``; ends that are no nodes
    don't count.  As elsewhere a 64-bit hash stands for an id; that those of all nodes
    differ is checked.
    """
    keyed = begun.select("id", "label", F.xxhash64("id").alias("key"))
    nodes, keys = keyed.agg(F.count("*"), F.count_distinct("key")).first()
    if nodes != keys:
        return None
    ends = edges.where("source != target").select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b"), F.col("w").cast("double").alias("w"))
    blocks = _blocks(ends, widest)
    if not blocks:
        return begun if blocks is not None else None
    levels = sorted(set(levels))
    dealt = ends.mapInArrow(_deal(blocks, np.array(levels)), _DEALT)
    linked = materialize(dealt.repartition(blocks, "block").groupBy("block").applyInArrow(_link(blocks), _LINKED), "linked")
    own = keyed.select(F.pmod("key", F.lit(blocks)).cast("int").alias("block"), "key", "label").repartition(blocks, "block").groupBy("block")
    held = materialize(own.cogroup(linked.repartition(blocks, "block").groupBy("block")).applyInArrow(_hold, _HELD + ", label binary"), "held")
    drop_scratch(linked)

    def each(run: Callable, schema: str, labels: DataFrame) -> DataFrame:
        return held.drop("label").repartition(blocks, "block").groupBy("block").cogroup(labels.repartition(blocks, "block").groupBy("block")).applyInArrow(run, schema)

    sent = materialize(held.mapInArrow(_first, _SENT), "sent")
    wanting = 0
    for turn in range(last):
        after = materialize(each(_round(turn, np.array(levels)), _SENT, sent), "sent")
        drop_scratch(sent)
        sent, wanting = after, after.where("other < 0").agg(F.sum("wanting")).first()[0]
        logger.info("round %d: %d nodes want to move", turn, wanting)
        if not wanting:
            break
    else:
        logger.warning("label propagation ended after %d rounds, %d nodes want to move", last, wanting)
    found = each(_named, "key long, label long", sent.where("other < 0"))
    out = materialize(keyed.select("id", "key").join(found, "key").select("id", "label"), "labels")
    drop_scratch(sent)
    drop_scratch(held)
    return out


def _blocks(ends: DataFrame, widest: int) -> int | None:
    """How many blocks the votes want, a power of two; none for no votes, and None where a block would be too large."""
    of = lambda c: F.pmod(c, F.lit(CLASSES)).cast("int")
    count = np.zeros(CLASSES, np.int64)
    for c, n in ends.select(F.explode(F.array(of("a"), of("b"))).alias("c")).groupBy("c").count().collect():  # CLASSES rows at most
        count[c] = n
    total, blocks = int(count.sum()), 1
    if not total:
        return 0
    while blocks < CLASSES and (total > blocks * VOTES or (blocks < widest and total > blocks * FEWEST)):
        blocks *= 2
    return blocks if count.reshape(-1, blocks).sum(axis=0).max() <= HUB * VOTES else None


# ---- arrays in binary columns


def _squeezed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _array(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _row(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _heads(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (keys & np.int64(blocks - 1)).astype(np.int32)


# ---- links by block


def _deal(blocks: int, levels: np.ndarray) -> Callable:
    """Every edge to the blocks of both its ends, as a vote of either for the other."""

    def out(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, w = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in batches]) for i in range(3))
        voter, nbr, level = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.searchsorted(levels, w).astype(np.uint8), 2)
        block = _block_of(voter, blocks)
        order = np.argsort(block.astype(np.uint16), kind="stable")
        voter, nbr, level, block = voter[order], nbr[order], level[order], block[order]
        cuts = [*_heads(block).tolist(), len(block)]
        rows = [(int(block[i]), voter[i:j].tobytes(), nbr[i:j].tobytes(), level[i:j].tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
        yield from _row(_DEALT, rows).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held >= _EDGES:
                yield from out(waiting)
                waiting, held = [], 0
        if held:
            yield from out(waiting)

    return run


def _link(blocks: int) -> Callable:
    """A block's votes by voter, each with the slot of its neighbour among all the block's neighbours; for every block those wanted of it."""

    def run(dealt: pa.Table) -> pa.Table:
        block = dealt["block"][0].as_py()
        voter, nbr, level = (np.concatenate([np.frombuffer(x, t) for x in dealt[c].to_pylist()]) for c, t in (("voter", np.int64), ("nbr", np.int64), ("level", np.uint8)))
        wanted, slot = np.unique(nbr, return_inverse=True)
        by = np.argsort(_block_of(wanted, blocks).astype(np.uint16), kind="stable")  # slots stand by block, and by key in it
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        voter, who = np.unique(voter, return_inverse=True)
        votes = who << 40 | place[slot].astype(np.int64) << 8 | level
        votes.sort()  # by voter and slot
        wanted, count = wanted[by], np.bincount(who, minlength=len(voter)).astype(np.int32)
        rows = [(block, None, voter.tobytes(), count.tobytes(), _squeezed((votes >> 8 & 0xFFFFFFFF).astype(np.int32)), _squeezed(votes.astype(np.uint8)), None)]
        other = _block_of(wanted, blocks)
        cuts = [*_heads(other).tolist(), len(other)]
        rows += [(int(other[i]), block, None, None, None, None, wanted[i:j].tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
        return _row(_LINKED, rows)

    return run


def _hold(nodes: pa.Table, linked: pa.Table) -> pa.Table:
    """A block: its nodes' keys and labels, its votes by the places of its nodes, and its routes, which name places too."""
    block = (nodes if nodes.num_rows else linked)["block"][0].as_py()
    key, label = nodes["key"].to_numpy(), nodes["label"].to_numpy()
    order = np.argsort(key)
    key, label = key[order], label[order]

    def places(wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        return np.where(key[at] == wanted, at, -1).astype(np.int32) if len(key) else np.full(len(wanted), -1, np.int32)

    at, count, slot, level = (np.zeros(0, t) for t in (np.int32, np.int32, np.int32, np.uint8))
    others, routes = [], []
    for row in sorted(linked.to_pylist(), key=lambda r: -1 if r["other"] is None else r["other"]):
        if row["other"] is not None:
            others.append(row["other"])
            routes.append(places(np.frombuffer(row["wanted"], np.int64)))
            continue
        at, count = places(np.frombuffer(row["voter"], np.int64)), np.frombuffer(row["count"], np.int32)
        own = np.repeat(at >= 0, count)
        slot, level = _array(row["slot"], np.int32)[own], _array(row["level"], np.uint8)[own]
        at, count = at[at >= 0], count[at >= 0]
    ends = np.array([[other, len(route)] for other, route in zip(others, routes, strict=True)], np.int32)
    route = np.concatenate([np.zeros(0, np.int32), *routes])
    columns = (key, at, count, np.diff(slot, prepend=np.int32(0)), level, ends, route)  # steps between slots take less than slots
    return _row(_HELD + ", label binary", [(block, *map(_squeezed, columns), label.tobytes())])


# ---- a round


def _sent(held: dict, label: np.ndarray, wanting: int) -> pa.Table:
    """A block's labels for itself, and for every block those that it wants."""
    rows, start = [(held["block"], -1, _squeezed(label), wanting)], 0
    asked = np.append(label, NONE)[_array(held["route"], np.int32)]
    for other, n in _array(held["other"], np.int32).reshape(-1, 2).tolist():
        rows.append((other, held["block"], _squeezed(asked[start : start + n]), None))
        start += n
    return _row(_SENT, rows)


def _first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for held in batch.to_pylist():
            yield from _sent(held, np.frombuffer(held["label"], np.int64), 0).to_batches()


def may_move(keys: np.ndarray, turn: int) -> np.ndarray:
    """``graph._turn`` of the ids whose xxhash64 are ``keys``: the hash goes on from theirs with the number of the turn."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = (keys.view(np.uint64) + p5 + np.uint64(4)) ^ np.uint64(turn) * p1
        h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
    return ((h ^ h >> np.uint64(32)) & np.uint64(1)) == 0


def wishes(label: np.ndarray, inbox: np.ndarray, at: np.ndarray, count: np.ndarray, slot: np.ndarray, level: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """For every node the label of the largest summed weight among its neighbours, the larger of equal ones; its own without any."""
    known, code = np.unique(inbox, return_inverse=True)
    low, mid = max(1, int(len(levels) - 1).bit_length()), max(1, len(known).bit_length())
    votes = np.repeat(np.arange(len(at), dtype=np.int64), count) << mid | code[slot]
    if len(known) and known[0] == NONE:
        votes, level = votes[code[slot] != 0], level[code[slot] != 0]
    wish = label.copy()
    if not len(votes):
        return wish
    votes = votes << low | level
    votes.sort()  # voter, label and weight in one number
    weight, votes = levels[votes & ((1 << low) - 1)], votes >> low
    heads = _heads(votes)
    total, votes = np.add.reduceat(weight, heads), votes[heads]
    voter, code = votes >> mid, votes & ((1 << mid) - 1)
    heads = _heads(voter)
    most = np.repeat(np.maximum.reduceat(total, heads), np.diff([*heads, len(voter)]))
    wish[at[voter[heads]]] = known[np.maximum.reduceat(np.where(total == most, code, -1), heads)]
    return wish


def _round(turn: int, levels: np.ndarray) -> Callable:
    def run(held: pa.Table, sent: pa.Table) -> pa.Table:
        block = held.to_pylist()[0]
        parts = [_array(x["label"], np.int64) for x in sorted(sent.select(["other", "label"]).to_pylist(), key=lambda x: x["other"])]
        label, inbox = parts[0], np.concatenate([np.zeros(0, np.int64), *parts[1:]])
        at, count, slot, level = (_array(block[c], t) for c, t in (("at", np.int32), ("count", np.int32), ("slot", np.int32), ("level", np.uint8)))
        wish = wishes(label, inbox, at, count, np.cumsum(slot), level, levels)
        wants = wish != label
        return _sent(block, np.where(wants & may_move(_array(block["key"], np.int64), turn), wish, label), int(wants.sum()))

    return run


def _named(held: pa.Table, sent: pa.Table) -> pa.Table:
    return pa.table({"key": _array(held["key"][0].as_py(), np.int64), "label": _array(sent["label"][0].as_py(), np.int64)})
