"""N-gram Jaccard join by PartEnum signatures.

Sets of shingles with a Jaccard similarity of at least 0.8 differ in at most
``(|a| + |b|) / 9`` shingles.  For a bound ``k`` on that difference the domain of
hashes is cut into ``n1`` parts and each part into ``N2``; by the pigeonhole
principle some part has at most ``K2`` differing shingles, so for some ``N2 - K2`` of
its sub-parts both sets hold the same shingles, and the hash of those is a
signature that they share.  The bounds form a grid; a pair uses the least that
holds its difference, and a set signs for each bound that a partner may use.

``n1`` exceeds the pigeonhole's need by a slack, so a set may leave out as many
parts with an empty selection; only a set with more of them signs for empty
selections too.  One of two similar sets at least is not of that kind, or both
are, so no pair is lost.

Equal sets are one node, named by a fingerprint.  Signatures travel in packed
blocks; the sets that share one are first compared with one of them, which joins
most groups of copies in linear work; groups that still hold several components
are compared member by member in bounded cells, first by parity sketches, which
never reject a similar pair.  Every link is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.graph import components
from weftline.llm.memory import tidy
from weftline.llm.shingles import PERCENT, fingerprints, linked, mix, shingle_sets
from weftline.llm.tokens import in_slices
from weftline.session import drop_scratch, materialize, shuffle_width

#: Sub-parts of a part, and how many of them are left out.
N2, K2 = 3, 1
#: The step of the grid of bounds, the slack of parts, and the bits of a sketch.
STEP, SLACK, SKETCH = 1.25, 0.15, 1024
#: Signatures meant for one bucket, held by a task before it sends them, and read at once.
BUCKET, FLUSH, PIECE = 1_000_000, 1_000_000, 2_000_000
#: Characters whose shingles are held at a time.
SLICE = 1_000_000
#: Members compared with one set, members of a cell, and pairs of a cell sent, at a time.
FAN, CELL, PAIRS = 256, 2048, 200_000
#: Rounds in which components join their nearest ones, before the rest is compared in full.
ROUNDS = 3
#: Members up to which equal groups are found and kept once.
FEW = 16


def _grid() -> np.ndarray:
    """The bounds 1, 2, 3, ... by steps, beyond the longest texts."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * STEP)))
    return np.array(out, np.int64)


GRID = _grid()


def bounds_of(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last place in the grid at which sets of these sizes sign; the last below the first: nowhere.

    Partners have ``ceil(0.8 n)`` to ``floor(n / 0.8)`` shingles.  Pairs with a bound of 0 are equal sets.
    """
    low = (size + -(-size * PERCENT // 100)) * (100 - PERCENT) // (100 + PERCENT)
    high = (size + size * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)
    first, last = np.searchsorted(GRID, np.maximum(low, 1)), np.searchsorted(GRID, high)
    return first, np.where(high < 1, -1, last)


def parts_of(k: int) -> tuple[int, int]:
    """(parts, slack) for a bound."""
    need = k // (K2 + 1) + 1
    slack = int(SLACK * need)
    return need + slack, slack


_PARTS = np.array([parts_of(int(k)) for k in GRID], np.int64)


def signatures(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) over many sets, each sorted and distinct."""
    first, last = bounds_of(sizes)
    out, whose = [], []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for step in range(int((last - first).max(initial=-1)) + 1):
        place = first + step
        signing = place <= last
        if not signing.any():
            continue
        place = np.where(signing, place, 0)
        n1, slack = np.where(signing, _PARTS[place, 0], 0), _PARTS[place, 1]
        base = np.concatenate([[0], np.cumsum(n1)])
        use = signing[owner]
        h, of = found[use], owner[use]
        with np.errstate(over="ignore"):
            dealt = mix(h + place[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            part = ((dealt >> np.uint64(32)) * n1[of].astype(np.uint64)) >> np.uint64(32)
            cell = (base[of] + part.astype(np.int64)) * N2 + ((dealt & np.uint64(0xFFFF)) % np.uint64(N2)).astype(np.int64)
            cells = int(base[-1]) * N2
            value = mix(h ^ np.uint64(0x5851F42D4C957F2D))
            # sums of 32-bit halves stay exact in the doubles that bincount adds
            high = np.bincount(cell, (value >> np.uint64(32)).astype(np.float64), cells).astype(np.uint64)
            low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), cells).astype(np.uint64)
            sums = ((high << np.uint64(32)) + low).reshape(-1, N2)
            counts = np.bincount(cell, minlength=cells).reshape(-1, N2)
            set_of = np.repeat(np.arange(len(sizes)), n1)
            nth = np.arange(len(set_of)) - base[:-1][set_of]
            chosen = sums.sum(1, dtype=np.uint64)[:, None] - sums  # one sub-part left out
            held = counts.sum(1)[:, None] - counts
            empty = held == 0
            over = np.bincount(set_of, empty.any(1), len(sizes)) > slack
            sent = ~empty | over[set_of][:, None]
            tag = (place[set_of].astype(np.uint64) << np.uint64(40)) + nth.astype(np.uint64) * np.uint64(N2)
            name = mix(mix(chosen + np.uint64(1)) ^ mix(tag[:, None] + np.arange(N2, dtype=np.uint64)))
        out.append(name[sent])
        whose.append(np.broadcast_to(set_of[:, None], sent.shape)[sent])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(whose)


def sketches(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parities of the members by bit, (sets, SKETCH / 8) bytes: two sets differ in at least as many members as bits."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bit = (mix(found + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(20)) % np.uint64(SKETCH)
    parity = np.bincount(owner * SKETCH + bit.astype(np.int64), minlength=len(sizes) * SKETCH) & 1
    return np.packbits(parity.astype(np.uint8).reshape(-1, SKETCH), axis=1)


def _texts(batch: pa.RecordBatch, column: int) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


_NODES = "doc_id long, mark long, node long, n long, sketch binary"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch, 2)
        for a, b in in_slices(texts, SLICE):
            found, sizes = shingle_sets(texts[a:b])
            marks = [r.tobytes() for r in sketches(found, sizes)]
            own = [batch.column(i).slice(a, b - a) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(fingerprints(found, sizes).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())], ["doc_id", "mark", "node", "n", "sketch"])


_TAIL = np.dtype("<u8")


def _pack(sig: np.ndarray, node: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block): how many nodes, the nodes, five bytes of each signature, two or four of its node's number."""
    bucket = ((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    bucket, sig, node = bucket[order], sig[order], node[order]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    keys, blocks = [], []
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(sig)], strict=True):
        if a == b:
            continue
        names, number = np.unique(node[a:b], return_inverse=True)
        tails = sig[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        wide = len(names) > 0xFFFF
        keys.append(int(bucket[a]))
        blocks.append(len(names).to_bytes(4, "little") + names.astype("<u8").tobytes() + tails.tobytes() + number.astype("<u4" if wide else "<u2").tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], ["bucket", "block"])


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:4], "little")
    names = np.frombuffer(block, "<u8", n, 4)
    width = 9 if n > 0xFFFF else 7
    count = (len(block) - 4 - 8 * n) // width
    tails = np.zeros((count, 8), np.uint8)
    tails[:, :5] = np.frombuffer(block, np.uint8, 5 * count, 4 + 8 * n).reshape(-1, 5)
    number = np.frombuffer(block, "<u4" if n > 0xFFFF else "<u2", count, 4 + 8 * n + 5 * count)
    return tails.view("<u8").ravel(), names[number]


def _sign(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed signatures of the texts; a set that this task has signed is not signed again."""
    seen: set[int] = set()
    sigs, nodes, held = [], [], 0
    for batch in batches:
        texts = _texts(batch, 0)
        for a, b in in_slices(texts, SLICE):
            found, sizes = shingle_sets(texts[a:b])
            names = fingerprints(found, sizes)
            fresh = np.zeros(len(sizes), bool)
            for i, name in enumerate(names.tolist()):
                if sizes[i] and name not in seen:
                    fresh[i] = True
                    seen.add(name)
            found = found[np.repeat(fresh, sizes)]
            sig, of = signatures(found, sizes[fresh])
            sigs.append(sig)
            nodes.append(names[fresh][of])
            held += len(sig)
            if held >= FLUSH:
                yield from _pack(np.concatenate(sigs), np.concatenate(nodes), buckets)
                sigs, nodes, held = [], [], 0
                if len(seen) > 1_000_000:
                    seen.clear()
    if held:
        yield from _pack(np.concatenate(sigs), np.concatenate(nodes), buckets)


_SHARED = "sig long, rep long, node long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, one set, another set) for each set but one that shares a signature; blocks come by bucket.

    What is held of a bucket are its distinct signatures, of which the number of
    buckets keeps few, and one piece of rows, however many sets share a signature.
    """
    current, sigs, nodes, held = None, [], [], 0
    known, rep = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def piece():
        nonlocal known, rep, sigs, nodes, held
        s, n = np.concatenate(sigs), np.concatenate(nodes)
        sigs, nodes, held = [], [], 0
        order = np.argsort(s, kind="stable")
        s, n = s[order], n[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        heads, group = s[first], np.cumsum(first) - 1
        lead = n[first].copy()
        if len(known):
            at = np.minimum(np.searchsorted(known, heads), len(known) - 1)
            old = known[at] == heads
            lead[old] = rep[at[old]]
            fresh = ~old
            merged = np.argsort(np.concatenate([known, heads[fresh]]), kind="stable")
            known, rep = np.concatenate([known, heads[fresh]])[merged], np.concatenate([rep, lead[fresh]])[merged]
        else:
            known, rep = heads, lead
        other = lead[group] != n
        rows = np.stack([s[other], lead[group][other], n[other]], 1)
        if len(rows):
            rows = np.unique(rows, axis=0) if len(rows) < 200_000 else rows
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i].view(np.int64) if rows[:, i].flags.c_contiguous else np.ascontiguousarray(rows[:, i]).view(np.int64)) for i in range(3)], ["sig", "rep", "node"])

    for batch in batches:
        for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != current:
                if held:
                    yield from piece()
                current, known, rep = bucket, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            s, n = _unpack(block.as_buffer().to_pybytes())
            sigs.append(s + np.uint64(bucket << 40))  # buckets share five-byte tails
            nodes.append(n)
            held += len(s)
            if held >= PIECE:
                yield from piece()
    if held:
        yield from piece()


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of (a, chunk, member or not, node, text) rows, which come in that order."""
    at, anchor = None, None
    for batch in batches:
        texts = _texts(batch, 4)
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        for lo, hi in in_slices(texts, SLICE):
            found, sizes = shingle_sets(texts[lo:hi])
            names, ends = fingerprints(found, sizes).view(np.int64).tolist(), np.cumsum(sizes)
            left, right = [], []
            for i, (a, chunk, member, node) in enumerate(keys[lo:hi]):
                if names[i] != node:  # another row with this doc_id
                    continue
                own = found[ends[i] - sizes[i] : ends[i]]
                if not member:
                    at, anchor = (a, chunk), own
                elif at == (a, chunk):
                    shared = len(np.intersect1d(anchor, own, assume_unique=True))
                    if linked(shared, len(anchor), len(own)):
                        left.append(a)
                        right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, written; ``texts`` has (node, text) of each."""
    width = shuffle_width(pairs.sparkSession)
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("_chunks")).withColumnRenamed("a", "_a")
    dealt = pairs.join(degree, F.col("a") == F.col("_a")).select("a", F.pmod(F.xxhash64("b"), F.col("_chunks")).alias("chunk"), "b")
    dealt = materialize(dealt, "pairs")
    of = texts.withColumnRenamed("node", "_node")
    members = dealt.join(of, F.col("b") == F.col("_node")).select("a", "chunk", F.lit(1).alias("member"), F.col("b").alias("node"), "text")
    anchors = dealt.select("a", "chunk").distinct().join(of, F.col("a") == F.col("_node")).select("a", "chunk", F.lit(0).alias("member"), F.col("a").alias("node"), "text")
    rows = members.unionByName(anchors).repartition(width, "a", "chunk").sortWithinPartitions("a", "chunk", "member", "node")
    links = materialize(rows.mapInArrow(tidy(_verify_rows), "a long, b long").distinct(), "links")
    drop_scratch(dealt)
    return links


def _compare_cells(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """(sig, a, b): pairs of a cell, of two components, that may link, of (sig, lower block, upper block, own block, node, component, n, sketch) rows by cell.

    With ``nearest`` only the closest pair of each component, by the sketches.
    """
    current, rows = None, []

    def batch_of(left: list, right: list) -> pa.RecordBatch:
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), current[0], np.int64)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["sig", "a", "b"])

    def cell():
        own = np.array([r[0] for r in rows])
        node, comp, n = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        bits = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
        lower, upper = (np.flatnonzero(own == current[1]), np.flatnonzero(own == current[2]))
        left, right, held, best = [], [], 0, {}
        for i in lower:
            js = upper[upper > i] if current[1] == current[2] else upper
            js = js[(comp[js] != comp[i]) & (np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * PERCENT)]
            if len(js):
                differ = np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64)
                close = differ * (100 + PERCENT) <= (n[js] + n[i]) * (100 - PERCENT)
                js, differ = js[close], differ[close]
            if not len(js):
                continue
            if not nearest:
                left.append(np.full(len(js), node[i]))
                right.append(node[js])
                held += len(js)
                if held > PAIRS:
                    yield batch_of(left, right)
                    left, right, held = [], [], 0
                continue
            far = differ / (n[js] + n[i])
            k = int(far.argmin())
            if far[k] < best.get(comp[i], (2,))[0]:
                best[comp[i]] = (far[k], i, js[k])
            for j, f in zip(js.tolist(), far.tolist(), strict=True):
                if f < best.get(comp[j], (2,))[0]:
                    best[comp[j]] = (f, i, j)
        if best:
            left, right = [node[[i for _, i, _ in best.values()]]], [node[[j for _, _, j in best.values()]]]
        yield batch_of(left, right)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(8)]
        for sig, lo, hi, own, node, comp, n, sketch in zip(*columns, strict=True):
            if (sig, lo, hi) != current:
                if rows:
                    yield from cell()
                current, rows = (sig, lo, hi), []
            rows.append((own, node, comp, n, sketch))
    if rows:
        yield from cell()


def _open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The (sig, node, component, size) rows of the groups of (sig, node) that hold several components, written.

    Sets that share a passage share many signatures; groups of FEW members or less
    that are equal are kept once.
    """
    named = members.join(labels.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("node") == F.col("_n"), "left").select("sig", "node", F.coalesce("_c", "node").alias("component"))
    named = materialize(named, "members")
    several = named.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo != hi").select(F.col("sig").alias("_s"), "size")
    # both are written, so that a large group is not dealt to one task for the sake of the small ones' lists
    several = materialize(several, "several")
    held = materialize(named.join(several, F.col("sig") == F.col("_s")).drop("_s"), "held")
    listed = held.filter(F.col("size") <= FEW).groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("node", "component"))).alias("m"))
    few = listed.select("m").distinct().select(F.xxhash64("m").alias("sig"), F.size("m").cast("long").alias("size"), F.explode("m").alias("x")).select("sig", "x.node", "x.component", "size")
    out = materialize(held.filter(F.col("size") > FEW).select("sig", "node", "component", "size").unionByName(few), "open")
    for table in (named, several, held):
        drop_scratch(table)
    return out


def _candidates(open_: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
    """(sig, a, b): pairs of different components that share a signature and may link by their sketches; written."""
    width = shuffle_width(open_.sparkSession)
    # members are dealt over the blocks of their group by hash, so no group is gathered to be numbered
    numbered = open_.withColumn("blocks", F.ceil(F.col("size") / CELL).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", "sig"), F.col("blocks")).cast("int"))
    marked = numbered.join(nodes.select(F.col("node").alias("_n"), "n", "sketch"), F.col("node") == F.col("_n"))
    spread = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread.select("sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "component", "n", "sketch")
    ordered = cells.repartition(width, "sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "node")
    return materialize(ordered.mapInArrow(tidy(lambda b: _compare_cells(b, nearest)), "sig long, a long, b long"), "candidates")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, labels): doc_id, mark (the text's hash), node and n of every row; node and component of each linked node."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    held = materialize(rows.mapInArrow(tidy(_nodes), _NODES), "nodes")
    total = held.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * 0.9) // BUCKET + 1)
    packed = rows.select("text").mapInArrow(tidy(lambda b: _sign(b, buckets)), "bucket long, block binary")
    met = packed.repartition(width, "bucket").sortWithinPartitions("bucket")
    shared = materialize(met.mapInArrow(tidy(_meet), _SHARED), "shared")

    # one row stands for a set: of its smallest text hash, and of those rows of its smallest doc_id
    row = F.struct("mark", F.col("doc_id").isNull().alias("none"), "doc_id")
    nodes = held.groupBy("node").agg(F.min(row).alias("row"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    involved = shared.select("node").unionByName(shared.select(F.col("rep").alias("node"))).distinct()
    wanted = nodes.join(involved, "node", "left_semi").select(F.col("row.doc_id").alias("_id"), F.col("row.mark").alias("_mark"), "node")
    texts = materialize(rows.join(wanted, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text"), "texts")
    several = texts.groupBy("node").count().filter("count > 1").select(F.col("node").alias("_n"))
    if not several.isEmpty():  # rows that agree in id and text: one of them is enough
        once = texts.join(several, F.col("node") == F.col("_n"), "left_semi").groupBy("node").agg(F.first("text").alias("text"))
        texts = materialize(texts.join(several, F.col("node") == F.col("_n"), "left_anti").unionByName(once), "texts")

    votes = shared.groupBy("node", "rep").count()
    best = votes.groupBy("node").agg(F.max(F.struct("count", "rep")).alias("m")).select(F.col("m.rep").alias("a"), F.col("node").alias("b"))
    links = _verify(best, texts)
    labels = materialize(components(links), "labels")
    tried = materialize(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "tried")
    open_ = shared.select("sig", "node").unionByName(shared.select("sig", F.col("rep").alias("node")).distinct()).distinct()
    turn = 0
    while True:
        open_ = _open_groups(open_.select("sig", "node"), labels)
        if not turn:
            drop_scratch(shared)
        # components join their nearest ones first; what is apart after that is compared in full
        found = _candidates(open_, nodes, turn < ROUNDS)
        # groups without a candidate have none later, as components only grow
        open_ = open_.join(materialize(found.select("sig").distinct(), "hit"), "sig", "left_semi")
        pairs = materialize(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        full = turn >= ROUNDS
        if not full and pairs.isEmpty():
            full = True
            pairs = materialize(_candidates(open_, nodes, False).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        links = links.unionByName(_verify(pairs, texts))
        labels = materialize(components(links), "labels")
        if full:
            break
        tried = tried.unionByName(pairs)
        turn += 1
    return held.drop("sketch"), labels


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n and component of every row, written."""
    held, labels = join(docs)
    named = held.join(labels.select(F.col("node").alias("_n"), "component"), F.col("node") == F.col("_n"), "left")
    return materialize(named.select("doc_id", "mark", "n", F.coalesce("component", "node").alias("component")), "named")


def component_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Nulls: a null text has an empty set; the empty set links with nothing.  A
    null doc_id is kept and never names a component unless all its ids are null.
    Repeated rows have equal sets and are linked.  An empty table gives no rows.
    Of ``docs`` only doc_id and text are read.
    """
    named = _named(docs)
    # written, so that a large component's rows can be joined in several tasks
    smallest = materialize(named.filter("n > 0").groupBy(F.col("component").alias("_c")).agg(F.min("doc_id").alias("_least")), "smallest")
    out = named.join(smallest, (F.col("component") == F.col("_c")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, and all rows without words.

    A component's row is that of its smallest doc_id (null last), of several rows
    with this id that of the smallest text hash, and of rows that agree in both one;
    so no text goes without a similar one that stays, whatever ids repeat.  Nulls: a
    null text has no words and stays; a null doc_id stays where its component has no
    other.  An empty table gives no rows.  All columns are kept, of any name; of rows
    that agree in doc_id and text one's other columns stay.
    """
    named = _named(docs.select("doc_id", "text"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    best = named.filter("n > 0").groupBy("component").agg(F.min(row).alias("row")).select(F.col("row.doc_id").alias("__wf_id"), F.col("row.mark").alias("__wf_best"))
    copies = named.filter("n > 0").groupBy(F.col("doc_id").alias("__wf_i"), F.col("mark").alias("__wf_m")).count().filter("count > 1").select("__wf_i", "__wf_m", F.lit(True).alias("__wf_more"))
    keep = materialize(best.join(copies, F.col("__wf_id").eqNullSafe(F.col("__wf_i")) & (F.col("__wf_best") == F.col("__wf_m")), "left").select("__wf_id", "__wf_best", "__wf_more"), "keep")
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__wf_id")) & (F.col("__wf_mark") == F.col("__wf_best"))
    kept = docs.withColumn("__wf_mark", F.xxhash64("text")).join(keep, same, "left").filter(F.col("__wf_best").isNotNull() | ~worded)
    if keep.filter("__wf_more").isEmpty():
        return kept.select(*docs.columns)
    own = materialize(kept.select("__wf_id", "__wf_mark", (F.col("__wf_more").isNotNull() & worded).alias("__wf_more"), F.struct(*docs.columns).alias("__wf_row")), "kept")
    repeated = own.filter("__wf_more").groupBy("__wf_id", "__wf_mark").agg(F.first("__wf_row").alias("__wf_row"))
    return own.filter("not __wf_more").select("__wf_row.*").unionByName(repeated.select("__wf_row.*"))
