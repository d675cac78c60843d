"""Embedding near-dedup by NN-descent.

Equal vectors are one node.  Neighbour lists start from the leaves of a forest
of random hyperplanes, split evenly where a leaf is hot, and are refined by
joining each node's neighbours with each other: who are close to the same node
are likely close.  Links are pairs whose cosine, in double precision, reaches the
threshold.  A list full of links is saturated: it may leave links out.  Nodes with
such lists look for links outside the component that their links make, until there
are none, and are compared with the whole of their component, in cells of bounded
size that return counts and no pairs; so are all nodes of components that fit one
cell.  Between other nodes the links of their lists count.  Trees grow with their
depth, so that a pair at the threshold shares a leaf as likely at any size.  The
recall of the counted links is audited on the vectors whose id 20 divides, against all
rows, in blocks; the descent goes on with more trees where it is too low, and where it
stays so, all vectors are compared with all in such blocks, which give counts and the
links that hold components together.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.graph import components
from weftline.session import drop_scratch, materialize, shuffle_width

logger = logging.getLogger(__name__)

THRESHOLD = 0.9
#: Neighbours of a list, trees of a forest at least, vectors of a leaf, rounds of descent at most.
NEIGHBOURS, TREES, LEAF, ROUNDS = 10, 8, 128, 3
#: Share of changed list entries below which the descent ends.
STILL = 0.02
#: Rows of a leaf above which it is split by salt; numbers of each side of a cell at most, and vectors at least.
HOT_LEAF, CELL_NUMBERS, CELL = 1024, 1 << 20, 512
#: Blocks over which a component is dealt, as far as they hold so many vectors and less than a cell's most.
BLOCKS, FEW = 8, 128
#: The audit: recall wanted, further forests at most; all vectors are asked where there are so many or fewer.
RECALL, FORESTS, ASKED = 0.95, 3, 4096
#: Vectors of a block, but for chance, and of those compared at once.
SCAN, SLICE = 4096, 256

_SLACK = 1e-3  # single precision proposes, double precision decides


def _planes(tree: int, dim: int) -> np.ndarray:
    return np.random.default_rng([tree, dim, 7]).standard_normal((48, dim)).astype(np.float32)


_NODES = "vec_id long, node long, dim int, vec binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; null for a vector that links with nothing. ``node`` hashes the given components."""
    import xxhash

    for batch in batches:
        nodes, dims, vecs = [], [], []
        for got in batch.column(1).to_pylist():
            vec = None if got is None or any(x is None for x in got) else np.array(got, np.float64)
            top = np.abs(vec).max(initial=0.0) if vec is not None else 0.0
            if vec is None or not np.isfinite(vec).all() or top == 0:
                nodes.append(None)
                dims.append(None)
                vecs.append(None)
                continue
            vec = np.where(vec == 0, 0.0, vec)  # one zero
            nodes.append(xxhash.xxh64_intdigest(vec.tobytes()) - (1 << 63))
            vec = vec / top  # no overflow in squares
            dims.append(len(vec))
            vecs.append((vec / np.sqrt(vec @ vec)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["vec_id", "node", "dim", "vec"])


def _code(batches: Iterator[pa.RecordBatch], trees: list[int], depth: int) -> Iterator[pa.RecordBatch]:
    """(tree, dim, leaf, node): the side of ``depth`` planes that each vector is on."""
    for batch in batches:
        node, dim = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        raw = batch.column(2).to_pylist()
        for d in np.unique(dim):
            own = np.flatnonzero(dim == d)
            x = np.frombuffer(b"".join(raw[i] for i in own), np.float32).reshape(len(own), -1)
            for tree in trees:
                bits = (x @ _planes(tree, int(d))[:depth].T > 0).astype(np.int64)
                leaf = bits @ (1 << np.arange(depth, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), tree, np.int32)), pa.array(np.full(len(own), d, np.int32)), pa.array(leaf), pa.array(node[own])], ["tree", "dim", "leaf", "node"])


_PAIRS = "node long, nbr long, cos float"


def _rows(left: list, right: list, cos: list) -> pa.RecordBatch:
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(cat(left, np.int64), pa.int64()), pa.array(cat(right, np.int64), pa.int64()), pa.array(cat(cos, np.float32).astype(np.float32), pa.float32())], ["node", "nbr", "cos"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int):
    """(key, columns) of runs with one key in sorted batches, ``most`` rows at a time; columns are lists."""
    current, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if row[:keys] != current or len(rows) >= most:
                if rows:
                    yield current, list(zip(*rows, strict=True))
                current, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield current, list(zip(*rows, strict=True))


def _leaves(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """The nearest neighbours of each vector among those of its leaf in other groups, above ``floor``, of (tree, dim, leaf, salt, node, own, vec) rows."""
    left, right, cos, held = [], [], [], 0
    for _, columns in _groups(batches, 4, 4 * LEAF):
        node, own, x = np.array(columns[4], np.int64), np.array(columns[5], np.int64), np.frombuffer(b"".join(columns[6]), np.float32).reshape(len(columns[4]), -1)
        if len(node) < 2:
            continue
        sim = x @ x.T
        sim[own[:, None] == own] = -2
        k = min(NEIGHBOURS, len(node) - 1)
        best = np.argpartition(-sim, k - 1, 1)[:, :k]
        near = np.take_along_axis(sim, best, 1)
        good = near > floor
        left.append(np.repeat(node, good.sum(1)))
        right.append(node[best][good])
        cos.append(near[good])
        held += int(good.sum())
        if held > 200_000:
            yield _rows(left, right, cos)
            left, right, cos, held = [], [], [], 0
    yield _rows(left, right, cos)


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the neighbours of one node, the pairs better than the worst of either's list, of (u, v, worst, vec) rows by u."""
    left, right, cos, held = [], [], [], 0
    for _, columns in _groups(batches, 1, 1 << 16):
        node, worst = np.array(columns[1], np.int64), np.array(columns[2], np.float32)
        if len(node) < 2:
            continue
        x = np.frombuffer(b"".join(columns[3]), np.float32).reshape(len(node), -1)
        sim = x @ x.T
        good = sim > worst[:, None] + 1e-6
        np.fill_diagonal(good, False)
        i, j = np.nonzero(good)
        left.append(node[i])
        right.append(node[j])
        cos.append(sim[i, j])
        held += len(i)
        if held > 200_000:
            yield _rows(left, right, cos)
            left, right, cos, held = [], [], [], 0
    yield _rows(left, right, cos)


def _best(pairs: DataFrame) -> DataFrame:
    """The NEIGHBOURS nearest of each node, written."""
    once = pairs.groupBy("node", "nbr").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("cos").desc(), "nbr"))
    return materialize(once.withColumn("_r", rank).filter(F.col("_r") <= NEIGHBOURS).drop("_r"), "lists")


def _forest(single: DataFrame, trees: list[int], depth: int, floor: float = -1.5) -> DataFrame:
    """Neighbours above ``floor`` within the leaves of some trees, of (node, dim, own, vec) rows; rows of one ``own`` are no neighbours."""
    width = shuffle_width(single.sparkSession)
    coded = materialize(single.select("node", "dim", "vec").mapInArrow(lambda b: _code(b, trees, depth), "tree int, dim int, leaf long, node long"), "leaves")
    keys = ["tree", "dim", "leaf"]
    sizes = coded.groupBy(*keys).agg(F.ceil(F.count("*") / HOT_LEAF).alias("_salts"))
    salted = coded.join(sizes, keys).withColumn("salt", F.pmod(F.xxhash64("tree", "node"), F.col("_salts")))
    with_vec = salted.select(*keys, "salt", F.col("node").alias("_n")).join(single.select("node", "own", "vec"), F.col("_n") == F.col("node")).select(*keys, "salt", "node", "own", "vec")
    ordered = with_vec.repartition(width, *keys, "salt").sortWithinPartitions(*keys, "salt", "node")
    return ordered.mapInArrow(lambda b: _leaves(b, floor), _PAIRS)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(0), pa.array([np.frombuffer(v, np.float64).astype(np.float32).tobytes() for v in batch.column(2).to_pylist()], pa.binary())], ["node", "dim", "own", "vec"])


def _descend(lists: DataFrame, single: DataFrame, total: int) -> DataFrame:
    """Refine the lists by their neighbours' neighbours until they rest."""
    width = shuffle_width(single.sparkSession)
    for _ in range(ROUNDS):
        worst = lists.groupBy("node").agg(F.min("cos").alias("worst"), F.count("*").alias("_k")).select("node", F.when(F.col("_k") < NEIGHBOURS, F.lit(-2.0)).otherwise(F.col("worst")).cast("float").alias("worst"))
        back = lists.select(F.col("nbr").alias("u"), F.col("node").alias("v"), "cos")
        rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("cos").desc(), "v"))
        near = lists.select(F.col("node").alias("u"), F.col("nbr").alias("v")).unionByName(back.withColumn("_r", rank).filter(F.col("_r") <= NEIGHBOURS).select("u", "v")).distinct()
        own = single.join(worst.withColumnRenamed("node", "_w"), F.col("node") == F.col("_w"), "left").select(F.col("node").alias("_n"), F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"), "vec")
        rows = near.join(own, F.col("v") == F.col("_n")).select("u", "v", "worst", "vec")
        found = rows.repartition(width, "u").sortWithinPartitions("u", "v").mapInArrow(_local_join, _PAIRS)
        better = _best(lists.unionByName(found))
        changed = better.join(lists.select(F.col("node").alias("_a"), F.col("nbr").alias("_b")), (F.col("node") == F.col("_a")) & (F.col("nbr") == F.col("_b")), "left_anti").count()
        drop_scratch(lists)
        lists = better
        if changed <= STILL * total * NEIGHBOURS:
            break
    return lists


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (batch.column(i).to_pylist() for i in (2, 3))
        keep = [float(np.frombuffer(a, np.float64) @ np.frombuffer(b, np.float64)) >= THRESHOLD for a, b in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """The list entries that link, as pairs (a, b)."""
    close = lists.filter(F.col("cos") >= THRESHOLD - _SLACK).select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()
    vec = nodes.select(F.col("node").alias("_n"), "vec")
    first = close.join(vec, F.col("a") == F.col("_n")).select("a", "b", F.col("vec").alias("x"))
    return first.join(vec, F.col("b") == F.col("_n")).select("a", "b", "x", F.col("vec").alias("y")).mapInArrow(_cosines, "a long, b long")


def _depth(rows: int) -> int:
    """Planes of a tree that leave LEAF rows a leaf."""
    return max(0, min(48, int(np.ceil(np.log2(max(1, rows / LEAF))))))


def _trees(depth: int) -> int:
    """Trees in some leaf of which two vectors at the threshold meet, with a probability of RECALL."""
    meet = (1 - np.arccos(THRESHOLD) / np.pi) ** depth
    return TREES if meet == 1 else max(TREES, int(np.ceil(np.log(1 - RECALL) / np.log1p(-meet))))


def _saturated(lists: DataFrame) -> DataFrame:
    """(_f): the nodes whose lists are full of links."""
    full = lists.groupBy("node").agg(F.min("cos").alias("_worst"), F.count("*").alias("_k"))
    return full.filter((F.col("_k") >= NEIGHBOURS) & (F.col("_worst") >= THRESHOLD - _SLACK)).select(F.col("node").alias("_f"))


def _outward(labels: DataFrame, full: DataFrame, single: DataFrame, nodes: DataFrame, forest: int) -> DataFrame:
    """``labels`` after the links that full lists leave out have joined their components.

    A link is in neither end's list only where both are full of nearer links.  The
    nodes of such lists look for links outside their own components, in new trees,
    until a forest of them finds none.
    """
    dense = materialize(single.join(full, F.col("node") == F.col("_f")).select("node", "dim", "vec"), "dense")
    rows = dense.count()
    depth, first = _depth(rows), (forest + 1) * 100_000
    many = _trees(depth)
    while rows:
        of = labels.select(F.col("node").alias("_o"), "component")
        inside = materialize(dense.join(of, F.col("node") == F.col("_o"), "left").select("node", "dim", F.coalesce("component", "node").alias("own"), "vec"), "inside")
        pairs = None
        for at in range(first, first + many, TREES):  # so many trees at once as disk holds
            some = materialize(_forest(inside, list(range(at, min(at + TREES, first + many))), depth, THRESHOLD - _SLACK), "pairs")
            pairs = some if pairs is None else pairs.unionByName(some)
        found = materialize(_links(pairs, nodes), "outward")
        drop_scratch(inside)
        if found.isEmpty():
            break
        labels = components(found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        first += many
    return labels


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows the asked members of a cell link with, and its other members with the asked, of (component, asked block, block, asks, full, node, copies, vec) rows by cell."""
    for _, columns in _groups(batches, 3, 1 << 62):
        asks, full, node, copies = (np.array(columns[i], np.int64) for i in (3, 4, 5, 6))
        x = np.frombuffer(b"".join(columns[7]), np.float64).reshape(len(node), -1)
        left, right = np.flatnonzero(asks == 1), np.flatnonzero(asks == 0)
        back, rest = np.zeros(len(right), np.int64), full[right] == 0
        for at in range(0, len(left), SLICE):
            some = left[at : at + SLICE]
            sim = (x[some] @ x[right].T >= THRESHOLD) & (node[some][:, None] != node[right])
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(sim @ copies[right])], ["node", "links"])
            back += copies[some] @ sim
        yield pa.RecordBatch.from_arrays([pa.array(node[right][rest]), pa.array(back[rest])], ["node", "links"])


def _enlarge(labels: DataFrame, nodes: DataFrame, full: DataFrame, links: DataFrame) -> DataFrame:
    """(node, links): rows that link with each node.

    Saturated nodes, and all nodes of components that a cell can hold, are compared
    with their whole components; the vectors sent grow with a component times its
    saturated nodes over the size of a cell.  Members are dealt over blocks by hash,
    a smaller component over BLOCKS.
    """
    width = shuffle_width(nodes.sparkSession)
    marked = labels.join(full, F.col("node") == F.col("_f"), "left").join(nodes.select(F.col("node").alias("_n"), "dim"), F.col("node") == F.col("_n")).select("node", "component", "dim", F.col("_f").isNotNull().alias("full"))
    marked = materialize(marked, "marked")
    counts = marked.groupBy(F.col("component").alias("_c")).agg(F.count("*").alias("_n"), F.count_if("full").alias("_full"), F.max("dim").alias("_dim"))
    most = F.greatest(F.lit(CELL), F.floor(F.lit(CELL_NUMBERS) / F.col("_dim")))
    cell, whole = F.least(most, F.greatest(F.lit(FEW), F.ceil(F.col("_n") / BLOCKS))), F.col("_n") <= most
    blocks = lambda n: F.ceil(n / cell).cast("int")
    sizes = materialize(counts.select("_c", whole.alias("_whole"), blocks(F.col("_n")).alias("_blocks"), blocks(F.when(whole, F.col("_n")).otherwise(F.col("_full"))).alias("_asked")), "sizes")
    dealt = marked.join(sizes, F.col("component") == F.col("_c")).withColumn("full", F.col("full") | F.col("_whole"))
    own = lambda n: F.pmod(F.xxhash64("node", "component"), n).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = dealt.filter("full").select("component", own(F.col("_asked")).alias("lo"), numbers(F.col("_blocks")).alias("hi"), F.lit(1).alias("asks"), F.lit(1).alias("full"), F.col("node").alias("_n"))
    told = dealt.filter("_asked > 0").select("component", numbers(F.col("_asked")).alias("lo"), own(F.col("_blocks")).alias("hi"), F.lit(0).alias("asks"), F.col("full").cast("int").alias("full"), F.col("node").alias("_n"))
    rows = asks.unionByName(told).join(nodes.select("node", "copies", "vec"), F.col("_n") == F.col("node")).select("component", "lo", "hi", "asks", "full", "node", "copies", "vec")
    counted = rows.repartition(width, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "asks", "node").mapInArrow(_count_cells, "node long, links long")
    # links between nodes of which none is compared
    rest = dealt.filter("not full").select(F.col("node").alias("_r"))
    both = links.join(rest, F.col("a") == F.col("_r"), "left_semi").join(rest, F.col("b") == F.col("_r"), "left_semi")
    ends = both.select(F.col("a").alias("node"), F.col("b").alias("_b")).unionByName(both.select(F.col("b").alias("node"), F.col("a").alias("_b")))
    listed = ends.join(nodes.select(F.col("node").alias("_n"), "copies"), F.col("_b") == F.col("_n")).select("node", F.col("copies").alias("links"))
    return counted.unionByName(listed).groupBy("node").agg(F.sum("links").alias("links"))


def _asked(batches: Iterator[pa.RecordBatch], queries) -> Iterator[pa.RecordBatch]:
    """(query, links): how many rows of other nodes each vector of a query set links with, over all."""
    names, dims, raw = queries.value
    for batch in batches:
        node, dim, vec, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_numpy()
        for d in np.unique(dim):
            own, mine = np.flatnonzero(dim == d), np.flatnonzero(dims == d)
            if not len(mine):
                continue
            x = np.frombuffer(b"".join(vec[i] for i in own), np.float64).reshape(len(own), -1)
            q = np.frombuffer(b"".join(raw[i] for i in mine), np.float64).reshape(len(mine), -1)
            for at in range(0, len(mine), SLICE):
                some = mine[at : at + SLICE]
                links = copies[own] @ ((x @ q[at : at + SLICE].T >= THRESHOLD) & (node[own][:, None] != names[some]))
                has = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(names[some][has]), pa.array(links[has], pa.int64())], ["query", "links"])


def _blocks(asked: DataFrame):
    """The vectors to ask (node, dim, vec) in blocks of about SCAN, one after the other on the driver: (rows, broadcast)."""
    spark = asked.sparkSession
    blocks = max(1, round(asked.count() / SCAN))
    drawn = F.pmod(F.xxhash64(F.lit("block"), "node"), F.lit(blocks))
    for block in range(blocks):
        rows = asked.filter(drawn == block).collect()
        if rows:
            names, dims = (np.array([r[c] for r in rows], np.int64) for c in ("node", "dim"))
            sent = spark.sparkContext.broadcast((names, dims, [bytes(r["vec"]) for r in rows]))
            yield rows, sent
            sent.unpersist()


def audit(nodes: DataFrame, counted: DataFrame, ids: DataFrame) -> float:
    """The share of the links of a query set, found by comparing it with all rows, that are in ``counted`` (node, links).

    What is counted has been compared, so it is never more than there is.  The set is
    the nodes of ``ids`` (vec_id, node) whose vec_id 20 divides, or all where there are
    ASKED or fewer.  Of the shares over links and over vectors with links the smaller
    counts; 1 where none has a link.
    """
    of = counted.select(F.col("node").alias("_o"), F.col("links").alias("known"))
    placed = nodes.join(of, F.col("node") == F.col("_o"), "left").select("node", "dim", "vec", F.coalesce("known", F.lit(0)).alias("known"))
    if nodes.count() > ASKED:
        placed = placed.join(ids.filter("vec_id % 20 = 0").select(F.col("node").alias("_q")).distinct(), F.col("node") == F.col("_q"), "left_semi")
    placed = materialize(placed, "asked")
    seen, links, met, shares = 0, 0, 0, 0.0
    for rows, sent in _blocks(placed):
        known = {r["node"]: r["known"] for r in rows}
        found = nodes.select("node", "dim", "vec", "copies").mapInArrow(lambda b, sent=sent: _asked(b, sent), "query long, links long").groupBy("query").agg(F.sum("links").alias("links"))
        for r in found.collect():  # a row a vector asked at most
            seen, links, met, shares = seen + 1, links + r["links"], met + known[r["query"]], shares + known[r["query"]] / r["links"]
    drop_scratch(placed)
    return min(met / links, shares / seen) if seen else 1.0


def _held_together(batches: Iterator[pa.RecordBatch], queries) -> Iterator[pa.RecordBatch]:
    """(a, b, links): the links that a block's vectors have in these rows, as counts (a = b), and enough of them to connect what they connect."""
    names, dims, raw = queries.value
    kinds = ["a", "b", "links"]
    for batch in batches:
        node, dim, vec, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_numpy()
        for d in np.unique(dim):
            own, mine = np.flatnonzero(dim == d), np.flatnonzero(dims == d)
            if not len(mine):
                continue
            x = np.frombuffer(b"".join(vec[i] for i in own), np.float64).reshape(len(own), -1)
            q = np.frombuffer(b"".join(raw[i] for i in mine), np.float64).reshape(len(mine), -1)
            for at in range(0, len(mine), SLICE):
                some = names[mine[at : at + SLICE]]
                met = (x @ q[at : at + SLICE].T >= THRESHOLD) & (node[own][:, None] != some)
                links, has = copies[own] @ met, met.any(0)
                left = np.full(len(own), len(some))
                label = np.where(has, np.arange(len(some)), len(some))
                while True:  # the least query that each is connected with in here
                    left = np.where(met, label[None], len(some)).min(1)
                    least = np.minimum(label, np.where(met, left[:, None], len(some)).min(0))
                    if (least == label).all():
                        break
                    label = least
                linked = met.any(1)
                a = np.concatenate([some[has], some[has], node[own][linked]])
                b = np.concatenate([some[has], some[label[has]], some[left[linked]]])
                n = np.concatenate([links[has], np.zeros(len(a) - has.sum(), np.int64)])
                keep = (a != b) | (n > 0)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(n[keep], pa.int64())], kinds)


def every_link(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, links), (node, component)) by comparing all vectors with all, block by block; no pair leaves a task but those that connect."""
    parts = []
    for _, sent in _blocks(nodes.select("node", "dim", "vec")):
        found = nodes.select("node", "dim", "vec", "copies").mapInArrow(lambda b, sent=sent: _held_together(b, sent), "a long, b long, links long")
        parts.append(materialize(found.groupBy("a", "b").agg(F.sum("links").alias("links")), "blocks"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    counted = rows.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return counted, components(rows.filter("a <> b").select("a", "b"))


def dedup_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    A vector that is null, zero, or holds a null or a number that isn't finite links
    with nothing; so do vectors of unequal length.  Equal vectors are linked.  Rows
    that share a vec_id are vectors each; a null vec_id names a component only if it
    has no other.  An empty table gives no rows.  Other columns are not read.  Where the
    audited recall stays below RECALL after the last forest the result is ``every_link``'s.
    """
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_read, _NODES)
    held = materialize(read, "vectors")
    nodes = materialize(held.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "nodes")
    total = nodes.count()
    single = materialize(nodes.select("node", "dim", "vec").mapInArrow(_single, "node long, dim int, own long, vec binary"), "single")
    depth = max(1, _depth(total))
    lists, labels, many = None, None, _trees(depth)
    for forest in range(1 + FORESTS):
        for at in range(forest * many, (forest + 1) * many, TREES):  # so many trees at once as disk holds
            pairs = _forest(single, list(range(at, min(at + TREES, (forest + 1) * many))), depth)
            better = _best(pairs if lists is None else lists.unionByName(pairs))
            if lists is not None:
                drop_scratch(lists)
            lists = better
        lists = _descend(lists, single, total)
        pairs, full = materialize(_links(lists, nodes), "links"), materialize(_saturated(lists), "saturated")
        labels = _outward(components(pairs), full, single, nodes, forest)
        links = materialize(_enlarge(labels, nodes, full, pairs), "counted")
        recall = audit(nodes, links, held)
        logger.info("recall of links %.4f after forest %d", recall, forest)
        if recall >= RECALL:
            break
    else:
        logger.warning("recall of links %.3f after %d forests of %d trees: comparing all vectors", recall, 1 + FORESTS, many)
        links, labels = every_link(nodes)
    named = held.select("vec_id", F.col("node").alias("_n"))
    info = nodes.select("node", "copies").join(links.withColumnRenamed("node", "_l"), F.col("node") == F.col("_l"), "left").join(labels.select(F.col("node").alias("_b"), "component"), F.col("node") == F.col("_b"), "left")
    info = info.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    rows = materialize(named.join(info, F.col("_n") == F.col("node"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component"), "named")
    # written, so that a large component's rows can be joined in several tasks
    least = materialize(rows.filter("component is not null").groupBy(F.col("component").alias("_c")).agg(F.min("vec_id").alias("_least")), "least")
    out = rows.join(least, F.col("component") == F.col("_c"), "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("_least")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
