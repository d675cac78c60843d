"""Token-ID output to a content-addressed store.

Each document's ids are cut into chunks where a rolling hash over the last ids
meets a pattern, so equal passages give equal chunks wherever they stand.  A
chunk is stored once, under its hash; a document is a recipe, the list of its
chunks; recipes lie in ascending doc_id order.

A document's Merkle root is made from its chunks as they are encoded, and travels
with its recipe; the manifest of a recipe file is the root over those, made while
the file is written.  Reading makes both anew from the chunk lists that it finds and
compares, so a recipe that was changed, lost, added or moved between encoding and
reading is seen.  A chunk is compared with its name.

Layout below the store's path (Parquet, written by Spark's writers):

- ``blocks/kind=chunk``: key: the hash, binary(16); body: the ids as unsigned 16-bit (32-bit
  where one is larger; the first byte says which) little-endian numbers, zstd-compressed
- ``blocks/kind=recipe``: recipes as encoded, in no order; ``recipes`` replaces them
- ``recipes``: part, ord, doc_id, local_start, n_tokens, chunks (hashes joined), root; the
  last row of a file, without ord, is its manifest: part, n_docs, n_tokens, root

The payloads cross the network once.  A document's checksum follows from its chunks'
checksums by the algebra of CRC-32, so no payload moves again.  ``reconstruct``
returns the ids themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.memory import tidy
from weftline.llm.tokens import encoder, in_slices
from weftline.session import scratch_path, shuffle_width, spread

#: Ids under one rolling hash, the mean chunk, and the bounds of a chunk.
WINDOW, MEAN, LEAST, MOST = 32, 1024, 128, 4096
END_ID = 2
HASH = 16
#: Hashes of chunks that one task has sent already; older ones may be sent again.
SENT = 200_000
#: Pieces of text whose ids a worker keeps.
CACHE = 800_000


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=HASH).digest()


def cuts(ids: np.ndarray) -> list[int]:
    """The ends of the chunks of an id stream; they depend on the ids near them alone."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        width = 1
        while width < WINDOW:
            h[width:] += h[:-width] << np.uint64(width)
            width *= 2
        hits = np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1
    ends, at = [], 0
    for hit in [*hits.tolist(), n]:
        while hit - at > MOST:
            at += MOST
            ends.append(at)
        if hit - at >= LEAST or hit == n and hit > at:
            at = hit
            ends.append(at)
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """The root over hashes; an odd one moves up as it is, none gives the hash of nothing."""
    if not leaves:
        return _digest(b"")
    while len(leaves) > 1:
        pairs = [_digest(a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0]


class MerkleStream:
    """The same root over leaves that come one by one, in memory that grows with their logarithm."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.peaks and self.peaks[-1][0] == level:
            leaf = _digest(self.peaks.pop()[1] + leaf)
            level += 1
        self.peaks.append((level, leaf))

    def root(self) -> bytes:
        if not self.peaks:
            return _digest(b"")
        peaks = [p for _, p in self.peaks]
        root = peaks.pop()
        while peaks:
            root = _digest(peaks.pop() + root)
        return root


@cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack_ids(ids: np.ndarray) -> bytes:
    """The file form of a chunk: one byte for the width, then the compressed numbers."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return bytes([wide]) + _compressor().compress(ids.astype("<u4" if wide else "<u2").tobytes())


def unpack_ids(payload: bytes) -> np.ndarray:
    raw = _decompressor().decompress(payload[1:])
    return np.frombuffer(raw, "<u4" if payload[0] else "<u2").astype("<u4")


# CRC-32 of a concatenation from the parts' (Castagnoli's and others' trick: appending n zero bytes is multiplication by x^(8n)).
_POLY = 0xEDB88320


def _multiply(a: int, b: int) -> int:
    """a * b modulo the CRC's polynomial, bits reflected."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


_shifts: dict[int, int] = {}


def _zeros(n: int) -> int:
    """x^(8n)."""
    if n not in _shifts:
        if len(_shifts) > 100_000:
            _shifts.clear()
        out, square, left = 1 << 31, 1 << 23, n
        while left:
            if left & 1:
                out = _multiply(out, square)
            square = _multiply(square, square)
            left >>= 1
        _shifts[n] = out
    return _shifts[n]


def crc_join(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of parts given as (checksum, bytes)."""
    out = 0
    for crc, n in parts:
        out = (_multiply(_zeros(n), out) if out else 0) ^ crc
    return out


def _root(chunks: bytes) -> bytes:
    """The root of a document from the joined names of its chunks."""
    return merkle([chunks[i : i + HASH] for i in range(0, len(chunks), HASH)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_BLOCKS = "key binary, kind string, doc_id long, n_tokens long, body binary, root binary"
_BLOCK_ROWS = pa.schema([("key", pa.binary()), ("kind", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("body", pa.binary()), ("root", pa.binary())])


def _encode(batches: Iterator[pa.RecordBatch], path: str, spaced: bool, end: int, ordinary: bool) -> Iterator[pa.RecordBatch]:
    """Chunks under their hashes, and recipes under keys of their own, so that none meet in one task because they are equal."""
    enc, sent, last = encoder(path, spaced, CACHE, ordinary), {}, np.array([end], "<u4")
    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in in_slices(texts, 16_000_000):
            out = []
            for doc, got in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                whole, at, names = np.append(got, last), 0, []
                for stop in cuts(whole):
                    chunk, at = whole[at:stop], stop
                    name = _digest(chunk.tobytes())
                    names.append(name)
                    if name not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent[name] = None
                        out.append((name, "chunk", None, len(chunk), pack_ids(chunk), None))
                out.append((part.to_bytes(4, "big") + count.to_bytes(8, "big"), "recipe", doc, len(whole), b"".join(names), merkle(names)))
                count += 1
            yield _batch(out, _BLOCK_ROWS)


_RECIPES = "part int, ord long, doc_id long, local_start long, n_tokens long, chunks binary, root binary, n_docs long"
_RECIPE_ROWS = pa.schema([("part", pa.int32()), ("ord", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.binary()), ("root", pa.binary()), ("n_docs", pa.int64())])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted recipes with their places, and their manifest behind them; roots are those made while encoding."""
    part, ordinal, start, tree = TaskContext.get().partitionId(), 0, 0, MerkleStream()
    for batch in batches:
        rows = []
        for doc, n, chunks, root in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            tree.add(root)
            rows.append((part, ordinal, doc, start, n, chunks, root, None))
            ordinal, start = ordinal + 1, start + n
        yield _batch(rows, _RECIPE_ROWS)
    if ordinal:
        yield _batch([(part, None, None, None, start, None, tree.root(), ordinal)], _RECIPE_ROWS)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts, by (part, ord, manifest last), whose recipes as read don't give the roots and counts made before."""
    part, state = None, None

    def done():  # without its manifest a part is wrong too
        return [(part,)] if part is not None and state != "ended" else []

    rows = []
    for batch in batches:
        for p, ordinal, start, n, chunks, root, docs in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if p != part:
                rows += done()
                part, state = p, (0, 0, MerkleStream())
            if isinstance(state, str):  # behind the manifest, or already wrong
                state = "wrong"
                continue
            count, tokens, tree = state
            if ordinal is None:
                state = "ended" if (docs, n, root) == (count, tokens, tree.root()) else "wrong"
            elif (ordinal, start) != (count, tokens) or _root(chunks) != root:
                state = "wrong"
            else:
                tree.add(root)
                state = (count + 1, tokens + n, tree)
    rows += done()
    yield _batch(rows, pa.schema([("part", pa.int32())]))


class Store:
    """A written store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks").filter("kind = 'chunk'").select(F.col("key").alias("hash"), F.col("body").alias("payload"))

    def index(self) -> DataFrame:
        return self.spark.read.schema(_RECIPES).parquet(f"{self.path}/recipes")

    def recipes(self) -> DataFrame:
        return self.index().filter("ord is not null").drop("n_docs")

    def manifests(self) -> DataFrame:
        return self.index().filter("ord is null").select("part", "n_docs", "n_tokens", "root")

    def check_manifests(self) -> None:
        """Raise where the recipes as read don't give the roots and counts made while they were encoded and written."""
        rows = self.index().select("part", "ord", "local_start", "n_tokens", "chunks", "root", "n_docs")
        ordered = rows.repartition("part").sortWithinPartitions("part", F.col("ord").asc_nulls_last())
        wrong = [r["part"] for r in ordered.mapInArrow(_compare, "part int").limit(10).collect()]
        if wrong:
            raise ValueError(f"{self.path}: recipes and manifests differ in parts {wrong}")

    def _starts(self) -> DataFrame:
        """The ids before each part: one row a recipe file."""
        order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return self.manifests().select("part", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("_before"))

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
        digests = self.chunks().mapInArrow(_read_chunks, "hash binary, crc long, bytes long")
        listed = self.recipes().select("part", "ord", "doc_id", "local_start", "n_tokens", F.expr(f"transform(sequence(0, length(chunks) div {HASH} - 1), i -> substring(chunks, i * {HASH} + 1, {HASH}))").alias("_list"))
        uses = listed.select("part", "ord", F.posexplode("_list").alias("pos", "hash"))
        found = uses.join(digests, "hash").groupBy("part", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "crc", "bytes"))).alias("_found"))
        whole = listed.withColumn("_n", F.size("_list")).drop("_list").join(found, ["part", "ord"]).join(self._starts(), "part")
        ready = whole.select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "_n", F.col("_found.crc").alias("crcs"), F.col("_found.bytes").alias("sizes"))
        return ready.mapInArrow(_join_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def reconstruct(self) -> DataFrame:
        """(doc_id, start, ids) of every document; the payloads are moved to their documents."""
        uses = self.recipes().select("part", "ord", "doc_id", "local_start", F.posexplode(F.expr(f"transform(sequence(0, length(chunks) div {HASH} - 1), i -> substring(chunks, i * {HASH} + 1, {HASH}))")).alias("pos", "hash"))
        got = uses.join(self.chunks(), "hash").groupBy("part", "ord", "doc_id", "local_start").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("_found"))
        ready = got.join(self._starts(), "part").select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), F.col("_found.payload").alias("payloads"))
        return ready.mapInArrow(_join_ids, "doc_id long, start long, ids array<long>")


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, crcs, sizes = batch.column(0).to_pylist(), [], []
        for name, payload in zip(names, batch.column(1).to_pylist(), strict=True):
            data = unpack_ids(payload).tobytes()
            if _digest(data) != name:
                raise ValueError(f"chunk {name.hex()} does not hold what its name says")
            crcs.append(zlib.crc32(data))
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], ["hash", "crc", "bytes"])


def _join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for doc, n, count, crc, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
            if len(crc) != count or sum(size) != 4 * n:
                raise ValueError(f"document {doc}: chunks are missing")
            crcs.append(crc_join(list(zip(crc, size, strict=True))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.concatenate([unpack_ids(p) for p in got]).astype(np.int64) for got in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])


def write_store(docs: DataFrame, path: str, tokenizer: str, spaced: bool = True, end_id: int = END_ID, ordinary: bool = False) -> Store:
    """Encode (doc_id, text) of ``docs`` and write them as a store; null texts are empty.

    Documents stand in ascending doc_id order, a null id first; rows of one id by
    length and chunks; equal rows in any order, dealt over several files where they
    are many.  ``ordinary``: strings of special tokens are text as any other.  Other
    columns are not read.  An empty table gives an empty store.
    """
    spark = docs.sparkSession
    blocks = spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(tidy(lambda b: _encode(b, tokenizer, spaced, end_id, ordinary)), _BLOCKS)
    nth = F.row_number().over(Window.partitionBy("key").orderBy("kind"))  # a chunk's rows are one a task, but for SENT
    # the width is left to adaptive execution: files are as many as the data asks, not two for each partition of a shuffle
    blocks.repartition("key").withColumn("_n", nth).filter("_n = 1").drop("_n").write.partitionBy("kind").option("compression", "none").parquet(f"{path}/blocks")
    encoded = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").filter("kind = 'recipe'")
    order = ["doc_id", "n_tokens", "chunks", "key"]
    ranged = encoded.select("doc_id", "n_tokens", F.col("body").alias("chunks"), "root", "key").repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    ranged.mapInArrow(_number, _RECIPES).write.parquet(f"{path}/recipes")
    return Store(spark, path)


def store_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The digest of ``docs`` read back from a store in the shared folder.

    Nulls: a null text is encoded as an empty one, one end id; a null doc_id
    stands first.  Repeated rows are documents each with its own recipe and share
    their chunks.  An empty table gives an empty store and no rows.
    """
    store = write_store(docs, scratch_path(docs.sparkSession, "store"), tokenizer)
    store.check_manifests()
    return store.documents()
