"""Exact vector search by cosine, accumulated in double precision."""

from __future__ import annotations

import functools
import hashlib
import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import materialize

logger = logging.getLogger(__name__)

#: Texts that an embedder gets at once.
BATCH = 32
#: Queries that are broadcast at once.
MAX_QUERIES = 10_000
#: Vectors, and queries, that a task compares at once.
ROWS = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def guarded(vector: Column, dim: int) -> Column:
    """The vector, or a zero one where there is none."""
    return F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), dim))


def of_dimension(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Only rows whose vector has ``dim`` components."""
    return df.where(F.size(column) == dim)


def top_k(vectors: DataFrame, query: list[float], k: int = 10, key: str = "id", column: str = "embedding", where: Column | None = None) -> DataFrame:
    """(key, similarity) of the k nearest: a scan and a bounded heap in each task, no full sort."""
    own = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return own.select(key, cosine(F.col(column), q).alias("similarity")).where("similarity is not null").orderBy(F.desc("similarity"), key).limit(k)


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", column: str = "embedding") -> DataFrame:
    """(query, neighbour, similarity): the k nearest other rows of every query row.

    The queries are a stated set, checked to be small, and are broadcast as one
    matrix; each task compares ROWS of either at a time and keeps k a query before anything is shuffled.  Queries without a
    whole vector have no neighbours, nor are rows without one any.
    """
    whole = lambda v: v is not None and len(v) > 0 and all(x is not None for x in v)
    rows = queries.select(key, column).limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries; ask in batches")
    if not any(whole(r[1]) for r in rows):
        return vectors.select(F.col(key).alias("query"), F.col(key).alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    dims = {len(r[1]) for r in rows if whole(r[1])}
    if len(dims) != 1:
        raise ValueError(f"queries of {sorted(dims)} components; ask for one length at a time")
    dim, rows = dims.pop(), [r for r in rows if whole(r[1])]
    names = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], np.float64)
    scale = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(scale == 0, 1, scale)[:, None]
    sent = vectors.sparkSession.sparkContext.broadcast((names, unit, scale > 0))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unit, real = sent.value
        asked, held = pd.Series(names).to_numpy(), {}
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                ids, x = part[key].to_numpy(), np.stack(part[column].to_numpy()).astype(np.float64)
                size = np.linalg.norm(x, axis=1)
                x /= np.where(size == 0, 1, size)[:, None]
                for q in range(0, len(names), ROWS):
                    sims = unit[q : q + ROWS] @ x.T
                    sims[~real[q : q + ROWS]] = -np.inf
                    sims[:, ~(size > 0)] = -np.inf
                    sims[np.isnan(sims) | (asked[q : q + ROWS, None] == ids)] = -np.inf
                    held[q] = _nearest(sims, ids, k, held.get(q))
        for q, (row, near, sims) in held.items():
            yield pd.DataFrame({"query": asked[q : q + ROWS][row], "neighbour": near, "similarity": sims})

    kind = vectors.schema[key].dataType.simpleString()
    # a row without a vector, of another length, or with a null in it is no neighbour
    same = of_dimension(vectors.select(key, column), column, dim).where(~F.exists(column, lambda x: x.isNull()))
    near = same.mapInPandas(nearest, f"query {kind}, neighbour {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest(sims: np.ndarray, ids: np.ndarray, k: int, held: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, similarity): the k largest of each row and of those held, the smaller id of equal ones; minus infinity is none."""
    if sims.shape[1] > k:  # all that are no smaller than a row's k-th, so that equal ones are told apart by their ids
        least = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
        row, col = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
    else:
        row, col = np.nonzero(sims > -np.inf)
    near, found = ids[col], sims[row, col]
    if held is not None:
        row, near, found = (np.concatenate(pair) for pair in zip(held, (row, near, found), strict=True))
    order = np.lexsort((near, -found, row))
    row, near, found = row[order], near[order], found[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], near[top], found[top]


def block_knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", column: str = "embedding") -> DataFrame:
    """batch_knn of any number of queries, in blocks dealt by hash, half of MAX_QUERIES each on average."""
    blocks = max(1, math.ceil(queries.count() / max(1, MAX_QUERIES // 2)))
    if blocks == 1:
        return batch_knn(vectors, queries, k, key, column)
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    parts = [materialize(batch_knn(vectors, queries.where(block == b), k, key, column), "neighbours") for b in range(blocks)]
    return functools.reduce(DataFrame.unionByName, parts)


def hashing_embedding(text: str, dim: int) -> list[float]:
    """A deterministic offline embedding: signed counts of hashed words, of unit length."""
    out = np.zeros(dim, np.float64)
    for word in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        out[h % dim] += 1.0 if h >> 63 else -1.0
    size = np.sqrt(out @ out)
    return (out / size if size else out).astype(np.float32).tolist()


def embed(df: DataFrame, text: str = "text", out: str = "embedding", dim: int = 384, embedder=None) -> DataFrame:
    """``df`` with vectors from ``embedder`` (texts to vectors, BATCH at a time); zero vectors where it fails."""
    run = embedder or (lambda texts: [hashing_embedding(t, dim) for t in texts])

    def one(text: str) -> list[float]:
        try:
            return run([text])[0]
        except Exception:  # a text that can't be embedded keeps its place with a zero vector
            return [0.0] * dim

    def some(part: list[str]) -> list[list[float]]:
        try:
            found = run(part)
            if len(found) == len(part):
                return found
        except Exception:  # the others of a batch are embedded one by one
            logger.warning("a batch of %d texts can't be embedded; trying them one by one", len(part))
        return [one(t) for t in part]

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            got = []
            for at in range(0, len(batch), BATCH):
                got += [v if len(v) == dim else [0.0] * dim for v in some([t or "" for t in batch.iloc[at : at + BATCH]])]
            yield pd.Series(got)

    return df.withColumn(out, vectors(F.col(text)))


def enriched_text(language: Column, kind: Column, label: Column, path: Column, text: Column) -> Column:
    """What is embedded of a node."""
    return F.format_string("[%s] %s %s in %s\n%s", language, kind, label, path, text)
