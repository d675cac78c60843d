"""Vectors stored by cell: those nearest to a centroid in one folder, and nearest cells read first.

Centroids are fitted on a sample of at most SAMPLE vectors, drawn by the hash of their
key; every vector is in the index.  A search reads the ``probe`` nearest cells, a number
that ``fit`` doubles until the recall that it measures is high enough, or all cells; an
exact search reads the nearest cells first and then those that can hold something
nearer than the k-th found, by the angle to the centroid and the cell's widest angle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators import vectors as V
from weftline.session import materialize

#: Vectors on which centroids are fitted, cells, and rounds of the fit, at most.
SAMPLE, CELLS, ROUNDS = 65_536, 4_096, 6
#: What rounding may take from an angle.
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def fit_centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of a sample of vectors by cosine; a cell that empties keeps its own."""
    x = _unit(sample)
    centres = x[:cells].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        there = np.linalg.norm(sums, axis=1) > 0
        centres[there] = _unit(sums[there])
    return centres


class CellIndex:
    """Rows (key, embedding) of one dimension below a folder."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", column: str = "embedding"):
        self.spark, self.path, self.key, self.column, self.probe = spark, path.rstrip("/"), key, column, 1

    def build(self, vectors: DataFrame, cells: int | None = None) -> CellIndex:
        """Write all vectors that have a direction; null, zero, non-finite and ragged ones have no neighbours."""
        key, column = self.key, self.column
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        dim = vectors.agg(F.max(F.size(column))).first()[0] or 0
        whole = vectors.select(key, column).where((F.size(column) == dim) & ~F.exists(column, bad) & F.exists(column, lambda x: x != 0))
        count = whole.count()
        if not count:
            raise ValueError("no vector has a direction, so there are no cells")
        cells = max(1, min(CELLS, cells or round(math.sqrt(count)), count))
        drawn = whole.orderBy(F.xxhash64(key), key).limit(min(SAMPLE, 64 * cells)).select(column).collect()
        centres = fit_centroids(np.array([r[0] for r in drawn], np.float64).reshape(len(drawn), dim), cells)
        sent = self.spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    sims = _unit(np.stack(batch[column].to_numpy()).astype(np.float64)) @ sent.value.T
                    cell = sims.argmax(1)
                    yield batch.assign(angle=np.arccos(np.clip(sims[np.arange(len(cell)), cell], -1, 1)), cell=cell)

        kind = lambda c: vectors.schema[c].dataType.simpleString()
        placed = whole.mapInPandas(assign, f"{key} {kind(key)}, {column} {kind(column)}, angle double, cell int")
        placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors")
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        widest = self.vectors().groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n"))
        known.join(widest, "cell").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        return self

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def _cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centroids and widest angles of the cells that hold vectors; CELLS at most."""
        rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        return np.array([r["cell"] for r in rows]), np.array([r["centre"] for r in rows], np.float64), np.array([r["angle"] for r in rows])

    def _of(self, cells: list[int]) -> DataFrame:
        return self.vectors().where(F.col("cell").isin(cells)).select(self.key, self.column)

    def nearest(self, query: list[float], k: int = 10, probe: int | None = None) -> DataFrame:
        """(key, similarity) of the k nearest in the ``probe`` nearest cells."""
        numbers, centres, _ = self._cells()
        order = np.argsort(-(centres @ np.asarray(query, np.float64)), kind="stable")[: probe or self.probe]
        return V.top_k(self._of(numbers[order].tolist()), query, k, self.key, self.column)

    def exact(self, query: list[float], k: int = 10) -> DataFrame:
        """What ``vectors.top_k`` gives of all vectors; cells that can't hold a nearer one are not read."""
        numbers, centres, widest = self._cells()
        q = np.asarray(query, np.float64)
        if not np.linalg.norm(q):
            return V.top_k(self.vectors(), query, k, self.key, self.column)
        angle = np.arccos(np.clip(centres @ q / np.linalg.norm(q), -1, 1))
        best = np.cos(np.maximum(angle - widest - SLACK, 0))  # of any vector in the cell
        order, take = np.argsort(angle, kind="stable"), self.probe
        while True:
            first = order[:take]
            found = V.top_k(self._of(numbers[first].tolist()), query, k, self.key, self.column).collect()
            worst = found[-1]["similarity"] if len(found) == k else -2.0
            rest = [i for i in order[take:] if best[i] >= worst - SLACK]
            if not rest or len(found) == k:
                return V.top_k(self._of(numbers[[*first, *rest]].tolist()), query, k, self.key, self.column)
            take *= 4

    def knn(self, queries: DataFrame, k: int, probe: int | None = None) -> DataFrame:
        """(query, neighbour, similarity, rank): ``vectors.batch_knn`` within the ``probe`` cells nearest to each query row.

        The queries are a stated set of at most MAX_QUERIES, which is checked; cells that
        none of them is near to are not read.
        """
        key, column = self.key, self.column
        rows = queries.select(key, column).limit(V.MAX_QUERIES + 1).collect()
        if len(rows) > V.MAX_QUERIES:
            raise ValueError(f"more than {V.MAX_QUERIES} queries; ask in batches")
        numbers, centres, _ = self._cells()
        rows = [r for r in rows if r[1] is not None and len(r[1]) == centres.shape[1] and np.isfinite(np.array(r[1], np.float64)).all() and any(r[1])]
        unit = _unit(np.array([r[1] for r in rows], np.float64).reshape(len(rows), centres.shape[1]))
        asked: dict[int, list[int]] = {}
        for i, order in enumerate(np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, : probe or self.probe]):
            for c in numbers[order].tolist():
                asked.setdefault(c, []).append(i)
        sent = self.spark.sparkContext.broadcast(([r[0] for r in rows], unit, asked))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, unit, asked = sent.value
            for batch in batches:
                out = []
                for cell, own in batch.groupby("cell"):
                    x, ids = _unit(np.stack(own[column].to_numpy()).astype(np.float64)), own[key].to_numpy()
                    sims = unit[asked[cell]] @ x.T
                    for q, row in zip(asked[cell], sims, strict=True):
                        ok = np.flatnonzero(ids != names[q])
                        best = ok[np.lexsort((ids[ok], -row[ok]))[:k]]
                        out.append(pd.DataFrame({"query": names[q], "neighbour": ids[best], "similarity": row[best]}))
                if out:
                    yield pd.concat(out)

        kind = queries.schema[key].dataType.simpleString()
        found = self.vectors().where(F.col("cell").isin(list(asked))).mapInPandas(near, f"query {kind}, neighbour {kind}, similarity double")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def recall(self, queries: DataFrame, k: int, probe: int, exact: DataFrame | None = None) -> float:
        """The share of the k nearest of each query row, by a comparison with all vectors, that ``probe`` cells hold."""
        true = exact if exact is not None else V.block_knn(self.vectors().select(self.key, self.column), queries, k, self.key, self.column)
        hits = true.select("query", "neighbour").join(self.knn(queries, k, probe).select("query", "neighbour"), ["query", "neighbour"], "left_semi").count()
        return hits / max(1, true.count())

    def fit(self, queries: DataFrame, k: int = 10, wanted: float = 0.9) -> float:
        """Set ``probe`` to the first of 1, 2, 4, ... cells with the recall wanted on these query rows; the recall."""
        numbers, _, _ = self._cells()
        exact = materialize(V.block_knn(self.vectors().select(self.key, self.column), queries, k, self.key, self.column), "exact")
        self.probe = 1
        while (found := self.recall(queries, k, self.probe, exact)) < wanted and self.probe < len(numbers):
            self.probe = min(2 * self.probe, len(numbers))
        return found
