"""Label propagation one node after the other: a workspace's graph as arrays in one task.

The scalable mode, ``graph.label_propagation``, moves nodes in rounds; this one moves
them singly, so a node sees what its neighbours have just become.  Both are weighted,
give equal votes to the larger label, and leave a graph without wishes as it is; they
agree as partitions where the votes leave no choice.  The order of a round is the
permutation that numpy's PCG64 draws for (SEED, round) over the ids in their order, so
a result depends on the graph alone.  Use the scalable mode where a workspace does
not fit one executor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import edge_weight

SEED = 42
#: Numbers of new labels begin here; smaller ones are seeds.
FRESH = 1 << 32


def propagate(a: np.ndarray, b: np.ndarray, weight: np.ndarray, label: np.ndarray, rounds: int) -> np.ndarray:
    """The labels after at most ``rounds`` rounds over the undirected edges (a[i], b[i]) of nodes 0 to n - 1."""
    label, n = label.copy(), len(label)
    ends, others, weights = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
    by_end = np.argsort(ends, kind="stable")
    others, weights = others[by_end], weights[by_end]
    limits = np.searchsorted(ends[by_end], np.arange(n + 1))
    with_votes = np.flatnonzero(np.diff(limits))
    for turn in range(rounds):
        before = label.copy()
        for v in np.random.default_rng([SEED, turn]).permutation(with_votes):
            near = slice(limits[v], limits[v + 1])
            names, which = np.unique(label[others[near]], return_inverse=True)
            sums = np.bincount(which, weights[near])
            label[v] = names[np.flatnonzero(sums == sums.max())[-1]]
        if (label == before).all():
            break
    return label


def compact(label: np.ndarray) -> np.ndarray:
    """Seeds keep their numbers; new labels count on from the largest of those, in the order in which they first occur."""
    names, first, which = np.unique(label, return_index=True, return_inverse=True)
    fresh = names >= FRESH
    start = names[~fresh].max(initial=-1) + 1
    numbers = names.copy()
    numbers[fresh] = start + np.argsort(np.argsort(first[fresh]))
    return numbers[which]


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 15, seeded: bool = False) -> DataFrame:
    """(workspace, id, community) of every node, each workspace on its own.

    With ``seeded`` the nodes' present communities are the seeds.  Parallel edges are
    summed before a workspace is gathered; edges of unknown ends and loops don't count.
    """
    home = nodes.select(F.col("id").alias("source"), F.col("workspace").alias("_w"))
    weighed = edges.where("source != target").join(home, "source").groupBy(F.col("_w").alias("workspace"), "source", "target").agg(F.sum(edge_weight(F.col("type"))).alias("weight"))

    def run(key, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = own.drop_duplicates("id").sort_values("id")
        place = pd.Index(own["id"])
        a, b = place.get_indexer(links["source"]), place.get_indexer(links["target"])
        known = (a >= 0) & (b >= 0)
        label = np.arange(len(own), dtype=np.int64) + FRESH
        if seeded:
            seeds = own["community"].to_numpy(dtype=np.float64, na_value=np.nan)
            label = np.where(np.isnan(seeds), label, np.nan_to_num(seeds)).astype(np.int64)
        found = propagate(a[known], b[known], links["weight"].to_numpy(np.float64)[known], label, rounds)
        return pd.DataFrame({"workspace": key[0], "id": own["id"], "community": compact(found)})

    columns = nodes.select("workspace", "id", "community")
    return columns.groupBy("workspace").cogroup(weighed.groupBy("workspace")).applyInPandas(run, "workspace string, id string, community int")
