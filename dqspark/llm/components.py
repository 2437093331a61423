"""Connected components of a graph in a DataFrame: by alternating stars, or in one task for up to ``FEW`` edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

ship(__name__)

#: Edges (4 MB of them) that one task unites; with more, the graph stays spread and is solved by stars.
FEW = 1 << 18


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node that each reaches: roots hang on lesser roots until no edge is open."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
        still = root[x] != root[y]
        x, y = x[still], y[still]
    return nodes, nodes[root]


def _united(batches) -> Iterator[pa.RecordBatch]:
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if parts:
        found = united(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "component"])


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these."""
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.filter("a < b").unionByName(low.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60, few: int | None = None) -> DataFrame:
    """edges (a < b, longs) -> (node, component): the smallest node reachable, for every node that has an edge.

    Up to ``few`` distinct edges, by count, are united in one task. For more, rounds follow the logarithm of the longest path; each is two stars (Kiveris et al. 2014) with a checkpoint. Sums and
    minima are taken before rows move, and the joins' hot sides can be split, so that a node with very many edges is
    no single task.
    """
    now = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
    if now.count() <= (FEW if few is None else few):
        return cut(now.coalesce(1).mapInArrow(_united, "node long, component long"))
    state = None
    for _ in range(most_rounds):
        now = cut(_small(_large(now)))
        new = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % 1_000_003)).head()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
