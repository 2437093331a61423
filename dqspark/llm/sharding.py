"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Law ``rows``: shard sizes differ by one row at most, and each assignment of rows to (shard, slot) is equally likely under
the seed. Rows are dealt to blocks by a hash (so a lost task finds the same block again, whatever the file splits).
How many rows each block sends to each cell (a cell is a run of a shard's slots) is a row of the communication matrix: the
counts under a uniform permutation of all rows, so that cells get exactly their sizes. Each block permutes its rows
locally and cuts them by its row of the matrix; rows are exchanged by cell, and each cell permutes again, which gives the
slots.

The matrix exists nowhere as a whole. The blocks are the leaves of a binary tree; at each node the cells' counts are split
between its halves by one multivariate hypergeometric draw, seeded by the node. A task walks down to its block and has
that block's row, in memory of a few rows of the matrix; another attempt of the task draws the same. Blocks and cells
follow the input, up to ``MOST`` each; beyond that they grow, and Spark sorts them with spilling.

Copies of one text are different rows here and fall independently; no group is kept together, as exact row counts and a
group of a third of all rows exclude each other. Defined cases: a null text has size 1 and the crc32 of no bytes (0);
rows that are alike in all of doc_id and text are interchangeable; an empty table gives no row; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import given_back, own_columns, ship

ship(__name__)

#: Rows of a block or cell; blocks and cells at most (about 130 million rows; 100 billion rows are 6 million a block).
BLOCK_ROWS, MOST = 8_192, 16_384
#: Rows up to which numpy draws, and the deviations that are searched where it can't.
NUMPY_ROWS, FAR = 1_000_000_000, 12


def shard_sizes(n: int, shards: int) -> np.ndarray:
    return n // shards + (np.arange(shards) < n % shards)


def draw(rng: np.random.Generator, cells: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows, taken from all rows of the cells without returning them, come from each cell."""
    total = int(cells.sum())
    if n in (0, total):
        return cells * int(n > 0)
    if total < NUMPY_ROWS:
        return rng.multivariate_hypergeometric(cells, n, method="marginals")
    if len(cells) == 1:
        return np.array([n], np.int64)
    half = len(cells) // 2
    good = int(cells[:half].sum())
    first = _hypergeometric(rng, good, total - good, n)
    return np.concatenate([draw(rng, cells[:half], first), draw(rng, cells[half:], n - first)])


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Inversion over the values within FAR deviations of the mode, by the ratios of neighbouring probabilities (floats; the
    values left out have a chance below 1e-30)."""
    low, high = max(0, n - bad), min(n, good)
    p = good / (good + bad)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    reach = int(FAR * (n * p * (1 - p)) ** 0.5) + 50
    x = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    steps = np.log(good - x[:-1]) + np.log(n - x[:-1]) - np.log(x[:-1] + 1) - np.log(bad - n + x[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return int(x[np.searchsorted(chances, rng.random() * chances[-1], "right")])


def matrix_row(block: int, before: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """How many rows the block sends to each cell. before: rows of all earlier blocks, for each block and the end."""
    low, high, left = 0, len(before) - 1, cells.astype(np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        first = draw(np.random.default_rng([seed, low, high]), left, int(before[mid] - before[low]))
        low, high, left = (low, mid, first) if block < mid else (mid, high, left - first)
    return left


def communication_matrix(blocks: np.ndarray, cells: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """All rows under a seed that rng draws, for small inputs and tests."""
    before, seed = np.concatenate([[0], np.cumsum(blocks)]), int(rng.integers(2**32))
    return np.array([matrix_row(i, before, cells, seed) for i in range(len(blocks))])


def shard(docs: DataFrame, shards: int = 16, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """docs (columns ``keep``, all by default) with size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    own, names = own_columns(docs, keep, tuple(made))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    sized = docs.select(*own, F.col("doc_id").alias("id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    n = docs.count()  # parquet has it in its footers
    p = int(min(MOST, max(1, -(-n // BLOCK_ROWS))))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("id", "text_crc32", F.lit(seed)), F.lit(p)).cast("int"))
    counts = dict(sized.groupBy("block").count().collect())  # at most MOST rows
    before = np.concatenate([[0], np.cumsum([counts.get(i, 0) for i in range(p)])]).astype(np.int64)
    sizes = shard_sizes(int(before[-1]), shards)
    parts = int(min(max(1, MOST // shards), max(1, -(-int(sizes.max()) // BLOCK_ROWS))))
    held = docs.sparkSession.sparkContext.broadcast((before, np.concatenate([shard_sizes(int(s), parts) for s in sizes])))  # 2 MOST numbers

    @F.pandas_udf(T.IntegerType())
    def cell_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        (before, cells), now, ends = held.value, -1, None
        for block, rank in batches:  # in order of blocks, as the ranks were made
            b, r, out = block.to_numpy(), rank.to_numpy(), np.zeros(len(block), np.int32)
            for i in np.unique(b).tolist():
                if i != now:
                    now, ends = i, np.cumsum(matrix_row(i, before, cells, seed))
                out[b == i] = np.searchsorted(ends, r[b == i], "right")
            yield pd.Series(out)

    once = W.partitionBy("block").orderBy(F.xxhash64("id", "text_crc32", F.lit(seed + 1)), "id", "text_crc32", "size")
    again = W.partitionBy("cell").orderBy(F.xxhash64("id", "text_crc32", F.lit(seed + 2)), "id", "text_crc32", "size")
    dealt = sized.withColumn("rank", (F.row_number().over(once) - 1).cast("long")).withColumn("cell", cell_of("block", "rank"))
    at, part = F.floor(F.col("cell") / F.lit(parts)), F.col("cell") % parts
    rows = F.lit(int(before[-1] // shards)) + (at < F.lit(int(before[-1] % shards))).cast("long")  # of the cell's shard
    offset = part * F.floor(rows / F.lit(parts)) + F.least(part, rows % F.lit(parts))
    slotted = dealt.withColumn("slot", (offset + F.row_number().over(again) - 1).cast("long"))
    return slotted.select(*(f"c_{i}" for i in range(len(names))), "size", "text_crc32", F.lit("rows").alias("law"), at.cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")).select(*given_back(names), *made)
