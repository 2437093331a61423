"""Ranks, running sums and quantiles over a whole table without one task that has all its rows.

Values are dealt to ``BINS`` ranges at edges that approximate quantiles; only the ranges' totals, a few numbers, go through
the driver. Edges balance the ranges; results don't rest on them.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BINS = 512


def settled(df: DataFrame) -> DataFrame:
    """df's rows in the shared folder of spark.checkpoint.dir, without the plan that made them: what reads them several times
    has a small plan and makes nothing twice. In local mode a temporary folder stands in for a missing setting."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def _edges(df: DataFrame, column: str, most: int) -> list[float]:
    """Up to ``most`` distinct values that cut the table in about equal ranges."""
    found = df.approxQuantile(column, [i / most for i in range(1, most)], 0.25 / most) if most > 1 else []
    return sorted(set(found))


def running(df: DataFrame, column: str, weights: list[str], by: list[str] | None = None) -> DataFrame:
    """df with ``<weight>_below`` and ``<weight>_same``: each weight's sum over all rows whose column is smaller, and over
    those where it is the same (of the same ``by``).

    Rows of one value are one row of sums first, so that a value which very many rows have is no large group."""
    keys = by or []
    sums = df.groupBy(*keys, column).agg(*(F.sum(w).alias(f"_{w}") for w in weights))
    edges = _edges(sums, column, BINS)
    at = F.lit(0)
    if edges:  # how many edges are at most the value
        held = F.array(*(F.lit(float(e)) for e in edges))
        at = F.size(F.filter(held, lambda e: e <= F.col(column)))
    binned = sums.withColumn("_bin", at)
    totals = binned.groupBy(*keys, "_bin").agg(*(F.sum(f"_{w}").alias(f"_t_{w}") for w in weights))  # BINS rows for each by
    earlier = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bin", *(F.coalesce(F.sum(f"_t_{w}").over(earlier), F.lit(0)).alias(f"_o_{w}") for w in weights))
    inside = W.partitionBy(*keys, "_bin").orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    placed = binned.join(F.broadcast(offsets), [*keys, "_bin"])  # BINS rows for each by
    below = placed.select(*keys, column, *((F.col(f"_o_{w}") + F.coalesce(F.sum(f"_{w}").over(inside), F.lit(0))).alias(f"{w}_below") for w in weights), *(F.col(f"_{w}").alias(f"{w}_same") for w in weights))
    return df.join(below, [*keys, column])


def quantile(df: DataFrame, column: str, q: float, weight: str | None = None) -> float | None:
    """The exact quantile (linear between neighbours) of a column, in which a row counts ``weight`` times. Each round counts
    rows in 4,096 ranges and goes on with the one that holds the place, until it has one value."""
    own = df.select(F.col(column).cast("double").alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n")).filter("x is not null")
    total = own.agg(F.sum("n")).head()[0]
    if not total:
        return None
    place = q * (total - 1)
    low = _order_statistic(own, int(place))
    return low if place == int(place) else low + (place - int(place)) * (_order_statistic(own, int(place) + 1) - low)


def _order_statistic(own: DataFrame, rank: int, ranges: int = 4_096) -> float:
    low, high = own.agg(F.min("x"), F.max("x")).head()
    while low < high:
        at = F.least(F.lit(ranges - 1), F.floor((F.col("x") - F.lit(low)) / F.lit(high - low) * ranges)) if high - low > 0 else F.lit(0)
        found = own.filter(F.col("x").between(low, high)).groupBy(at.alias("b")).agg(F.sum("n").alias("n"), F.min("x").alias("a"), F.max("x").alias("z")).collect()
        for r in sorted(found, key=lambda r: r.a):
            if rank < r.n:
                low, high = r.a, r.z
                break
            rank -= r.n
    return low
