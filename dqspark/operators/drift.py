"""Drift between two years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import num, yes

MEASURES = ("Quantity", "UnitPrice", "LineValue")


def relative(a: Column, b: Column) -> Column:
    """(b - a) / |a|; from 0: null to 0, infinite to all else."""
    return F.when(a == 0, F.when(b == 0, F.lit(None).cast("double")).otherwise(F.lit(float("inf")))).otherwise((b - a) / F.nullif(F.abs(a), F.lit(0.0)))


def band(rel: Column) -> Column:
    x = F.abs(rel)
    return F.when(rel.isNull() | F.isnan(rel), "n/a").when(x >= 0.25, "alert").when(x >= 0.10, "watch").otherwise("none")


def _with_value(df: DataFrame) -> DataFrame:
    return df.withColumns({"Quantity": num("Quantity"), "UnitPrice": num("UnitPrice"), "LineValue": F.round(num("Quantity") * num("UnitPrice"), 2), "_year": F.year("InvoiceDate")})


def _stack(one: DataFrame, names: list[tuple[str, ...]], keys: list[str]) -> DataFrame:
    rows = [F.struct(*(F.lit(x).alias(k) for k, x in zip(keys, n, strict=True)), F.col("_".join(n) + "_a").cast("double").alias("value_a"), F.col("_".join(n) + "_b").cast("double").alias("value_b")) for n in names]
    out = one.select(F.explode(F.array(*rows)).alias("x")).select("x.*").withColumn("_rel", relative(F.col("value_a"), F.col("value_b")))
    return out.select(*keys, F.round("value_a", 4).alias("value_a"), F.round("value_b", 4).alias("value_b"), F.round("_rel", 4).alias("rel_change"), band(F.col("_rel")).alias("band"))


def measures(df: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Median, mean and deviation of each measure in both years, in one pass."""
    one, names = [], []
    for m in MEASURES:
        for s, f in (("median", F.median), ("mean", F.avg), ("std", F.stddev_samp)):
            names.append((m, s))
            one += [f(F.when(F.col("_year") == y, F.col(m))).alias(f"{m}_{s}_{k}") for k, y in zip("ab", years, strict=True)]
    return _stack(_with_value(df).agg(*one), names, ["measure", "statistic"])


def shares(df: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Shares of returns, giveaways, guests, cancellations and the home country, and row counts."""
    preds = {"return": yes(F.col("Quantity") < 0), "giveaway": yes(F.col("UnitPrice") == 0), "guest": F.col("CustomerID").isNull(), "cancellation": yes(F.col("InvoiceNo").startswith("C")), "uk": yes(F.col("Country") == "United Kingdom")}
    one = [F.coalesce(F.avg(F.when(F.col("_year") == y, p.cast("double"))), F.lit(0.0)).alias(f"{n}_{k}") for n, p in preds.items() for k, y in zip("ab", years, strict=True)]
    one += [F.count_if(F.col("_year") == y).alias(f"rows_{k}") for k, y in zip("ab", years, strict=True)]
    return _stack(_with_value(df).agg(*one), [(n,) for n in (*preds, "rows")], ["metric"])


def verdict(df: DataFrame, years: tuple[int, int]) -> DataFrame:
    """One row: the worst band and the largest finite change."""
    both = measures(df, years).select("band", "rel_change").unionByName(shares(df, years).select("band", "rel_change"))
    rank = F.expr("case band when 'alert' then 3 when 'watch' then 2 when 'none' then 1 else 0 end")
    finite = F.when(F.abs("rel_change") < float("inf"), F.abs("rel_change"))
    return both.agg(F.max_by("band", rank).alias("verdict"), F.max(finite).alias("max_rel_change"), F.count_if(F.col("band") == "alert").alias("n_alert"), F.count_if(F.col("band") == "watch").alias("n_watch"))


def years(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("InvoiceDate").alias("year")).agg(F.count(F.lit(1)).alias("n_rows"))
