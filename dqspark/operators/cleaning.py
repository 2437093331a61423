"""Cleaning: normalise, impute, exact and near duplicates, before/after differences."""

from __future__ import annotations

import difflib
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.expr import CANONICAL, changed, country, num, parse_date, squeeze

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def normalise(df: DataFrame) -> DataFrame:
    """Text squeezed and upper-cased, countries resolved, dates parsed (or null)."""
    return df.withColumns({
        "StockCode": squeeze(F.col("StockCode")), "Description": squeeze(F.col("Description")), "Country": country(F.col("Country")),
        "InvoiceDate": parse_date("InvoiceDate"),
    })


def normalise_log(df: DataFrame) -> DataFrame:
    """How many values of each column normalising changes."""
    after = {"StockCode": squeeze(F.col("StockCode")), "Description": squeeze(F.col("Description")), "Country": country(F.col("Country"))}
    log = df.agg(*(F.count_if(changed(F.col(c), x)).alias(c) for c, x in after.items()), F.count_if(F.col("InvoiceDate").isNotNull() & parse_date("InvoiceDate").isNull()).alias("InvoiceDate"))
    return log.select(F.explode(F.create_map(*(x for c in (*after, "InvoiceDate") for x in (F.lit(c), F.col(c))))).alias("column", "n_changed"))


def description_lookup(df: DataFrame) -> DataFrame:
    """Each code's most frequent description, the smallest of the most frequent. Counts come first, so that a code of
    very many rows is a few counts."""
    n = df.filter("StockCode is not null and Description is not null").groupBy("StockCode", "Description").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("StockCode").agg(F.max("n").alias("m")).withColumnRenamed("StockCode", "_code")
    return n.join(best, (F.col("StockCode") == F.col("_code")) & (F.col("n") == F.col("m"))).groupBy("StockCode").agg(F.min("Description").alias("LookupDescription"))


def impute(df: DataFrame) -> DataFrame:
    """Descriptions from the lookup or else the most frequent one; quantities and prices by their medians."""
    top = df.filter("Description is not null").groupBy("Description").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "Description").limit(1).collect()
    medians = df.agg(F.median(num("Quantity")).alias("q"), F.median(num("UnitPrice")).alias("p")).head()
    joined = df.join(description_lookup(df), "StockCode", "left")
    how = F.when(F.col("Description").isNotNull(), "kept").when(F.col("LookupDescription").isNotNull(), "lookup").otherwise("mode")
    return joined.withColumns({
        "description_source": how, "Description": F.coalesce("Description", "LookupDescription", F.lit(top[0].Description if top else None).cast("string")),
        "Quantity": F.coalesce(num("Quantity"), F.lit(medians.q)), "UnitPrice": F.coalesce(num("UnitPrice"), F.lit(medians.p)),
    }).select(*df.columns, "description_source")


def exact_dedup(df: DataFrame, keys: list[str] = CANONICAL) -> DataFrame:
    """The first row (least row_id) of each group of rows alike in all keys; nulls are alike. A group is reduced where
    its rows are, so a row repeated very often is no large group."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct("row_id", *(c for c in rest if c != "row_id"))).alias("_first")).select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns))


def duplicate_groups(df: DataFrame, keys: list[str] = CANONICAL) -> DataFrame:
    """One row: rows, groups of more than one, rows beyond the first of each."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_removed"))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def near_pairs(df: DataFrame, threshold: float = 0.9, distance: bool = False) -> DataFrame:
    """(StockCode, a, b, similarity): spellings a < b of one code that are alike, but not equal.

    Distinct spellings are joined within their code; lengths bound the ratio from above before it is computed.
    ``distance`` takes 1 - levenshtein / longer length instead, inside the JVM.
    """
    names = df.filter("StockCode is not null and Description is not null").select("StockCode", "Description").distinct()
    pairs = names.withColumnRenamed("Description", "a").join(names.withColumnRenamed("Description", "b"), "StockCode").filter("a < b")
    la, lb = F.length("a"), F.length("b")
    near = pairs.filter(2 * F.least(la, lb) >= threshold * (la + lb))
    similarity = 1 - F.levenshtein("a", "b") / F.greatest(la, lb) if distance else ratio("a", "b")
    return near.withColumn("similarity", similarity).filter((F.col("similarity") >= threshold) & (F.col("similarity") < 1))


def near_groups(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(group_id, StockCode, descriptions, n_rows, first_row, max_similarity): spellings that pairs connect; reported,
    never merged. A code's spellings meet in one task, its rows don't."""
    pairs = near_pairs(df, threshold)

    def connect(pdf: pd.DataFrame) -> pd.DataFrame:
        of: dict[str, str] = {}

        def root(x: str) -> str:
            while of.setdefault(x, x) != x:
                x = of[x]
            return x

        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            low, high = sorted((root(a), root(b)))
            of[high] = low
        return pd.DataFrame([(pdf["StockCode"].iloc[0], x, root(x)) for x in of], columns=["StockCode", "Description", "root"])

    members = pairs.groupBy("StockCode").applyInPandas(connect, "StockCode string, Description string, root string")
    best = pairs.join(members.select("StockCode", F.col("Description").alias("a"), "root"), ["StockCode", "a"]).groupBy("StockCode", "root").agg(F.max("similarity").alias("max_similarity"))
    rows = df.groupBy("StockCode", "Description").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    groups = members.join(rows, ["StockCode", "Description"]).groupBy("StockCode", "root").agg(F.array_sort(F.collect_list("Description")).alias("descriptions"), F.sum("n").alias("n_rows"), F.min("first").alias("first_row"))
    return groups.join(best, ["StockCode", "root"]).withColumn("group_id", F.concat(F.lit("ng-"), F.substring(F.sha2(F.concat_ws("|", "StockCode", "root"), 256), 1, 12))).drop("root")


def clean(df: DataFrame) -> DataFrame:
    """Normalised, imputed, without exact duplicates. (Medians fill all gaps of measures, so nearest neighbours, which
    may also be asked for by themselves, have none to fill here.)"""
    return exact_dedup(impute(normalise(df)).drop("description_source"))


def _dirty(df: DataFrame) -> dict[str, Column]:
    c = F.col
    return {
        "null_description": c("Description").isNull(), "alias": F.upper(F.trim(c("Country"))).isin(["EIRE", "UK", "USA"]), "padded": c("Description") != F.trim(c("Description")),
        "lower_code": c("StockCode") != F.upper(c("StockCode")), "guest": c("CustomerID").isNull(), "zero_quantity": c("Quantity") == 0,
    }


def defect_sample(df: DataFrame) -> DataFrame:
    """(role, row_id): the first row with each defect, and the first with none."""
    roles = _dirty(df)
    tagged = F.array_compact(F.array(*(F.when(x, F.lit(r)) for r, x in roles.items())))
    each = df.select("row_id", F.explode(F.when(F.size(tagged) > 0, tagged).otherwise(F.array(F.lit("clean")))).alias("role"))
    return each.groupBy("role").agg(F.min("row_id").alias("row_id"))


def diff(df: DataFrame) -> DataFrame:
    """(row_id, status, operations): what cleaning did to each row; removed > imputed > normalised > preserved > unchanged."""
    before = normalise(df)
    firsts = exact_dedup(impute(before).drop("description_source")).select("row_id", F.lit(True).alias("kept"))
    ops = F.array_compact(F.array(*(F.when(changed(df[c], x), F.lit(f"normalised:{c}")) for c, x in (("StockCode", squeeze(F.col("StockCode"))), ("Description", squeeze(F.col("Description"))), ("Country", country(F.col("Country"))))), F.when(F.col("Description").isNull(), F.lit("imputed:Description"))))
    logged = df.select("row_id", ops.alias("ops"), F.col("CustomerID").isNull().alias("guest")).join(firsts, "row_id", "left")
    status = F.when(F.col("kept").isNull(), "removed").when(F.array_contains("ops", "imputed:Description"), "imputed").when(F.size("ops") > 0, "normalised").when(F.col("guest"), "preserved").otherwise("unchanged")
    return logged.select("row_id", status.alias("status"), F.array_join("ops", ",").alias("operations"))
