"""Profiling: types, missing values, cardinality, distributions, correlations, and data-quality flags.

Per-column metrics come from one unpivot to (column, value) and grouped sums, so a table is read once for all columns
and distinct counts never multiply rows by columns.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import PATTERNS, adjusted_kurtosis, adjusted_skew, correlation, integral, num, parse_date, parsed_date, strip

MONTHS = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
# Name parts that hint at personal data; the first that occurs counts.
PII = [("customerid", "direct"), ("customer", "direct"), ("email", "direct"), ("phone", "direct"), ("address", "direct"), ("name", "quasi"), ("country", "quasi"), ("city", "quasi"), ("postcode", "quasi"), ("zip", "quasi"), ("dob", "quasi"), ("birth", "quasi")]


def render(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return integral(F.col(c)) if kind in ("double", "float") else F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else F.col(c).cast("string")


def tall(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value): every value as text, nulls too."""
    columns = columns or df.columns
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), render(df, c).alias("value")) for c in columns))).alias("x")).select("x.*")


def distinct_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n) of non-null values."""
    return tall(df, columns).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def missing_per_column(df: DataFrame) -> DataFrame:
    """(column, n_missing, missing_pct): one pass, a counter for each column."""
    names = {c: f"n_{i}" for i, c in enumerate(df.columns)}
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(n) for c, n in names.items()))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(n).alias("n_missing")) for c, n in names.items())))
    pct = F.round(F.coalesce(F.try_divide(100.0 * F.col("n_missing"), F.col("n")), F.lit(0.0)), 2)
    return one.select("n", each.alias("x")).select("n", "x.*").select("column", "n_missing", pct.alias("missing_pct"))


def _missing(df: DataFrame) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))


def missing_per_row(df: DataFrame) -> DataFrame:
    m = df.select(_missing(df).alias("m"))
    return m.agg(F.count_if(F.col("m") == 0).alias("rows_complete"), F.count_if(F.col("m") == 1).alias("rows_one"), F.count_if(F.col("m") >= 2).alias("rows_more"), F.coalesce(F.max("m"), F.lit(0)).cast("long").alias("max_missing"))


def missing_total(df: DataFrame) -> DataFrame:
    t = df.select(_missing(df).alias("m")).agg((F.count(F.lit(1)) * len(df.columns)).alias("n_cells"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_missing"))
    return t.withColumn("missing_pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("n_missing"), F.col("n_cells")), F.lit(0.0)), 4))


def cardinality(df: DataFrame) -> DataFrame:
    d = distinct_values(df).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n"))
    r = F.col("n_unique") / F.col("n")
    return d.select("column", "n_unique", F.round(r, 6).alias("ratio"), F.when(r >= 0.5, "high").when(r >= 0.05, "medium").otherwise("low").alias("level"))


def top_values(df: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    w = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return distinct_values(df, columns).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def column_profile(df: DataFrame) -> DataFrame:
    n = tall(df).groupBy("column").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"))
    u = distinct_values(df).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.min("value").alias("min_text"), F.max("value").alias("max_text"))
    return n.join(u, "column", "left").select("column", "n_rows", "n_null", F.round(100.0 * F.col("n_null") / F.col("n_rows"), 2).alias("null_pct"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "min_text", "max_text")


def _predicates(v: Column) -> dict[str, Column]:
    """What a value as text looks like."""
    t = strip(v)
    return {
        "n_int": t.rlike(PATTERNS["int"]), "n_float": t.rlike(PATTERNS["float"]), "n_dateish": t.rlike("[-/:]") | t.rlike(MONTHS), "n_date": t.rlike("[-/: ]") & parsed_date(t).isNotNull(),
        "n_bool": F.lower(t).isin("true", "false", "0", "1"), "n_suffix": t.rlike(r"^[+-]?\d+[A-Za-z]+$"), "n_cancelled": t.rlike(PATTERNS["cancelled"]), "n_blank": t == "",
        "n_email": t.rlike(PATTERNS["email"]), "n_url": t.rlike(PATTERNS["url"]), "n_phone": t.rlike(PATTERNS["phone"]),
    }


def shapes(df: DataFrame) -> DataFrame:
    """Counts of values of each shape by column, with the number of distinct values. Each distinct value is judged once
    and weighs as many rows as have it."""
    each = tall(df).groupBy("column", "value").agg(F.count(F.lit(1)).alias("m"))
    total = lambda p: F.coalesce(F.sum(F.when(p, F.col("m"))), F.lit(0))
    preds = _predicates(F.col("value"))
    return each.groupBy("column").agg(F.sum("m").alias("n_rows"), total(F.col("value").isNotNull()).alias("n"), F.count("value").alias("n_unique"), *(total(p).alias(k) for k, p in preds.items()))


def _stored(df: DataFrame, *kinds: str) -> Column:
    """Whether the column (by name) is stored in one of the kinds."""
    return F.col("column").isin([c for c, k in df.dtypes if any(k.startswith(x) for x in kinds)])


def _dtype(df: DataFrame) -> Column:
    n, text = F.col("n"), _stored(df, "string")
    date = text & (F.col("n_dateish") >= 0.5 * n) & (F.col("n_date") >= 0.9 * n)
    kind = F.when(n == 0, "string").when(_stored(df, "boolean") | (F.col("n_bool") == n) & (F.col("n_unique") <= 2), "boolean").when(_stored(df, "timestamp", "date") | date, "date")
    return kind.when(F.col("n_int") == n, "int").when(F.col("n_float") == n, "float").otherwise("string")


def infer_dtype(df: DataFrame) -> DataFrame:
    """(column, dtype): string if empty; boolean if stored so, or if all values are of true, false, 0, 1 and two or fewer;
    date if stored so, or text of which most looks like dates and nine tenths are some; int; float; string."""
    return shapes(df).select("column", _dtype(df).alias("dtype"))


def mixed_type(df: DataFrame, least: int = 5, share: float = 0.005) -> DataFrame:
    s = shapes(df).withColumn("full", F.col("n") - F.col("n_blank")).withColumn("n_text", F.col("n") - F.col("n_blank") - F.col("n_float"))
    r = F.coalesce(F.try_divide(F.col("n_float").cast("double"), F.col("full").cast("double")), F.lit(0.0))
    minority = F.least("n_float", "n_text")
    mixed = ((minority >= least) & (minority >= share * F.col("full"))) | ((F.col("n_suffix") >= least) & (r > 0.5))
    return s.select("column", F.col("n_float").alias("n_numeric"), "n_text", F.round(r, 4).alias("numeric_ratio"), "n_suffix", "n_cancelled", mixed.alias("is_mixed"))


# The meaning of the eight known columns.
SEMANTICS = {
    "InvoiceNo": "invoice_id", "StockCode": "product_id (SKU)", "Description": "product_description", "Quantity": "quantity",
    "InvoiceDate": "transaction_datetime", "UnitPrice": "unit_price", "CustomerID": "customer_id", "Country": "country",
}


def infer_semantic(df: DataFrame) -> DataFrame:
    """(column, semantic): known columns by name; others by detectors in order over names, types and shapes."""
    s = shapes(df).withColumn("dtype", _dtype(df))
    name, n, t = F.lower("column"), F.col("n"), F.col("dtype")
    rate = lambda c: (F.col(c) >= 0.9 * n) & (n > 0)
    known = F.create_map(*(F.lit(x) for kv in SEMANTICS.items() for x in kv))[F.col("column")]
    kind = F.when(known.isNotNull(), known).when((t == "date") | name.rlike("date|time"), "datetime").when(t == "boolean", "boolean_flag")
    kind = kind.when((F.col("n_email") == n) & (n > 0), "email").when(rate("n_url"), "url").when(rate("n_phone") & _stored(df, "string"), "phone")  # digits and a point are a number's too
    kind = kind.when(name.rlike("price|amount|cost|total"), "price/amount").when(name.rlike("qty|quantity|count"), "quantity").when(name.rlike("(^|_)(id|no|code|key)$|^sku$"), "id/code").when(name.contains("name"), "name")
    kind = kind.when((t == "string") & (F.col("n_unique") <= F.greatest(F.lit(50.0), 0.05 * F.col("n_rows"))), "category").when(t.isin("int", "float"), "numeric_measure").otherwise("text")
    return s.select("column", kind.alias("semantic"))


def _follows(dtype: Column, v: Column) -> Column:
    p = _predicates(v)
    return F.when(dtype == "int", p["n_int"]).when(dtype == "float", p["n_float"]).when(dtype == "date", p["n_date"]).when(dtype == "boolean", p["n_bool"]).otherwise(F.lit(True))


def first_values(values: DataFrame, k: int) -> DataFrame:
    """(column, examples): the k least of each column's distinct values, as text."""
    w = W.partitionBy("column").orderBy("value")
    some = values.select("column", "value").distinct().withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k)
    return some.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), " | ").alias("examples"))


def dtype_consistency(df: DataFrame) -> DataFrame:
    """How many non-null values follow the type that their column is inferred to have."""
    s = shapes(df).withColumn("dtype", _dtype(df))
    good = F.expr("case dtype when 'int' then n_int when 'float' then n_float when 'date' then n_date when 'boolean' then n_bool else n end")
    return s.select("column", "dtype", good.alias("n_consistent"), (F.col("n") - good).alias("n_inconsistent"), F.round(F.coalesce(F.try_divide(good.cast("double"), F.col("n").cast("double")), F.lit(1.0)), 4).alias("rate"))


def inconsistent_examples(df: DataFrame, k: int = 5) -> DataFrame:
    """(column, examples): values that don't follow their column's type."""
    kinds = infer_dtype(df)  # a row for each column
    return first_values(distinct_values(df).join(kinds, "column").filter(~_follows(F.col("dtype"), F.col("value"))), k)


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each measure. Exact quantiles, adjusted skewness and kurtosis."""
    own = df.select(*(num(c).alias(c) for c in columns))
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.median(c), 4).alias("median"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.percentile(c, F.lit(0.25)), 4).alias("q1"), F.round(F.percentile(c, F.lit(0.75)), 4).alias("q3"), F.count_if(F.col(c) < 0).alias("n_negative"), F.count_if(F.col(c) == 0).alias("n_zero"), F.round(adjusted_skew(c), 4).alias("skew"), F.round(adjusted_kurtosis(c), 4).alias("kurtosis")).alias(c) for c in columns]
    return own.agg(*stats).select(F.explode(F.array(*columns)).alias("x")).select("x.*")


def iqr_outliers(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Fences and what lies beyond them; the fences are a few numbers that the second pass gets as literals."""
    own = df.select(*(num(c).alias(c) for c in columns))
    fences = own.agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns)).head()
    out = []
    for c in columns:
        q1, q3 = fences[c] or (0.0, 0.0)
        low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        beyond = F.count_if((F.col(c) < low) | (F.col(c) > high))
        out.append(F.struct(F.lit(c).alias("column"), F.lit(low).alias("low"), F.lit(high).alias("high"), beyond.alias("n_outliers"), F.round(F.coalesce(F.try_divide(100.0 * beyond, F.count(c)), F.lit(0.0)), 4).alias("outlier_pct")).alias(c))
    return own.agg(*out).select(F.explode(F.array(*columns)).alias("x")).select("x.*")


def corr_long(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.select(*(num(c).alias(c) for c in columns)).agg(*(F.round(correlation(a, b), 4).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs))).alias("x")).select("x.*")


def histogram(df: DataFrame, column: str, bins: int = 60, cap: float = 0.995) -> DataFrame:
    """(bin, n) of the values capped at a quantile."""
    own = df.select(num(column).alias("x")).filter("x is not null")
    low, high = own.agg(F.min("x"), F.percentile("x", F.lit(cap))).head()
    width = ((high or 0.0) - (low or 0.0)) / bins or 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.least("x", F.lit(high)) - F.lit(low)) / F.lit(width))).cast("int")
    return own.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sample_rows(df: DataFrame, n: int = 1_000, seed: int = 42, key: str = "row_id") -> DataFrame:
    """The n rows first in an order by arithmetic on a whole-number key: the same rows for one seed, whatever the partitions."""
    return df.orderBy(F.pmod(F.col(key) * 1103515245 + seed * 12345, F.lit(2147483648)), key).limit(n)


def missing_heatmap(df: DataFrame, n: int = 1_000, key: str = "row_id") -> DataFrame:
    """(key, a 0/1 column for each column): which cells of a sample of rows are missing."""
    return sample_rows(df, n, key=key).select(key, *(F.col(f"`{c}`").isNull().cast("int").alias(c) for c in df.columns if c != key)).orderBy(key)


# Flags of the measures and invoices, their severities and columns.
NUMERIC_FLAGS = [
    ("negative-quantity", "info", "Quantity"), ("bulk-quantity", "info", "Quantity"), ("zero-quantity", "warning", "Quantity"), ("negative-price", "critical", "UnitPrice"),
    ("zero-price", "warning", "UnitPrice"), ("extreme-price", "info", "UnitPrice"), ("cancelled-invoices", "info", "InvoiceNo"),
]
SEVERITY = {"missing-critical": "critical", "missing-high": "warning", "empty-column": "critical", "constant-column": "warning", "date-out-of-range": "warning", "mixed-type": "warning", "dtype-mismatch": "warning", "date-as-text": "warning", "padded-text": "warning", "case-variants": "info", "pii-direct": "warning", "pii-quasi": "info"}


def flags_numeric(df: DataFrame) -> DataFrame:
    """(flag, severity, n) of the measures' and invoices' flags that are raised."""
    q, p = num("Quantity"), num("UnitPrice")
    judged = [q < 0, F.abs(q) > 1000, q == 0, p < 0, p == 0, p > 1000, F.col("InvoiceNo").rlike(r"^C\d+$")]
    one = df.agg(*(F.count_if(c).alias(n) for (n, _, _), c in zip(NUMERIC_FLAGS, judged, strict=True)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("flag"), F.lit(s).alias("severity"), F.col(n).alias("n")) for n, s, _ in NUMERIC_FLAGS))).alias("x")).select("x.*").filter("n > 0")


def date_flags(df: DataFrame, window: tuple[str, str] = ("2009-01-01", "2011-12-31"), column: str = "InvoiceDate") -> DataFrame:
    """(flag, column, n): dates outside the window, whose end is its last day's midnight."""
    outside = ~parse_date(column).between(*(F.lit(x).cast("timestamp_ntz") for x in window))
    return df.agg(F.count_if(outside).alias("n")).filter("n > 0").select(F.lit("date-out-of-range").alias("flag"), F.lit(column).alias("column"), "n")


def flags(df: DataFrame, window: tuple[str, str] = ("2009-01-01", "2011-12-31")) -> DataFrame:
    """(flag, category, severity, column, n, examples): all flags that a table raises. Examples are the least values; n is
    rows, for case-variants groups, and for names that hint at persons null."""
    text = [c for c, k in df.dtypes if k == "string"]
    none = F.lit(None).cast("string").alias("examples")
    cols = ["flag", "column", "n", "examples"]
    missing = missing_flags(df).join(missing_per_column(df).select("column", F.col("n_missing").alias("n")), "column").select("flag", "column", "n", none)
    at = F.create_map(*(F.lit(x) for n, _, c in NUMERIC_FLAGS for x in (n, c)))[F.col("flag")]
    parts = [missing]
    if {"Quantity", "UnitPrice", "InvoiceNo"} <= set(df.columns):
        parts.append(flags_numeric(df).select("flag", at.alias("column"), "n", none))
    if "InvoiceDate" in df.columns:
        parts.append(date_flags(df, window).select("flag", "column", "n", none))
    values = distinct_values(df)
    numeric = strip(F.col("value")).rlike(PATTERNS["float"]) | (strip(F.col("value")) == "")
    mixed = mixed_type(df).filter("is_mixed").select("column", F.col("n_text").alias("n"))
    parts.append(mixed.join(first_values(values.filter(~numeric), 5), "column", "left").select(F.lit("mixed-type").alias("flag"), "column", "n", "examples"))
    wrong = dtype_consistency(df).filter("n_inconsistent > 0")
    shown = wrong.join(inconsistent_examples(df), "column", "left")
    parts.append(shown.select(F.lit("dtype-mismatch").alias("flag"), "column", F.col("n_inconsistent").alias("n"), "examples"))
    parts.append(shown.filter((F.col("dtype") == "date") & F.col("column").isin(text)).select(F.lit("date-as-text").alias("flag"), "column", F.col("n_inconsistent").alias("n"), "examples"))
    if text:
        own = values.filter(F.col("column").isin(text))
        padded = own.filter(F.col("value") != strip(F.col("value")))
        parts.append(padded_text(df, text).filter("n_padded > 0").join(first_values(padded, 3), "column").select(F.lit("padded-text").alias("flag"), "column", F.col("n_padded").alias("n"), "examples"))
        groups = own.groupBy("column", F.lower(strip(F.col("value"))).alias("value")).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        parts.append(case_variants(df, text).filter("n_groups > 0").join(first_values(groups, 3), "column").select(F.lit("case-variants").alias("flag"), "column", F.col("n_groups").alias("n"), "examples"))
    parts.append(pii_columns(df).select(F.concat(F.lit("pii-"), "kind").alias("flag"), "column", F.lit(None).cast("long").alias("n"), F.col("pattern").alias("examples")))
    every = reduce(DataFrame.unionByName, (p.select(*cols) for p in parts))
    severity = F.create_map(*(F.lit(x) for kv in ({n: s for n, s, _ in NUMERIC_FLAGS} | SEVERITY).items() for x in kv))[F.col("flag")]
    category = F.when(F.col("flag").startswith("pii-"), "pii").when(F.col("flag").isin("mixed-type", "dtype-mismatch", "date-as-text", "padded-text", "case-variants"), "format").otherwise("suspicious")
    return every.select("flag", category.alias("category"), severity.alias("severity"), "column", "n", "examples")


def flag_summary(flagged: DataFrame) -> DataFrame:
    """One row: flags, and how many of each severity."""
    return flagged.agg(F.count(F.lit(1)).alias("n_flags"), *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "warning", "info")))


def missing_flags(df: DataFrame) -> DataFrame:
    """missing-critical, missing-high, empty-column and constant-column."""
    s = missing_per_column(df).join(distinct_values(df).groupBy("column").agg(F.count(F.lit(1)).alias("u")), "column", "left")
    flag = F.when(F.col("u").isNull(), F.array(F.lit("missing-critical"), F.lit("empty-column"))).otherwise(F.array_compact(F.array(F.when(F.col("missing_pct") >= 95, F.lit("missing-critical")).when(F.col("missing_pct") >= 20, F.lit("missing-high")), F.when(F.col("u") == 1, F.lit("constant-column")))))
    return s.select("column", F.explode(flag).alias("flag"), "missing_pct")


def case_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_groups): groups of distinct values that differ by case or outer white space only."""
    return distinct_values(df, columns).groupBy("column", F.lower(strip(F.col("value"))).alias("g")).agg(F.count(F.lit(1)).alias("m")).groupBy("column").agg(F.count_if(F.col("m") > 1).alias("n_groups"))


def padded_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return tall(df, columns).groupBy("column").agg(F.count_if(F.col("value") != strip(F.col("value"))).alias("n_padded"))


def pii_columns(df: DataFrame) -> DataFrame:
    found = [(c, k, next(p for p, _ in PII if p in c.lower())) for c in df.columns for k in [next((k for p, k in PII if p in c.lower()), None)] if k]
    return df.sparkSession.createDataFrame(found, "column string, kind string, pattern string")
