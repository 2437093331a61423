"""Features, scaling, one-hot columns, and the quality and health scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import CANONICAL, Contract, country, num, parse_date, squeeze, strip, yes
from . import drift, rules


def extract(df: DataFrame) -> DataFrame:
    """LineValue, three flags and six calendar parts, where they are absent."""
    d, q, p = parse_date("InvoiceDate"), num("Quantity"), num("UnitPrice")
    new = {
        "LineValue": F.bround(q * p, 2) + F.lit(0.0), "IsCancellation": yes(F.col("InvoiceNo").startswith("C")), "IsReturn": yes(q < 0), "IsGiveaway": yes(p == 0),
        "InvoiceYear": F.year(d), "InvoiceMonth": F.month(d), "InvoiceDay": F.dayofmonth(d), "InvoiceHour": F.hour(d), "InvoiceWeekday": F.weekday(d), "InvoiceQuarter": F.quarter(d),
    }
    return df.withColumns({k: v for k, v in new.items() if k not in df.columns})


def scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by the population's deviation into <column>_scaled; a constant column gives 0."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    s = df.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns)).head()
    return df.withColumns({f"{c}_scaled": (F.col(c) - F.lit(s[c].m)) / F.lit(s[c].s or 1.0) for c in columns})


def one_hot(df: DataFrame, column: str = "Country", most: int = 1_000) -> DataFrame:
    """0/1 columns for the sorted distinct values; a column of more than ``most`` values is refused."""
    values = [r[0] for r in df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return df.withColumns({f"{column}_{v}": yes(F.col(column) == v).cast("int") for v in values})


def valid(c: Contract) -> Column:
    """All hard constraints of a row."""
    q, p, d = num("Quantity"), num("UnitPrice"), parse_date("InvoiceDate")
    cid = num("CustomerID")
    return (
        yes(F.col("InvoiceNo").rlike(c.invoice_re)) & yes(F.col("StockCode").rlike(c.stock_re))
        & yes((q % 1 == 0) & (q != 0) & q.between(-c.quantity_bound, c.quantity_bound))
        & yes(p.between(0, c.price_cap) & (F.bround(p, 2) == p))
        & yes(d.between(F.lit(c.window[0]).cast("timestamp_ntz"), F.lit(c.window[1]).cast("timestamp_ntz")))
        & (F.col("CustomerID").isNull() | yes((cid % 1 == 0) & cid.between(*c.customer_block)))
        & yes(country(F.col("Country")).isin(c.countries))
        & (F.col("Description").isNull() | (strip(F.col("Description")) != ""))
    )


def consistent() -> Column:
    same = [F.coalesce(F.col(c), F.lit("")) == F.coalesce(x, F.lit("")) for c, x in (("StockCode", squeeze(F.col("StockCode"))), ("Description", squeeze(F.col("Description"))), ("Country", country(F.col("Country"))))]
    return same[0] & same[1] & same[2] & parse_date("InvoiceDate").isNotNull()


def quality(df: DataFrame, contract: Contract | None = None) -> DataFrame:
    """One row: completeness, consistency, uniqueness, validity and total, 0 to 100; an empty table is refused."""
    c = contract or Contract()
    complete = ~sum((F.col(x).isNull().cast("int") for x in CANONICAL if x != "CustomerID"), F.lit(0)).cast("boolean")
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(complete).alias("a"), F.count_if(consistent()).alias("b"), F.count_if(valid(c)).alias("d"))
    distinct = df.groupBy(*CANONICAL).agg(F.count(F.lit(1)).alias("m")).agg(F.count(F.lit(1)).alias("u")).head().u
    if distinct == 0:
        raise ValueError("no rows to score")
    pct = lambda x: F.round(100.0 * x / F.col("n"), 2)
    dims = one.select(pct(F.col("a")).alias("completeness"), pct(F.col("b")).alias("consistency"), pct(F.lit(distinct)).alias("uniqueness"), pct(F.col("d")).alias("validity"))
    return dims.withColumn("total", F.round(0.25 * F.col("completeness") + 0.35 * F.col("validity") + 0.2 * F.col("consistency") + 0.2 * F.col("uniqueness"), 2))


def health(n_rows: int, n_hard: int, n_review: int, n_both: int, drift: float | None) -> dict:
    """The weighted health score of distinct rows by severity, rows that both outlier models flag and the largest drift."""
    if not n_rows:
        raise ValueError("no rows to score")
    good = lambda n: 100.0 * (1 - n / n_rows)
    parts = {"validity": good(n_hard), "anomaly": good(n_both), "consistency": good(n_review), "stability": 100.0 * (1 - min(1.0, (drift or 0.0) / 0.5))}
    score = round(0.4 * parts["validity"] + 0.25 * parts["anomaly"] + 0.2 * parts["consistency"] + 0.15 * parts["stability"], 2)
    return {"score": score, "grade": "Healthy" if score >= 95 else "Watch" if score >= 80 else "Review"} | {k: round(v, 2) for k, v in parts.items()}


def health_score(df: DataFrame, both: DataFrame, c: Contract | None = None) -> DataFrame:
    """One row: score, grade and its four parts. both: the rows that both outlier models flag."""
    c = c or Contract()
    sev, d = rules.rows_by_severity(df, c).head(), drift.verdict(df, c.years).head()
    one = health(sev.n_rows, sev.n_hard, sev.n_review, both.count(), d.max_rel_change)
    return df.sparkSession.createDataFrame([one], "score double, grade string, validity double, anomaly double, consistency double, stability double")
