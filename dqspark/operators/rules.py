"""The twenty row rules, their counts, findings, examples, and the scores by severity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import Contract, num, parse_date, strip, yes


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    build: Callable[[Contract], Column]


# Functions, as a column expression needs a session and this module is imported before one is there.
def q() -> Column:
    return num("Quantity")


def p() -> Column:
    return num("UnitPrice")


def cancelled() -> Column:
    return yes(F.col("InvoiceNo").startswith("C"))


def line_value() -> Column:
    return F.round(q() * p(), 2) + F.lit(0.0)  # no negative zero


def _outside(x: Column, low: float, high: float) -> Column:
    return yes(~x.between(low, high))


def _date(c: Contract) -> Column:
    return F.coalesce(~parse_date("InvoiceDate").between(*(F.lit(x).cast("timestamp_ntz") for x in c.window)), F.lit(True))


def _customer(c: Contract) -> Column:
    x = num("CustomerID")
    return yes((x % 1 != 0) | ~x.between(*c.customer_block))


RULES = [
    Rule("unitprice_negative", "price", "hard", lambda c: yes(p() < 0)),
    Rule("unitprice_above_cap", "price", "hard", lambda c: yes(p() > c.price_cap)),
    Rule("quantity_zero", "quantity", "hard", lambda c: yes(q() == 0)),
    Rule("quantity_out_of_bounds", "quantity", "hard", lambda c: _outside(q(), -c.quantity_bound, c.quantity_bound)),
    Rule("quantity_bulk", "quantity", "review", lambda c: yes(F.abs(q()) > c.quantity_bulk)),
    Rule("quantity_atypical", "quantity", "info", lambda c: _outside(q(), *c.quantity_plausible)),
    Rule("unitprice_premium", "price", "review", lambda c: yes(p() > c.price_premium)),
    Rule("linevalue_extreme", "price", "review", lambda c: yes(F.abs(line_value()) > c.line_extreme)),
    Rule("unitprice_giveaway", "price", "info", lambda c: yes(p() == 0)),
    Rule("country_unknown", "category", "hard", lambda c: yes(~F.col("Country").isin(c.countries))),
    Rule("country_rare", "category", "review", lambda c: F.col("Country").isNotNull() & (F.col("_n_country") <= c.rare_country)),
    Rule("customerid_out_of_block", "category", "hard", _customer),
    Rule("invoiceno_format", "format", "hard", lambda c: F.coalesce(~F.col("InvoiceNo").rlike(c.invoice_re), F.lit(True))),
    Rule("stockcode_format", "format", "hard", lambda c: F.coalesce(~F.col("StockCode").rlike(c.stock_re), F.lit(True))),
    Rule("description_missing_or_blank", "format", "review", lambda c: F.coalesce(strip(F.col("Description")) == "", F.lit(True))),
    Rule("invoicedate_out_of_window", "format", "hard", _date),
    Rule("return_without_cancellation", "logic", "review", lambda c: yes(q() < 0) & ~cancelled()),
    Rule("cancellation_without_return", "logic", "hard", lambda c: cancelled() & ~yes(q() < 0)),
    Rule("duplicate_line_key", "logic", "review", lambda c: F.col("_n_key") > 1),
    Rule("guest_high_value", "logic", "review", lambda c: F.col("CustomerID").isNull() & yes(F.abs(line_value()) > c.guest_high)),
]
KEY = ["InvoiceNo", "StockCode", "InvoiceDate"]


def flag(df: DataFrame, contract: Contract | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """df with one boolean column for each rule.

    Counts by country come from a grouped join (few countries, broadcast by size), so that one country is no single task;
    those by line key from a window over the key.
    """
    contract, rules = contract or Contract(), RULES if rules is None else rules
    names, out = {r.rule_id for r in rules}, df
    if "country_rare" in names:
        counts = df.groupBy("Country").agg(F.count(F.lit(1)).alias("_n_country")).withColumnRenamed("Country", "_country")
        out = out.join(counts, F.col("Country") == F.col("_country"), "left").drop("_country")
    if "duplicate_line_key" in names:
        out = out.withColumn("_n_key", F.count(F.lit(1)).over(W.partitionBy(*KEY)))
    return out.select(*df.columns, *(r.build(contract).alias(r.rule_id) for r in rules))



def counts(df: DataFrame, contract: Contract | None = None) -> DataFrame:
    """A row for each rule: rule_id, category, severity, n_violations, violation_pct; one pass over the rows."""
    flagged = flag(df, contract)
    sums = flagged.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(r.rule_id).alias(r.rule_id) for r in RULES))
    each = F.explode(F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.col(r.rule_id).alias("n_violations")) for r in RULES)))
    pct = F.round(F.coalesce(F.try_divide(100.0 * F.col("n_violations"), F.col("n")), F.lit(0.0)), 4)
    return sums.select("n", each.alias("x")).select("x.*", pct.alias("violation_pct"))


def violations(df: DataFrame, contract: Contract | None = None) -> DataFrame:
    """(row_id, rule_id, category, severity), a row for each violation."""
    flagged = flag(df, contract)
    hit = F.array_compact(F.array(*(F.when(F.col(r.rule_id), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"))) for r in RULES)))
    return flagged.select("row_id", F.explode(hit).alias("x")).select("row_id", "x.*")


def snapshot() -> Column:
    """A row as JSON: dates in seconds, no NaN."""
    cols = [F.col("InvoiceNo"), F.col("StockCode"), F.col("Description"), num("Quantity").alias("Quantity"), F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"), num("UnitPrice").alias("UnitPrice"), F.col("CustomerID"), F.col("Country")]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def examples(df: DataFrame, k: int = 3, contract: Contract | None = None) -> DataFrame:
    """The first k violations of each rule. Each task keeps its own first k before they meet."""
    w = W.partitionBy("rule_id").orderBy("row_id")
    return violations(df, contract).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def findings(df: DataFrame, contract: Contract | None = None) -> DataFrame:
    """Rules with violations as findings: class and level by severity."""
    s = F.col("severity")
    kind, level = F.when(s == "hard", "impossible").otherwise("suspicious"), F.when(s == "hard", "critical").when(s == "review", "high").otherwise("medium")
    return counts(df, contract).filter("n_violations > 0").select("rule_id", kind.alias("error_type"), level.alias("level"), "n_violations")


def rows_by_severity(df: DataFrame, contract: Contract | None = None) -> DataFrame:
    """One row: n_rows, and the rows that any rule of each severity hits, without a shuffle beyond the rules' own."""
    any_ = {s: F.greatest(*(F.col(r.rule_id) for r in RULES if r.severity == s)) for s in ("hard", "review", "info")}
    flagged = flag(df, contract)
    every = F.greatest(*(F.col(r.rule_id) for r in RULES))
    return flagged.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(c).alias(f"n_{s}") for s, c in any_.items()), F.count_if(every).alias("n_flagged"))


def rollup(df: DataFrame, contract: Contract | None = None) -> DataFrame:
    """Violations by category, by severity, and in all."""
    v = counts(df, contract)
    return v.groupingSets([["category"], ["severity"], []], "category", "severity").agg(F.sum("n_violations").alias("n_violations"), F.count(F.lit(1)).alias("n_rules"))


def error_severity() -> Column:
    n = F.col("n_rows")
    return F.round(F.least(F.lit(100.0), F.coalesce(F.try_divide(100 * (F.col("n_hard") + 0.3 * F.col("n_review") + 0.1 * F.col("n_info")), n), F.lit(0.0))), 2)
