"""The schema contract that a table's own values show: patterns of identifiers, ranges, policies, and checks of it.

Every part is read off all values (each distinct one judged once) and ends in a few rows, which ``infer`` gathers into a
Contract and ``schema`` into a report. What no data can show, such as signs, bounds and roles, are fixed values.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import COUNTRY_ALIASES, PATTERNS, Contract, country, num, parse_date, strip
from .contract import constraints
from .profile import column_profile, infer_dtype, render, tall

# Role, type and whether gaps are allowed, by column.
ROLES = {
    "InvoiceNo": ("key", "string", False),
    "StockCode": ("key", "string", False),
    "Description": ("text", "string", True),
    "Quantity": ("measure", "int", False),
    "InvoiceDate": ("timestamp", "date", False),
    "UnitPrice": ("measure", "float", False),
    "CustomerID": ("key", "int", True),
    "Country": ("dimension", "string", False),
}
# Steps of cleaning in order, the columns they touch, and the rules that ask for them.
CLEANING_PLAN = [
    (1, "strip_whitespace", ["StockCode", "Description", "Country"], ["StockCode.trim", "Description.trim", "Country.trim"]),
    (2, "normalise_case", ["StockCode", "Description", "Country"], ["StockCode.case", "Description.case", "Country.case"]),
    (3, "normalise_country_aliases", ["Country"], ["Country.alias"]),
    (4, "parse_datetimes", ["InvoiceDate"], ["InvoiceDate.format"]),
    (5, "cast_nullable_integer", ["CustomerID"], ["CustomerID.integer"]),
    (6, "impute_description_from_stockcode", ["Description"], ["Description.null", "Description.per_stockcode"]),
    (7, "derive_line_columns", ["LineValue", "IsCancellation", "IsReturn", "IsGiveaway"], []),
]
FAMILIES = ["numeric", "suffixed", "prefixed", "service"]
# Fixed value: codes that aren't numbers with a letter before or behind.
SERVICE = r"[A-Za-z][A-Za-z0-9 .'/&_()-]{0,30}"
#: By how much observed widths are widened on both sides; multiples of the quartiles' distance of the two inner tiers.
TOLERANCE, TYPICAL, PLAUSIBLE = 1, 1.5, 3.0


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, m): distinct values as text, and how many rows have each."""
    return tall(df, columns).withColumnRenamed("value", "v").groupBy("column", "v").agg(F.count(F.lit(1)).alias("m"))


def _quantifier(low: Column, high: Column) -> Column:
    widened = F.concat(F.lit("{"), F.greatest(F.lit(1), low - TOLERANCE).cast("string"), F.lit(","), (high + TOLERANCE).cast("string"), F.lit("}"))
    return F.when(low.isNull(), F.lit("+")).otherwise(widened)


def identifier_families(df: DataFrame, columns: tuple[str, ...] = ("InvoiceNo", "StockCode", "CustomerID"), prefix: str = "C") -> DataFrame:
    """(column, family, n, pct, pattern): numbers, numbers with letters behind, with the prefix before, and the rest. Widths
    of digits and letters are those observed, widened by one; the families' rows add up to the non-null ones."""
    v, t = F.col("v"), strip(F.col("v"))
    plain, behind = v.rlike(r"^\d+$"), v.rlike(r"^\d+[A-Za-z]+$")
    digits = F.when(plain, F.length(v)).when(behind, F.length(F.regexp_extract(v, r"^(\d+)", 1)))
    letters = F.when(behind, F.length(F.regexp_extract(v, r"([A-Za-z]+)$", 1)))
    family = F.when(t.rlike(PATTERNS["float"]), "numeric").when(t.rlike(r"^[+-]?\d+[A-Za-z]+$"), "suffixed").when(t.rlike(PATTERNS["cancelled"]), "prefixed").otherwise("service")
    each = _values(df, list(columns)).select("column", "v", "m", F.when(v.isNotNull(), family).alias("family"), digits.alias("digits"), letters.alias("letters"))
    widths = each.groupBy("column").agg(F.sum("m").alias("rows"), F.min("digits").alias("a"), F.max("digits").alias("b"), F.min("letters").alias("c"), F.max("letters").alias("d"))
    counted = each.filter("family is not null").groupBy("column", "family").agg(F.sum("m").alias("n")).join(widths, "column")
    wide, long = _quantifier(F.col("a"), F.col("b")), F.coalesce(_quantifier(F.col("c"), F.col("d")), F.lit("+"))
    inner = F.when(F.col("family") == "numeric", F.concat(F.lit(r"\d"), wide)).when(F.col("family") == "suffixed", F.concat(F.lit(r"\d"), wide, F.lit("[A-Za-z]"), long)).when(F.col("family") == "prefixed", F.concat(F.lit(prefix + r"\d"), wide)).otherwise(F.lit(SERVICE))
    return counted.select("column", "family", "n", F.round(100.0 * F.col("n") / F.col("rows"), 3).alias("pct"), F.concat(F.lit("^"), inner, F.lit("$")).alias("pattern"))


def identifier_patterns(df: DataFrame, columns: tuple[str, ...] = ("InvoiceNo", "StockCode", "CustomerID")) -> DataFrame:
    """(column, pattern, n_families, n_accounted): the families' patterns as alternatives of one."""
    rank = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(FAMILIES) for x in (f, i))), F.col("family"))
    inner = F.concat(F.lit("(?:"), F.expr("substring(pattern, 2, length(pattern) - 2)"), F.lit(")"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("i"), inner.alias("p")))), lambda x: x["p"]), "|")
    one = identifier_families(df, columns).groupBy("column").agg(parts.alias("p"), F.count(F.lit(1)).alias("n_families"), F.sum("n").alias("n_accounted"))
    return one.select("column", F.concat(F.lit("^(?:"), F.col("p"), F.lit(")$")).alias("pattern"), "n_families", "n_accounted")


def measure_ranges(df: DataFrame, c: Contract | None = None) -> DataFrame:
    """(column, tier, low, high): typical and plausible fences about the quartiles, clipped to the hard bounds."""
    c = c or Contract()
    hard = {"Quantity": (-c.quantity_bound, c.quantity_bound), "UnitPrice": (0.0, c.price_cap)}
    one = df.agg(*(F.percentile(num(m), F.array(F.lit(0.25), F.lit(0.75))).alias(m) for m in hard))
    rows = []
    for m, (low, high) in hard.items():
        q1, q3 = F.col(m)[0], F.col(m)[1]
        for tier, k in (("typical", TYPICAL), ("plausible", PLAUSIBLE)):
            rows.append((m, tier, F.greatest(q1 - k * (q3 - q1), F.lit(float(low))), F.least(q3 + k * (q3 - q1), F.lit(float(high)))))
        rows.append((m, "atypical", F.lit(float(low)), F.lit(float(high))))
    each = [F.struct(F.lit(m).alias("column"), F.lit(t).alias("tier"), F.round(a, 4).alias("low"), F.round(b, 4).alias("high")) for m, t, a, b in rows]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def envelopes(df: DataFrame, step: int = 1_000) -> DataFrame:
    """One row: the customers' block (least and largest id, outward to whole steps) and the calendar years of the dates."""
    d, x = parse_date("InvoiceDate"), num("CustomerID")
    one = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(d).alias("first"), F.max(d).alias("last"))
    year = lambda c, end: F.concat(F.lpad(F.year(c).cast("string"), 4, "0"), F.lit(end))
    return one.select((F.floor(F.col("a") / step) * step).cast("long").alias("block_low"), (F.ceil(F.col("b") / step) * step).cast("long").alias("block_high"), year("first", "-01-01 00:00:00").alias("window_low"), year("last", "-12-31 23:59:59").alias("window_high"))


def text_policy(df: DataFrame, column: str = "Description", most_null_pct: float = 1.0) -> DataFrame:
    """One row for a text column: gaps and whether they are few enough, lengths, and how many values need which cleaning."""
    t = F.col(column)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(t.isNull()).alias("n_null"), F.coalesce(F.min(F.length(strip(t))), F.lit(0)).alias("min_length"), F.coalesce(F.max(F.length(strip(t))), F.lit(0)).alias("max_length"), F.count_if(t != strip(t)).alias("n_padded"), F.count_if(strip(t).rlike(r"\s{2,}")).alias("n_spaced"), F.count_if(t != F.upper(t)).alias("n_not_upper"), F.count_if(strip(t) == "").alias("n_blank"))
    pct = F.round(F.coalesce(F.try_divide(100.0 * F.col("n_null"), F.col("n_rows")), F.lit(0.0)), 2)
    return one.select(F.lit(column).alias("column"), "n_rows", "n_null", pct.alias("null_pct"), (pct <= most_null_pct).alias("null_pct_accepted"), "min_length", "max_length", "n_padded", "n_spaced", "n_not_upper", "n_blank")


def categories(df: DataFrame, column: str = "Country", c: Contract | None = None) -> DataFrame:
    """(value, n, n_alias, basis): canonical values that are seen or of the reference set; basis says of which."""
    c = c or Contract()
    raw = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("raw")).agg(F.count(F.lit(1)).alias("m"))
    alias = F.upper(strip(F.col("raw"))).isin(list(COUNTRY_ALIASES))
    seen = raw.groupBy(country(F.col("raw")).alias("value")).agg(F.sum("m").alias("n"), F.coalesce(F.sum(F.when(alias, F.col("m"))), F.lit(0)).alias("n_alias"))
    known = df.sparkSession.createDataFrame([(x, True) for x in c.countries], "value string, known boolean")
    both = seen.join(known, "value", "full")
    basis = F.when(F.col("n").isNull(), "reference").when(F.col("known").isNull(), "seen").otherwise("both")
    return both.select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_alias", F.lit(0)).alias("n_alias"), basis.alias("basis"))


def column_contract(df: DataFrame) -> DataFrame:
    """(column, role, expected_dtype, nullable, n_null, n_unique, is_key): known columns by their roles, others as unknown,
    with the type their values have."""
    own = df.drop("row_id")
    known = {c: ROLES[c] for c in own.columns if c in ROLES}
    said = lambda i: F.create_map(*(F.lit(x) for c, r in known.items() for x in (c, r[i])))[F.col("column")] if known else F.lit(None)
    both = column_profile(own).join(infer_dtype(own), "column")
    return both.select("column", F.coalesce(said(0), F.lit("unknown")).alias("role"), F.coalesce(said(1), F.col("dtype")).alias("expected_dtype"), F.coalesce(said(2), F.col("n_null") > 0).alias("nullable"), "n_null", "n_unique", ((F.col("n_unique") == F.col("n_rows")) & (F.col("n_rows") > 0)).alias("is_key"))


def checks(df: DataFrame, c: Contract | None = None) -> DataFrame:
    """(check_id, n_found, n_expected, passed): the contract's own proof. Every column has a role or a fallback, a type and a
    domain; the families of each identifier add up to its non-null rows; the constraints' severities are all known."""
    c, own = c or Contract(), df.drop("row_id")
    columns = column_contract(df)
    typed = F.col("expected_dtype").isin("int", "float", "string", "date", "boolean")
    domain = F.col("role").isin("key", "measure", "timestamp", "text", "dimension") | (F.col("role") == "unknown") & typed
    whole = [("every-column-has-schema", F.count(F.lit(1))), ("every-column-has-expected-dtype", F.count_if(typed)), ("every-column-has-value-domain", F.count_if(domain))]
    one = columns.agg(*(x.alias(n) for n, x in whole))
    rows = [one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check_id"), F.col(n).cast("long").alias("n_found"), F.lit(len(own.columns)).cast("long").alias("n_expected")) for n, _ in whole))).alias("x")).select("x.*")]
    keys = [k for k, (role, *_) in ROLES.items() if role == "key" and k in own.columns]
    if keys:
        filled = own.agg(*(F.count(k).alias(k) for k in keys)).select(F.explode(F.array(*(F.struct(F.lit(k).alias("column"), F.col(k).alias("n_expected")) for k in keys))).alias("x")).select("x.*")
        found = identifier_families(own, tuple(keys)).groupBy("column").agg(F.sum("n").alias("n_found"))
        rows.append(filled.join(found, "column", "left").select(F.concat("column", F.lit("-family-accounting")).alias("check_id"), F.coalesce("n_found", F.lit(0)).alias("n_found"), "n_expected"))
    known = constraints(c)
    rows.append(df.sparkSession.createDataFrame([("every-constraint-has-severity", sum(s in ("hard", "review", "info") for s, _ in known.values()), len(known))], "check_id string, n_found long, n_expected long"))
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("n_found") == F.col("n_expected"))


def cleaning_plan(df: DataFrame) -> DataFrame:
    """(step, operation, columns, mandated_by) for the columns that the table has or will have."""
    made = {x for _, op, xs, _ in CLEANING_PLAN for x in xs if op == "derive_line_columns"}
    rows = [(i, op, [x for x in xs if x in df.columns or x in made], rules) for i, op, xs, rules in CLEANING_PLAN]
    return df.sparkSession.createDataFrame([(i, op, ",".join(xs), ",".join(rules)) for i, op, xs, rules in rows if xs], "step int, operation string, columns string, mandated_by string")


def infer(df: DataFrame, base: Contract | None = None) -> Contract:
    """The contract of a table: base, with patterns, ranges, block and window as the values show them. Of a column that has
    no value base's rule stays."""
    base = base or Contract()
    patterns = {r["column"]: r.pattern for r in identifier_patterns(df, ("InvoiceNo", "StockCode")).collect()}
    ranges = {(r["column"], r.tier): (r.low, r.high) for r in measure_ranges(df, base).collect() if r.low is not None}
    e = envelopes(df).head()
    fence = lambda m, tier, default: ranges.get((m, tier), default)
    return replace(
        base,
        invoice_re=patterns.get("InvoiceNo", base.invoice_re), stock_re=patterns.get("StockCode", base.stock_re),
        quantity_typical=fence("Quantity", "typical", base.quantity_typical), quantity_plausible=fence("Quantity", "plausible", base.quantity_plausible),
        price_typical=fence("UnitPrice", "typical", base.price_typical), price_plausible=fence("UnitPrice", "plausible", base.price_plausible),
        customer_block=base.customer_block if e.block_low is None else (e.block_low, e.block_high),
        window=base.window if e.window_low is None else (e.window_low, e.window_high),
    )


def schema(df: DataFrame, base: Contract | None = None) -> dict:
    """The report of a table's contract, all of it a few rows: columns, families, ranges, policies, plan, checks."""
    rows = lambda x: [r.asDict() for r in x.collect()]
    found = infer(df, base)
    own = [k for k in ("InvoiceNo", "StockCode", "CustomerID") if k in df.columns]
    proof = rows(checks(df, found))
    severities = [s for s, _ in constraints(found).values()]
    return {
        "columns": rows(column_contract(df)), "families": rows(identifier_families(df, tuple(own))), "patterns": {"InvoiceNo": found.invoice_re, "StockCode": found.stock_re},
        "measures": rows(measure_ranges(df, found)), "customer_block": list(found.customer_block), "window": list(found.window), "texts": rows(text_policy(df)), "categories": rows(categories(df, c=found)),
        "constraints": {k: s for k, (s, _) in constraints(found).items()}, "constraints_by_severity": {s: severities.count(s) for s in ("hard", "review", "info")},
        "cleaning_plan": rows(cleaning_plan(df)), "checks": proof, "all_passed": all(r["passed"] for r in proof),
    }


def from_schema(report: dict | None, base: Contract | None = None) -> Contract:
    """The contract that a saved report says; what it doesn't say is as in base."""
    base, report = base or Contract(), report or {}
    fences = {(r["column"], r["tier"]): (r["low"], r["high"]) for r in report.get("measures", [])}
    seen = sorted({r["value"] for r in report.get("categories", []) if r["basis"] != "seen"})
    return replace(
        base,
        invoice_re=report.get("patterns", {}).get("InvoiceNo", base.invoice_re), stock_re=report.get("patterns", {}).get("StockCode", base.stock_re),
        quantity_typical=fences.get(("Quantity", "typical"), base.quantity_typical), quantity_plausible=fences.get(("Quantity", "plausible"), base.quantity_plausible),
        price_typical=fences.get(("UnitPrice", "typical"), base.price_typical), price_plausible=fences.get(("UnitPrice", "plausible"), base.price_plausible),
        customer_block=tuple(report.get("customer_block", base.customer_block)), window=tuple(report.get("window", base.window)), countries=seen or base.countries,
    )
