"""What the schema contract says about rows: value families, tiers, keys, validity and constraint counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import COUNTRY_ALIASES, Contract, integral, num, parse_date, squeeze, strip, title, yes
from .features import valid

#: Longest description, and most countries.
LONGEST, MOST_COUNTRIES = 128, 40


def family(c: Column) -> Column:
    t = strip(c)
    return F.when(t.rlike(r"^\d+$"), "numeric").when(t.rlike(r"^\d+[A-Za-z]{1,2}$"), "suffixed").when(t.rlike(r"(?i)^C\d+$"), "prefixed").otherwise("service")


def value_families(df: DataFrame, columns: tuple[str, ...] = ("InvoiceNo", "StockCode")) -> DataFrame:
    """(column, family, n, pct): the families' rows add up to the non-null ones."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns))
    each = df.select(F.explode(pairs).alias("x")).select("x.*").filter("v is not null")
    n = each.groupBy("column").agg(F.count(F.lit(1)).alias("all"))
    by = each.groupBy("column", family(F.col("v")).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return by.join(n, "column").select("column", "family", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("pct"))


def tier(x: Column, typical: tuple[float, float], plausible: tuple[float, float], hard: tuple[float, float]) -> Column:
    inside = F.when(x.between(*typical), "typical").when(x.between(*plausible), "plausible").otherwise("atypical")
    return F.when(x.isNull(), "missing").when(~x.between(*hard), "invalid").otherwise(inside)


def measure_tiers(df: DataFrame, c: Contract | None = None) -> DataFrame:
    c = c or Contract()
    q = tier(num("Quantity"), c.quantity_typical, c.quantity_plausible, (-c.quantity_bound, c.quantity_bound))
    p = tier(num("UnitPrice"), c.price_typical, c.price_plausible, (0, c.price_cap))
    pairs = F.array(*(F.struct(F.lit(k).alias("column"), x.alias("tier")) for k, x in (("Quantity", q), ("UnitPrice", p))))
    return df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("column", "tier").agg(F.count(F.lit(1)).alias("n"))


def key_candidates(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """(candidate, n_distinct, is_key) by grouping, one candidate at a time."""
    out = None
    for name, cols in keys.items():
        sizes = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("m"))
        one = sizes.agg(F.lit(name).alias("candidate"), F.count(F.lit(1)).alias("n_distinct"), (F.coalesce(F.max("m"), F.lit(1)) == 1).alias("is_key"))
        out = one if out is None else out.unionByName(one)
    return out


def row_validity(df: DataFrame) -> DataFrame:
    q, p = num("Quantity"), num("UnitPrice")
    preds = {"giveaway": yes(p == 0), "return": yes(q < 0), "cancellation": yes(F.col("InvoiceNo").startswith("C")), "guest": F.col("CustomerID").isNull(), "no_description": F.col("Description").isNull()}
    one = df.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(c).alias(n) for n, c in preds.items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).alias("n")) for n in preds)))
    return one.select("all", each.alias("x")).select("x.*", F.round(F.coalesce(F.try_divide(100.0 * F.col("x.n"), F.col("all")), F.lit(0.0)), 4).alias("pct"))


def _is_text(c: str) -> Column:
    return F.expr(f"typeof(`{c}`) <> 'string' and `{c}` is not null")


def constraints(c: Contract) -> dict[str, tuple[str, Column | None]]:
    """(severity, violated) by name. Where no column says, the rule is about the whole table, or about uses that no row
    shows (whether an id is averaged, or shared)."""
    q, p, cid, d = num("Quantity"), num("UnitPrice"), num("CustomerID"), parse_date("InvoiceDate")
    invoice, stock, t, land = (F.col(x) for x in ("InvoiceNo", "StockCode", "Description", "Country"))
    window = [F.lit(x).cast("timestamp_ntz") for x in c.window]
    zone = F.col("InvoiceDate").cast("string").rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}(:?\d{2})?)$")
    return {
        "InvoiceNo.type": ("hard", yes(_is_text("InvoiceNo"))),
        "InvoiceNo.pattern": ("hard", F.coalesce(~invoice.rlike(c.invoice_re), F.lit(True))),
        "InvoiceNo.case": ("review", yes(invoice != F.upper(invoice))),
        "StockCode.type": ("hard", yes(_is_text("StockCode"))),
        "StockCode.pattern": ("hard", F.coalesce(~stock.rlike(c.stock_re), F.lit(True))),
        "StockCode.case": ("review", yes(stock != F.upper(stock))),
        "StockCode.trim": ("review", yes(stock != strip(stock))),
        "CustomerID.type": ("hard", F.col("CustomerID").isNotNull() & cid.isNull()),
        "CustomerID.pattern": ("hard", yes(~integral(cid).rlike(c.customer_re))),
        "CustomerID.integer": ("hard", yes(cid % 1 != 0)),
        "CustomerID.block": ("hard", yes(~cid.between(*c.customer_block))),
        "CustomerID.not_a_measure": ("info", None),
        "CustomerID.pii": ("review", None),
        "Quantity.dtype": ("hard", q.isNull()),
        "Quantity.bounds": ("hard", yes(~q.between(-c.quantity_bound, c.quantity_bound))),
        "Quantity.integer": ("hard", yes(q % 1 != 0)),
        "Quantity.no_zero": ("hard", yes(q == 0)),
        "Quantity.sign": ("info", yes(q < 0)),
        "Quantity.bulk": ("review", yes(F.abs(q) > c.quantity_bulk)),
        "UnitPrice.dtype": ("hard", p.isNull()),
        "UnitPrice.bounds": ("hard", yes(p > c.price_cap)),
        "UnitPrice.non_negative": ("hard", yes(p < 0)),
        "UnitPrice.zero": ("review", yes(p == 0)),
        "UnitPrice.currency": ("hard", yes(F.bround(p, 2) != p)),
        "UnitPrice.extreme": ("review", yes(p > c.price_premium)),
        "InvoiceDate.format": ("hard", F.col("InvoiceDate").isNotNull() & d.isNull()),
        "InvoiceDate.resolution": ("hard", yes(F.date_format(d, "SSSSSS") != "000000")),
        "InvoiceDate.tz": ("hard", yes(zone)),
        "InvoiceDate.window": ("hard", yes(~d.between(*window))),
        "InvoiceDate.no_future": ("hard", yes(d > F.localtimestamp())),
        "InvoiceDate.null": ("hard", F.col("InvoiceDate").isNull()),
        "Description.type": ("hard", yes(_is_text("Description"))),
        "Description.trim": ("review", yes(t != strip(t))),
        "Description.spacing": ("review", yes(t.rlike(r"\s{2,}"))),
        "Description.case": ("review", yes(t != F.upper(t))),
        "Description.nonempty": ("hard", yes(strip(t) == "")),
        "Description.length": ("review", yes(F.length(t) > LONGEST)),
        "Description.null": ("review", t.isNull()),
        "Description.per_stockcode": ("review", None),
        "Country.type": ("hard", yes(_is_text("Country"))),
        "Country.trim": ("review", yes(land != strip(land))),
        "Country.case": ("review", yes(strip(land) != title(strip(land)))),
        "Country.pattern": ("hard", yes(~land.rlike(r"^[A-Z][A-Za-z .'\-]{1,29}$"))),
        "Country.alias": ("review", yes(F.upper(strip(land)).isin(list(COUNTRY_ALIASES)))),
        "Country.cardinality": ("hard", None),
        "Country.null": ("hard", land.isNull()),
        "Country.pii": ("info", None),
    }


def constraint_violations(df: DataFrame, c: Contract | None = None) -> DataFrame:
    """(constraint, severity, n_violations): rows that violate each; codes of more than one description after cleaning;
    countries beyond the most; null for rules about uses."""
    found = constraints(c or Contract())
    judged = {n: x for n, (_, x) in found.items() if x is not None}
    names = {n: n.replace(".", "|") for n in judged}
    one = df.agg(*(F.count_if(x).alias(names[n]) for n, x in judged.items()))
    record = lambda n, x: F.struct(F.lit(n).alias("constraint"), F.lit(found[n][0]).alias("severity"), x.cast("long").alias("n_violations"))
    rows = one.select(F.explode(F.array(*(record(n, F.col(names[n])) for n in judged))).alias("x")).select("x.*")
    spelled = df.filter("StockCode is not null and Description is not null").groupBy(squeeze(F.col("StockCode")).alias("code"), squeeze(F.col("Description")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    codes = spelled.groupBy("code").agg(F.count(F.lit(1)).alias("m")).agg(F.count_if(F.col("m") > 1).alias("n")).select(record("Description.per_stockcode", F.col("n")).alias("x"))
    lands = df.filter("Country is not null").groupBy("Country").agg(F.count(F.lit(1)).alias("m")).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - MOST_COUNTRIES).alias("n")).select(record("Country.cardinality", F.col("n")).alias("x"))
    uses = [(n, found[n][0], None) for n in ("CustomerID.not_a_measure", "CustomerID.pii", "Country.pii")]
    said = df.sparkSession.createDataFrame(uses, "constraint string, severity string, n_violations long")
    return rows.unionByName(codes.select("x.*")).unionByName(lands.select("x.*")).unionByName(said)


def validity_mask(df: DataFrame, c: Contract | None = None) -> DataFrame:
    return df.select("row_id", valid(c or Contract()).alias("is_valid"))


def infer(profile: dict) -> dict:
    """Typical and plausible ranges and the date window out of a numeric and temporal profile
    ({column: {q1, q3, low, high}} and {column: {min, max}}); ``inference`` derives them from a table."""
    out = {}
    for c, x in profile.items():
        if "q1" in x:
            iqr = x["q3"] - x["q1"]
            clip = lambda lo, hi, x=x: (max(lo, x.get("low", lo)), min(hi, x.get("high", hi)))
            out[c] = {"typical": clip(x["q1"] - 1.5 * iqr, x["q3"] + 1.5 * iqr), "plausible": clip(x["q1"] - 3 * iqr, x["q3"] + 3 * iqr)}
        else:
            out[c] = {"window": (f"{str(x['min'])[:4]}-01-01 00:00:00", f"{str(x['max'])[:4]}-12-31 23:59:59")}
    return out
