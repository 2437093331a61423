"""Null-safe column expressions and the fixed values of the line-item contract."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical columns, header aliases, country aliases and reference countries.
CANONICAL = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
HEADER_ALIASES = {
    "invoice": "InvoiceNo", "invoiceno": "InvoiceNo", "invoice_no": "InvoiceNo", "invoicenumber": "InvoiceNo",
    "stockcode": "StockCode", "stock_code": "StockCode", "description": "Description",
    "quantity": "Quantity", "qty": "Quantity", "invoicedate": "InvoiceDate", "invoice_date": "InvoiceDate",
    "price": "UnitPrice", "unitprice": "UnitPrice", "unit_price": "UnitPrice",
    "customerid": "CustomerID", "customer_id": "CustomerID", "customer id": "CustomerID", "country": "Country",
}
COUNTRY_ALIASES = {
    "EIRE": "Ireland", "UK": "United Kingdom", "U.K.": "United Kingdom", "U K": "United Kingdom",
    "USA": "United States", "US": "United States", "U.S.A.": "United States", "RSA": "South Africa",
    "UAE": "United Arab Emirates", "U.E.": "United Arab Emirates",
}
COUNTRIES = [
    "Australia", "Austria", "Bahrain", "Belgium", "Channel Islands", "Cyprus", "Denmark", "Finland", "France", "Germany",
    "Greece", "Iceland", "Ireland", "Israel", "Italy", "Japan", "Lithuania", "Netherlands", "Nigeria", "Norway", "Poland",
    "Portugal", "Spain", "Sweden", "Switzerland", "United Arab Emirates", "United Kingdom", "United States",
]
# Patterns. (?U) gives Java's \s, \d and \w the Unicode classes.
PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"(?i)^(https?://|www\.)\S+$",
    "phone": r"^\+?[\d][\d\s().-]{6,}$",
    "int": r"^[+-]?\d+$",
    "float": r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$",
    "cancelled": r"(?i)^C\d+$",
    "invoice": r"^C?\d{5,7}$",
    "suffix": r"^\d{4,6}[A-Za-z]{1,2}$",
    "cprefix": r"^C\d{4,6}$",
    "service": r"^[A-Za-z][A-Za-z0-9 .'/&_()-]{0,30}$",
    "price": r"^\d+(\.\d{1,2})?$",
    "prefixed": r"(?i)^C\d+$",
}
INVOICE_RE = r"^(?:(?:\d{5,7})|(?:C\d{5,7}))$"
STOCK_RE = r"^(?:(?:\d{4,6})|(?:\d{4,6}[A-Za-z]{1,2})|(?:C\d{4,6})|(?:[A-Za-z][A-Za-z0-9 .'/&_()-]{0,30}))$"


@dataclass(frozen=True)
class Contract:
    """Thresholds of the line-item contract; every one may be set for other data."""

    invoice_re: str = INVOICE_RE
    stock_re: str = STOCK_RE
    quantity_bound: float = 10_000
    quantity_bulk: float = 1_000
    quantity_plausible: tuple[float, float] = (-20, 29)
    quantity_typical: tuple[float, float] = (-9.5, 18.5)
    price_cap: float = 20_000
    price_premium: float = 1_000
    price_typical: tuple[float, float] = (0, 9.75)
    price_plausible: tuple[float, float] = (0, 14.85)
    line_extreme: float = 10_000
    guest_high: float = 1_000
    rare_country: int = 5
    customer_re: str = r"^(?:(?:\d{4,6}))$"
    customer_block: tuple[int, int] = (12_000, 19_000)
    window: tuple[str, str] = ("2009-01-01 00:00:00", "2011-12-31 23:59:59")
    years: tuple[int, int] = (2009, 2010)
    countries: list[str] = field(default_factory=lambda: list(COUNTRIES))


#: The contract for the adapter over the driver's tables, whose dates lie elsewhere.
RETAIL_CONTRACT = Contract(window=("1995-01-01 00:00:00", "2001-06-30 23:59:59"), years=(1999, 2000))


def num(name: str) -> Column:
    """A number, or null for what isn't one (NaN too)."""
    x = F.expr(f"try_cast(`{name}` as double)")
    return F.when(~F.isnan(x), x)


# Layouts of dates that are read besides ISO ones; months come before days.
DATE_LAYOUTS = [
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "M/d/yy H:mm", "M/d/yy",
    "d-MMM-yyyy H:mm:ss", "d-MMM-yyyy H:mm", "d-MMM-yyyy", "d MMM yyyy H:mm", "d MMM yyyy", "MMM d, yyyy", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d",
]


def parsed_date(text: Column) -> Column:
    """A date and time out of text of any known layout, or null."""
    t = strip(text)
    return F.coalesce(F.try_to_timestamp(t), *(F.try_to_timestamp(t, F.lit(x)) for x in DATE_LAYOUTS)).cast("timestamp_ntz")


def parse_date(name: str) -> Column:
    """A column's dates; those stored as such aren't rendered and read again."""
    return F.coalesce(F.expr(f"try_cast(`{name}` as timestamp_ntz)"), parsed_date(F.col(name).cast("string")))


def yes(predicate: Column) -> Column:
    """Unknown counts as no."""
    return F.coalesce(predicate, F.lit(False))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space at the ends off, each run inside one space, upper case."""
    return F.upper(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def title(c: Column) -> Column:
    """A letter is upper case where no letter stands before it, and lower case elsewhere."""
    cut = F.split(F.lower(c), r"(?<![\p{L}])(?=[\p{L}])")
    return F.array_join(F.transform(cut, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")


def country(c: Column) -> Column:
    """Stripped, in title case, aliases resolved."""
    aliases = F.create_map(*(F.lit(x) for kv in COUNTRY_ALIASES.items() for x in kv))
    return F.coalesce(aliases[F.upper(strip(c))], title(strip(c)))


def changed(old: Column, new: Column) -> Column:
    return old.isNotNull() & ~old.eqNullSafe(new)


def any_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def integral(c: Column) -> Column:
    """Numbers without a fraction as integers' text, other numbers as they are."""
    return F.when(c % 1 == 0, c.cast("long").cast("string")).otherwise(c.cast("string"))


def adjusted_skew(name: str) -> Column:
    n = F.count(name).cast("double")
    return F.when(F.stddev_pop(name) == 0, F.lit(0.0)).when(n >= 3, F.skewness(name) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def adjusted_kurtosis(name: str) -> Column:
    n = F.count(name).cast("double")
    return F.when(F.stddev_pop(name) == 0, F.lit(0.0)).when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(name) + 6))


def correlation(a: str, b: str) -> Column:
    """Pearson's over rows that have both; 0 if either is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))
