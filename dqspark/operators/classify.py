"""Content-based column classification and TF-IDF terms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import COUNTRIES, PATTERNS, integral, num, parsed_date, strip
from .profile import MONTHS, render

# The meaning of the canonical columns, and the classes in the order in which ties are decided.
EXPECTED = {
    "InvoiceNo": "invoice_id", "StockCode": "product_id", "Description": "product_description", "Quantity": "quantity",
    "InvoiceDate": "transaction_datetime", "UnitPrice": "unit_price", "CustomerID": "customer_id", "Country": "country",
}
# Cues of a header by class. Parts that it contains, ends with or equals, and parts that forbid the cue.
CUES = {
    "invoice_id": {"has": ["invoice"], "not": ["date"]},
    "product_id": {"has": ["stockcode", "sku"], "ends": ["code"]},
    "product_description": {"has": ["descript", "productname"], "is": ["name"]},
    "quantity": {"has": ["quantity"], "is": ["qty"]},
    "transaction_datetime": {"has": ["date", "time"]},
    "unit_price": {"has": ["price", "amount", "cost"]},
    "customer_id": {"has": ["customer", "cust"]},
    "country": {"has": ["country", "nation"]},
    "email": {"has": ["email"]},
    "phone": {"has": ["phone", "tel", "mobile"]},
    "url": {"has": ["url", "website", "link"]},
}
# Header parts of calendar fields, which claim no meaning.
CALENDAR = ["year", "month", "day", "hour", "minute", "second", "week", "quarter", "weekday"]
# Weights of signals by class; "cue" is the header's.
WEIGHTS = {
    "invoice_id": {"invoice_rate": 2.0, "cancelled_rate": 0.5, "cue": 1.0},
    "product_id": {"short_sku_rate": 2.0, "suffix_rate": 0.5, "cue": 1.0},
    "product_description": {"much_vocabulary": 0.6, "many_tokens": 0.8, "alpha_ratio": 0.6, "cue": 1.0},
    "quantity": {"int_rate": 1.5, "has_negative": 0.5, "no_decimals": 0.5, "cue": 1.0},
    "transaction_datetime": {"datetime_rate": 2.0, "cue": 1.0},
    "unit_price": {"price_rate": 1.5, "has_decimals": 0.8, "cue": 1.0},
    "customer_id": {"block_rate": 2.0, "null_rate": 0.5, "int_rate": 0.5, "cue": 1.0},
    "country": {"country_rate": 2.5, "few_values": 0.5, "cue": 1.0},
    "email": {"email_rate": 2.0, "cue": 1.0},
    "phone": {"phone_rate": 2.0, "cue": 1.0},
    "url": {"url_rate": 2.0, "cue": 1.0},
    "boolean_flag": {"bool_rate": 2.5},
    "category": {"few_values": 0.5},
    "text": {"alpha_ratio": 0.3, "many_tokens": 0.2},
}
CLASSES = list(WEIGHTS)
# Words for yes and no, spellings of countries besides their names, the block of customers' ids.
BOOLEANS = ["true", "false", "0", "1", "yes", "no", "y", "n", "t", "f"]
SPELLINGS = ["eire", "usa", "uk", "u.k."]
BLOCK = (12_000, 19_000)
UNCERTAIN = 0.3


def plain_header(column: str) -> str:
    return re.sub(r"[\s_-]+", "", column.lower())


def header_cues(column: str) -> dict[str, int]:
    """0 or 1 by class."""
    name = plain_header(column)

    def cue(c: dict[str, list[str]]) -> bool:
        found = any(p in name for p in c.get("has", [])) or any(name.endswith(p) for p in c.get("ends", [])) or name in c.get("is", [])
        return found and not any(p in name for p in c.get("not", []))

    return {k: int(cue(c)) for k, c in CUES.items()}


def expected(column: str) -> str | None:
    """What a header claims; calendar fields and headers without a cue claim nothing."""
    if column in EXPECTED:
        return EXPECTED[column]
    if any(p in plain_header(column) for p in CALENDAR):
        return None
    return next((k for k, on in header_cues(column).items() if on), None)


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, t, m): distinct values as stripped text (null for gaps), and how many rows have each."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), render(df, c).alias("v")) for c in columns))
    return df.select(F.explode(pairs).alias("x")).select("x.column", strip(F.col("x.v")).alias("t")).groupBy("column", "t").agg(F.count(F.lit(1)).alias("m"))


def signals(df: DataFrame, columns: list[str] | None = None, n: int | None = None, key: str = "row_id") -> DataFrame:
    """Rates of a column's values by content: all of them, or those of the n rows first by key."""
    columns = columns or [c for c in df.columns if c != key]
    own = df.orderBy(key).limit(n) if n else df
    each = _values(own, columns)
    # each distinct value is judged once and weighs as many rows as have it; whole numbers are judged as such
    t, m = F.col("t"), F.col("m")
    x = num("t")
    canon = F.when(t.rlike(PATTERNS["float"]) & (x % 1 == 0) & (F.abs(x) < 1e15), integral(x)).otherwise(t)
    letters, digits = F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, r"[^\p{Nd}]", ""))
    filled = F.sum(F.when(t.isNotNull(), m)).cast("double")
    share = lambda c: F.coalesce(F.try_divide(F.sum(F.when(c, m)).cast("double"), filled), F.lit(0.0))
    rate = lambda c: F.round(share(c), 4)
    ratio = lambda c: F.round(F.coalesce(F.try_divide(F.sum(c * m).cast("double"), F.sum(F.length(t) * m).cast("double")), F.lit(0.0)), 4)
    whole, service = canon.rlike(PATTERNS["int"]), t.rlike(PATTERNS["service"]) & ~t.rlike(PATTERNS["int"])
    dateish = t.rlike("[/:]") | t.rlike(r"\d{4}-\d{1,2}-\d{1,2}") | t.rlike(MONTHS)
    cancelled = canon.rlike(PATTERNS["cprefix"]) | F.upper(canon).startswith("C") & canon.rlike(PATTERNS["invoice"])
    sku = whole & F.length(F.regexp_replace(canon, "^[+-]", "")).between(4, 6) | canon.rlike(PATTERNS["suffix"]) | canon.rlike(PATTERNS["cprefix"]) | service
    out = each.groupBy("column").agg(
        F.sum(m).alias("n"), F.round(F.sum(F.when(t.isNull(), m).otherwise(0)) / F.sum(m), 4).alias("null_rate"),
        F.count("t").alias("n_unique"), F.round(F.count("t") / F.sum(m), 6).alias("cardinality"),
        F.round(F.coalesce(F.try_divide(F.sum(F.size(F.regexp_extract_all(F.lower(t), F.lit(r"((?U)\w+)"), 1)) * m).cast("double"), filled), F.lit(0.0)), 3).alias("avg_tokens"),
        ratio(letters).alias("alpha_ratio"), ratio(digits).alias("digit_ratio"),
        rate(t.rlike(PATTERNS["float"])).alias("numeric_rate"), F.coalesce(F.max((x < 0).cast("int")), F.lit(0)).alias("has_negative"), F.coalesce(F.max((x % 1 != 0).cast("int")), F.lit(0)).alias("has_decimals"),
        F.round(F.coalesce(F.percentile(F.abs(x), F.lit(0.5), m), F.lit(0.0)), 4).alias("median_abs"),
        F.when(share(dateish) >= 0.5, rate(parsed_date(t).isNotNull())).otherwise(F.lit(0.0)).alias("datetime_rate"),
        rate(t.rlike(PATTERNS["email"])).alias("email_rate"), rate(t.rlike(PATTERNS["url"])).alias("url_rate"), rate(canon.rlike(PATTERNS["phone"])).alias("phone_rate"), rate(F.lower(t).isin(BOOLEANS)).alias("bool_rate"),
        rate(canon.rlike(PATTERNS["invoice"])).alias("invoice_rate"), rate(service).alias("service_rate"), rate(canon.rlike(PATTERNS["suffix"])).alias("suffix_rate"), rate(cancelled).alias("cancelled_rate"), rate(t.rlike(PATTERNS["price"])).alias("price_rate"),
        rate(F.lower(t).isin([c.lower() for c in COUNTRIES] + SPELLINGS)).alias("country_rate"), rate(whole & x.between(*BLOCK)).alias("block_rate"), rate(whole).alias("int_rate"), rate(sku).alias("sku_rate"),
    )
    words = each.select("column", F.explode(F.regexp_extract_all(F.lower(t), F.lit(r"((?U)\w+)"), 1)).alias("w")).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("vocab_size"))
    return out.join(words, "column", "left").fillna(0, ["vocab_size"])


def scores(sig: DataFrame, columns: list[str]) -> DataFrame:
    """(column, i, semantic, score): weighted sums of signals and the header's cue, a row for each class."""
    c = F.col
    cues = {k: [x for x in columns if header_cues(x)[k]] for k in CUES}
    short = F.when(c("avg_tokens") <= 2, 1.0).otherwise(F.greatest(F.lit(0.2), 2 / F.greatest(c("avg_tokens"), F.lit(1e-9))))
    made = {
        "short_sku_rate": c("sku_rate") * short, "much_vocabulary": F.least(c("vocab_size") / 1000.0, F.lit(1.0)), "many_tokens": F.least(c("avg_tokens") / 3, F.lit(1.0)),
        "no_decimals": 1 - c("has_decimals"), "few_values": 1 - F.least(20 * c("cardinality"), F.lit(1.0)),
    }

    def score(k: str) -> Column:
        # a column without a value has none of the signals
        parts = [F.lit(w) * (c("column").isin(cues[k]).cast("int") if s == "cue" else made.get(s, c(s) if s not in made else None)) for s, w in WEIGHTS[k].items()]
        return F.round(sum(parts[1:], parts[0]).cast("double"), 4)

    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("semantic"), score(k).alias("score")) for i, k in enumerate(CLASSES))))
    return sig.select("column", each.alias("x")).select("column", "x.*")


def classify(df: DataFrame, columns: list[str] | None = None, n: int | None = None) -> DataFrame:
    """(column, semantic, score, confidence, status): the best class, the earlier of equal ones; below 0.3 uncertain."""
    columns = columns or [c for c in df.columns if c != "row_id"]
    s = scores(signals(df, columns, n), columns)
    ranked = s.withColumn("r", F.row_number().over(W.partitionBy("column").orderBy(F.desc("score"), "i"))).filter("r <= 2")
    best = ranked.groupBy("column").agg(F.max(F.when(F.col("r") == 1, F.col("semantic"))).alias("semantic"), F.max("score").alias("score"), F.min("score").alias("second"))
    maps = {c: e for c in columns if (e := expected(c))}
    want = F.create_map(*(F.lit(x) for kv in maps.items() for x in kv))[F.col("column")] if maps else F.lit(None).cast("string")
    sure = F.col("score") >= UNCERTAIN
    confidence = F.when(sure, F.round(F.coalesce(F.try_divide(F.col("score") - F.col("second"), F.col("score")), F.lit(0.0)), 3)).otherwise(F.lit(0.0))
    semantic = F.when(sure, F.col("semantic")).otherwise("uncertain")
    status = F.when(want.isNull(), "unmapped").when(want == semantic, "match").otherwise("mismatch")
    return best.select("column", semantic.alias("semantic"), F.round("score", 4).alias("score"), confidence.alias("confidence"), status.alias("status"))


def classification_counts(classified: DataFrame) -> DataFrame:
    """One row: columns, those whose header claims a meaning, and how many of these match or not."""
    on = lambda s: F.count_if(F.col("status") == s)
    return classified.agg(F.count(F.lit(1)).alias("n_columns"), F.count_if(F.col("status") != "unmapped").alias("n_checked"), on("match").alias("n_match"), on("mismatch").alias("n_mismatch"))


def term_counts(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, term, tf) of words of two characters or more."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]{2,})"), 1)
    return df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_terms(df: DataFrame, text: str, key: str, k: int = 5) -> DataFrame:
    """(term, df, mean_tfidf): the k terms of the largest mean, smoothed idf, each text scaled to length one."""
    tf = term_counts(df, text, key)
    n = df.count()
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)
    x = tf.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    means = x.join(norm, key).groupBy("term").agg(F.max("df").alias("df"), (F.sum(F.col("x") / F.col("norm")) / n).alias("m"))
    return means.orderBy(F.desc(F.round("m", 9)), "term").limit(k).select("term", "df", F.round("m", 6).alias("mean_tfidf"))


def vocabulary(df: DataFrame, text: str, key: str) -> DataFrame:
    return term_counts(df, text, key).groupBy("term").agg(F.sum("tf").alias("n")).agg(F.count(F.lit(1)).alias("vocab_size"), F.sum("n").alias("n_tokens"))
