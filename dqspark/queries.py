"""Every operator of the engine as a query over the driver's tables, beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import CANONICAL, COUNTRIES, COUNTRY_ALIASES, INVOICE_RE, PATTERNS, STOCK_RE, country, integral
from .functions.expr import RETAIL_CONTRACT as C
from .operators import anomaly, classify, cleaning, contract, drift, features, profile, rules
from .sources.tables import RETAIL_SQL, alias_headers, retail, table, union_limit

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}
MEASURES = ["Quantity", "UnitPrice"]


def query(name: str, sql: str | None = None, on: str = "") -> Callable[[Callable[[DataFrame], DataFrame]], None]:
    """Register f(retail rows), or f(rows of the named table), and its SQL (over ``retail``, or over the tables)."""

    def add(f: Callable[[DataFrame], DataFrame]) -> None:
        Q[name] = lambda s, d: f(table(s, d, on) if on else retail(s, d))
        if sql:
            SQL[name] = sql if on else f"WITH retail AS ({RETAIL_SQL}) {sql}"

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def squeezed(c: str) -> str:
    return f"upper(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


def resolved(c: str) -> str:
    aliases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRY_ALIASES.items())
    return f"CASE upper(trim({c})) {aliases} ELSE array_to_string(list_transform(string_split(lower(trim({c})), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END"


NORMAL = f", normal AS (SELECT row_id, InvoiceNo, {squeezed('StockCode')} AS StockCode, {squeezed('Description')} AS Description, Quantity, InvoiceDate, UnitPrice, CustomerID, {resolved('Country')} AS Country FROM retail)"
LOOKUP = ", lookup AS (SELECT StockCode, Description AS d FROM (SELECT StockCode, Description, row_number() OVER (PARTITION BY StockCode ORDER BY count(*) DESC, Description) AS r FROM normal WHERE Description IS NOT NULL AND StockCode IS NOT NULL GROUP BY 1, 2) WHERE r = 1), top AS (SELECT Description AS d FROM normal WHERE Description IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
FILLED = LOOKUP + ", filled AS (SELECT n.row_id, n.InvoiceNo, n.StockCode, coalesce(n.Description, l.d, (SELECT d FROM top)) AS Description, CASE WHEN n.Description IS NOT NULL THEN 'kept' WHEN l.d IS NOT NULL THEN 'lookup' ELSE 'mode' END AS description_source, n.Quantity, n.InvoiceDate, n.UnitPrice, n.CustomerID, n.Country FROM normal n LEFT JOIN lookup l ON n.StockCode = l.StockCode)"
KEYS = ", ".join(CANONICAL)
FIRSTS = f", firsts AS (SELECT {KEYS}, min(row_id) AS row_id FROM filled GROUP BY ALL)"
PRED = {
    "unitprice_negative": "UnitPrice < 0", "unitprice_above_cap": "UnitPrice > 20000", "quantity_zero": "Quantity = 0", "quantity_out_of_bounds": "NOT Quantity BETWEEN -10000 AND 10000", "quantity_bulk": "abs(Quantity) > 1000",
    "quantity_atypical": "NOT Quantity BETWEEN -20 AND 29", "unitprice_premium": "UnitPrice > 1000", "linevalue_extreme": "abs(round(Quantity * UnitPrice, 2)) > 10000", "unitprice_giveaway": "UnitPrice = 0",
    "country_unknown": f"Country NOT IN ({quoted(COUNTRIES)})", "country_rare": "Country IS NOT NULL AND count(*) OVER (PARTITION BY Country) <= 5", "customerid_out_of_block": "NOT CustomerID BETWEEN 12000 AND 19000",
    "invoiceno_format": f"InvoiceNo IS NULL OR NOT regexp_matches(InvoiceNo, '{INVOICE_RE}')", "stockcode_format": "StockCode IS NULL OR NOT regexp_matches(StockCode, '" + STOCK_RE.replace("'", "''") + "')", "description_missing_or_blank": "Description IS NULL OR trim(Description) = ''",
    "invoicedate_out_of_window": "InvoiceDate IS NULL OR NOT InvoiceDate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '2001-06-30 23:59:59'", "return_without_cancellation": "Quantity < 0 AND NOT starts_with(InvoiceNo, 'C')", "cancellation_without_return": "starts_with(InvoiceNo, 'C') AND NOT coalesce(Quantity < 0, false)",
    "duplicate_line_key": "count(*) OVER (PARTITION BY InvoiceNo, StockCode, InvoiceDate) > 1", "guest_high_value": "CustomerID IS NULL AND abs(round(Quantity * UnitPrice, 2)) > 1000",
}
FLAGGED = ", flagged AS (SELECT row_id, " + ", ".join(f"coalesce({p}, false) AS {n}" for n, p in PRED.items()) + " FROM retail), catalogue(rule_id, category, severity) AS (VALUES " + ", ".join(f"('{r.rule_id}', '{r.category}', '{r.severity}')" for r in rules.RULES) + "), hits AS (UNPIVOT (SELECT row_id, " + ", ".join(f"CASE WHEN {n} THEN 1 END AS {n}" for n in PRED) + " FROM flagged) ON * EXCLUDE row_id INTO NAME rule_id VALUE v)"
RULES = FLAGGED + ", counted AS (SELECT c.*, count(h.row_id) AS n_violations FROM catalogue c LEFT JOIN hits h ON c.rule_id = h.rule_id GROUP BY ALL)"
ANY = {s: " OR ".join(r.rule_id for r in rules.RULES if r.severity == s) for s in ("hard", "review", "info")}
SEVERITY = FLAGGED + ", sev AS (SELECT count(*) AS n_rows, " + ", ".join(f"count(*) FILTER (WHERE {p}) AS n_{s}" for s, p in ANY.items()) + ", count(*) FILTER (WHERE " + " OR ".join(PRED) + ") AS n_flagged FROM flagged)"
RENDER = {c: c for c in ("InvoiceNo", "StockCode", "Description", "Country")} | {"Quantity": "CASE WHEN Quantity % 1 = 0 THEN CAST(CAST(Quantity AS BIGINT) AS VARCHAR) ELSE CAST(Quantity AS VARCHAR) END", "UnitPrice": "CASE WHEN UnitPrice % 1 = 0 THEN CAST(CAST(UnitPrice AS BIGINT) AS VARCHAR) ELSE CAST(UnitPrice AS VARCHAR) END", "InvoiceDate": "strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S')", "CustomerID": "CAST(CustomerID AS VARCHAR)"}
TALL = ", tall AS (" + " UNION ALL ".join(f'SELECT \'{c}\' AS "column", {RENDER[c]} AS value FROM retail' for c in CANONICAL) + '), uniq AS (SELECT "column", value, count(*) AS n FROM tall WHERE value IS NOT NULL GROUP BY 1, 2)'
A = {k: v.replace("'", "''") for k, v in PATTERNS.items()}
SHAPES = TALL + f""", shapes AS (SELECT t."column", count(value) AS n, count(*) FILTER (WHERE regexp_matches(trim(value), '{A["int"]}')) AS n_int, count(*) FILTER (WHERE regexp_matches(trim(value), '{A["float"]}')) AS n_float,
 count(*) FILTER (WHERE regexp_matches(value, '[-/:]') OR regexp_matches(value, '(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)')) AS n_dateish, count(*) FILTER (WHERE regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}} ')) AS n_date,
 count(*) FILTER (WHERE lower(trim(value)) IN ('true', 'false', '0', '1')) AS n_bool, count(*) FILTER (WHERE regexp_matches(trim(value), '^\\d+[A-Za-z]+$')) AS n_suffix, count(*) FILTER (WHERE regexp_matches(trim(value), '(?i)^C\\d+$')) AS n_cancelled, count(*) FILTER (WHERE trim(value) = '') AS n_blank,
 (SELECT count(*) FROM uniq u WHERE u."column" = t."column") AS n_unique FROM tall t GROUP BY 1),
 typed AS (SELECT *, CASE WHEN n = 0 THEN 'string' WHEN n_bool = n AND n_unique <= 2 THEN 'boolean' WHEN n_dateish >= 0.5 * n AND n_date >= 0.9 * n THEN 'date' WHEN n_int = n THEN 'int' WHEN n_float = n THEN 'float' ELSE 'string' END AS dtype FROM shapes)"""
MISSING = ", m AS (SELECT " + " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in CANONICAL) + " AS m FROM retail)"
VALID = f"coalesce(regexp_matches(InvoiceNo, '{INVOICE_RE}') AND regexp_matches(StockCode, '" + STOCK_RE.replace("'", "''") + f"') AND Quantity % 1 = 0 AND Quantity <> 0 AND Quantity BETWEEN -10000 AND 10000 AND UnitPrice BETWEEN 0 AND 20000 AND round_even(UnitPrice, 2) = UnitPrice AND InvoiceDate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-06-30 23:59:59' AND (CustomerID IS NULL OR CustomerID BETWEEN 12000 AND 19000) AND {resolved('Country')} IN ({quoted(COUNTRIES)}) AND (Description IS NULL OR trim(Description) <> ''), false)"
YEARS = ", y AS (SELECT *, round(Quantity * UnitPrice, 2) AS LineValue, year(InvoiceDate) AS yr FROM retail)"
REL = "CASE WHEN value_a = 0 THEN CASE WHEN value_b = 0 THEN NULL ELSE CAST('inf' AS DOUBLE) END ELSE (value_b - value_a) / abs(value_a) END"
BANDED = f"round(value_a, 4) AS value_a, round(value_b, 4) AS value_b, round({REL}, 4) AS rel_change, CASE WHEN ({REL}) IS NULL THEN 'n/a' WHEN abs({REL}) >= 0.25 THEN 'alert' WHEN abs({REL}) >= 0.1 THEN 'watch' ELSE 'none' END AS band"
DRIFT_M = YEARS + ", dm AS (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, '{s}' AS statistic, {f}({m}) FILTER (WHERE yr = 1999) AS value_a, {f}({m}) FILTER (WHERE yr = 2000) AS value_b FROM y" for m in drift.MEASURES for s, f in (("median", "median"), ("mean", "avg"), ("std", "stddev_samp"))) + f"), measures AS (SELECT measure, statistic, {BANDED} FROM dm)"
SHARE = {"return": "Quantity < 0", "giveaway": "UnitPrice = 0", "guest": "CustomerID IS NULL", "cancellation": "starts_with(InvoiceNo, 'C')", "uk": "Country = 'United Kingdom'"}
DRIFT_S = ", ds AS (" + " UNION ALL ".join([f"SELECT '{n}' AS metric, coalesce(avg(CASE WHEN {p} THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE yr = 1999), 0) AS value_a, coalesce(avg(CASE WHEN {p} THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE yr = 2000), 0) AS value_b FROM y" for n, p in SHARE.items()] + ["SELECT 'rows', CAST(count(*) FILTER (WHERE yr = 1999) AS DOUBLE), CAST(count(*) FILTER (WHERE yr = 2000) AS DOUBLE) FROM y"]) + f"), shares AS (SELECT metric, {BANDED} FROM ds)"

# --- rules
query("rule_counts", RULES + " SELECT *, round(100.0 * n_violations / (SELECT count(*) FROM retail), 4)::DOUBLE AS violation_pct FROM counted")(lambda r: rules.counts(r, C))
query("rule_violations_long", FLAGGED + " SELECT row_id, rule_id, category, severity FROM hits JOIN catalogue USING (rule_id)")(lambda r: rules.violations(r, C))
query("rule_examples", FLAGGED + " SELECT * FROM (SELECT row_id, rule_id, category, severity, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY row_id) AS INT) AS rank FROM hits JOIN catalogue USING (rule_id)) WHERE rank <= 3")(lambda r: rules.examples(r, 3, C))
query("rule_by_severity", RULES + " SELECT severity, CAST(sum(n_violations) AS BIGINT) AS n_violations, count(*) AS n_rules FROM counted GROUP BY 1")(lambda r: rules.counts(r, C).groupBy("severity").agg(F.sum("n_violations").alias("n_violations"), F.count(F.lit(1)).alias("n_rules")))
query("rule_rollup", RULES + " SELECT category, severity, CAST(sum(n_violations) AS BIGINT) AS n_violations, count(*) AS n_rules FROM counted GROUP BY GROUPING SETS ((category), (severity), ())")(lambda r: rules.rollup(r, C))
query("rule_findings", RULES + " SELECT rule_id, CASE severity WHEN 'hard' THEN 'impossible' ELSE 'suspicious' END AS error_type, CASE severity WHEN 'hard' THEN 'critical' WHEN 'review' THEN 'high' ELSE 'medium' END AS level, n_violations FROM counted WHERE n_violations > 0")(lambda r: rules.findings(r, C))
query("severity_rows", SEVERITY + " SELECT * FROM sev")(lambda r: rules.rows_by_severity(r, C))
query("row_snapshot", "SELECT row_id, CAST(json_object('InvoiceNo', InvoiceNo, 'StockCode', StockCode, 'Description', Description, 'Quantity', Quantity, 'InvoiceDate', strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S'), 'UnitPrice', UnitPrice, 'CustomerID', CustomerID, 'Country', Country) AS VARCHAR) AS snapshot FROM retail")(lambda r: r.select("row_id", rules.snapshot().alias("snapshot")))

# --- projections
query("normalize_text", NORMAL + " SELECT row_id, StockCode, Description, Country FROM normal")(lambda r: cleaning.normalise(r).select("row_id", "StockCode", "Description", "Country"))
query("country_alias", f"SELECT DISTINCT Country AS raw, {resolved('Country')} AS country FROM retail")(lambda r: r.select(F.col("Country").alias("raw")).distinct().withColumn("country", country(F.col("raw"))))
query("parse_dates", "SELECT count(*) AS n, count(try_cast(strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)) AS n_parsed FROM retail")(lambda r: r.agg(F.count(F.lit(1)).alias("n"), F.count(F.try_to_timestamp(F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("n_parsed")))
query("regex_probe", "SELECT " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(StockCode, '{A[k]}')) AS n_{k}" for k in PATTERNS) + " FROM retail")(lambda r: r.agg(*(F.count_if(F.col("StockCode").rlike(p)).alias(f"n_{k}") for k, p in PATTERNS.items())))
query("line_value", "SELECT row_id, round(Quantity * UnitPrice, 2) + 0.0 AS line_value FROM retail")(lambda r: r.select("row_id", rules.line_value().alias("line_value")))
query("date_parts", "SELECT row_id, CAST(year(InvoiceDate) AS INT) AS y, CAST(month(InvoiceDate) AS INT) AS m, CAST(day(InvoiceDate) AS INT) AS d, CAST(hour(InvoiceDate) AS INT) AS h, CAST(isodow(InvoiceDate) - 1 AS INT) AS wd, CAST(quarter(InvoiceDate) AS INT) AS q FROM retail")(lambda r: r.select("row_id", F.year("InvoiceDate").alias("y"), F.month("InvoiceDate").alias("m"), F.dayofmonth("InvoiceDate").alias("d"), F.hour("InvoiceDate").alias("h"), F.weekday("InvoiceDate").alias("wd"), F.quarter("InvoiceDate").alias("q")))
query("line_flags", "SELECT row_id, starts_with(InvoiceNo, 'C') AS is_cancellation, coalesce(Quantity < 0, false) AS is_return, coalesce(UnitPrice = 0, false) AS is_giveaway FROM retail")(lambda r: features.extract(r).select("row_id", F.col("IsCancellation").alias("is_cancellation"), F.col("IsReturn").alias("is_return"), F.col("IsGiveaway").alias("is_giveaway")))
query("country_unknown", f"SELECT row_id, Country FROM retail WHERE Country NOT IN ({quoted(COUNTRIES)})")(lambda r: r.filter(~F.col("Country").isin(COUNTRIES)).select("row_id", "Country"))
query("canon_render", f"SELECT row_id, {RENDER['Quantity']} AS quantity, {RENDER['UnitPrice']} AS price FROM retail")(lambda r: r.select("row_id", integral(F.col("Quantity")).alias("quantity"), integral(F.col("UnitPrice")).alias("price")))
query("header_alias", "SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country, row_id FROM retail")(lambda r: alias_headers(r.withColumnsRenamed({"InvoiceNo": "Invoice", "Quantity": " qty", "UnitPrice": "Price", "CustomerID": "Customer ID", "StockCode": "stock_code"})))
query("scan_union_limit", "SELECT * FROM (SELECT 0 AS _sheet, row_id FROM retail WHERE row_id < 100000000 ORDER BY row_id LIMIT 5000) UNION ALL SELECT * FROM (SELECT 1, row_id FROM retail WHERE row_id >= 100000000 ORDER BY row_id LIMIT 5000)")(lambda r: union_limit([r.filter("row_id < 100000000"), r.filter("row_id >= 100000000")], ["row_id"], 5_000).select("_sheet", "row_id"))

# --- profiling
query("missing_per_column", TALL + ' SELECT "column", count(*) FILTER (WHERE value IS NULL) AS n_missing, round(100.0 * count(*) FILTER (WHERE value IS NULL) / count(*), 2)::DOUBLE AS missing_pct FROM tall GROUP BY 1')(lambda r: profile.missing_per_column(r.drop("row_id")))
query("missing_per_row", MISSING + " SELECT count(*) FILTER (WHERE m = 0) AS rows_complete, count(*) FILTER (WHERE m = 1) AS rows_one, count(*) FILTER (WHERE m >= 2) AS rows_more, CAST(max(m) AS BIGINT) AS max_missing FROM m")(lambda r: profile.missing_per_row(r.drop("row_id")))
query("missing_total", MISSING + " SELECT count(*) * 8 AS n_cells, CAST(sum(m) AS BIGINT) AS n_missing, round(100.0 * sum(m) / (count(*) * 8), 4)::DOUBLE AS missing_pct FROM m")(lambda r: profile.missing_total(r.drop("row_id")))
query("cardinality", TALL + ", d AS (SELECT \"column\", count(*) AS n_unique, count(*)::DOUBLE / sum(n) AS r FROM uniq GROUP BY 1) SELECT \"column\", n_unique, round(r, 6) AS ratio, CASE WHEN r >= 0.5 THEN 'high' WHEN r >= 0.05 THEN 'medium' ELSE 'low' END AS level FROM d")(lambda r: profile.cardinality(r.drop("row_id")))
query("top_values", TALL + ' SELECT * FROM (SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INT) AS rank FROM uniq) WHERE rank <= 5')(lambda r: profile.top_values(r.drop("row_id")))
query("column_profile", TALL + ' SELECT t."column", count(*) AS n_rows, count(*) - count(value) AS n_null, round(100.0 * (count(*) - count(value)) / count(*), 2)::DOUBLE AS null_pct, count(DISTINCT value) AS n_unique, min(value) AS min_text, max(value) AS max_text FROM tall t GROUP BY 1')(lambda r: profile.column_profile(r.drop("row_id")))
query("infer_dtype", SHAPES + ' SELECT "column", dtype FROM typed')(lambda r: profile.infer_dtype(r.drop("row_id")))
query("mixed_type", SHAPES + ', s AS (SELECT *, n - n_blank - n_float AS n_text, coalesce(n_float::DOUBLE / nullif(n - n_blank, 0), 0) AS r FROM shapes) SELECT "column", n_float AS n_numeric, n_text, round(r, 4) AS numeric_ratio, n_suffix, n_cancelled, (least(n_float, n_text) >= 5 AND least(n_float, n_text) >= 0.005 * (n - n_blank)) OR (n_suffix >= 5 AND r > 0.5) AS is_mixed FROM s')(lambda r: profile.mixed_type(r.drop("row_id")))
query("dtype_consistency", SHAPES + ", g AS (SELECT *, CASE dtype WHEN 'int' THEN n_int WHEN 'float' THEN n_float WHEN 'date' THEN n_date WHEN 'boolean' THEN n_bool ELSE n END AS good FROM typed) SELECT \"column\", dtype, good AS n_consistent, n - good AS n_inconsistent, round(coalesce(good::DOUBLE / nullif(n, 0), 1), 4) AS rate FROM g")(lambda r: profile.dtype_consistency(r.drop("row_id")))
query("numeric_summary", ", t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x FROM retail" for c in MEASURES) + ') SELECT "column", count(x) AS n, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS std, min(x) AS min, max(x) AS max, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.75), 4) AS q3, count(*) FILTER (WHERE x < 0) AS n_negative, count(*) FILTER (WHERE x = 0) AS n_zero, round(skewness(x), 4) AS skew, round(kurtosis(x), 4) AS kurtosis FROM t GROUP BY 1')(lambda r: profile.numeric_summary(r, MEASURES))
query("iqr_outliers", ", t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x FROM retail" for c in MEASURES) + '), f AS (SELECT "column", quantile_cont(x, 0.25) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS low, quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS high FROM t GROUP BY 1) SELECT "column", low, high, count(*) FILTER (WHERE x < low OR x > high) AS n_outliers, round(100.0 * count(*) FILTER (WHERE x < low OR x > high) / count(x), 4)::DOUBLE AS outlier_pct FROM t JOIN f USING ("column") GROUP BY ALL')(lambda r: profile.iqr_outliers(r, MEASURES))
query("corr_long", "SELECT 'Quantity' AS a, 'Quantity' AS b, round(corr(Quantity, Quantity), 4) AS r FROM retail UNION ALL SELECT 'Quantity', 'UnitPrice', round(corr(Quantity, UnitPrice), 4) FROM retail UNION ALL SELECT 'UnitPrice', 'UnitPrice', round(corr(UnitPrice, UnitPrice), 4) FROM retail")(lambda r: profile.corr_long(r, MEASURES))
query("hist_capped", ", e AS (SELECT min(Quantity) AS lo, quantile_cont(Quantity, 0.995) AS hi FROM retail) SELECT CAST(least(59, floor((least(Quantity, hi) - lo) / ((hi - lo) / 60))) AS INT) AS bin, count(*) AS n FROM retail, e GROUP BY 1")(lambda r: profile.histogram(r, "Quantity"))
query("sample_rows", "SELECT row_id FROM retail ORDER BY (row_id * 1103515245 + 42 * 12345) % 2147483648, row_id LIMIT 1000")(lambda r: profile.sample_rows(r).select("row_id"))
query("flags_numeric", ", f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS flag, '{s}' AS severity, count(*) FILTER (WHERE {p}) AS n FROM retail" for n, s, p in [("negative-quantity", "info", "Quantity < 0"), ("bulk-quantity", "info", "abs(Quantity) > 1000"), ("zero-quantity", "warning", "Quantity = 0"), ("negative-price", "critical", "UnitPrice < 0"), ("zero-price", "warning", "UnitPrice = 0"), ("extreme-price", "info", "UnitPrice > 1000"), ("cancelled-invoices", "info", "regexp_matches(InvoiceNo, '(?i)^C\\d+$')")]) + ") SELECT * FROM f WHERE n > 0")(profile.flags_numeric)
query("flags_missing", TALL + ", s AS (SELECT \"column\", round(100.0 * count(*) FILTER (WHERE value IS NULL) / count(*), 2)::DOUBLE AS missing_pct, count(DISTINCT value) AS u FROM tall GROUP BY 1) SELECT \"column\", unnest(CASE WHEN u = 0 THEN ['missing-critical', 'empty-column'] ELSE list_filter([CASE WHEN missing_pct >= 95 THEN 'missing-critical' WHEN missing_pct >= 20 THEN 'missing-high' END, CASE WHEN u = 1 THEN 'constant-column' END], lambda x: x IS NOT NULL) END) AS flag, missing_pct FROM s")(lambda r: profile.missing_flags(r.drop("row_id")))
query("case_variants", TALL + ", g AS (SELECT \"column\", lower(trim(value)) AS g, count(*) AS m FROM uniq WHERE \"column\" IN ('StockCode', 'Description', 'Country') GROUP BY 1, 2) SELECT \"column\", count(*) FILTER (WHERE m > 1) AS n_groups FROM g GROUP BY 1")(lambda r: profile.case_variants(r, ["StockCode", "Description", "Country"]))
query("padded_text", TALL + ", g AS (SELECT * FROM tall WHERE \"column\" IN ('StockCode', 'Description', 'Country')) SELECT \"column\", count(*) FILTER (WHERE value <> trim(value)) AS n_padded FROM g GROUP BY 1")(lambda r: profile.padded_text(r, ["StockCode", "Description", "Country"]))
query("pii_columns", "SELECT * FROM (VALUES ('CustomerID', 'direct', 'customerid'), ('Country', 'quasi', 'country')) t(\"column\", kind, pattern)")(lambda r: profile.pii_columns(r.drop("row_id")))

# --- contract
FAMILY = "CASE WHEN regexp_matches(trim(v), '^\\d+$') THEN 'numeric' WHEN regexp_matches(trim(v), '^\\d+[A-Za-z]{1,2}$') THEN 'suffixed' WHEN regexp_matches(trim(v), '(?i)^C\\d+$') THEN 'prefixed' ELSE 'service' END"
query("value_families", f", e AS (SELECT 'InvoiceNo' AS \"column\", InvoiceNo AS v FROM retail UNION ALL SELECT 'StockCode', StockCode FROM retail) SELECT \"column\", {FAMILY} AS family, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY \"column\"), 4)::DOUBLE AS pct FROM e WHERE v IS NOT NULL GROUP BY 1, 2")(contract.value_families)
TIER = "CASE WHEN x IS NULL THEN 'missing' WHEN NOT x BETWEEN {4} AND {5} THEN 'invalid' WHEN x BETWEEN {0} AND {1} THEN 'typical' WHEN x BETWEEN {2} AND {3} THEN 'plausible' ELSE 'atypical' END"
query("measure_tiers", f"SELECT 'Quantity' AS \"column\", {TIER.format(-9.5, 18.5, -20, 29, -10000, 10000)} AS tier, count(*) AS n FROM (SELECT Quantity AS x FROM retail) GROUP BY ALL UNION ALL SELECT 'UnitPrice', {TIER.format(0, 9.75, 0, 14.85, 0, 20000)}, count(*) FROM (SELECT UnitPrice AS x FROM retail) GROUP BY ALL")(lambda r: contract.measure_tiers(r, C))
query("key_candidates", "SELECT 'row_id' AS candidate, count(DISTINCT row_id) AS n_distinct, count(DISTINCT row_id) = count(*) AS is_key FROM retail UNION ALL SELECT 'line', (SELECT count(*) FROM (SELECT DISTINCT InvoiceNo, StockCode, InvoiceDate FROM retail)), (SELECT count(*) FROM (SELECT DISTINCT InvoiceNo, StockCode, InvoiceDate FROM retail)) = count(*) FROM retail")(lambda r: contract.key_candidates(r, {"row_id": ["row_id"], "line": rules.KEY}))
query("row_validity", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (WHERE {p}) AS n, round(100.0 * count(*) FILTER (WHERE {p}) / count(*), 4)::DOUBLE AS pct FROM retail" for k, p in [("giveaway", "UnitPrice = 0"), ("return", "Quantity < 0"), ("cancellation", "starts_with(InvoiceNo, 'C')"), ("guest", "CustomerID IS NULL"), ("no_description", "Description IS NULL")]))(contract.row_validity)
query("validity_mask", f"SELECT row_id, {VALID} AS is_valid FROM retail")(lambda r: contract.validity_mask(r, C))

# --- cleaning
query("description_lookup", NORMAL + LOOKUP + ' SELECT StockCode, d AS "LookupDescription" FROM lookup')(lambda r: cleaning.description_lookup(cleaning.normalise(r)))
query("impute_description", NORMAL + FILLED + " SELECT row_id, Description, description_source FROM filled")(lambda r: cleaning.impute(cleaning.normalise(r)).select("row_id", "Description", "description_source"))
query("impute_median", ", g AS (SELECT row_id, CASE WHEN row_id % 10 = 0 THEN NULL ELSE Quantity END AS Quantity, CASE WHEN row_id % 10 = 1 THEN NULL ELSE UnitPrice END AS UnitPrice FROM retail) SELECT row_id, coalesce(Quantity, (SELECT median(Quantity) FROM g)) AS Quantity, coalesce(UnitPrice, (SELECT median(UnitPrice) FROM g)) AS UnitPrice FROM g")(lambda r: cleaning.impute(r.withColumns({"Quantity": F.when(F.col("row_id") % 10 != 0, F.col("Quantity")), "UnitPrice": F.when(F.col("row_id") % 10 != 1, F.col("UnitPrice"))})).select("row_id", "Quantity", "UnitPrice"))
query("exact_dedup", f"SELECT min(row_id) AS row_id, {KEYS} FROM retail GROUP BY ALL")(cleaning.exact_dedup)
query("dup_groups", f", g AS (SELECT count(*) AS n FROM retail GROUP BY {KEYS}) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE n > 1) AS n_groups, CAST(sum(n - 1) AS BIGINT) AS n_removed FROM g")(cleaning.duplicate_groups)
query("clean_pipeline", NORMAL + FILLED + FIRSTS + f" SELECT row_id, {KEYS} FROM firsts")(cleaning.clean)
query("near_dup_pairs")(lambda r: cleaning.near_pairs(cleaning.normalise(r), 0.6))
query("near_dup_levenshtein", NORMAL + ", d AS (SELECT DISTINCT StockCode, Description FROM normal WHERE Description IS NOT NULL) SELECT a.StockCode, a.Description AS a, b.Description AS b, round(1 - levenshtein(a.Description, b.Description)::DOUBLE / greatest(length(a.Description), length(b.Description)), 6) AS similarity FROM d a JOIN d b ON a.StockCode = b.StockCode AND a.Description < b.Description WHERE 2 * least(length(a.Description), length(b.Description)) >= 0.3 * (length(a.Description) + length(b.Description)) AND 1 - levenshtein(a.Description, b.Description)::DOUBLE / greatest(length(a.Description), length(b.Description)) >= 0.3")(lambda r: cleaning.near_pairs(cleaning.normalise(r), 0.3, distance=True).withColumn("similarity", F.round("similarity", 6)))
query("near_dup_groups")(lambda r: cleaning.near_groups(cleaning.normalise(r), 0.6))
query("defect_sample", ", t AS (SELECT row_id, unnest(CASE WHEN len(r) > 0 THEN r ELSE ['clean'] END) AS role FROM (SELECT row_id, list_filter([CASE WHEN Description IS NULL THEN 'null_description' END, CASE WHEN upper(trim(Country)) IN ('EIRE', 'UK', 'USA') THEN 'alias' END, CASE WHEN Description <> trim(Description) THEN 'padded' END, CASE WHEN StockCode <> upper(StockCode) THEN 'lower_code' END, CASE WHEN CustomerID IS NULL THEN 'guest' END, CASE WHEN Quantity = 0 THEN 'zero_quantity' END], lambda x: x IS NOT NULL) AS r FROM retail)) SELECT role, min(row_id) AS row_id FROM t GROUP BY 1")(cleaning.defect_sample)
query("cleaning_diff", NORMAL + FILLED + FIRSTS + f", o AS (SELECT r.row_id, CustomerID IS NULL AS guest, list_filter([CASE WHEN StockCode <> {squeezed('StockCode')} THEN 'normalised:StockCode' END, CASE WHEN Description <> {squeezed('Description')} THEN 'normalised:Description' END, CASE WHEN Country <> {resolved('Country')} THEN 'normalised:Country' END, CASE WHEN Description IS NULL THEN 'imputed:Description' END], lambda x: x IS NOT NULL) AS ops FROM retail r) SELECT row_id, CASE WHEN row_id NOT IN (SELECT row_id FROM firsts) THEN 'removed' WHEN list_contains(ops, 'imputed:Description') THEN 'imputed' WHEN len(ops) > 0 THEN 'normalised' WHEN guest THEN 'preserved' ELSE 'unchanged' END AS status, array_to_string(ops, ',') AS operations FROM o")(cleaning.diff)


def fills(known: str, wanted: str, t: str) -> str:
    """SQL of the fills of one measure out of g: donors of the same value, or else the five nearest rows."""
    return f""", don{t} AS (SELECT {known} AS v, count(*) AS n, sum({wanted}) AS s FROM g WHERE {known} IS NOT NULL AND {wanted} IS NOT NULL GROUP BY 1), ask{t} AS (SELECT DISTINCT {known} AS v FROM g WHERE {known} IS NOT NULL AND {wanted} IS NULL),
 dis{t} AS (SELECT a.v, abs(d.v - a.v) AS d, n, s, sum(n) OVER (PARTITION BY a.v ORDER BY abs(d.v - a.v) RANGE UNBOUNDED PRECEDING) AS cum FROM ask{t} a, don{t} d WHERE a.v NOT IN (SELECT v FROM don{t})), rea{t} AS (SELECT v, coalesce(min(d) FILTER (WHERE cum >= 5), max(d)) AS reach FROM dis{t} GROUP BY 1),
 fill{t} AS (SELECT a.v, s / n AS fill FROM ask{t} a JOIN don{t} d ON a.v = d.v UNION ALL SELECT v, sum(s / d) / sum(n / d) FROM dis{t} JOIN rea{t} USING (v) WHERE d <= reach GROUP BY 1)"""


query("knn_impute", ", g AS (SELECT row_id, Quantity, CASE WHEN row_id % 20 <> 0 THEN UnitPrice END AS UnitPrice FROM retail)" + fills("Quantity", "UnitPrice", "p") + " SELECT row_id, Quantity, round(coalesce(UnitPrice, fill), 6) AS UnitPrice FROM g LEFT JOIN fillp ON Quantity = v")(lambda r: anomaly.knn_impute(r.withColumn("UnitPrice", F.when(F.col("row_id") % 20 != 0, F.col("UnitPrice")))).select("row_id", "Quantity", F.round("UnitPrice", 6).alias("UnitPrice")))
HIDDEN = "(row_id * 1103515245 + {0}) % 2147483648 % 20 = 0"
query("knn_verify", f", m AS (SELECT *, {HIDDEN.format(12345)} AS hq, {HIDDEN.format(54321)} AS hp FROM retail), g AS (SELECT row_id, hq, hp, Quantity AS tq, UnitPrice AS tp, CASE WHEN NOT hq THEN Quantity END AS Quantity, CASE WHEN NOT hp THEN UnitPrice END AS UnitPrice FROM m)" + fills("Quantity", "UnitPrice", "p") + fills("UnitPrice", "Quantity", "q") + ", med AS (SELECT median(Quantity) AS mq, median(UnitPrice) AS mp FROM g), filled AS (SELECT g.*, coalesce(Quantity, round(q.fill), mq) AS fq, coalesce(UnitPrice, p.fill, mp) AS fp FROM g LEFT JOIN fillp p ON Quantity = p.v LEFT JOIN fillq q ON UnitPrice = q.v, med), e AS (SELECT abs(fq - tq) AS e FROM filled WHERE hq UNION ALL SELECT abs(fp - tp) FROM filled WHERE hp) SELECT count(*) AS n_masked, round(avg(e), 4) AS mae, round(avg(CASE WHEN e < 0.005 THEN 1.0::DOUBLE ELSE 0 END), 4) AS exact_match FROM e")(anomaly.knn_verify)

# --- features and scores
query("extract_features", "SELECT row_id, round_even(Quantity * UnitPrice, 2) + 0.0 AS LineValue, starts_with(InvoiceNo, 'C') AS IsCancellation, Quantity < 0 AS IsReturn, UnitPrice = 0 AS IsGiveaway, CAST(isodow(InvoiceDate) - 1 AS INT) AS InvoiceWeekday, CAST(quarter(InvoiceDate) AS INT) AS InvoiceQuarter FROM retail")(lambda r: features.extract(r).select("row_id", "LineValue", "IsCancellation", "IsReturn", "IsGiveaway", "InvoiceWeekday", "InvoiceQuarter"))
SCALED = "SELECT row_id, round((Quantity - avg(Quantity) OVER ()) / stddev_pop(Quantity) OVER (), 6) AS Quantity_scaled, round((UnitPrice - avg(UnitPrice) OVER ()) / stddev_pop(UnitPrice) OVER (), 6) AS UnitPrice_scaled FROM retail"
query("scale_features", SCALED)(lambda r: features.scale(r, MEASURES).select("row_id", *(F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in MEASURES)))
query("scaled_features", SCALED + " WHERE Quantity IS NOT NULL AND UnitPrice IS NOT NULL")(lambda r: features.scale(r.dropna(subset=MEASURES), MEASURES).select("row_id", *(F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in MEASURES)))
HOT = ["Atlantis", "Australia", "Austria", "Bahrain", "Belgium", "Cyprus", "Denmark", "Finland", "France", "Germany", "Greece", "Iceland", "Ireland", "Israel", "Italy", "Japan", "Nigeria", "Norway", "Poland", "Portugal", "Spain", "Sweden", "United Kingdom", "United States"]
query("onehot_country", NORMAL + " SELECT row_id, " + ", ".join(f"CASE WHEN Country = '{c}' THEN 1 ELSE 0 END AS \"Country_{c}\"" for c in HOT) + " FROM normal")(lambda r: features.one_hot(cleaning.normalise(r).select("row_id", "Country")).drop("Country"))
query("quality_score", NORMAL + f", g AS (SELECT count(*) AS u FROM (SELECT DISTINCT {KEYS} FROM retail)), q AS (SELECT round(100.0 * count(*) FILTER (WHERE InvoiceNo IS NOT NULL AND StockCode IS NOT NULL AND Description IS NOT NULL AND Quantity IS NOT NULL AND InvoiceDate IS NOT NULL AND UnitPrice IS NOT NULL AND Country IS NOT NULL) / count(*), 2)::DOUBLE AS completeness, round(100.0 * count(*) FILTER (WHERE StockCode = {squeezed('StockCode')} AND coalesce(Description, '') = coalesce({squeezed('Description')}, '') AND Country = {resolved('Country')}) / count(*), 2)::DOUBLE AS consistency, round(100.0 * (SELECT u FROM g) / count(*), 2)::DOUBLE AS uniqueness, round(100.0 * count(*) FILTER (WHERE {VALID}) / count(*), 2)::DOUBLE AS validity FROM retail) SELECT *, round(0.25::DOUBLE * completeness + 0.35::DOUBLE * validity + 0.2::DOUBLE * consistency + 0.2::DOUBLE * uniqueness, 2) AS total FROM q")(lambda r: features.quality(r, C))

# --- drift
query("drift_measures", DRIFT_M + " SELECT * FROM measures")(lambda r: drift.measures(r, C.years))
query("drift_shares", YEARS + DRIFT_S + " SELECT * FROM shares")(lambda r: drift.shares(r, C.years))
query("drift_verdict", DRIFT_M + DRIFT_S + ", b AS (SELECT band, rel_change FROM measures UNION ALL SELECT band, rel_change FROM shares) SELECT CASE max(CASE band WHEN 'alert' THEN 3 WHEN 'watch' THEN 2 WHEN 'none' THEN 1 ELSE 0 END) WHEN 3 THEN 'alert' WHEN 2 THEN 'watch' WHEN 1 THEN 'none' ELSE 'n/a' END AS verdict, max(abs(rel_change)) FILTER (WHERE NOT isinf(rel_change)) AS max_rel_change, count(*) FILTER (WHERE band = 'alert') AS n_alert, count(*) FILTER (WHERE band = 'watch') AS n_watch FROM b")(lambda r: drift.verdict(r, C.years))
query("year_counts", "SELECT CAST(year(InvoiceDate) AS INT) AS year, count(*) AS n_rows FROM retail GROUP BY 1")(drift.years)

# --- outliers and evaluation
POINTS = "SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part GROUP BY ALL"
LOF = f"WITH p AS ({POINTS}), d AS (SELECT a.x, a.y, b.x AS bx, b.y AS by_, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.x, a.y ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.x, b.y) AS r FROM p a JOIN p b ON a.x <> b.x OR a.y <> b.y), n AS (SELECT * FROM d WHERE r <= 20), k AS (SELECT x, y, max(d) AS kd FROM n GROUP BY 1, 2), l AS (SELECT n.x, n.y, 1 / greatest(1e-10, avg(greatest(n.d, k.kd))) AS lrd FROM n JOIN k ON n.bx = k.x AND n.by_ = k.y GROUP BY 1, 2), s AS (SELECT n.x, n.y, avg(b.lrd) / any_value(a.lrd) AS lof FROM n JOIN l b ON n.bx = b.x AND n.by_ = b.y JOIN l a ON n.x = a.x AND n.y = a.y GROUP BY 1, 2)"


def part_points(df: DataFrame) -> DataFrame:
    return df.select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


query("lof_scores", LOF + " SELECT x, y, round(lof, 6) AS lof FROM s", on="part")(lambda p: anomaly.lof(part_points(p), ["x", "y"]).select("x", "y", F.round("lof", 6).alias("lof")))
query("lof_flags", LOF + ", c AS (SELECT quantile_cont(lof, 0.99) AS cut FROM s) SELECT count(*) AS n_points, count(*) FILTER (WHERE round(lof, 9) > round(cut, 9)) AS n_flagged FROM s, c", on="part")(lambda p: anomaly.flag_top(anomaly.lof(part_points(p), ["x", "y"]), "lof").agg(F.count(F.lit(1)).alias("n_points"), F.count_if("is_outlier").alias("n_flagged")))
query("isolation_forest")(lambda r: anomaly.isolation_forest(r, MEASURES).select("Quantity", "UnitPrice", "n", F.round("score", 6).alias("score")))
query("anomaly_severity")(lambda r: anomaly.severity(r, MEASURES))
query("evaluate_models")(lambda r: anomaly.evaluate(r, MEASURES))
query("recall_by_model")(lambda r: anomaly.recall_by_model(r, MEASURES))
query("lof_retail")(lambda r: anomaly.lof(r, MEASURES).select(*MEASURES, "n", F.round("lof", 6).alias("lof")))
RANKED = "WITH t AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part)"
AVG_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"
query("combined_rank", RANKED + f" SELECT p_partkey, round(({AVG_RANK.format('a')} + {AVG_RANK.format('b')}) / 2, 6) AS combined FROM t", on="part")(lambda p: anomaly.combined_rank(p.select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b")), "a", "b").select("p_partkey", F.round("combined", 6).alias("combined")))
query("anomaly_topk", RANKED + ", u AS (SELECT p_partkey, a, b, row_number() OVER (ORDER BY a DESC, p_partkey) <= 10 AS ta, row_number() OVER (ORDER BY b DESC, p_partkey) <= 10 AS tb FROM t) SELECT p_partkey, a, b, CASE WHEN ta AND tb THEN 'both' WHEN ta THEN 'a' ELSE 'b' END AS source FROM u WHERE ta OR tb", on="part")(lambda p: anomaly.top_union(p.select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b")), "a", "b", ["p_partkey"]))
query("inject_anomalies", ", b AS (SELECT row_id, r, row_number() OVER (ORDER BY r, row_id) - 1 AS i, r / 2147483648.0::DOUBLE AS u FROM (SELECT row_id, (row_id * 1103515245 + 12345) % 2147483648 AS r FROM retail) ORDER BY r, row_id LIMIT 100), m AS (SELECT row_id + 1000000000 AS row_id, CAST(CASE i % 4 WHEN 0 THEN 1 + floor(12 * u) WHEN 1 THEN 15000 + floor(45000 * u) WHEN 2 THEN -60000 + floor(45000 * u) ELSE 300 + floor(600 * u) END AS DOUBLE) AS Quantity, round(CASE i % 4 WHEN 0 THEN 25000 + 35000 * u WHEN 3 THEN 2000 + 7000 * u ELSE 1 + 9 * u END, 2) AS UnitPrice, ['extreme_price', 'extreme_quantity', 'extreme_return', 'odd_combo'][i % 4 + 1] AS anomaly_type, 1 AS label FROM b), a AS (SELECT row_id, Quantity, UnitPrice, NULL AS anomaly_type, 0 AS label FROM retail UNION ALL SELECT * FROM m) SELECT *, round(Quantity * UnitPrice, 2) + 0.0 AS LineValue FROM a")(lambda r: anomaly.inject(r))
LABELLED = "WITH j AS (SELECT doc_id, quality, n_chars, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))"


def labelled(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars", "source"), "doc_id").withColumn("p", (F.col("n_chars") > 1000).cast("int")))


Q["confusion_metrics"] = labelled(lambda j: anomaly.confusion(j, "quality", "p"))
SQL["confusion_metrics"] = LABELLED + ", c AS (SELECT count(*) FILTER (WHERE quality = 1 AND p = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND p = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND p <> 1) AS fn, count(*) FILTER (WHERE quality <> 1 AND p <> 1) AS tn FROM j) SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM c"
Q["roc_auc"] = labelled(lambda j: anomaly.roc_auc(j, "quality", "n_chars"))
SQL["roc_auc"] = LABELLED + ", r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM j), s AS (SELECT sum(r) FILTER (WHERE quality = 1) AS w, count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg FROM r) SELECT n_pos, n_neg, round((w - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg), 6) AS auc FROM s"
Q["roc_curve"] = labelled(lambda j: anomaly.roc_curve(j, "quality", "n_chars"))
SQL["roc_curve"] = LABELLED + ", g AS (SELECT n_chars::DOUBLE AS threshold, count(*) FILTER (WHERE quality = 1) AS a, count(*) FILTER (WHERE quality = 0) AS b FROM j GROUP BY 1) SELECT threshold, round(sum(b) OVER w::DOUBLE / sum(b) OVER (), 6) AS fpr, round(sum(a) OVER w::DOUBLE / sum(a) OVER (), 6) AS tpr FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)"
Q["precision_at_k"] = labelled(lambda j: anomaly.precision_at_k(j, "quality", "n_chars", "doc_id"))
SQL["precision_at_k"] = LABELLED + ", k AS (SELECT count(*) AS k FROM j WHERE quality = 1), t AS (SELECT quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM j) SELECT k, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS precision_at_k FROM t, k WHERE r <= k GROUP BY k"
Q["recall_by_type"] = labelled(lambda j: anomaly.recall_by_type(j.filter("quality = 1"), "source", "p"))
SQL["recall_by_type"] = LABELLED.replace("n_chars, CASE", "n_chars, source, CASE") + " SELECT source AS anomaly_type, count(*) AS n, round(avg(p), 4) AS recall FROM j WHERE quality = 1 GROUP BY 1"

# --- terms
TERMS = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2)"
query("tfidf_terms", TERMS + ", n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT term, count(*) AS df, ln((1.0::DOUBLE + any_value(n)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf, n GROUP BY 1), x AS (SELECT doc_id, term, df, tf * idf AS x FROM tf JOIN idf USING (term)), l AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM x GROUP BY 1), m AS (SELECT term, max(df) AS df, sum(x / l) / (SELECT n FROM n) AS m FROM x JOIN l USING (doc_id) GROUP BY 1) SELECT term, df, round(m, 6) AS mean_tfidf FROM m ORDER BY round(m, 9) DESC, term LIMIT 5", on="documents")(lambda d: classify.tfidf_terms(d, "text", "doc_id"))
query("vocab_size", TERMS + " SELECT count(DISTINCT term) AS vocab_size, CAST(sum(tf) AS BIGINT) AS n_tokens FROM tf", on="documents")(lambda d: classify.vocabulary(d, "text", "doc_id"))


def queries() -> dict[str, Query]:
    from . import schema_queries  # registers its own into the same tables

    assert schema_queries.query is query
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
