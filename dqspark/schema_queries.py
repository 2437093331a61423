"""Queries of the inferred contract, the flags, dates of mixed layouts and the column classifier, beside their SQL.

Registered into the tables of ``queries``; the SQL states thresholds, weights and cues by itself, so that a wrong value in
the library shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.expr import CANONICAL, COUNTRIES, parsed_date
from .functions.expr import RETAIL_CONTRACT as C
from .operators import classify, cleaning, contract, features, inference, profile, rules
from .queries import A, DRIFT_M, DRIFT_S, PRED, SEVERITY, SHAPES, TALL, query, quoted, resolved, squeezed

# --- dates of mixed layouts
query("parse_mixed_dates", "SELECT row_id, CASE row_id % 3 WHEN 0 THEN InvoiceDate WHEN 1 THEN date_trunc('minute', InvoiceDate) ELSE date_trunc('day', InvoiceDate) END AS parsed FROM retail")(
    lambda r: r.select("row_id", parsed_date(F.when(F.col("row_id") % 3 == 0, F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss")).when(F.col("row_id") % 3 == 1, F.date_format("InvoiceDate", "M/d/yyyy H:mm")).otherwise(F.date_format("InvoiceDate", "d-MMM-yyyy"))).alias("parsed"))
)

# --- the contract that values show
VALS = TALL + ', vals AS (SELECT "column", value AS v, count(*) AS m FROM tall WHERE "column" IN (\'InvoiceNo\', \'StockCode\', \'CustomerID\') GROUP BY 1, 2)'
PLAIN, BEHIND = r"regexp_matches(v, '^\d+$')", r"regexp_matches(v, '^\d+[A-Za-z]+$')"
WIDE = "coalesce('{' || greatest(1, a - 1) || ',' || (b + 1) || '}', '+')"
LONG = "coalesce('{' || greatest(1, c - 1) || ',' || (d + 1) || '}', '+')"
FAMILIES = (
    VALS
    + rf""", widths AS (SELECT "column", sum(m) AS total, min(CASE WHEN {PLAIN} THEN length(v) WHEN {BEHIND} THEN length(regexp_extract(v, '^(\d+)', 1)) END) AS a, max(CASE WHEN {PLAIN} THEN length(v) WHEN {BEHIND} THEN length(regexp_extract(v, '^(\d+)', 1)) END) AS b,
 min(CASE WHEN {BEHIND} THEN length(regexp_extract(v, '([A-Za-z]+)$', 1)) END) AS c, max(CASE WHEN {BEHIND} THEN length(regexp_extract(v, '([A-Za-z]+)$', 1)) END) AS d FROM vals GROUP BY 1),
 counted AS (SELECT "column", CASE WHEN regexp_matches(trim(v), '{A["float"]}') THEN 'numeric' WHEN regexp_matches(trim(v), '^[+-]?\d+[A-Za-z]+$') THEN 'suffixed' WHEN regexp_matches(trim(v), '(?i)^C\d+$') THEN 'prefixed' ELSE 'service' END AS family, CAST(sum(m) AS BIGINT) AS n FROM vals WHERE v IS NOT NULL GROUP BY 1, 2),
 families AS (SELECT f."column", family, n, round(100.0 * n / total, 3)::DOUBLE AS pct, CASE family WHEN 'numeric' THEN '\d' || {WIDE} WHEN 'suffixed' THEN '\d' || {WIDE} || '[A-Za-z]' || {LONG} WHEN 'prefixed' THEN 'C\d' || {WIDE} ELSE '[A-Za-z][A-Za-z0-9 .''/&_()-]{{0,30}}' END AS inside FROM counted f JOIN widths w ON f."column" = w."column")"""
)
query("identifier_families", FAMILIES + " SELECT \"column\", family, n, pct, '^' || inside || '$' AS pattern FROM families")(inference.identifier_families)
query("identifier_patterns", FAMILIES + " SELECT \"column\", '^(?:' || string_agg('(?:' || inside || ')', '|' ORDER BY CASE family WHEN 'numeric' THEN 0 WHEN 'suffixed' THEN 1 WHEN 'prefixed' THEN 2 ELSE 3 END) || ')$' AS pattern, count(*) AS n_families, CAST(sum(n) AS BIGINT) AS n_accounted FROM families GROUP BY 1")(inference.identifier_patterns)
query(
    "measure_ranges",
    ", q AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS \"column\", quantile_cont({m}, 0.25) AS q1, quantile_cont({m}, 0.75) AS q3, {low}::DOUBLE AS lo, {high}::DOUBLE AS hi FROM retail" for m, low, high in (("Quantity", -10000, 10000), ("UnitPrice", 0, 20000)))
    + ") SELECT \"column\", tier, round(CASE tier WHEN 'atypical' THEN lo ELSE greatest(lo, q1 - k * (q3 - q1)) END, 4) AS low, round(CASE tier WHEN 'atypical' THEN hi ELSE least(hi, q3 + k * (q3 - q1)) END, 4) AS high FROM q, (VALUES ('typical', 1.5::DOUBLE), ('plausible', 3.0::DOUBLE), ('atypical', 0.0::DOUBLE)) t(tier, k)",
)(lambda r: inference.measure_ranges(r, C))
query("contract_envelopes", "SELECT CAST(floor(min(CustomerID) / 1000.0) * 1000 AS BIGINT) AS block_low, CAST(ceil(max(CustomerID) / 1000.0) * 1000 AS BIGINT) AS block_high, year(min(InvoiceDate)) || '-01-01 00:00:00' AS window_low, year(max(InvoiceDate)) || '-12-31 23:59:59' AS window_high FROM retail")(inference.envelopes)
query(
    "text_policy",
    r"SELECT 'Description' AS \"column\", count(*) AS n_rows, count(*) - count(Description) AS n_null, round(100.0 * (count(*) - count(Description)) / count(*), 2)::DOUBLE AS null_pct, round(100.0 * (count(*) - count(Description)) / count(*), 2) <= 1 AS null_pct_accepted, CAST(min(length(trim(Description))) AS INT) AS min_length, CAST(max(length(trim(Description))) AS INT) AS max_length, count(*) FILTER (WHERE Description <> trim(Description)) AS n_padded, count(*) FILTER (WHERE regexp_matches(trim(Description), '\s{2,}')) AS n_spaced, count(*) FILTER (WHERE Description <> upper(Description)) AS n_not_upper, count(*) FILTER (WHERE trim(Description) = '') AS n_blank FROM retail".replace('\\"', '"'),
)(inference.text_policy)
query("category_policy", f", seen AS (SELECT {resolved('Country')} AS value, count(*) AS n, count(*) FILTER (WHERE upper(trim(Country)) IN ('EIRE', 'UK', 'U.K.', 'U K', 'USA', 'US', 'U.S.A.', 'RSA', 'UAE', 'U.E.')) AS n_alias FROM retail WHERE Country IS NOT NULL GROUP BY 1), ref(value) AS (VALUES " + ", ".join(f"('{c}')" for c in COUNTRIES) + ") SELECT coalesce(s.value, r.value) AS value, coalesce(n, 0) AS n, coalesce(n_alias, 0) AS n_alias, CASE WHEN s.value IS NULL THEN 'reference' WHEN r.value IS NULL THEN 'seen' ELSE 'both' END AS basis FROM seen s FULL JOIN ref r ON s.value = r.value")(lambda r: inference.categories(r, c=C))
COLUMN_CONTRACT = TALL + """, roles("column", role, expected_dtype, nullable) AS (VALUES ('InvoiceNo', 'key', 'string', false), ('StockCode', 'key', 'string', false), ('Description', 'text', 'string', true), ('Quantity', 'measure', 'int', false), ('InvoiceDate', 'timestamp', 'date', false), ('UnitPrice', 'measure', 'float', false), ('CustomerID', 'key', 'int', true), ('Country', 'dimension', 'string', false)),
 stats AS (SELECT "column", count(*) - count(value) AS n_null, count(DISTINCT value) AS n_unique, count(DISTINCT value) = count(*) AS is_key FROM tall GROUP BY 1)"""
query("column_contract", COLUMN_CONTRACT + ' SELECT r."column", role, expected_dtype, nullable, n_null, n_unique, is_key FROM roles r JOIN stats s ON r."column" = s."column"')(inference.column_contract)
query("contract_checks", FAMILIES + ", found AS (SELECT 'every-column-has-schema' AS check_id, 8 AS n_found, 8 AS n_expected UNION ALL SELECT 'every-column-has-expected-dtype', 8, 8 UNION ALL SELECT 'every-column-has-value-domain', 8, 8 UNION ALL SELECT 'every-constraint-has-severity', 47, 47 UNION ALL SELECT f.\"column\" || '-family-accounting', CAST(sum(n) AS BIGINT), any_value(e) FROM families f JOIN (SELECT \"column\", count(value) AS e FROM tall GROUP BY 1) t ON f.\"column\" = t.\"column\" GROUP BY f.\"column\") SELECT check_id, CAST(n_found AS BIGINT) AS n_found, CAST(n_expected AS BIGINT) AS n_expected, n_found = n_expected AS passed FROM found")(lambda r: inference.checks(r, C))
query("cleaning_plan", "SELECT CAST(step AS INT) AS step, operation, columns, mandated_by FROM (VALUES (1, 'strip_whitespace', 'StockCode,Description,Country', 'StockCode.trim,Description.trim,Country.trim'), (2, 'normalise_case', 'StockCode,Description,Country', 'StockCode.case,Description.case,Country.case'), (3, 'normalise_country_aliases', 'Country', 'Country.alias'), (4, 'parse_datetimes', 'InvoiceDate', 'InvoiceDate.format'), (5, 'cast_nullable_integer', 'CustomerID', 'CustomerID.integer'), (6, 'impute_description_from_stockcode', 'Description', 'Description.null,Description.per_stockcode'), (7, 'derive_line_columns', 'LineValue,IsCancellation,IsReturn,IsGiveaway', '')) t(step, operation, columns, mandated_by)")(inference.cleaning_plan)

# --- all 47 constraints: rows that violate each, by severity
LAND = "trim(Country)"
TITLED = f"array_to_string(list_transform(string_split(lower({LAND}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
HARD = {
    "InvoiceNo.type": "false", "InvoiceNo.pattern": PRED["invoiceno_format"], "StockCode.type": "false", "StockCode.pattern": PRED["stockcode_format"], "CustomerID.type": "false", "CustomerID.pattern": r"NOT regexp_matches(CAST(CustomerID AS VARCHAR), '^\d{4,6}$')", "CustomerID.integer": "CustomerID % 1 <> 0", "CustomerID.block": PRED["customerid_out_of_block"],
    "Quantity.dtype": "Quantity IS NULL", "Quantity.bounds": PRED["quantity_out_of_bounds"], "Quantity.integer": "Quantity % 1 <> 0", "Quantity.no_zero": "Quantity = 0", "UnitPrice.dtype": "UnitPrice IS NULL", "UnitPrice.bounds": "UnitPrice > 20000", "UnitPrice.non_negative": "UnitPrice < 0", "UnitPrice.currency": "round_even(UnitPrice, 2) <> UnitPrice",
    "InvoiceDate.format": "false", "InvoiceDate.resolution": "microsecond(InvoiceDate) % 1000000 <> 0", "InvoiceDate.tz": "false", "InvoiceDate.window": "NOT InvoiceDate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-06-30 23:59:59'", "InvoiceDate.no_future": "InvoiceDate > CAST(now() AS TIMESTAMP)", "InvoiceDate.null": "InvoiceDate IS NULL",
    "Description.type": "false", "Description.nonempty": "trim(Description) = ''", "Country.type": "false", "Country.pattern": r"NOT regexp_matches(Country, '^[A-Z][A-Za-z .''\-]{1,29}$')", "Country.null": "Country IS NULL",
}
REVIEW = {
    "InvoiceNo.case": "InvoiceNo <> upper(InvoiceNo)", "StockCode.case": "StockCode <> upper(StockCode)", "StockCode.trim": "StockCode <> trim(StockCode)", "Quantity.bulk": "abs(Quantity) > 1000", "UnitPrice.zero": "UnitPrice = 0", "UnitPrice.extreme": "UnitPrice > 1000",
    "Description.trim": "Description <> trim(Description)", "Description.spacing": r"regexp_matches(Description, '\s{2,}')", "Description.case": "Description <> upper(Description)", "Description.length": "length(Description) > 128", "Description.null": "Description IS NULL",
    "Country.trim": f"Country <> {LAND}", "Country.case": f"{LAND} <> {TITLED}", "Country.alias": f"upper({LAND}) IN ('EIRE', 'UK', 'U.K.', 'U K', 'USA', 'US', 'U.S.A.', 'RSA', 'UAE', 'U.E.')",
}
ON_ROWS = [(k, "hard", p) for k, p in HARD.items()] + [(k, "review", p) for k, p in REVIEW.items()] + [("Quantity.sign", "info", "Quantity < 0")]
WHOLE = [
    f"SELECT 'Description.per_stockcode' AS \"constraint\", 'review' AS severity, count(*) FILTER (WHERE m > 1) AS n_violations FROM (SELECT count(DISTINCT {squeezed('Description')}) AS m FROM retail WHERE StockCode IS NOT NULL AND Description IS NOT NULL GROUP BY {squeezed('StockCode')})",
    "SELECT 'Country.cardinality', 'hard', greatest(0, count(DISTINCT Country) - 40) FROM retail",
    "SELECT * FROM (VALUES ('CustomerID.not_a_measure', 'info', CAST(NULL AS BIGINT)), ('CustomerID.pii', 'review', NULL), ('Country.pii', 'info', NULL)) t",
]
CONSTRAINT_SQL = ", found AS (" + " UNION ALL ".join([*WHOLE, *(f"SELECT '{k}', '{s}', count(*) FILTER (WHERE {p}) FROM retail" for k, s, p in ON_ROWS)]) + ")"
query("constraint_violations", CONSTRAINT_SQL + ' SELECT "constraint", severity, CAST(n_violations AS BIGINT) AS n_violations FROM found')(lambda r: contract.constraint_violations(r, C))
query("constraint_severities", "SELECT * FROM (VALUES ('hard', 28::BIGINT), ('review', 16::BIGINT), ('info', 3::BIGINT)) t(severity, n_constraints)")(lambda r: contract.constraint_violations(r.limit(0), C).groupBy("severity").agg(F.count(F.lit(1)).alias("n_constraints")))

# --- flags
TEXT = "('InvoiceNo', 'StockCode', 'Description', 'Country')"
FIRST = "(SELECT string_agg(value, ' | ' ORDER BY value) FROM (SELECT DISTINCT value FROM ({0}) ORDER BY value LIMIT {1}))"


def first(source: str, k: int) -> str:
    return FIRST.format(source, k)


NUMBERS = [("negative-quantity", "info", "Quantity", "Quantity < 0"), ("bulk-quantity", "info", "Quantity", "abs(Quantity) > 1000"), ("zero-quantity", "warning", "Quantity", "Quantity = 0"), ("negative-price", "critical", "UnitPrice", "UnitPrice < 0"), ("zero-price", "warning", "UnitPrice", "UnitPrice = 0"), ("extreme-price", "info", "UnitPrice", "UnitPrice > 1000"), ("cancelled-invoices", "info", "InvoiceNo", r"regexp_matches(InvoiceNo, '^C\d+$')")]
NO_NUMBER = f"NOT regexp_matches(trim(value), '{A['float']}') AND trim(value) <> ''"
FLAGS = (
    SHAPES
    + f""", gaps AS (SELECT "column", count(*) - count(value) AS n, round(100.0 * (count(*) - count(value)) / count(*), 2) AS pct, count(DISTINCT value) AS u FROM tall GROUP BY 1),
 groups AS (SELECT "column", lower(trim(value)) AS g FROM uniq WHERE "column" IN {TEXT} GROUP BY 1, 2 HAVING count(*) > 1),
 raised(flag, category, severity, "column", n, examples) AS ("""
    + " UNION ALL ".join(
        [
            "SELECT 'missing-critical', 'suspicious', 'critical', \"column\", n, NULL::VARCHAR FROM gaps WHERE pct >= 95 OR u = 0",
            "SELECT 'missing-high', 'suspicious', 'warning', \"column\", n, NULL FROM gaps WHERE pct >= 20 AND pct < 95 AND u > 0",
            "SELECT 'empty-column', 'suspicious', 'critical', \"column\", n, NULL FROM gaps WHERE u = 0",
            "SELECT 'constant-column', 'suspicious', 'warning', \"column\", n, NULL FROM gaps WHERE u = 1",
            *(f"SELECT '{f}', 'suspicious', '{s}', '{c}', count(*) FILTER (WHERE {p}), NULL FROM retail HAVING count(*) FILTER (WHERE {p}) > 0" for f, s, c, p in NUMBERS),
            "SELECT 'date-out-of-range', 'suspicious', 'warning', 'InvoiceDate', count(*) FILTER (WHERE NOT InvoiceDate BETWEEN TIMESTAMP '2009-01-01' AND TIMESTAMP '2011-12-31'), NULL FROM retail HAVING count(*) FILTER (WHERE NOT InvoiceDate BETWEEN TIMESTAMP '2009-01-01' AND TIMESTAMP '2011-12-31') > 0",
            *(f"SELECT 'mixed-type', 'format', 'warning', '{c}', n - n_blank - n_float, {first(f'SELECT value FROM uniq WHERE {chr(34)}column{chr(34)} = {chr(39)}{c}{chr(39)} AND {NO_NUMBER}', 5)} FROM shapes WHERE \"column\" = '{c}' AND ((least(n_float, n - n_blank - n_float) >= 5 AND least(n_float, n - n_blank - n_float) >= 0.005 * (n - n_blank)) OR (n_suffix >= 5 AND n_float > 0.5 * (n - n_blank)))" for c in CANONICAL),
            *(f"SELECT 'padded-text', 'format', 'warning', '{c}', count(*) FILTER (WHERE {c} <> trim({c})), {first(f'SELECT {c} AS value FROM retail WHERE {c} <> trim({c})', 3)} FROM retail HAVING count(*) FILTER (WHERE {c} <> trim({c})) > 0" for c in ("InvoiceNo", "StockCode", "Description", "Country")),
            *(f"SELECT 'case-variants', 'format', 'info', '{c}', count(*), {first(f'SELECT g AS value FROM groups WHERE {chr(34)}column{chr(34)} = {chr(39)}{c}{chr(39)}', 3)} FROM groups WHERE \"column\" = '{c}' HAVING count(*) > 0" for c in ("InvoiceNo", "StockCode", "Description", "Country")),
            "SELECT 'pii-direct', 'pii', 'warning', 'CustomerID', NULL, 'customerid'",
            "SELECT 'pii-quasi', 'pii', 'info', 'Country', NULL, 'country'",
        ]
    )
    + ")"
)
query("flags_all", FLAGS + ' SELECT flag, category, severity, "column", n, examples FROM raised')(lambda r: profile.flags(r.drop("row_id")))
query("flags_summary", FLAGS + ", s AS (SELECT severity FROM raised) SELECT count(*) AS n_flags, count(*) FILTER (WHERE severity = 'critical') AS n_critical, count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'info') AS n_info FROM s")(lambda r: profile.flag_summary(profile.flags(r.drop("row_id"))))
MESSY = ", messy AS (SELECT CASE row_id % 4 WHEN 0 THEN strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(InvoiceDate, '%-m/%-d/%Y %-H:%M') WHEN 2 THEN strftime(InvoiceDate, '%Y-%m-%d') ELSE CASE WHEN row_id % 100 = 3 THEN 'on day ' || (row_id % 7) || ' - ?' ELSE strftime(InvoiceDate, '%Y-%m-%d') END END AS d FROM retail)"
query("flags_of_text_dates", MESSY + ", bad AS (SELECT d FROM messy WHERE d LIKE 'on day%') SELECT flag, 'format' AS category, 'warning' AS severity, 'InvoiceDate' AS \"column\", (SELECT count(*) FROM bad) AS n, (SELECT string_agg(d, ' | ' ORDER BY d) FROM (SELECT DISTINCT d FROM bad ORDER BY d LIMIT 5)) AS examples FROM (VALUES ('dtype-mismatch'), ('date-as-text')) t(flag)")(
    lambda r: profile.flags(r.select(F.when(F.col("row_id") % 4 == 0, F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss")).when(F.col("row_id") % 4 == 1, F.date_format("InvoiceDate", "M/d/yyyy H:mm")).when(F.col("row_id") % 100 == 3, F.concat(F.lit("on day "), (F.col("row_id") % 7).cast("string"), F.lit(" - ?"))).otherwise(F.date_format("InvoiceDate", "yyyy-MM-dd")).alias("InvoiceDate")), ("1900-01-01", "2100-01-01"))
)
query("infer_semantic", "SELECT * FROM (VALUES ('InvoiceNo', 'invoice_id'), ('StockCode', 'product_id (SKU)'), ('Description', 'product_description'), ('Quantity', 'quantity'), ('InvoiceDate', 'transaction_datetime'), ('UnitPrice', 'unit_price'), ('CustomerID', 'customer_id'), ('Country', 'country')) t(\"column\", semantic)")(lambda r: profile.infer_semantic(r.drop("row_id")))
query("infer_semantic_orders", "SELECT * FROM (VALUES ('o_orderkey', 'numeric_measure'), ('o_custkey', 'numeric_measure'), ('o_orderstatus', 'category'), ('o_totalprice', 'price/amount'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'category')) t(\"column\", semantic)", on="orders")(profile.infer_semantic)

# --- health: severities of the rules, drift, and rows extreme in both measures in place of the models' flags
BOTH = "abs(Quantity) > 45 AND UnitPrice > 12"
HEALTH = SEVERITY + DRIFT_M + DRIFT_S + f", b AS (SELECT max(abs(rel_change)) FILTER (WHERE NOT isinf(rel_change)) AS drift FROM (SELECT rel_change FROM measures UNION ALL SELECT rel_change FROM shares)), both_ AS (SELECT count(*) AS n_both FROM retail WHERE {BOTH}), p AS (SELECT 100.0::DOUBLE * (1 - n_hard::DOUBLE / n_rows) AS v, 100.0::DOUBLE * (1 - n_both::DOUBLE / n_rows) AS a, 100.0::DOUBLE * (1 - n_review::DOUBLE / n_rows) AS c, 100.0::DOUBLE * (1 - least(1.0::DOUBLE, coalesce(drift, 0) / 0.5::DOUBLE)) AS s FROM sev, b, both_), h AS (SELECT *, round(0.4::DOUBLE * v + 0.25::DOUBLE * a + 0.2::DOUBLE * c + 0.15::DOUBLE * s, 2) AS score FROM p)"
query("health_score", HEALTH + " SELECT score, CASE WHEN score >= 95 THEN 'Healthy' WHEN score >= 80 THEN 'Watch' ELSE 'Review' END AS grade, round(v, 2) AS validity, round(a, 2) AS anomaly, round(c, 2) AS consistency, round(s, 2) AS stability FROM h")(lambda r: features.health_score(r, r.filter((F.abs("Quantity") > 45) & (F.col("UnitPrice") > 12)), C))
query("error_severity", SEVERITY + " SELECT n_rows, least(100, round(100 * (n_hard + 0.3 * n_review + 0.1 * n_info) / n_rows, 2))::DOUBLE AS error_severity FROM sev")(lambda r: rules.rows_by_severity(r, C).select("n_rows", rules.error_severity().alias("error_severity")))

# --- columns by content
SPELLED = quoted([c.lower() for c in COUNTRIES] + ["eire", "usa", "uk", "u.k."])


def signals(tall: str) -> str:
    hit = lambda k, c="t": f"regexp_matches({c}, '{A.get(k, k)}')"
    rate = lambda p: f"round(coalesce(sum(CASE WHEN {p} THEN m END)::DOUBLE / filled, 0), 4)"
    whole, service = hit("int", "k"), f"({hit('service')} AND NOT {hit('int')})"
    dateish = r"(regexp_matches(t, '[/:]') OR regexp_matches(t, '\d{4}-\d{1,2}-\d{1,2}') OR regexp_matches(t, '(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)'))"
    ratio = lambda p: f"round(coalesce(sum(length(regexp_replace(t, '{p}', '', 'g')) * m)::DOUBLE / nullif(sum(length(t) * m), 0), 0), 4)"
    return (
        tall
        + f""", u AS (SELECT "column", trim(value) AS t, count(*) AS m FROM tall GROUP BY 1, 2), x AS (SELECT *, TRY_CAST(t AS DOUBLE) AS x FROM u), e AS (SELECT *, CASE WHEN {hit("float")} AND x % 1 = 0 AND abs(x) < 1e15 THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE t END AS k, sum(CASE WHEN t IS NOT NULL THEN m END) OVER (PARTITION BY "column") AS filled FROM x),
 med AS (SELECT "column", round(coalesce(quantile_cont(abs(TRY_CAST(trim(value) AS DOUBLE)), 0.5), 0), 4) AS median_abs FROM tall GROUP BY 1), voc AS (SELECT "column", count(DISTINCT w) AS vocab_size FROM (SELECT "column", unnest(regexp_extract_all(lower(t), '\\w+')) AS w FROM u) GROUP BY 1),
 sig0 AS (SELECT "column", CAST(sum(m) AS BIGINT) AS n, round(sum(CASE WHEN t IS NULL THEN m ELSE 0 END)::DOUBLE / sum(m), 4) AS null_rate, count(t) AS n_unique, round(count(t)::DOUBLE / sum(m), 6) AS cardinality, round(coalesce(sum(len(regexp_extract_all(lower(t), '\\w+')) * m)::DOUBLE / any_value(filled), 0), 3) AS avg_tokens,
 {ratio("[^a-zA-Z]")} AS alpha_ratio, {ratio("[^0-9]")} AS digit_ratio, {rate(hit("float"))} AS numeric_rate, CAST(coalesce(max(CASE WHEN x < 0 THEN 1 WHEN x IS NOT NULL THEN 0 END), 0) AS INT) AS has_negative, CAST(coalesce(max(CASE WHEN x % 1 <> 0 THEN 1 WHEN x IS NOT NULL THEN 0 END), 0) AS INT) AS has_decimals,
 CASE WHEN coalesce(sum(CASE WHEN {dateish} THEN m END)::DOUBLE / any_value(filled), 0) >= 0.5 THEN {rate("TRY_CAST(t AS TIMESTAMP) IS NOT NULL")} ELSE 0 END AS datetime_rate, {rate(hit("email"))} AS email_rate, {rate(hit("url"))} AS url_rate, {rate(hit("phone", "k"))} AS phone_rate, {rate("lower(t) IN ('true', 'false', '0', '1', 'yes', 'no', 'y', 'n', 't', 'f')")} AS bool_rate,
 {rate(hit("invoice", "k"))} AS invoice_rate, {rate(service)} AS service_rate, {rate(hit("suffix", "k"))} AS suffix_rate, {rate(f"({hit('cprefix', 'k')} OR (upper(k) LIKE 'C%' AND {hit('invoice', 'k')}))")} AS cancelled_rate, {rate(hit("price"))} AS price_rate, {rate(f"lower(t) IN ({SPELLED})")} AS country_rate, {rate(f"({whole} AND x BETWEEN 12000 AND 19000)")} AS block_rate, {rate(whole)} AS int_rate,
 {rate(f"(({whole} AND length(ltrim(k, '+-')) BETWEEN 4 AND 6) OR {hit('suffix', 'k')} OR {hit('cprefix', 'k')} OR {service})")} AS sku_rate FROM e GROUP BY "column", filled), sig AS (SELECT s.*, median_abs, coalesce(vocab_size, 0) AS vocab_size FROM sig0 s JOIN med USING ("column") LEFT JOIN voc USING ("column"))"""
    )


def cue(p: str) -> str:
    return f"(CASE WHEN {p} THEN 1.0::DOUBLE ELSE 0 END)"


HEAD = "regexp_replace(lower(\"column\"), '[\\s_-]+', '', 'g')"
has = lambda *parts: " OR ".join(f"contains(h, '{p}')" for p in parts)
FEW, TOKENS = "(1 - least(20 * cardinality, 1.0::DOUBLE))", "least(avg_tokens / 3, 1.0::DOUBLE)"
FORMULAS = [
    ("invoice_id", f"2 * invoice_rate + 0.5::DOUBLE * cancelled_rate + {cue('contains(h, ' + chr(39) + 'invoice' + chr(39) + ') AND NOT contains(h, ' + chr(39) + 'date' + chr(39) + ')')}"),
    ("product_id", f"2 * sku_rate * (CASE WHEN avg_tokens <= 2 THEN 1.0::DOUBLE ELSE greatest(0.2::DOUBLE, 2 / avg_tokens) END) + 0.5::DOUBLE * suffix_rate + {cue(has('stockcode', 'sku') + ' OR h LIKE ' + chr(39) + '%code' + chr(39))}"),
    ("product_description", f"0.6::DOUBLE * least(vocab_size / 1000.0::DOUBLE, 1.0::DOUBLE) + 0.8::DOUBLE * {TOKENS} + 0.6::DOUBLE * alpha_ratio + {cue(has('descript', 'productname') + ' OR h = ' + chr(39) + 'name' + chr(39))}"),
    ("quantity", f"1.5::DOUBLE * int_rate + 0.5::DOUBLE * has_negative + 0.5::DOUBLE * (1 - has_decimals) + {cue(has('quantity') + ' OR h = ' + chr(39) + 'qty' + chr(39))}"),
    ("transaction_datetime", f"2 * datetime_rate + {cue(has('date', 'time'))}"),
    ("unit_price", f"1.5::DOUBLE * price_rate + 0.8::DOUBLE * has_decimals + {cue(has('price', 'amount', 'cost'))}"),
    ("customer_id", f"2 * block_rate + 0.5::DOUBLE * null_rate + 0.5::DOUBLE * int_rate + {cue(has('customer', 'cust'))}"),
    ("country", f"2.5::DOUBLE * country_rate + 0.5::DOUBLE * {FEW} + {cue(has('country', 'nation'))}"),
    ("email", f"2 * email_rate + {cue(has('email'))}"), ("phone", f"2 * phone_rate + {cue(has('phone', 'tel', 'mobile'))}"), ("url", f"2 * url_rate + {cue(has('url', 'website', 'link'))}"),
    ("boolean_flag", "2.5::DOUBLE * bool_rate"), ("category", f"0.5::DOUBLE * {FEW}"), ("text", f"0.3::DOUBLE * alpha_ratio + 0.2::DOUBLE * {TOKENS}"),
]


def scored(tall: str) -> str:
    return signals(tall) + f", hs AS (SELECT *, {HEAD} AS h FROM sig), sc AS (" + " UNION ALL ".join(f"SELECT \"column\", {i} AS i, '{k}' AS semantic, round({f}, 4) AS score FROM hs" for i, (k, f) in enumerate(FORMULAS)) + ")"


def classified(tall: str, want: dict[str, str]) -> str:
    claims = " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in want.items())
    return scored(tall) + f", rk AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY score DESC, i) AS r FROM sc), best AS (SELECT \"column\", max(CASE WHEN r = 1 THEN semantic END) AS semantic, max(score) AS score, min(score) AS second FROM rk WHERE r <= 2 GROUP BY 1), said AS (SELECT \"column\", CASE WHEN score < 0.3 THEN 'uncertain' ELSE semantic END AS semantic, round(score, 4) AS score, CASE WHEN score < 0.3 THEN 0 ELSE round((score - second) / score, 3) END AS confidence, CASE \"column\" {claims} END AS want FROM best), classes AS (SELECT \"column\", semantic, score, confidence, CASE WHEN want IS NULL THEN 'unmapped' WHEN want = semantic THEN 'match' ELSE 'mismatch' END AS status FROM said)"


WANT = {"InvoiceNo": "invoice_id", "StockCode": "product_id", "Description": "product_description", "Quantity": "quantity", "InvoiceDate": "transaction_datetime", "UnitPrice": "unit_price", "CustomerID": "customer_id", "Country": "country"}
DECOYS = {"Country": "Contact_Email", "CustomerID": "PhoneNumber", "Description": "Item_Code"}
RENAMED = TALL.replace("tall AS (", "tall AS (SELECT CASE \"column\" " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in DECOYS.items()) + ' ELSE "column" END AS "column", value FROM (', 1).replace("), uniq AS", ")), uniq AS", 1)
MISLED = {c: k for c, k in WANT.items() if c not in DECOYS} | {"Contact_Email": "email", "PhoneNumber": "phone", "Item_Code": "product_id"}
query("column_signals", signals(TALL) + " SELECT * FROM sig")(lambda r: classify.signals(r, CANONICAL))
query("semantic_scores", scored(TALL) + ' SELECT "column", CAST(i AS INT) AS i, semantic, score FROM sc')(lambda r: classify.scores(classify.signals(r, CANONICAL), CANONICAL))
query("classify_columns", classified(TALL, WANT) + " SELECT * FROM classes")(lambda r: classify.classify(r, CANONICAL))
query("mislabel_demo", classified(RENAMED, MISLED) + " SELECT * FROM classes")(lambda r: classify.classify(r.drop("row_id").withColumnsRenamed(DECOYS)))
query("classification_counts", classified(RENAMED, MISLED) + " SELECT count(*) AS n_columns, count(*) FILTER (WHERE status <> 'unmapped') AS n_checked, count(*) FILTER (WHERE status = 'match') AS n_match, count(*) FILTER (WHERE status = 'mismatch') AS n_mismatch FROM classes")(lambda r: classify.classification_counts(classify.classify(r.drop("row_id").withColumnsRenamed(DECOYS))))
query("normalise_log", f"SELECT * FROM (SELECT 'StockCode' AS \"column\", count(*) FILTER (WHERE StockCode <> {squeezed('StockCode')}) AS n_changed FROM retail UNION ALL SELECT 'Description', count(*) FILTER (WHERE Description <> {squeezed('Description')}) FROM retail UNION ALL SELECT 'Country', count(*) FILTER (WHERE Country <> {resolved('Country')}) FROM retail UNION ALL SELECT 'InvoiceDate', 0 FROM retail HAVING count(*) > 0)")(cleaning.normalise_log)
