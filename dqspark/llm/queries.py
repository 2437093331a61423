"""The corpus operators as queries over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chroma, decontaminate, langid, line_dedup, mixing, sharding, simhash, substring_dedup, token_shards, toxicity
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("kept_text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("kept_text")


def op3_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no audio among the tables: the UTF-8 bytes of each text are the samples of its recording."""
    return chroma.match(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_line_dedup, op2_substring_dedup, op3_chroma, op4_toxicity, op5_language_id, op6_mixing, op7_decontamination, op8_simhash, op9_sharding, op10_token_shards]
    return {f.__name__: f for f in own}


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT d.doc_id, d.i, d.line, o.keeper IS NOT NULL AND o.keeper <> d.doc_id AS dropped
  FROM keyed d LEFT JOIN often o ON d.k = o.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SUBSTRING_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
hashed AS (
  SELECT doc_id, list_transform(generate_series(1, len(ws) - 49), lambda i: md5(array_to_string(ws[i:i + 49], ' '))) AS hs
  FROM texts WHERE len(ws) >= 50),
windows AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM hashed),
first AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i
  FROM windows JOIN first USING (h) WHERE doc_id > low),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
sized AS (SELECT item, ws, least(10, len(ws)) AS n FROM items WHERE len(ws) > 0),
item_windows AS (
  SELECT DISTINCT item, n, unnest(list_transform(generate_series(1, len(ws) - n + 1), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
  FROM sized),
doc_lists AS (
  SELECT doc_id, n, list_transform(generate_series(1, len(ws) - n + 1), lambda i: array_to_string(ws[i:i + n - 1], ' ')) AS gs
  FROM texts, (SELECT DISTINCT n FROM sized) WHERE len(ws) >= n),
doc_windows AS (SELECT doc_id, n, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM doc_lists),
hits AS (SELECT doc_id, n, i, item FROM doc_windows JOIN item_windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
whose AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN words USING (doc_id) LEFT JOIN whose USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_SQL, "op2_substring_dedup": SUBSTRING_SQL, "op6_mixing": mixing.MIX_SQL, "op7_decontamination": DECONTAMINATION_SQL}
