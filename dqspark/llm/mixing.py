"""Mixing sources to target weights by temperature, with DataFrame functions only.

A document has max(1, words) tokens (words are runs of other than ASCII white space). A source's weight is its token
share to the power of an exponent between 0 (all alike) and 1 (as they are), over the sum of these. The exponent is
bisected to the least one whose repetition (most over fewest passes over a source) keeps a limit, or to the one that
meets a target entropy of the weights, inside one row of source totals. The budget of tokens is the least that passes
over every source once, unless given. A source then has budget * weight tokens: whole passes over it and a part of one,
whose documents are the first ones in that pass's own permutation (by a keyed hash of document and pass).

Block permutations realise the mix in order: the budget is cut into blocks of ``block_tokens``; a document's block is
that of its place in its source's stream, so each block has all sources by weight, and each block is permuted by itself.
No source is one task: streams are added up in cells (hash ranges of a source, as many as it has documents for), whose
few totals give each cell its offset.

Defined cases: a null source is the source ''; null and empty texts count one token; rows of one doc_id are documents of
their own (alike ones interchange); an empty table gives no row; extra columns stay (``mix``). Sources, unlike documents,
are few: their totals are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import given_back, own_columns

#: Documents of a cell, and the cells that the totals of a pass are kept in at most.
CELL_DOCS, MOST_CELLS = 4_096, 65_536
STEPS = 60


def tokens() -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]++"))).cast("long")


def _repetition(alpha: Column, totals: Column) -> Column:
    passes = F.transform(totals, lambda t: F.pow(t, alpha - 1))
    return F.array_max(passes) / F.array_min(passes)


def _entropy(alpha: Column, totals: Column) -> Column:
    powers = F.transform(totals, lambda t: F.pow(t, alpha))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(powers, F.lit(0.0), lambda a, x: a - x / total * F.ln(x / total))


def weights(totals: DataFrame, repetition: float | None = 2.0, entropy: float | None = None) -> DataFrame:
    """totals (source, docs, total) with alpha and weight; one of repetition and entropy is the target.

    ``entropy`` is a share of the largest possible, ln(number of sources); targets beyond what exponents from 0 to 1
    give end at 0 or 1. Both measures fall as the exponent grows.
    """
    if (repetition is None) == (entropy is None):
        raise ValueError("one target: repetition or entropy")
    row = totals.agg(F.array_sort(F.collect_list(F.struct("source", "docs", "total"))).alias("s")).withColumn("t", F.transform("s", lambda x: x["total"].cast("double")))

    def measure(alpha: Column) -> Column:
        return _repetition(alpha, F.col("t")) > F.lit(float(repetition)) if entropy is None else _entropy(alpha, F.col("t")) > F.lit(float(entropy)) * F.ln(F.size("t").cast("double"))

    def step(bounds: Column, _: Column) -> Column:
        mid = (bounds["low"] + bounds["high"]) / 2
        return F.when(measure(mid), F.struct(mid.alias("low"), bounds["high"].alias("high"))).otherwise(F.struct(bounds["low"].alias("low"), mid.alias("high")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    bounds = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    alpha = F.when(~measure(F.lit(0.0)), F.lit(0.0)).otherwise(bounds["high"])
    found = row.withColumn("alpha", alpha).withColumn("p", F.aggregate(F.transform("t", lambda x: F.pow(x, F.col("alpha"))), F.lit(0.0), lambda a, x: a + x))
    each = found.select("alpha", "p", F.explode("s").alias("x")).select("x.*", "alpha", (F.pow(F.col("x.total").cast("double"), F.col("alpha")) / F.col("p")).alias("weight"))
    return each


def plan(docs: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """(source, docs, total, alpha, weight, copies, budget): copies is how often a source is passed over."""
    own = docs.select(F.coalesce("source", F.lit("")).alias("source"), tokens().alias("tokens"))
    each = weights(own.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("total")), repetition, entropy)
    size = F.lit(float(budget)) if budget is not None else F.max(F.col("total") / F.col("weight")).over(W.partitionBy())  # over the few sources
    return each.withColumn("budget", size).withColumn("copies", F.round(F.col("weight") * F.col("budget") / F.col("total"), 9))


def _hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))


def mix(docs: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, budget: float | None = None, block_tokens: int = 1_000_000, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """docs (columns ``keep``, all by default) with mix_source, tokens, alpha, weight, epoch, block and place (from 0 in a block),
    one row for each time that the mix has a document."""
    made = ["mix_source", "tokens", "alpha", "weight", "epoch", "block", "place"]
    own, names = own_columns(docs, keep, tuple(made))
    planned = plan(docs, repetition, entropy, budget)
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(*own, id_.alias("id"), F.coalesce("source", F.lit("")).alias("source"), tokens().alias("tokens"))
    passes = rows.join(planned, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("copies"), F.lit(1)).cast("int") - 1)))
    cells = F.least(F.lit(MOST_CELLS), F.ceil(F.col("docs") / F.lit(CELL_DOCS)))
    hashed = passes.withColumn("h", _hash(seed, F.col("id"), F.col("epoch"))).withColumn("cell", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * cells / F.lit(2.0**32)).cast("int"))
    sums = hashed.groupBy("source", "epoch", "cell").agg(F.sum("tokens").alias("in_cell"))
    before = W.partitionBy("source", "epoch").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # MOST_CELLS rows at most
    offsets = sums.select("source", "epoch", "cell", F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("source", "epoch", "cell").orderBy("h", "id", "tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = hashed.join(offsets, ["source", "epoch", "cell"]).withColumn("upto", F.col("offset") + F.sum("tokens").over(inside))
    part = F.col("upto") <= F.round((F.col("copies") - F.col("epoch")) * F.col("total"), 3)
    taken = placed.filter((F.col("epoch") + 1 <= F.col("copies")) | part)
    share = (F.col("epoch") * F.col("total") + F.col("upto") - F.col("tokens")) / (F.col("copies") * F.col("total"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("budget") / F.lit(block_tokens)))
    blocked = taken.withColumn("block", F.floor(F.round(share * blocks, 9)).cast("long")).withColumn("g", _hash(seed + 1, F.col("id"), F.col("epoch")))
    place = F.row_number().over(W.partitionBy("block").orderBy("g", "id", "tokens")).cast("long") - 1  # about block_tokens
    return blocked.withColumn("place", place).select(*given_back(names), F.col("source").alias("mix_source"), "tokens", F.round("alpha", 6).alias("alpha"), F.round("weight", 6).alias("weight"), "epoch", "block", "place")


#: mix() with its defaults, for (doc_id, mix_source, ...) of documents.
MIX_SQL = r"""
WITH RECURSIVE own AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, coalesce(source, '') AS source,
         greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS tokens
  FROM documents),
totals AS (SELECT source, CAST(sum(tokens) AS DOUBLE) AS total FROM own GROUP BY source),
ends AS (SELECT min(total) AS a, max(total) AS b FROM totals),
bisected(i, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN much THEN mid ELSE low END, CASE WHEN much THEN high ELSE mid END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid, pow(a, (low + high) / 2 - 1) / pow(b, (low + high) / 2 - 1) > 2 AS much FROM bisected, ends WHERE i < 60)),
found AS (SELECT CASE WHEN b / a <= 2 THEN 0 ELSE high END AS alpha FROM bisected, ends WHERE i = 60),
weighed AS (SELECT source, total, alpha, pow(total, alpha) / (SELECT sum(pow(total, alpha)) FROM totals, found) AS weight FROM totals, found),
planned AS (SELECT *, round(weight * budget / total, 9) AS copies FROM weighed, (SELECT max(total / weight) AS budget FROM weighed)),
passes AS (
  SELECT o.*, total, alpha, weight, budget, copies, unnest(generate_series(0, CAST(greatest(ceil(copies), 1) AS INT) - 1)) AS epoch
  FROM own o JOIN planned USING (source)),
placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source, epoch ORDER BY md5('42:' || id || ':' || epoch), id, tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM passes),
blocked AS (
  SELECT *, CAST(floor(round((epoch * total + upto - tokens) / (copies * total) * greatest(1, ceil(budget / 1000000)), 9)) AS BIGINT) AS block
  FROM placed WHERE epoch + 1 <= copies OR upto <= round((copies - epoch) * total, 3))
SELECT doc_id, source AS mix_source, tokens, round(alpha, 6) AS alpha, round(weight, 6) AS weight, CAST(epoch AS INT) AS epoch, block,
       row_number() OVER (PARTITION BY block ORDER BY md5('43:' || id || ':' || epoch), id, tokens) - 1 AS place
FROM blocked
"""
