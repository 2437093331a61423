"""Substring dedup by level-wise doubling.

Each word covered by a window of ``window`` words whose word sequence also starts in a document of a smaller doc_id is
removed. Windows are judged on the input.

1. First level, half the length: windows of ``window // 2`` words. Not each of them is shuffled: every full window is
   represented by the smallest hash of the half windows in it, which is the same wherever its words are the same, and a
   document gives each such hash once (about one for 13 words), with a sum of the hashes of the full windows that it
   stands for. Hashes that only one document has die here. Where a smaller document has a hash with the same sum, it has
   the same full windows, and all of them go.
2. Second level, the full length: what is left, windows whose representative lives in different surroundings, is extended
   to ``window`` words. They are compared document against document: the smallest doc_id with a window keeps it, the
   others lose it. Windows with a representative that many documents share are first dealt to salted groups by document;
   whoever is not the smallest of a group is decided there, and only the groups' smallest go on, so that no group has all
   rows of a hot passage.
3. Doubling ends as no longer window can remove a word that the full length doesn't.

A window is compared by two 64-bit hashes (the half window's and its own). Texts are shuffled once: both joins with them
use the same exchange. Defined cases: a null, empty or short text has no window and keeps all words; rows of one doc_id
are one document, so they never remove each other's words; a null doc_id is below all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Out, batch_of, bound_batches, columns, covered, cut, doc_key, given_back, mix64, own_columns, rows_of, schema_with, ship, sliding_min, window_hashes, with_own, word_hashes

ship(__name__)

#: Documents that share a half window from which its full windows are salted.
HOT = 2_000


def representatives(words: np.ndarray, window: int) -> np.ndarray:
    """For each full window, the smallest (mixed) hash of the half windows inside it."""
    half = max(1, window // 2)
    return sliding_min(mix64(window_hashes(words, half)), window - half + 1)


def _first_level(window: int):
    schema = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("v", pa.int64()), ("around", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for k, th, text in rows_of(batches, "k", "th", "text"):
            words = (text or b"").split()
            if len(words) >= window:
                hashed = word_hashes(words)
                v, full = representatives(hashed, window), mix64(window_hashes(hashed, window), 1)
                order = np.argsort(v)
                v = v[order]
                first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                v, around = v[first], np.add.reduceat(full[order], first)
                if out.add(np.full(len(v), k, np.int64), np.full(len(v), th, np.int64), v.view(np.int64), around.view(np.int64)):
                    yield out.take()
        yield out.take()

    return run


def _among(values: list[int], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where v has one of the values, and which."""
    known = np.array(values, np.int64).view(np.uint64)
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], v), len(known) - 1)
    start = np.flatnonzero(known[order][at] == v)
    return start, order[at[start]]


def _second_level(window: int):
    schema = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("v", pa.int64()), ("h", pa.int64()), ("salts", pa.int32())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for k, th, text, alive in rows_of(batches, "k", "th", "text", "alive"):
            if not alive:
                continue
            words = word_hashes(text.split())
            v = representatives(words, window)
            start, which = _among([a["v"] for a in alive], v)
            salts = np.array([a["salts"] for a in alive], np.int32)
            h, once = np.unique(window_hashes(words, window)[start], return_index=True)
            if out.add(np.full(len(h), k, np.int64), np.full(len(h), th, np.int64), v[start][once].view(np.int64), h.view(np.int64), salts[which][once]):
                yield out.take()
        yield out.take()

    return run


MADE = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.binary())])


def _remove(window: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lost, gone in zip(*columns(batch, "text", "lost", "gone"), strict=True):
                words = (text or b"").split()
                n = len(words)
                if lost or gone:
                    hashed = word_hashes(words)
                    starts = [_among(lost, window_hashes(hashed, window))[0]] if lost else []
                    starts += [_among(gone, representatives(hashed, window))[0]] if gone else []
                    out = covered(n, np.concatenate(starts), window)
                    words = [w for w, g in zip(words, out.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept))
            yield with_own(batch, MADE.names, batch_of(MADE, rows).columns)

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, keep: list[str] | None = None) -> DataFrame:
    """docs (columns ``keep``, all by default) with n_words, n_removed, kept_sha256 and kept_text (binary UTF-8)."""
    bound_batches(docs.sparkSession)
    own, names = own_columns(docs, keep, tuple(MADE.names))
    texts = docs.select(*own, doc_key().alias("k"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    first = texts.select("k", "th", "text").mapInArrow(_first_level(window), "k long, th long, v long, around long")
    shared = first.groupBy("v").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n"), (F.min("around") == F.max("around")).alias("alike")).filter("low < high")
    salts = F.when(F.col("n") > HOT, F.ceil(F.sqrt(F.col("n")))).otherwise(1).cast("int").alias("salts")
    met = first.join(shared.select("v", "low", "alike", salts), "v")
    same = W.partitionBy("v", "around", F.pmod(F.xxhash64("k"), F.col("salts")))
    judged = met.withColumn("gone", (F.col("k") > F.min("k").over(same)) | (F.col("alike") & (F.col("k") > F.col("low"))))
    gone, alive = F.when(F.col("gone"), F.col("v")), F.when(~F.col("gone") & ~F.col("alike"), F.struct("v", "salts"))
    plan = cut(judged.groupBy("k", "th").agg(F.collect_list(gone).alias("gone"), F.collect_list(alive).alias("alive")))
    # all columns go to both joins of the texts, so that both read one exchange
    windows = texts.join(plan.select("k", "th", "alive"), ["k", "th"], "left").mapInArrow(_second_level(window), "k long, th long, v long, h long, salts int")
    near = windows.withColumn("low", F.min("k").over(W.partitionBy("h", "v", F.pmod(F.xxhash64("k"), F.col("salts")))))
    left = near.filter("k > low or salts > 1").withColumn("apart", F.when(F.col("k") > F.col("low"), F.pmod(F.xxhash64("k"), F.lit(1_000_000))).otherwise(-1))
    lost = left.withColumn("least", F.min("k").over(W.partitionBy("h", "v", "apart"))).filter("apart >= 0 or k > least")
    lost = plan.select("k", "th", "gone").join(lost.groupBy("k", "th").agg(F.collect_set("h").alias("lost")), ["k", "th"], "left")
    joined = texts.join(lost, ["k", "th"], "left")
    out = joined.mapInArrow(_remove(window), schema_with(joined, "n_words long, n_removed long, kept_sha256 string, kept_text binary"))
    return out.select(*given_back(names), *MADE.names)
