"""Line dedup by sharded minimal perfect hashes.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code
points that ``min_docs`` documents hold lose all their lines but in the largest doc_id.

1. Every document gives the 128-bit hashes of its distinct eligible keys; counting them (partial sums first) gives the
   distinct hashes with their document counts and largest ids.
2. Hashes are dealt to shards. Each shard gets a minimal perfect hash (a cascade of bit arrays) that indexes an array of
   32-bit fingerprints and one of counts, saturated at what a byte holds (four bytes if ``min_docs`` needs more); ids are
   kept only for counts of ``min_docs`` or more, by rank.
3. Probes (hash, document) go to the shards, not to the lines: a task streams through its probes, sorted behind the
   arrays of their shard. A shard with many probes, such as that of one very common line, is copied to several tasks and
   its probes are dealt among them by document.
4. The hashes to drop return to their documents, where the text is cut.

Defined cases: a null or empty text is one empty line; rows with one doc_id count as one document and each is cut; a null
doc_id is a document with an id below all others; other columns, whatever their names, stay (``dedup_lines``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Out, batch_of, bound_batches, columns, cut, doc_key, given_back, mix64, own_columns, rows_of, schema_with, ship, with_own

ship(__name__)

SPACE = b" \t\n\x0b\x0c\r"
#: Distinct lines to a shard, and shards at most.
SHARD_KEYS, MOST_SHARDS = 16_384, 500_000
#: Probes that one copy of a shard answers.
PROBES = 200_000
LINE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("k", pa.int64())])


def line_hash(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128-bit hash of an eligible line's key."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (not key.isascii() and sum(b & 0xC0 != 0x80 for b in key) < min_chars):
        return None
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & (2**64 - 1)


# --- minimal perfect hash ---------------------------------------------------------------------------------------------


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h1 ^ mix64(h2, level + 1), level) % np.uint64(size)).astype(np.int64)


def build_mph(h1: np.ndarray, h2: np.ndarray, gamma: float = 2.0) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits of a minimal perfect hash over distinct 128-bit keys: each level keeps the keys that meet no
    other key in it, the rest go on to the next."""
    sizes, bits, left = [], [], np.arange(len(h1))
    while len(left):
        size = max(64, -(-int(gamma * len(left)) // 64) * 64)
        slot = _slots(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~alone[slot]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, np.uint64)


class Mph:
    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """0 to n-1 for each key that was built in, any of these or -1 for others."""
        out, left, word = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            slot = _slots(h1[left], h2[left], level, size)
            w, bit = word + (slot >> 6), (slot & 63).astype(np.uint64)
            hit = (self.bits[w] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[w] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[w] + below)[hit]
            left, word = left[~hit], word + size // 64
            if not len(left):
                break
        return out


# --- tasks ------------------------------------------------------------------------------------------------------------


def _hash_lines(min_chars: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        out = Out(LINE)
        for k, text in rows_of(batches, "k", "text"):
            found = {h for line in (text or b"").split(b"\n") if (h := line_hash(line, min_chars))}
            if found:
                h1, h2 = np.array(list(found), np.uint64).T.copy().view(np.int64)
                if out.add(h1, h2, np.full(len(h1), k, np.int64)):
                    yield out.take()
        yield out.take()

    return run


SHARD = "shard int, salt int, kind int, sizes array<int>, bits binary, fingerprints binary, counts binary, keepers binary, h1 long, h2 long, k long"


def count_type(min_docs: int) -> type:
    """The smallest type whose saturated counts still tell ``min_docs`` apart."""
    return np.uint8 if min_docs <= 255 else np.uint32


def _build_shards(min_docs: int):
    kind = count_type(min_docs)

    def run(key, pdf):
        import pandas as pd

        h1, h2 = (pdf[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        sizes, bits = build_mph(h1, h2)
        at = Mph(sizes, bits).index(h1, h2)
        fingerprints, counts, keepers = np.zeros(len(at), np.uint32), np.zeros(len(at), kind), np.zeros(len(at), np.int64)
        fingerprints[at] = (h2 >> np.uint64(32)).astype(np.uint32)
        counts[at] = np.minimum(pdf["n_docs"].to_numpy(), np.iinfo(kind).max)
        keepers[at] = pdf["keeper"].to_numpy()
        kept = keepers[counts >= min_docs]
        return pd.DataFrame({"shard": [key[0]], "sizes": [sizes], "bits": [bits.tobytes()], "fingerprints": [fingerprints.tobytes()], "counts": [counts.tobytes()], "keepers": [kept.tobytes()]})

    return run


def _probe(min_docs: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        now, mph, out = None, None, Out(LINE)
        for batch in batches:
            shard, salt, kind = (batch.column(i).to_numpy() for i in (0, 1, 2))
            h1, h2, k = (batch.column(i).fill_null(0).to_numpy() for i in (8, 9, 10))
            edges = np.flatnonzero(np.diff(shard) | np.diff(salt) | np.diff(kind)) + 1
            for a, b in zip([0, *edges], [*edges, len(shard)], strict=True):
                if a == b:
                    continue
                if kind[a] == 0:
                    sizes, bits, fp, counts, keepers = (batch.column(i)[a].as_py() for i in range(3, 8))
                    mph, fp, counts = Mph(sizes, np.frombuffer(bits, np.uint64)), np.frombuffer(fp, np.uint32), np.frombuffer(counts, count_type(min_docs))
                    often = counts >= min_docs
                    now, rank, keepers = (shard[a], salt[a]), np.cumsum(often) - 1, np.frombuffer(keepers, np.int64)
                    continue
                assert now == (shard[a], salt[a]), "probes without their shard"
                p, q = h1[a:b].view(np.uint64), h2[a:b].view(np.uint64)
                at = mph.index(p, q)
                hit = (at >= 0) & (fp[at] == (q >> np.uint64(32)).astype(np.uint32)) & often[at]
                at = at[hit]
                drop = keepers[rank[at]] != k[a:b][hit]
                if out.add(h1[a:b][hit][drop], h2[a:b][hit][drop], k[a:b][hit][drop]):
                    yield out.take()
        yield out.take()

    return run


def _rewrite(min_chars: int, schema: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, drops in zip(*columns(batch, "text", "drops"), strict=True):
                lines = (text or b"").split(b"\n")
                n = len(lines)
                if drops:
                    gone = {(d["h1"] % 2**64, d["h2"] % 2**64) for d in drops}
                    lines = [x for x in lines if line_hash(x, min_chars) not in gone]
                kept = b"\n".join(lines)
                rows.append((n, n - len(lines), hashlib.sha256(kept).hexdigest(), kept))
            yield with_own(batch, schema.names, batch_of(schema, rows).columns)

    return run


MADE = pa.schema([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.binary())])


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(k, h1, h2): which line hashes each document loses."""
    bound_batches(docs.sparkSession)
    texts = docs.select(doc_key().alias("k"), F.col("text").cast("binary").alias("text"))
    lines = texts.mapInArrow(_hash_lines(min_chars), "h1 long, h2 long, k long")
    stats = cut(lines.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("k").alias("keeper")))
    distinct = stats.count()
    n = min(MOST_SHARDS, max(1, -(-distinct // SHARD_KEYS)))
    shard = F.pmod(F.col("h1"), F.lit(n)).cast("int").alias("shard")
    arrays = stats.withColumn("shard", shard).groupBy("shard").applyInPandas(_build_shards(min_docs), "shard int, sizes array<int>, bits binary, fingerprints binary, counts binary, keepers binary")
    copies = stats.groupBy(shard).agg(F.ceil(F.sum("n_docs") / F.lit(PROBES)).cast("int").alias("copies"))  # at most MOST_SHARDS rows
    arrays = arrays.join(F.broadcast(copies), "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"))
    probes = lines.withColumn("shard", shard).join(F.broadcast(copies), "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("k"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("kind"), "h1", "h2", "k")
    both = arrays.unionByName(probes, allowMissingColumns=True).selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in SHARD.split(", ")))
    tasks = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return tasks.mapInArrow(_probe(min_docs), "h1 long, h2 long, k long")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: list[str] | None = None) -> DataFrame:
    """docs (columns ``keep``, all by default) with n_lines, n_dropped, kept_sha256 and kept_text (binary UTF-8)."""
    drops = repeated_lines(docs, min_chars, min_docs).groupBy("k").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    own, names = own_columns(docs, keep, tuple(MADE.names))
    joined = docs.select(*own, doc_key().alias("k"), F.col("text").cast("binary").alias("text")).join(drops, "k", "left")
    made = joined.mapInArrow(_rewrite(min_chars, MADE), schema_with(joined, "n_lines long, n_dropped long, kept_sha256 string, kept_text binary"))
    return made.select(*given_back(names), *MADE.names)
