"""Token-ID shards in training order.

Texts become token ids of a public vocabulary (its file's path is a parameter), with an end id after each, cut into
sequences of a fixed length; the last one of a text is filled with end ids. Sequences are numbered without gaps; a keyed
Feistel permutation on the least even number of bits that holds all numbers, walked along its cycle while it leaves the
range, gives each sequence its global slot. Slots are dealt in ranges to shards, each written in slot order with one
stride: the sequence at slot s begins ``stride * (s % per_shard)`` bytes into shard ``s // per_shard``, so a reader can
go on at any slot. No table of the permutation exists anywhere.

The sequences are written once to the shared folder before they are numbered, so a lost executor renumbers nothing and
no text is tokenised twice. Defined cases: null and empty texts are one sequence of end ids and have 0 tokens; strings of
special tokens in a text are ordinary text; rows of one doc_id are texts of their own; an empty table gives no row.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, mix64, rows_of, ship, written

ship(__name__)

#: Fixed value: the pattern that splits text before merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY, END, LENGTH, PER_SHARD = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, 512, 4_096
ROUNDS = 4
_ENCODERS: dict = {}


def encoder(ranks: bytes):
    import tiktoken

    key = zlib.crc32(ranks)
    if key not in _ENCODERS:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding(f"public-{key}", pat_str=PATTERN, mergeable_ranks=found, special_tokens={})
    return _ENCODERS[key]


def sequences(ids: list[int], length: int, end: int) -> np.ndarray:
    """One row of so many ids for each sequence of a text."""
    n = len(ids) + 1
    out = np.full(-(-n // length) * length, end, np.uint16)
    out[: n - 1] = ids
    return out.reshape(-1, length)


def _tokenise(held, length: int, end: int):
    schema = pa.schema([("task", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int32()), ("tokens", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        task, at, encode, rows = TaskContext.get().partitionId(), 0, encoder(held.value).encode_ordinary, []
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = encode(text or "")
            for part, s in enumerate(sequences(ids, length, end)):
                rows.append((task, at, doc_id, part, min(length, len(ids) - part * length), s.tobytes()))
                at += 1
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def feistel(x: np.ndarray, bits: int, key: int) -> np.ndarray:
    """A permutation of the numbers of 2 * bits bits."""
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for i in range(ROUNDS):
        left, right = right, left ^ (mix64(right, key * ROUNDS + i) & mask)
    return (left << np.uint64(bits)) | right


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 to n-1: the Feistel permutation, again for those that it takes out of the range."""
    bits = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    out = feistel(x.astype(np.uint64), bits, key)
    while (far := out >= np.uint64(n)).any():
        out[far] = feistel(out[far], bits, key)
    return out.astype(np.int64)


def shards(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 42) -> DataFrame:
    """(slot, shard, offset, doc_id, part, n_tokens, tokens), a row for each sequence; a partition holds whole shards in
    slot order, tokens are ``length`` little-endian 16-bit ids."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(vocabulary, "rb") as f:  # on the driver; about a megabyte is broadcast
        held = spark.sparkContext.broadcast(f.read())
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(held, length, end), "task int, at long, doc_id long, part int, n_tokens int, tokens binary")
    stored = written(made, "tokens")
    counts = sorted(stored.groupBy("task").count().collect())  # a row for each task of the scan
    starts, n = {}, 0
    for task, count in counts:
        starts[task], n = n, n + count
    total, offsets = n, np.zeros(max(starts, default=0) + 1, np.int64)
    for task, start in starts.items():
        offsets[task] = start
    begin = spark.sparkContext.broadcast(offsets)

    @F.pandas_udf(T.LongType())
    def slot_of(task: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(permute(begin.value[task.to_numpy()] + at.to_numpy(), total, key))

    slotted = stored.select(slot_of("task", "at").alias("slot"), "doc_id", "part", "n_tokens", "tokens").withColumn("shard", F.floor(F.col("slot") / F.lit(per_shard)).cast("long"))
    placed = slotted.withColumn("offset", (F.col("slot") % per_shard) * F.lit(2 * length))
    ranges = max(1, -(-total // per_shard))
    return placed.repartitionByRange(min(ranges, 20_000), "shard").sortWithinPartitions("slot").select("slot", "shard", "offset", "doc_id", "part", "n_tokens", "tokens")


def _join(batches) -> Iterator[pa.RecordBatch]:
    """Rows in slot order -> one row for each shard."""
    now, first, parts = None, 0, []
    row = lambda: pa.RecordBatch.from_pydict({"shard": [now], "first_slot": [first], "n": [len(parts)], "payload": [b"".join(parts)]}, schema=pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())]))
    for slot, shard, tokens in rows_of(batches, "slot", "shard", "tokens"):
        if shard != now:
            if parts:
                yield row()
            now, first, parts = shard, slot, []
        parts.append(tokens)
    if parts:
        yield row()


def write(docs: DataFrame, path: str, **options) -> None:
    """Shard payloads, each the ids of its sequences in slot order at one stride, as a Parquet table by shard."""
    shards(docs, **options).mapInArrow(_join, "shard long, first_slot long, n long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str, slot: int, n: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """The ids of n sequences from a slot on: only the shards that hold them are read, and only those bytes leave them."""
    low, high = slot // per_shard, (slot + n - 1) // per_shard
    a = F.greatest(F.lit(0), F.lit(slot) - F.col("first_slot"))
    b = F.least(F.col("n"), F.lit(slot + n) - F.col("first_slot"))
    cut = F.substring(F.col("payload"), (a * (2 * length) + 1).cast("int"), ((b - a) * (2 * length)).cast("int"))
    rows = spark.read.parquet(path).filter(F.col("shard").between(low, high)).orderBy("shard").select(cut.alias("x")).collect()
    return np.frombuffer(b"".join(bytes(r.x) for r in rows), np.uint16).reshape(-1, length)
