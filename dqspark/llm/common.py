"""Helpers shared by the corpus operators: shipping, checkpoints, hashing, word arrays."""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Stands for a null doc_id wherever ids are compared or joined: smaller than any other id.
NULL_ID = -(2**63)
#: Largest Arrow batch sent to a Python worker, so that long texts don't pile up there.
BATCH_BYTES = 4 << 20


def ship(name: str) -> None:
    """Pickle the module's functions by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. A folder of this machine stands in for it in local mode only, where driver
    and executors are one process; on a cluster a missing setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


_OPEN: list[list[Callable[[], None]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Folders that are made inside go at its end."""
    _OPEN.append([])
    try:
        yield
    finally:
        for remove in _OPEN.pop():
            remove()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes at the end of scratch(), or when the driver's Python ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def safely() -> None:
        try:
            remove()
        except Exception:  # the session has ended before; its shared folder is the cluster's to clear
            return

    if _OPEN:
        _OPEN[-1].append(safely)
    else:
        atexit.register(safely)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads take the columns they need, and cut off its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Spark deletes shuffle files when the driver collects the plan that made them; with an idle heap that can be very late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("bB"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def own_columns(docs: DataFrame, keep: list[str] | None = None, made: tuple[str, ...] = ()) -> tuple[list[Column], list[str]]:
    """docs' columns (``keep``, all by default) that no result replaces, as c_0, c_1 and so on, and their own names: so no
    column of docs, whatever its name, clashes with a column that an operator uses."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    return [F.col("`" + c.replace("`", "``") + "`").alias(f"c_{i}") for i, c in enumerate(names)], names


def given_back(names: list[str]) -> list[Column]:
    return [F.col(f"c_{i}").alias(c) for i, c in enumerate(names)]


def schema_with(df: DataFrame, made: str = "") -> T.StructType:
    """The schema of df's own columns (c_0 and so on), and of what an operator makes."""
    own = [T.StructField(f.name, f.dataType) for f in df.schema if f.name.startswith("c_")]
    return T.StructType([*own, *(T.StructType.fromDDL(made) if made else [])])


def with_own(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    """The batch's own columns (c_0 and so on) beside made ones."""
    own = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name.startswith("c_")]
    return pa.RecordBatch.from_arrays([*(x for _, x in own), *arrays], names=[*(n for n, _ in own), *names])


def doc_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def held_out(name: str = "doc_id") -> Column:
    """The rows no label is learnt from: crc32 of the id as text leaves 2 modulo 4 (a null id is never held out)."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def few(df: DataFrame, h: Column, most: int, by: str | None = None) -> DataFrame:
    """The ``most`` rows of least hash (of each value of column ``by``), a uniform sample of rows.

    Rows are counted first, and only those whose hash is below about twice the wanted share go on to be ranked: what
    is ranked is bounded by the sample and not by the table.
    """
    hashed = df.withColumn("_u", F.shiftrightunsigned(h, 1) / F.lit(2.0**63))
    if by is None:
        return hashed.filter(F.col("_u") < F.lit((2.0 * most + 100) / max(1, df.count()))).orderBy("_u", *df.columns).limit(most).drop("_u")
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))  # a row for each value of by
    near = hashed.join(F.broadcast(counts), by).filter(F.col("_u") < F.lit(2.0 * most + 100) / F.col("_n"))
    ranked = near.withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy("_u", *df.columns)))
    return ranked.filter(F.col("_i") <= most).drop("_u", "_n", "_i")


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def doubled(level: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of windows of twice the length from hashes of windows of one length (polynomial modulo 2**64)."""
    return level[:-length] * np.uint64(pow(base, length, 2**64)) + level[length:] if len(level) > length else level[:0]


def window_hashes(words: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes of all windows of so many words, by doubling over the binary digits of length."""
    n = len(words) - length + 1
    if n <= 0:
        return words[:0]
    out, done, level, size = np.zeros(n, np.uint64), 0, words, 1
    while True:
        if length & size:
            out = out * np.uint64(pow(base, size, 2**64)) + level[done : done + n]
            done += size
        if done == length:
            return out
        level, size = doubled(level, size, base), 2 * size


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    if len(x) < width:
        return x[:0]
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + lengths, n), -1)
    return np.cumsum(steps[:-1]) > 0


def long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*columns(batch, *names), strict=True)


class Out:
    """Gathers numpy arrays per column and gives record batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 200_000):
        self.schema, self.most, self.parts, self.n = schema, most, [[] for _ in schema], 0

    def add(self, *values: np.ndarray) -> bool:
        for part, v in zip(self.parts, values, strict=True):
            part.append(v)
        self.n += len(values[0])
        return self.n >= self.most

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(np.concatenate(p) if p else np.zeros(0, f.type.to_pandas_dtype()), f.type) for p, f in zip(self.parts, self.schema, strict=True)]
        self.parts, self.n = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)
