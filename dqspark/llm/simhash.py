"""SimHash near-dedup with pigeonhole blocks.

A text's fingerprint has a bit where over half of the XXH64 hashes (seed 42) of its word shingles have it. Two
fingerprints link at ``distance`` or fewer differing bits; a component is what links reach.

Fingerprints are made distinct first, so copies never pair. Of six blocks of bits, three or fewer differing bits leave at
least three blocks alike: each fingerprint is dealt under each choice of three blocks (20 keys of 30 to 33 bits), those with one key
are candidates, and Hamming distances decide. A key's fingerprints give a spanning forest of their links and not all
pairs. A key with more than ``HOT`` fingerprints (a dense group of near copies) is split the same way on the bits that
the key leaves free, which finds the same links, until it is small or no bit is left to split on. Components of the
forest edges come from alternating stars.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; fewer words than a shingle has
give one shingle of all words; rows of one doc_id keep their own fingerprints and share the id; a null doc_id is below
all others; ties can't arise, as components are the least doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import NULL_ID, Out, batch_of, bound_batches, columns, cut, doc_key, freed, given_back, mix64, own_columns, rows_of, scratch, ship, window_hashes, word_hashes, written
from .components import components

ship(__name__)

SEED, BLOCKS = 42, 6
#: Fingerprints of one key that are compared with each other; more are split further.
HOT = 16_384
#: Shingles whose bits are counted at once.
PIECE = 1 << 16
WEIGHTS = np.arange(64, dtype=np.uint64)
ALL = 2**64 - 1


def shingle_hashes(text: bytes, size: int = 3) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of so many bits fit in bytes
            counts += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return counts


def fingerprint(text: bytes | None, size: int = 3) -> int:
    h = shingle_hashes(text or b"", size)
    return int((2 * bit_counts(h) > len(h)).astype(np.uint64) @ (np.uint64(1) << WEIGHTS)) if len(h) else 0


def _fingerprints(size: int, keep: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, size) for t in columns(batch, "_text")[0]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made)], names=[*keep, "_fp"])

    return run


def block_masks(free: int, blocks: int = BLOCKS, alike: int = BLOCKS - 3) -> list[int]:
    """Masks of the bits of each choice of ``alike`` out of ``blocks`` blocks of the free bits."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    parts = [sum(p.tolist()) for p in np.array_split(np.array(bits, dtype=object), blocks)] if len(bits) >= blocks else []
    return [sum(c) for c in combinations(parts, alike)]


def forest(fps: np.ndarray, distance: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the distinct fingerprints' components under links, by a search in rows of distances."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= distance
            if near.any():
                new, left = left[near], left[~near]
                a += [i] * len(new)
                b += new.tolist()
                queue += new.tolist()
    return fps[np.array(a, np.int64)], fps[np.array(b, np.int64)]


EDGES = pa.schema([("x", pa.int64()), ("y", pa.int64())])


def _forests(distance: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        out = Out(EDGES)
        for batch in batches:
            for fps in columns(batch, "fps")[0]:
                a, b = forest(np.array(fps, np.int64).view(np.uint64), distance)
                if len(a) and out.add(a.view(np.int64), b.view(np.int64)):
                    yield out.take()
        yield out.take()

    return run


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """fps: distinct longs in column fp. (x, y) of fingerprints that link, enough for the components of all links."""
    if distance != BLOCKS - 3:
        raise ValueError(f"{BLOCKS} blocks are laid out for distance {BLOCKS - 3}")
    spark, signed = fps.sparkSession, lambda m: m - 2**64 if m >= 2**63 else m
    masks, found = block_masks(ALL), None
    dealt = fps.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    while True:  # three times at most: then a key leaves 9 bits free, which is 512 fingerprints
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        keyed = cut(dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        few = dealt.join(keyed.filter(F.col("n") <= HOT).drop("n"), ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        edges = few.select("fps").mapInArrow(_forests(distance), "x long, y long")
        found = edges if found is None else found.unionByName(edges)
        hot = keyed.filter(F.col("n") > HOT)
        if hot.isEmpty():
            return found.distinct()
        deeper = {m: [m | s for s in block_masks(ALL & ~m)] for m in masks}
        finer = spark.createDataFrame([(signed(m), [signed(x) for x in xs]) for m, xs in deeper.items()], "mask long, finer array<long>")
        masks = sorted({x for xs in deeper.values() for x in xs})
        dealt = dealt.join(hot.drop("n"), ["mask", "key"]).join(F.broadcast(finer), "mask").select("fp", F.explode("finer").alias("mask")).distinct()  # finer: 20 or 400 rows


def fingerprints(docs: DataFrame, size: int = 3, keep: list[str] | None = None) -> DataFrame:
    """docs (columns ``keep``) with the fingerprint as a long in _fp."""
    bound_batches(docs.sparkSession)
    keep = list(docs.columns) if keep is None else keep
    own = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "_text"), "`_fp` long"])
    return own.mapInArrow(_fingerprints(size, keep), fields)


def cluster(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id)."""
    hashed = cut(fingerprints(docs, size, ["doc_id"]).select("doc_id", doc_key().alias("k"), F.col("_fp").alias("fp")))
    low = hashed.groupBy("fp").agg(F.min("k").alias("low"))
    joined = components(links(low.select("fp"), distance).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    rooted = low.join(joined, low.fp == joined.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component_id") != NULL_ID, F.col("component_id")).alias("component_id"))


# --- near copies by shingle similarity ----------------------------------------------------------------------------------

#: Texts (about) with a shingle beyond which it is common, and how many of the commonest are told apart at most.
COMMON, MOST_COMMON = 16, 1 << 24
#: Shingles that are counted at once, and those of a bucket.
COUNTED, BUCKET = 1_000_000, 1_000_000
#: Other sets that a set is held against before all pairs that share a key.
PARTNERS = 8
#: First open keys of a set (of those that sets of other components share) by which a pair that shares an earlier key is known.
HEAD = 8
#: Longs of parities that go with each key of a set; those of larger sets are folded to as many.
LOW = 32


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """The distinct hashes of all of the text's shingles, in order."""
    words = word_hashes((text or b"").lower().split())
    return np.unique(mix64(window_hashes(words, min(size, len(words))), len(words) if len(words) < size else 0)) if len(words) else words


def set_name(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def parities(h: np.ndarray) -> np.ndarray:
    """A bit for each bucket of hashes that holds an odd number of them, twice as many buckets as hashes or more, in longs:
    two sets differ in as many hashes as their parities at least."""
    buckets = 1 << max(6, (2 * len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits(np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1 == 1, bitorder="little").view(np.int64)


def parity_distance(a: Column, b: Column) -> Column:
    """In how many buckets parities differ. One may have twice the other's longs: its halves are folded onto each other."""
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda t, n: t + n)
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, F.size(x)), lambda i, j: i.bitwiseXOR(j))
    return F.when(F.size(a) == F.size(b), differ(a, b)).when(F.size(a) > F.size(b), differ(half(a), b)).otherwise(differ(a, half(b)))


def folded(bits: Column) -> Column:
    """Parities of ``LOW`` longs at most: buckets whose low places are alike are one."""
    one = lambda i: F.aggregate(F.sequence(F.lit(0), (F.size(bits) / LOW).cast("int") - 1), F.lit(0).cast("long"), lambda t, j: t.bitwiseXOR(F.get(bits, i + LOW * j)))
    return F.when(F.size(bits) <= LOW, bits).otherwise(F.transform(F.sequence(F.lit(0), F.lit(LOW - 1)), one))


def may_be_near(n: Column, m: Column, a: Column, b: Column) -> Column:
    """What sizes and parities don't rule out: sets of n and m shingles and similarity 0.8 differ in (n + m) / 9."""
    return F.when((5 * F.least(n, m) >= 4 * F.greatest(n, m)), 9 * parity_distance(a, b) <= n + m).otherwise(F.lit(False))


def among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of the hashes a table of bits by their low places has."""
    at = (h.view(np.uint64) & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return table[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def prefix(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in the order of (whether it is common, hash), so many that a set of similarity 0.8 has one of them
    among its own."""
    often, n = among(h, common), len(h) - (4 * len(h) + 4) // 5 + 1
    rare = h[~often][:n]
    return np.concatenate([rare, h[often][: n - len(rare)]])


PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _pack(parts: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Distinct hashes and their counts (up to 65,535; none said if all are 1) by their low bits; 32 bits above are sent."""
    h, n = np.unique(np.concatenate(parts), return_counts=True)
    bucket, n = (h & np.uint64((1 << bits) - 1)).astype(np.int64), np.minimum(n, 65_535).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    at, first = np.unique(bucket[order], return_index=True)
    rows = []
    for i, own in zip(at.tolist(), np.split(order, first[1:]), strict=True):
        rows.append((i, (h[own] >> np.uint64(bits)).astype(np.uint32).tobytes(), n[own].tobytes() if (n[own] > 1).any() else b""))
    return batch_of(PACKED, rows)


def _packed(size: int, bits: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        seen, parts, n = set(), [], 0
        for (text,) in rows_of(batches, "text"):
            h = shingle_set(text, size)
            if len(h) and (s := set_name(h)) not in seen:
                seen.add(s)
                parts.append(h[: 3 * len(h) // 10 + 1])
                n += len(parts[-1])
            if n >= COUNTED:
                yield _pack(parts, bits)
                parts, n = [], 0
        if parts:
            yield _pack(parts, bits)

    return run


def _common(bits: int):
    schema = pa.schema([("th", pa.int64()), ("n", pa.int64())])

    def counted(bucket: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(k := np.concatenate(keys), kind="stable")
        k, n = k[order], np.concatenate(counts)[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.add.reduceat(n, first)
        th = (k[first].astype(np.uint64) << np.uint64(bits)) | np.uint64(bucket)
        return pa.RecordBatch.from_arrays([pa.array(th[n > COMMON].view(np.int64)), pa.array(n[n > COMMON])], schema=schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, keys, counts = -1, [], []
        for bucket, k, n in rows_of(batches, "bucket", "keys", "counts"):
            if bucket != now and keys:
                yield counted(now, keys, counts)
                keys, counts = [], []
            now = bucket
            keys.append(np.frombuffer(k, np.uint32))
            counts.append(np.frombuffer(n, np.uint16) if n else np.ones(len(keys[-1]), np.uint16))
        if keys:
            yield counted(now, keys, counts)

    return run


def common_shingles(own: DataFrame, size: int) -> np.ndarray:
    """A table of bits for shingles of more than ``COMMON`` texts among the first three tenths (by hash) of all texts'
    shingles, 16 MB at most. The table only orders shingles, alike for all texts: what is found doesn't rest on it."""
    words = own.agg(F.sum(F.length("text"))).head()[0] or 0
    bits = max(0, (words // 20 // BUCKET).bit_length())  # three tenths of a word for each six characters
    packed = own.select("text").mapInArrow(_packed(size, bits), "bucket int, keys binary, counts binary")
    found = cut(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_common(bits), "th long, n long"))
    least = COMMON
    while found.filter(F.col("n") > least).count() > MOST_COMMON:
        least *= 2
    return held_bits(found.filter(F.col("n") > least))


def held_bits(names: DataFrame) -> np.ndarray:
    """names (longs in column th) as bits of their low places: 2**27 at most, so others may be among them."""
    size = 1 << min(27, max(16, 5 + names.count().bit_length()))
    at = F.col("th").bitwiseAND(F.lit(size - 1)) + 1
    table = names.groupBy(F.bitmap_bucket_number(at).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toArrow()
    out = np.zeros((size >> 15, 4096), np.uint8)
    for i, bits in zip(*(table.column(c).to_pylist() for c in ("at", "bits")), strict=True):
        out[i - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _prefixes(size: int, held):
    schema = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("bits", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set's keys are given once a task
        for batch in batches:
            names, sizes, bits, keys = [], [], [], []
            for text in columns(batch, "text")[0]:
                h = shingle_set(text, size)
                s = set_name(h)
                names.append(s)
                sizes.append(len(h))
                bits.append(None if s in seen else parities(h))
                keys.append([] if s in seen or not len(h) else prefix(h, held.value).view(np.int64))
                seen.add(s)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("th"), *(pa.array(x, f.type) for x, f in zip((names, sizes, bits, keys), list(schema)[2:], strict=True))], schema=schema)

    return run


def _whole(size: int, held):
    schema = pa.schema([("s", pa.int64()), ("hashes", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows = []
            for text in batch.column("text").filter(pa.array(among(batch.column("th").to_numpy(), held.value))).to_pylist():
                h = shingle_set(text, size)
                s = set_name(h)
                if s not in seen:
                    seen.add(s)
                    rows.append((s, h.tobytes()))
            yield batch_of(schema, rows)

    return run


def _are_near(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for x, y, a, b in zip(*columns(batch, "x", "y", "hx", "hy"), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b)):
                found.append((x, y))
        yield batch_of(EDGES, found)


def verified(open_: DataFrame, sizes: DataFrame, own: DataFrame, size: int) -> DataFrame:
    """Those of pairs (x, y) whose whole sets have similarity 0.8 or more. Texts of open pairs only are hashed again: no
    other set is shuffled."""
    asked = open_.select(F.col("x").alias("s")).unionByName(open_.select(F.col("y").alias("s"))).distinct()
    held = own.sparkSession.sparkContext.broadcast(held_bits(cut(sizes.join(asked, "s").select("th"))))
    sets = own.select("text", "th").mapInArrow(_whole(size, held), "s long, hashes binary")
    sets = written(sets.groupBy("s").agg(F.first("hashes").alias("hashes")), "sets")
    side = lambda c: sets.select(F.col("s").alias(c), F.col("hashes").alias(f"h{c}"))
    return cut(open_.join(side("x"), "x").join(side("y"), "y").mapInArrow(_are_near, "x long, y long").distinct())


def joined(edges: DataFrame) -> DataFrame:
    return components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("x"), F.greatest(a, b).alias("y")


def partners(multi: DataFrame) -> DataFrame:
    """Pairs (x, y) of a set and the ``PARTNERS`` that stand for most of its keys: a key is stood for by its least set, and
    by three sets of about the size, which are the least by a hash and so vary by key."""
    banded = multi.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))))
    by_key = banded.groupBy("key").agg(F.min("s").alias("t"))
    by_band = banded.groupBy("key", "band").agg(F.array(F.min("s"), F.min_by("s", F.xxhash64("s")), F.min_by("s", F.xxhash64("s", "key"))).alias("ts"))
    near = banded.join(by_band, ["key", "band"]).select("s", F.explode(F.array_distinct("ts")).alias("t"))
    votes = near.unionByName(banded.join(by_key, "key").select("s", "t")).filter("s <> t").groupBy("s", "t").agg(F.count(F.lit(1)).alias("n"))
    ranked = votes.withColumn("i", F.row_number().over(W.partitionBy("s").orderBy(F.desc("n"), "t"))).filter(F.col("i") <= PARTNERS)
    return ranked.select(*_pair("s", "t")).distinct()


def alike(own: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (x, y) of sets whose texts' fingerprints link; sets of one fingerprint are paired with the least of them."""
    placed = cut(fingerprints(own, keep=["th"]).join(sizes.select("th", "s"), "th").select("s", F.col("_fp").alias("fp")).distinct())
    least = cut(placed.groupBy("fp").agg(F.min("s").alias("t")))
    one = placed.join(least, "fp").filter("s <> t").select("s", "t")
    side = lambda c, t: least.select(F.col("fp").alias(c), F.col("t").alias(t))
    two = links(least.select("fp")).join(side("x", "s"), "x").join(side("y", "t"), "y").select("s", "t")
    return one.unionByName(two).select(*_pair("s", "t")).distinct()


def open_pairs(multi: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (x, y) of sets that share a key, aren't in one component and may be near, each at the first key it shares. Keys
    that no set of another component has are no one's first: a text's own words would fill its ``HEAD`` and tell nothing."""
    placed = multi.join(found, multi.s == found.node, "left").select("key", "s", "n", "pos", F.coalesce("component", "s").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    by_set = W.partitionBy("s").orderBy("pos")
    ranked = placed.join(mixed, "key").select("*", F.row_number().over(by_set).alias("i"), F.collect_list("key").over(by_set.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("open"))
    before = ranked.select("key", "s", "n", "pos", "c", F.slice("open", F.lit(1), F.least(F.col("i") - 1, F.lit(HEAD))).alias("before"))
    rest = before.join(sizes.select("s", folded(F.col("bits")).alias("bits")), "s")
    less, more = rest.alias("a"), rest.alias("b")  # every condition is on both, so that one exchange serves both
    fits = F.expr("a.key = b.key and a.c <> b.c and (a.n < b.n or a.n = b.n and a.s < b.s) and 5 * a.n >= 4 * b.n and a.pos <= least(a.n, b.n) - (8 * least(a.n, b.n) + 8) div 9 and 9 * least(a.n - a.pos, b.n - b.pos) >= 4 * (a.n + b.n)")
    near = may_be_near(F.col("a.n"), F.col("b.n"), F.col("a.bits"), F.col("b.bits"))
    return less.join(more, fits & near & ~F.expr("arrays_overlap(a.before, b.before)")).select(*_pair("a.s", "b.s"))


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """(k, component) for documents whose component of near copies (similarity 0.8 or more on the sets of shingles of five
    words) has a smaller id; k is doc_key().

    Exact, whatever the number of texts. Equal sets are one. In any order of all shingles, sets of similarity 0.8 share one
    of the first fifth of each (of the first ninth of the smaller): these are keys, and keys of one set only go. Common
    shingles come last in the order, so a passage of many texts is a key only of texts of hardly anything else. First each
    set is held against those that its SimHash fingerprint links it to (three differing bits) and a few sets that share most
    keys with it; pairs are ruled out by sizes and parities and decided on
    the whole sets. Then all pairs of a key that aren't in one component yet are decided in the same way, each at the first
    open key it shares (as far as ``HEAD`` of them tell): a crowded key of near copies is about one component by then, and pairs
    whose parities differ too much are never made.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(doc_key().alias("k"), F.col("text").cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    with scratch():
        held = docs.sparkSession.sparkContext.broadcast(common_shingles(own, size))
        named = written(own.mapInArrow(_prefixes(size, held), "k long, th long, s long, n int, bits array<long>, keys array<long>"), "prefixes")
        keys = named.select("s", "n", F.posexplode("keys").alias("pos", "key"))
        shared = keys.groupBy("key").agg(F.min("s").alias("low"), F.max("s").alias("high")).filter("low <> high").select("key")
        multi = written(keys.join(shared, "key").distinct(), "keys")
        one = [F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"), F.min("th").alias("th")]
        sizes = written(named.join(multi.select("s").distinct(), "s").groupBy("s").agg(*one), "sizes")
        freed(docs.sparkSession)

        side = lambda c: sizes.select(F.col("s").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))

        tried = cut(alike(own, sizes).unionByName(partners(multi)).distinct())
        first = cut(tried.join(side("x"), "x").join(side("y"), "y").filter(may_be_near(F.col("nx"), F.col("ny"), F.col("bx"), F.col("by"))).select("x", "y"))
        found = joined(verified(first, sizes, own, size))
        freed(docs.sparkSession)

        second = cut(open_pairs(multi, found, sizes).distinct().join(tried, ["x", "y"], "left_anti"))
        if not second.isEmpty():
            freed(docs.sparkSession)
            stars = found.filter("node <> component").select(F.col("component").alias("x"), F.col("node").alias("y"))
            found = joined(stars.unionByName(verified(second, sizes, own, size)))

        low = named.groupBy("s").agg(F.min("k").alias("low"))
        rooted = low.join(found, low.s == found.node, "left").select("s", "low", F.coalesce("component", "s").alias("root"))
        least = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component")), "root").select("s", "component")
        return cut(named.join(least, "s").filter("k <> component").select("k", "component").distinct())


def dedup(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs without near copies: of each component the rows of the least doc_id stay (rows that share that id all stay)."""
    own, names = own_columns(docs)
    gone = near_duplicates(docs, size).select("k").distinct()
    return docs.select(*own, doc_key().alias("k")).join(gone, "k", "left_anti").select(*given_back(names))
