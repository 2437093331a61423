"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of 0-9, a-z (A-Z lower-cased) and all characters beyond ASCII. A benchmark item's windows are its runs of
``n`` words; an item of fewer words, but not none, is one window. Training texts are scanned window by window with
rolling hashes against a sorted array of the benchmark's hashes (a bit table before it drops nearly all), each hit is
verified word by word, and its words are marked. ``remove`` then cuts the marked spans or the documents.

The benchmark is broadcast in parts of about ``PART_WORDS`` words, whose total is counted before: a larger benchmark
takes several passes over the texts, whose hits are united; between them the rows are written, so that no worker holds
more than one part. Defined cases: null texts and texts without a word have no window; an item_id that comes twice counts
once; items with a null id take part under the id ''; rows of one doc_id are judged by themselves; columns named like a
result are replaced, all others stay, whatever their names; empty tables give no row, an empty benchmark no hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bound_batches, covered, given_back, own_columns, schema_with, ship, window_hashes, with_own, word_hashes, written

ship(__name__)

#: Lower-cases A-Z and makes all other ASCII but 0-9 and a-z a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Words of the benchmark that one broadcast holds (40 bytes each, with their text, in every Python worker).
PART_WORDS = 1_000_000
FILTER_BITS = 22


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Index:
    """A benchmark's windows in flat arrays: its words once, joined by spaces, and by window length the sorted distinct
    hashes with the places and items of each."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.ids = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.ids)}
        texts, at, found = [], 0, {}
        for item, text in items:
            words = normal_words(text)
            if words:
                length = min(n, len(words))
                h = window_hashes(word_hashes(words), length)
                found.setdefault(length, []).append((h, np.full(len(h), number[item], np.int32), np.arange(at, at + len(h))))
                texts += words
                at += len(words)
        self.text = b" ".join(texts)
        self.begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        self.by_length = {length: self._sorted(*(np.concatenate(x) for x in zip(*parts, strict=True)), length) for length, parts in found.items()}

    def words(self, at: int, length: int) -> bytes:
        return self.text[self.begins[at] : self.begins[at + length] - 1]

    def _sorted(self, h: np.ndarray, item: np.ndarray, at: np.ndarray, length: int) -> tuple:
        order = np.lexsort((at, item, h))
        h, item, at = h[order], item[order], at[order]
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (item[1:] == item[:-1])])
        for i in np.flatnonzero(again).tolist():  # an item's repeats of a window go, other words of one hash stay
            again[i] = self.words(at[i - 1], length) == self.words(at[i], length)
        h, item, at = h[~again], item[~again], at[~again]
        hashes, first = np.unique(h, return_index=True)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return hashes, np.append(first, len(h)), item, at, np.packbits(seen)

    def hits(self, words: list[bytes], seen: dict[int, np.ndarray]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items that have one."""
        hit, items = np.zeros(len(words), bool), set()
        hashed = word_hashes(words)
        for length, (hashes, first, item, at, _) in self.by_length.items():
            h = window_hashes(hashed, length)
            some = np.flatnonzero(seen[length][(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(hashes, h[some]), len(hashes) - 1)
            alike, starts = hashes[place] == h[some], []
            for i, j in zip(some[alike].tolist(), place[alike].tolist(), strict=True):
                own = b" ".join(words[i : i + length])
                whose = [int(item[k]) for k in range(first[j], first[j + 1]) if self.words(at[k], length) == own]
                if whose:
                    items.update(whose)
                    starts.append(i)
            if starts:
                hit |= covered(len(words), np.array(starts), length)
        return hit, {self.ids[i] for i in items}


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


SCANNED = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _scan(held, text: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        index = held.value
        seen = {length: np.unpackbits(bits).view(bool) for length, (*_, bits) in index.by_length.items()}
        for batch in batches:
            rows, names = [], batch.schema.names
            earlier = [batch.column(names.index(c)).to_pylist() for c in ("spans", "items")] if "spans" in names else [[[]] * batch.num_rows] * 2
            for own, spans, known in zip(texts_of(batch, text), *earlier, strict=True):
                words = normal_words(own)
                hit, items = index.hits(words, seen)
                if spans:
                    hit |= covered(len(words), (p := np.array(spans, np.int64).reshape(-1, 2))[:, 0], p[:, 1] - p[:, 0])
                    items |= set(known)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
                rows.append((len(words), edges.tolist(), sorted(items)))
            more = ["text"] if "text" in names else []
            yield with_own(batch, [*more, *SCANNED.names], [*(batch.column(names.index(c)) for c in more), *batch_of(SCANNED, rows).columns])

    return run


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, keep: list[str] | None, made: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], str]:
    """Columns c_0 and so on of the names, n_words, spans (begins and ends of hit runs of words, in turn) and items; and
    which column has the text, which goes to the workers once."""
    spark = docs.sparkSession
    bound_batches(spark)
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text"), size.alias("words"))
    total = items.agg(F.coalesce(F.sum("words"), F.lit(0))).head()[0]
    parts = max(1, -(-total // PART_WORDS))
    own, names = own_columns(docs, keep, made)
    text = f"c_{names.index('text')}" if "text" in names else "text"
    out = docs.select(*own, *([] if "text" in names else [F.col("text").cast("binary").alias("text")]))
    schema = schema_with(out, ("" if "text" in names else "text binary, ") + "n_words long, spans array<int>, items array<string>")
    for i in range(parts):  # one, unless the benchmark is very large
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == i)
        held = spark.sparkContext.broadcast(Index([(r.id, bytes(r.text or b"")) for r in part.collect()], n))
        out = (written(out, "scanned") if i else out).mapInArrow(_scan(held, text), schema)
    return out, names, text


MADE = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep: list[str] | None = None) -> DataFrame:
    """docs (columns ``keep``, all by default) with n_words, n_hit, n_items, items_sha256, contaminated."""
    found, names, _ = _scanned(docs, benchmark, n, keep, MADE)
    pairs = F.transform(F.sequence(F.lit(1), F.size("spans"), F.lit(2)), lambda i: F.element_at("spans", (i + 1).cast("int")) - F.element_at("spans", i.cast("int")))
    n_hit = F.when(F.size("spans") == 0, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0), lambda a, b: a + b)).cast("long")
    made = ["n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")]
    return found.select(*(f"c_{i}" for i in range(len(names))), *made).select(*given_back(names), *MADE)


#: A word with its byte offsets, for cutting spans out of a text as it was written.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _cut(text: bytes, spans: list[int]) -> bytes:
    at = [m.span() for m in WORD.finditer(text)]
    gone, last, kept = covered(len(at), (p := np.array(spans, np.int64).reshape(-1, 2))[:, 0], p[:, 1] - p[:, 0]), 0, []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2)
    for a, b in edges.tolist():
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]])


def _cut_all(text: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans"))
            cut = [t if t is None or not s else _cut(t, s) for t, s in zip(texts_of(batch, text), spans.to_pylist(), strict=True)]
            yield with_own(batch, ["spans", "cut"], [spans, pa.array(cut, pa.binary())])

    return run


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, how: str = "documents") -> DataFrame:
    """docs, with their own columns, without contaminated documents, or with the hit spans cut from the texts (n_chars,
    if there is one, follows the text)."""
    if how not in ("documents", "spans"):
        raise ValueError("how: documents or spans")
    found, names, text = _scanned(docs, benchmark, n, None)
    if how == "documents":
        return found.filter(F.size("spans") == 0).select(*given_back(names))
    cut = found.mapInArrow(_cut_all(text), schema_with(found, "spans array<int>, cut binary"))
    new = {"text": F.col("cut").cast("string")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length(new["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"c_{names.index('n_chars')}"))
    return cut.select(*(new[c].alias(c) if c in new else old for c, old in zip(names, given_back(names), strict=True)))
