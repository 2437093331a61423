"""Toxicity: a counterfactual-regularised linear classifier.

A text's features are its distinct words, lower-cased (runs of ASCII letters, digits and characters beyond ASCII), and
the beginnings of longer ones. Words
whose counts in toxic and other labelled texts differ by chance alone are left out by a test against the binomial; the
rest get weights by logistic regression. In each labelled text with an identity term, the term is also swapped for each
other term of its group, and squared changes of the score are a penalty: a mention of one group then weighs what a
mention of another does, and a group that occurs in toxic texts by accident makes no neutral mention toxic. Terms that no
labelled text has weigh nothing and are swapped in too, as is a word that names no group, so that a line whose terms all
occur isn't toxic as a whole; beginnings of terms are no features, so a swap moves nothing else.

The model is fitted on at most ``SAMPLE`` labelled rows, taken by a hash of the id; every text is scored whole. Defined
cases: null and empty texts have no words and get the score of the intercept, as do texts of words that none of the labels
tells anything of; the intercept is that of the smoothed share of toxic rows; a doc_id that labels hold twice counts with
each of its rows; null labels and null ids teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, columns, cut, few, given_back, held_out, own_columns, schema_with, ship, with_own, word_hashes

ship(__name__)

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 16_000
#: Standard deviations by which a word's count must leave chance, and the least difference of texts.
SURE, LEAST = 3.5, 4.0
THRESHOLD = 0.3
#: Characters of the beginnings of longer words that are features besides the words.
STEMS = (4, 5, 6)
#: Neutral names of groups; terms of one line may be swapped for each other.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual", "transgender"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("immigrants", "refugees", "citizens", "foreigners", "natives"),
    ("immigrant", "refugee", "citizen", "foreigner", "native"),
    ("deaf", "blind", "disabled", "paralyzed"),
    ("young", "old", "elderly", "teenage"),
)
TERMS = frozenset(t for group in IDENTITY_TERMS for t in group)
#: Makes ASCII but letters and digits a space.
WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: str | None) -> np.ndarray:
    """Hashes of the distinct words and of their beginnings."""
    words = set((text or "").lower().encode("utf-8", "replace").translate(WORDS).split())
    long = [w for w in (w.decode("utf-8", "ignore") for w in words if len(w) > min(STEMS)) if len(w) > min(STEMS)]
    stems = {w[:n] + "-" for n in STEMS for w in long if len(w) > n and w not in TERMS}
    return np.unique(word_hashes([*words, *(s.encode() for s in stems)]))


def identity_groups() -> list[np.ndarray]:
    return [word_hashes([t.encode() for t in group]) for group in IDENTITY_TERMS]


def _features(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t).view(np.int64) for t in columns(batch, "text")[0]]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(made, pa.list_(pa.int64()))], names=["toxic", "words"])


def select(sample: DataFrame) -> np.ndarray:
    """Words that tell the classes apart beyond chance, and identity terms that occur. The sample bounds their number: all
    of them have more than ``LEAST`` of its texts."""
    n, k = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).head()
    p, terms = k / max(1, n), np.concatenate(identity_groups()).view(np.int64).tolist()
    words = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    far, sd = F.abs(F.col("k") - p * F.col("n")), F.sqrt(F.col("n") * (p * (1 - p)))
    sure = words.filter((far > F.greatest(F.lit(LEAST), SURE * sd)) | F.col("word").isin(terms))
    return np.sort(np.array([r.word for r in sure.select("word").collect()], np.int64).view(np.uint64))


def _selected(held):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(r := np.array(w, np.int64).view(np.uint64))[np.isin(r, held.value)].view(np.int64) for w in columns(batch, "words")[0]]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(made, pa.list_(pa.int64()))], names=["toxic", "words"])

    return run


def swaps(rows: list[np.ndarray], words: np.ndarray) -> dict[tuple[int, int], int]:
    """How many labelled texts have term i, and not j, of the same group: the pairs whose swap changes the text. All terms
    without a weight, and a word that names no group, are j = -1, counted once each."""
    out: dict[tuple[int, int], int] = {}
    groups = [([int(i) for i in np.searchsorted(words, g) if i < len(words) and words[i] in g], len(g)) for g in identity_groups()]
    for row in rows:
        for group, size in groups:
            have = {i for i in group if words[i] in row} if group else set()
            for i in have:
                for j, often in [*((j, 1) for j in group if j not in have), (-1, size - len(group) + 1)]:
                    out[i, j] = out.get((i, j), 0) + often
    return out


def fit(rows: list[np.ndarray], y: np.ndarray, l2: float = 0.05, counterfactual: float = 1.0, steps: int = 400) -> dict:
    """Words, weights and intercept, from the selected words of each row. The intercept stays at the share of toxic rows: a
    fitted one would be what clean words leave over, and would flag texts for saying nothing that the labels know."""
    n, k = len(rows), float(y.sum()) if len(y) else 0.0
    base = float(np.log((k + 0.5) / (n - k + 0.5))) if n else -2.0
    if n == 0 or k in (0.0, float(n)):
        return {"words": np.zeros(0, np.uint64), "weights": np.zeros(0), "intercept": base}
    words = np.unique(np.concatenate(rows))
    held = [np.searchsorted(words, r) for r in rows]
    at, row = np.concatenate(held).astype(np.int64), np.repeat(np.arange(n), [len(h) for h in held])
    pairs = swaps([words[h] for h in held], words)
    i, j, often = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64), np.array(list(pairs.values()), np.float64)
    known = j >= 0
    w, m, v = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words))
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(row, weights=w[at], minlength=n) + base
        r = 1 / (1 + np.exp(-z)) - y
        g = np.bincount(at, weights=r[row], minlength=len(words)) + l2 * w
        change = 2 * counterfactual * often * (w[i] - np.where(known, w[j], 0.0))
        np.add.at(g, i, change)
        np.add.at(g, j[known], -change[known])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return {"words": words, "weights": w, "intercept": base}


def train(docs: DataFrame, labels: DataFrame, seed: int = 42) -> dict:
    """Model from labels of documents that aren't held out; the sample of labels is small enough to be broadcast."""
    bound_batches(docs.sparkSession)
    own = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = few(own.select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic")), F.xxhash64("doc_id", F.lit(seed)), SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    sample = cut(texts.mapInArrow(_features, "toxic int, words array<long>"))
    held = docs.sparkSession.sparkContext.broadcast(select(sample))
    rows = sorted((r.toxic, tuple(r.words)) for r in sample.mapInArrow(_selected(held), "toxic int, words array<long>").collect())
    return fit([np.array(w, np.int64).view(np.uint64) for _, w in rows], np.array([float(t) for t, _ in rows]))


def score_one(text: str | None, model: dict) -> float:
    z, words = model["intercept"], model["words"]
    if len(words):
        x = features(text)
        at = np.minimum(np.searchsorted(words, x), len(words) - 1)
        z += float(model["weights"][at[words[at] == x]].sum())
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _score(held):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([score_one(t, held.value) for t in columns(batch, "text")[0]], pa.float64())
            yield with_own(batch, ["held_out", "score"], [batch.column("held_out"), scores])

    return run


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs (columns ``keep``, all by default) with held_out, score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    own, names = own_columns(docs, keep, ("held_out", "score", "predicted"))
    sent = docs.select(*own, held_out().alias("held_out"), F.col("text").alias("text"))
    scored = sent.mapInArrow(_score(held), schema_with(sent, "held_out boolean, score double"))
    return scored.select(*given_back(names), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
