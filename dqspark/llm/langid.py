"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the n-grams of one to three characters of the lower-cased text, where a run of non-letters is one space,
hashed to ``BUCKETS``. Weights come from follow-the-regularised-leader with elastic-net penalties, which leaves most of
them zero; a temperature fitted on rows apart from the training rows then calibrates the probabilities.

The model is fitted on a bounded sample: ``SAMPLE`` labelled rows, equally many for each language as far as there are,
taken by a hash of the id. Every text is scored whole (in pieces of ``PIECE`` characters). Defined cases: a null text or one
without a letter gives ``und`` and score 0; without any labelled row every text does; with one language all others get
it at score 1; rows without an id take part in scoring, and as training rows too (they are never held out).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, columns, few, given_back, held_out, own_columns, schema_with, ship, with_own

ship(__name__)

BUCKETS, PIECE = 1 << 14, 1 << 20
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 4_000
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point, whether it is a letter (beyond the third plane nothing is)."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x40000)), bool, 0x40000))
    return _LETTERS[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and their counts; none if it has no letter."""
    total, any_letter = np.zeros(BUCKETS, np.int64), False
    for i in range(0, len(text or ""), PIECE):
        x = np.frombuffer(text[i : i + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = letters()[np.minimum(x, 0x3FFFF)]
        any_letter = any_letter or bool(is_letter.any())
        x = np.concatenate([[32], np.where(is_letter, x, 32), [32]]).astype(np.uint32)
        x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
        one = x * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + one[1:]
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + one[2:]
        for h in (one, two, three):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount((h >> np.uint32(18)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total) if any_letter else np.zeros(0, np.int64)
    return at, total[at]


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(1e-12, float(np.sqrt(x @ x)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3, seed: int = 0) -> np.ndarray:
    """Weights (BUCKETS x classes) of multinomial logistic regression by FTRL-proximal."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits of least log loss, by golden sections of its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _features(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [ngram_counts(t) for t in columns(batch, "text")[0]]
        arrays = [batch.column("lang"), batch.column("h"), pa.array([a.astype(np.uint16).tobytes() for a, _ in made], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in made], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "h", "at", "counts"])


def train(docs: DataFrame, seed: int = 42) -> dict:
    """The model: languages, weights, idf and temperature."""
    bound_batches(docs.sparkSession)
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = labelled.select("lang").distinct().count()
    h = F.xxhash64("doc_id", F.lit(seed))
    chosen = few(labelled.select("doc_id", "lang"), h, max(1, SAMPLE // max(1, known)), "lang")
    # ids alone are ranked; SAMPLE of them at most are broadcast, so texts aren't shuffled
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct().withColumnsRenamed({"doc_id": "id", "lang": "l"})), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("l")))
    rows = sorted(texts.select("lang", h.alias("h"), "text").mapInArrow(_features, "lang string, h long, at binary, counts binary").collect(), key=lambda r: (r.h, r.lang, r["at"]))
    rows = [r for r in rows if len(r["at"])]
    languages = sorted({r.lang for r in rows})
    if len(languages) < 2:
        return {"languages": languages, "weights": np.zeros((BUCKETS, len(languages)), np.float32), "idf": np.ones(BUCKETS, np.float32), "temperature": 1.0}
    raw = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.uint32)) for r in rows]
    y = np.array([languages.index(r.lang) for r in rows])
    df = np.bincount(np.concatenate([a for a, _ in raw]), minlength=BUCKETS)
    idf = np.log((1 + len(raw)) / (1 + df)) + 1
    x = [(a, vector(a, c, idf)) for a, c in raw]
    apart = np.arange(len(x)) % 5 == 4
    weights = ftrl([v for v, p in zip(x, apart, strict=True) if not p], y[~apart], len(languages), seed=seed)
    logits = np.array([v @ weights[a] for (a, v), p in zip(x, apart, strict=True) if p]).reshape(-1, len(languages))
    return {"languages": languages, "weights": weights.astype(np.float32), "idf": idf.astype(np.float32), "temperature": temperature(logits, y[apart]) if apart.any() else 1.0}


def predict_one(text: str | None, model: dict) -> tuple[str, float]:
    at, counts = ngram_counts(text)
    if not len(at) or not model["languages"]:
        return UNKNOWN, 0.0
    p = softmax(vector(at, counts, model["idf"]) @ model["weights"][at].astype(np.float64) / model["temperature"])
    best = int(np.argmax(p))
    return model["languages"][best], float(p[best])


def _predict(held, text: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict_one(t, held.value) for t in columns(batch, text)[0]]
            made = [batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield with_own(batch, ["held_out", "lang_pred", "score"], made)

    return run


def _scored(docs: DataFrame, model: dict, keep: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Columns c_0 and so on of the names, held_out, lang_pred and score. A text that is kept goes to the workers once."""
    own, names = own_columns(docs, keep, ("held_out", "lang_pred", "score"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    sent = docs.select(*own, held_out().alias("held_out"), *([] if "text" in names else [F.col("text").alias("text")]))
    text = f"c_{names.index('text')}" if "text" in names else "text"
    return sent.mapInArrow(_predict(held, text), schema_with(sent, "held_out boolean, lang_pred string, score double")), names


def identify(docs: DataFrame, model: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (columns ``keep``, all by default) with held_out, lang_pred and score."""
    found, names = _scored(docs, train(docs) if model is None else model, keep)
    return found.select(*given_back(names), "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs, with their own columns, without texts that have no letter or whose best language is less sure than ``least``."""
    model = train(docs)
    found, names = _scored(docs.withColumnsRenamed({c: f"own {c}" for c in ("held_out", "lang_pred", "score")}), model, None)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*given_back(names)).toDF(*docs.columns)
