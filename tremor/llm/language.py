"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text in lower case, with a space for every run of other characters than letters, gives its
1- to 3-grams, hashed to ``2 ** BITS`` buckets.  A feature is a bucket's share of the text's
n-grams times its inverse document frequency (and a fixed factor), which is counted over all documents of the
training folds.  Weights are learned by follow-the-regularised-leader with L1 and L2 penalties
on at most ``rows`` labelled documents a language, and a temperature fitted on a fifth of these
that was set aside makes the scores probabilities.

Null texts and texts without a letter are ``und`` with score 0.  Null languages are not learned
from.  A null doc_id is in no fold: it isn't held out, nor learned from.  Rows that repeat a
doc_id are each predicted.  Without any labelled row all predictions are ``und``.  Further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added_up, chunked, fold_of, hands, mapped, record

BITS = 17
# Factor on all features, so that their steps and the penalties are of one order.
SCALE = 64.0
ORDERS = 3
# Labelled documents a language that the weights are learned from.
ROWS = 1_000
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """The buckets of all n-grams of a text; none if it has no letter."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as a space
    codes = np.where(letter, codes, np.uint32(32))[keep]
    codes = np.concatenate([np.array([32], np.uint32), codes, np.array([32], np.uint32)])
    out, h = [], np.zeros(0, np.uint32)
    for n in range(ORDERS):
        h = codes * _FACTORS[0] + np.uint32(1) if not n else (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _FACTORS[1] + codes[n:] * _FACTORS[2]
        out.append(h)
    h = np.concatenate(out)
    h = (h ^ (h >> np.uint32(13))) * _FACTORS[2]
    return (h ^ (h >> np.uint32(16))) >> np.uint32(32 - BITS)


def learnable(docs: DataFrame) -> DataFrame:
    """Documents that may be learned from: crc32 of the id modulo 4 other than 2, with a language."""
    return docs.filter((fold_of("doc_id", 4) != 2) & F.col("lang").isNotNull())


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all these documents each bucket occurs, and how many they are."""
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
    size = 1 << BITS

    def run(batches):
        counts, last = np.zeros(size, dtype=np.uint32), np.zeros(size, dtype=np.int64)
        for batch in hands(batches):
            for text in batch.column("text").to_pylist():
                grams = ngrams(text)
                places = np.arange(len(grams))
                last[grams] = places
                counts[grams[last[grams] == places]] += 1  # one place for each bucket
        yield record(schema, **chunked(counts))

    return added_up(mapped(docs.select("text"), run, "chunk int, counts binary"), size), docs.count()


@dataclass(frozen=True)
class Model:
    """Weights times inverse document frequencies for each bucket and language, and the temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str | None) -> np.ndarray | None:
        grams = ngrams(text)
        if not len(grams) or not self.languages:
            return None
        return self.weights.take(grams, axis=0).sum(axis=0, dtype=np.float64) / len(grams) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text)
        if z is None:
            return UNKNOWN, 0.0
        z = z / self.temperature
        p = np.exp(z - z.max())
        return self.languages[int(z.argmax())], float(p.max() / p.sum())


class Ftrl:
    """Follow-the-regularised-leader with a learning rate for each weight, for a softmax over ``k`` classes."""

    def __init__(self, size: int, k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.z, self.n = np.zeros((size, k)), np.zeros((size, k))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def at(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.at(rows)
        z = values @ w
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        g = values[:, None].astype(np.float64) * p
        step = (np.sqrt(self.n[rows] + g * g) - np.sqrt(self.n[rows])) / self.alpha
        self.z[rows] += g - step * w
        self.n[rows] += g * g


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """Up to about ``rows`` documents of each language, chosen by a hash of the id."""
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.lit(0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(1 + int((1 << 20) * min(1.0, rows / n)))).otherwise(share)
    return docs.filter(part < share).limit(2 * rows * max(1, len(sizes)))


def fit(docs: DataFrame, rows: int = ROWS, epochs: int = 4, seed: int = 7) -> Model:
    """Learn from documents of the training folds; the document frequencies cover all of them."""
    frequencies, total = document_frequencies(docs)
    idf = SCALE * (np.log((1.0 + total) / (1.0 + frequencies)) + 1.0)
    schema = pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), ("grams", pa.binary()), ("shares", pa.binary())])

    def features(batches):
        for batch in hands(batches):
            found = [np.unique(ngrams(t), return_counts=True) for t in batch.column("text").to_pylist()]
            yield record(schema, lang=batch.column("lang"), doc_id=batch.column("doc_id"), grams=[g.astype("<u4").tobytes() for g, _ in found],
                         shares=[(c / max(1, c.sum())).astype("<f4").tobytes() for _, c in found])

    chosen = mapped(sampled(docs, rows).select("lang", "doc_id", "text"), features, "lang string, doc_id long, grams binary, shares binary")
    got = sorted((r["lang"], r["doc_id"], bytes(r["grams"]), bytes(r["shares"])) for r in chosen.collect() if len(r["grams"]))
    languages = sorted({r[0] for r in got})
    size, k = 1 << BITS, len(languages)
    cases = []
    for lang, _, grams, shares in got:
        g = np.frombuffer(grams, dtype="<u4").astype(np.int32)
        values = np.append(np.frombuffer(shares, dtype="<f4") * idf[g], 1.0).astype(np.float32)
        cases.append((np.append(g, np.int32(size)), values, languages.index(lang)))
    del got
    order = np.random.default_rng(seed).permutation(len(cases))
    aside, used = order[::5], np.setdiff1d(order, order[::5], assume_unique=True)
    leader = Ftrl(size + 1, k)
    for epoch in range(epochs):
        for i in np.random.default_rng(seed + epoch).permutation(used):
            leader.learn(*cases[i])
    weights = leader.at(slice(None))
    logits = np.array([cases[i][1] @ weights[cases[i][0]] for i in aside]).reshape(-1, max(1, k))
    temperature = calibrate(logits, np.array([cases[i][2] for i in aside], dtype=np.int64))
    return Model(languages, (weights[:size] * idf[:, None]).astype(np.float32), weights[size], temperature)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, from a grid of quarter-octaves; 1 without cases.

    The targets leave the other classes one case in ``n + 2``: that nothing was wrong among n
    cases doesn't make the next one certain.
    """
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    target = np.full((n, k), 1.0 / (n + 2) / (k - 1))
    target[np.arange(n), labels] = 1.0 - 1.0 / (n + 2)

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - (target * z).sum(axis=1)).mean())

    return min((2.0 ** (e / 4) for e in range(-24, 25)), key=loss)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score``; only the text is looked at."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in hands(batches):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield record(schema, doc_id=batch.column("doc_id"), lang_pred=[f[0] for f in found], score=[f[1] for f in found])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def told(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Whole rows whose text has a known language with at least that score; each row is judged by its own text."""

    def run(batches):
        for batch in hands(batches):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], type=pa.bool_()))

    return mapped(docs, run, docs.schema)


def held_out() -> Column:
    return F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))


def identify(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    model = fit(learnable(docs).select("doc_id", "text", "lang"), rows)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
