"""Document quality by Bradley-Terry pairwise ranking.

Every document has a vector of text measures.  Preference pairs set a document labelled 1
against one labelled 0; the weights minimise the logistic loss on the differences of the two
vectors, with an L2 penalty.  Each measure enters through the bins between its quantiles, so a
middle value may be best.  A document's raw score is its weighted sum, and the threshold is the
quantile of the training scores at the share of documents labelled 0: score 0.5.

Measures are worked out once for all documents and written to the shared folder; at most
``rows`` labelled documents of each label are learned from.  The threshold and the spread are those
of all labelled documents of the training folds, at every size.

Null and empty texts have measures of their own (no words) and are scored like others.  Rows
that repeat a doc_id are each scored.  Null labels, and rows whose doc_id is null, are not
learned from.  With labels of one kind only, or none, every score is 0.5 and predicted 1.
Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import fold_of, hands, mapped, record

# Bounds: labelled documents of each label that are learned from, and preference pairs drawn from them.
ROWS = 4_000
PAIRS = 20_000
BINS = 10
# An order statistic is found by counts in so many ranges, until at most so many values are left to sort.
RANGES = 1_024
SORTED = 10_000

MEASURES = ("words", "word_length", "distinct", "echoed", "top_word", "symbols", "symbol_kinds_at_end", "stops", "bars", "bangs", "upper",
            "digits", "accented", "line_words", "repeated_lines", "repeated_pairs")
_SYMBOLS = re.compile(r"[#$%&*<>=^~|\\{}\[\]_@+/]")
_DIGITS, _UPPER, _OTHER = re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[^\x00-\x7f]")


def measures(text: str | None) -> list[float]:
    """The text measures, as shares of words, characters or lines."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    pairs = Counter(zip(words, words[1:], strict=False))
    echoed = sum(c for (a, b), c in pairs.items() if a == b)
    ends = sum(w[-1] in "#$%&*!|" for w in words)
    return [np.log1p(len(words)), (len(text) - text.count(" ")) / n, len(counts) / n, echoed / n, max(counts.values(), default=0) / n,
            len(_SYMBOLS.findall(text)) / chars, ends / n, sum(map(text.count, ".?;:")) / n, text.count("|") / n, text.count("!") / n,
            len(_UPPER.findall(text)) / chars, len(_DIGITS.findall(text)) / chars, len(_OTHER.findall(text)) / chars,
            np.log1p(len(words) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), 1 - len(pairs) / max(1, n - 1)]


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, measures`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("measures", pa.list_(pa.float64()))])

    def run(batches):
        for batch in hands(batches):
            yield record(schema, doc_id=batch.column("doc_id"), measures=[measures(t) for t in batch.column("text").to_pylist()])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, measures array<double>")


@dataclass(frozen=True)
class Ranker:
    """Bin edges of each measure, a weight for each bin, the threshold and the scale of the raw scores."""

    edges: list[np.ndarray]
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, values: np.ndarray) -> np.ndarray:
        """The weighted sums, added up in one order so that a row's sum doesn't depend on its batch."""
        out, at = np.zeros(len(values)), 0
        for i, e in enumerate(self.edges):
            out += self.weights[at + np.searchsorted(e, values[:, i], side="right")]
            at += len(e) + 1
        return out

    def scores(self, values: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(values), 0.5)
        z = np.clip((self.raw(values) - self.threshold) / self.scale, -40, 40)
        return 1 / (1 + np.exp(-z))


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One indicator for each bin of each measure."""
    parts = [np.eye(len(e) + 1)[np.searchsorted(e, values[:, i], side="right")] for i, e in enumerate(edges)]
    return np.concatenate(parts, axis=1)


def bradley_terry(better: np.ndarray, worse: np.ndarray, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights whose scores make the preferences most likely (Newton steps on the logistic loss of the differences)."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (1 - p) - penalty * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + penalty * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(values: np.ndarray, labels: np.ndarray, share: float, pairs: int = PAIRS, seed: int = 11) -> Ranker:
    """Learn from measures and 0/1 labels; ``share`` is the share of label 0 among all labelled documents."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Ranker([], np.zeros(0), 0.0, 1.0)
    edges = [np.unique(np.quantile(np.concatenate([values[good, i], values[bad, i]]), np.arange(1, BINS) / BINS)) for i in range(values.shape[1])]
    edges = [np.unique(np.concatenate([e, np.quantile(values[bad, i], [0.1, 0.5, 0.9])])) for i, e in enumerate(edges)]
    x = binned(values, edges)
    draw = np.random.default_rng(seed)
    w = bradley_terry(x[draw.choice(good, pairs)], x[draw.choice(bad, pairs)])
    raw = x @ w
    # Each label's documents stand for their share of all labelled ones.
    weight = np.where(labels == 1, (1 - share) / len(good), share / len(bad))
    order = np.argsort(raw, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), share - 1e-9))
    low, high = raw[order[min(at, len(order) - 1)]], raw[order[min(at + 1, len(order) - 1)]]
    return Ranker(edges, w, float((low + high) / 2), float(max(1e-6, np.std(raw))) / 4)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the id modulo 3 other than 1."""
    return labels.filter((fold_of("doc_id", 3) != 1) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))


def trained(known: DataFrame, labels: DataFrame, rows: int = ROWS) -> Ranker:
    usable = learnable(labels)
    sizes = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    share_of = F.lit(0)
    for label, n in sizes.items():
        share_of = F.when(F.col("quality") == label, F.lit(1 + int((1 << 20) * min(1.0, rows / n)))).otherwise(share_of)
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share_of).limit(4 * rows)
    got = sorted((r["doc_id"], r["quality"], tuple(r["measures"])) for r in known.join(chosen, "doc_id").collect())
    values = np.array([g[2] for g in got]).reshape(-1, len(MEASURES))
    ranker = fit(values, np.array([g[1] for g in got]), sizes.get(0, 0) / max(1, sum(sizes.values())))
    return placed(ranker, known, usable) if len(ranker.weights) else ranker


def placed(ranker: Ranker, known: DataFrame, usable: DataFrame) -> Ranker:
    """The ranker with the threshold and scale of all labelled training documents."""
    raw = written(mapped(known, _scorer(ranker.raw, "raw"), "doc_id long, raw double").join(usable, "doc_id").select("raw", "quality"), "raw")
    zeros = raw.filter("quality = 0").count()
    low = order_statistic(raw, zeros - 1)
    above = raw.agg(F.count_if(F.col("raw") <= low), F.min(F.when(F.col("raw") > low, F.col("raw"))), F.stddev_pop("raw")).first()
    high = low if above[0] > zeros or above[1] is None else above[1]
    # The spread is summed up in any order: its last digits are left out.
    return replace(ranker, threshold=(low + high) / 2, scale=max(1e-6, float(f"{above[2]:.9g}")) / 4)


def order_statistic(raw: DataFrame, at: int) -> float:
    """The value of column ``raw`` that ``at`` values come before, exactly, by counts in ever narrower ranges."""
    low, high, n = raw.agg(F.min("raw"), F.max("raw"), F.count("raw")).first()
    while low < high:
        left = raw.filter(F.col("raw").between(low, high))
        if n <= SORTED:
            return sorted(r["raw"] for r in left.select("raw").collect())[at]
        part = F.least(F.floor((F.col("raw") - low) / ((high - low) / RANGES)), F.lit(RANGES - 1))
        for r in left.groupBy(part.alias("part")).agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.count("*").alias("n")).orderBy("part").collect():
            if at < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            at -= r["n"]
    return low


def _scorer(score, name: str):
    schema = pa.schema([("doc_id", pa.int64()), (name, pa.float64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = batch.column("measures").flatten().to_numpy().reshape(-1, len(MEASURES))
                yield record(schema, **{"doc_id": batch.column("doc_id"), name: pa.array(score(values))})

    return run


def held_out() -> Column:
    return F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))


def rank(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    known = written(measured(docs), "measures")
    ranker = trained(known, labels, rows)
    return mapped(known, _scorer(ranker.scores, "score"), "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
