"""Document quality by positive-unlabelled learning.

Trusted positives and unlabelled web text are described by measures of their form; a linear model
minimises the non-negative unbiased risk of the logistic loss under an estimated class prior. The prior
is estimated from the same two samples: where positives are densest, their share of the unlabelled texts
bounds it. Negative labels aren't used at all. The samples are bounded by ``most_labelled`` and
``most_unlabelled``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share, mapped

_BYTES = np.arange(256)
_ASCII = {
    "space": (9, 10, 11, 12, 13, 32),
    "digit": tuple(range(48, 58)),
    "upper": tuple(range(65, 91)),
    "lower": tuple(range(97, 123)),
    "stop": (33, 44, 46, 58, 59, 63),
    "mark": (35, 36, 37, 38, 42, 60, 62, 64, 92, 94, 95, 96, 124, 126),
    "pipe": (124,),
    "shout": (33,),
    "quote": (34, 39, 40, 41, 45),
}
_CLASSES = np.array([np.isin(_BYTES, v) for v in _ASCII.values()] + [_BYTES >= 128], dtype=np.float64).T
N_FEATURES = 24


def features(text: str | None) -> list[float]:
    """Measures of a whole text's form; a null or empty text has zeros but for the last."""
    raw = (text or "").encode("utf-8", "replace")
    words = (text or "").split()
    if not words:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts @ _CLASSES / len(raw)
    n = len(words)
    kinds, pairs, triples = len(set(words)), len(set(zip(words, words[1:]))), len(set(zip(words, words[1:], words[2:])))
    stay = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    chars = len(text) - n
    letters = max(share[2] + share[3] + share[9], 1e-9)
    return [
        *np.log1p(100 * share).tolist(),
        np.log1p(100 * share[2] / letters),
        np.log1p(100 * share[5] * len(raw) / n),
        np.log1p(100 * share[6] * len(raw) / n),
        np.log1p(100 * share[7] * len(raw) / n),
        np.log1p(n),
        np.log1p(chars / n),
        kinds / n,
        1 - pairs / max(1, n - 1) if n > 1 else 0.0,
        1 - triples / max(1, n - 2) if n > 2 else 0.0,
        stay / n,
        np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        float(n < 4),
        0.0,
    ]


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(w: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        grad = gradient(w)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def nnpu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Non-negative risk of the logistic loss, and the gradient that is followed.

    Where the estimated risk of negatives falls below 0 it counts as 0, and the step goes the other way.
    """
    up, uu = p @ w, u @ w
    negative = np.logaddexp(0, uu).mean() - prior * np.logaddexp(0, up).mean()
    pull = u.T @ _sigmoid(uu) / len(u) - prior * (p.T @ _sigmoid(up)) / len(p)
    push = -prior * (p.T @ _sigmoid(-up)) / len(p)
    return prior * np.logaddexp(0, -up).mean() + max(0.0, negative), push + pull if negative >= 0 else -pull


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (last: intercept) on features standardised by the returned rows: weights, means, scales."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = _standard(positive, mean, scale), _standard(unlabelled, mean, scale)
    start = np.zeros(p.shape[1])
    start[-1] = np.log(prior / (1 - prior))
    w = _adam(start, lambda w: nnpu_risk(w, p, u, prior)[1] + decay * np.append(w[:-1], 0), steps, rate)
    return np.vstack([w, np.append(mean, 0), np.append(scale, 1)])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300) -> float:
    """Share of positives among the unlabelled, from above: the least ratio of the two tails of a score.

    The score tells the samples apart and is fitted on every other row; the ratio is taken on the rest, at
    the threshold where it is least with allowance for the tails' sampling error.
    """
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = _standard(positive, mean, scale), _standard(unlabelled, mean, scale)
    fit_p, fit_u, p, u = p[::2], u[::2], p[1::2], u[1::2]
    if min(len(fit_p), len(p), len(fit_u), len(u)) < 20:
        return 0.5
    gradient = lambda w: (fit_u.T @ _sigmoid(fit_u @ w)) / len(fit_u) - (fit_p.T @ _sigmoid(-(fit_p @ w))) / len(fit_p) + 1e-3 * w
    w = _adam(np.zeros(p.shape[1]), gradient, steps, 0.05)
    of_p, of_u = np.sort(p @ w), np.sort(u @ w)
    cuts = np.unique(np.concatenate([of_p, of_u]))
    tail_p, tail_u = 1 - np.searchsorted(of_p, cuts) / len(p), 1 - np.searchsorted(of_u, cuts) / len(u)
    cuts = tail_p > 0
    slack = np.sqrt(np.log(40) / 2 / len(u)) + np.sqrt(np.log(40) / 2 / len(p))
    best = np.argmin((tail_u[cuts] + 1.01 * slack) / tail_p[cuts])
    return float(tail_u[cuts][best] / tail_p[cuts][best])


def _featurised(docs: DataFrame, extra: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["kind", "x"])

    return mapped(docs.select(F.col("text").cast("string"), extra.cast("int").alias("kind")), run, "kind int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most_labelled: int = 20_000, most_unlabelled: int = 20_000) -> dict:
    """Learn from the positives of ``labels`` (doc_id, quality) where ``learn`` holds, and from unlabelled documents.

    Of an id with several labels the lowest counts; null ids and labels are left out. The samples are
    drawn by a hash of the id and hold about as many rows as the bounds say, at any input size. With
    no positive or no unlabelled document at all, every text is scored with a prior of one half.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    good, total = known.count(), docs.count()
    sample = known.where(hash_share(F.col("doc_id"), most_labelled / max(1, good), "quality")).select(F.col("doc_id").alias("_known"))
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_known"), "left")
    web = hash_share(F.col("doc_id"), most_unlabelled / max(1, total), "web")
    chosen = joined.where(F.col("_known").isNotNull() | web)
    rows = _featurised(chosen, F.when(F.col("_known").isNotNull(), 1).otherwise(0) + F.when(web, 2).otherwise(0)).toPandas()
    if not len(rows) or not (rows.kind & 1).any() or not (rows.kind & 2).any():
        return {"prior": 0.5, "model": None}
    x = np.array(rows.x.tolist())
    positive, unlabelled = x[rows.kind & 1 == 1], x[rows.kind & 2 == 2]
    prior = float(np.clip(estimate_prior(positive, unlabelled), 0.05, 0.98))
    return {"prior": prior, "model": fit_nnpu(positive, unlabelled, prior)}


def _scores(texts: list[str | None], model: dict) -> np.ndarray:
    x = np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)
    if model["model"] is None:
        return np.full(len(x), model["prior"])
    w, mean, scale = model["model"]
    return _sigmoid(_standard(x, mean[:-1], scale[:-1]) @ w)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and the quality score of each whole text; a null text is scored as an empty one, a null id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1).to_pylist(), model), pa.float64())], names=["doc_id", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at).to_pylist(), model) >= threshold, pa.bool_()))

    return mapped(docs, run, docs.schema)
