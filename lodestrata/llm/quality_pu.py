"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives (label 1) and unlabelled web text train a linear model on features of a
text's style. The risk is the non-negative unbiased estimator of Kiryo et al. (2017):

    pi * E_P[l(z)] + max(0, E_U[l(-z)] - pi * E_P[l(-z)])

with the logistic loss l and the class prior pi. Where the bracket falls below zero, the step
goes against its gradient. The prior is estimated from the positives and the unlabelled rows
(`estimate_prior`). Negative labels are never read.

The classifier fits on a bounded sample: `n_positive` and `n_unlabelled` rows (parameters, 6,000
and 12,000) by the hash of their columns. Scoring covers every row and its whole text.

Defined results: a null text counts as empty and gets the score of an empty text; repeated rows
get equal scores; with no positive or no row in the training folds every score is 0.5, or the
prior where one is given; an empty table gives no rows; extra columns are not read, and pass
through `accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import column, held_out, raw, rows_of, sampled

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "mark": b"!?",
    "stop": b".,;:",
    "bracket": b"()[]{}",
    "other": b"\"'`~@^_=+-/\\",
    "space": b" \t\n\x0b\x0c\r",
    "high": bytes(range(128, 256)),
}
_MAP = np.zeros((256, len(_CLASSES)), np.float64)
for _j, _chars in enumerate(_CLASSES.values()):
    _MAP[list(_chars), _j] = 1.0
_UPPER2 = np.zeros(256, bool)
_UPPER2[list(range(128, 159))] = True  # second byte of most upper-case Latin-1 letters

FEATURES = (*_CLASSES, "n_words", "mean_word", "distinct", "adjacent", "lines", "distinct_lines", "per_line", "one_letter", "accent_upper")


def features(text: bytes) -> list[float]:
    """Style of one text, each number within about 0 to 1."""
    n = len(text)
    words = text.split()
    m = len(words)
    b = np.frombuffer(text, np.uint8)
    counts = np.bincount(b, minlength=256)
    share = counts @ _MAP / max(n, 1)
    lines = text.split(b"\n")
    after = b[1:][b[:-1] == 195] if n > 1 else b[:0]
    return [
        *share.tolist(),
        min(1.0, np.log1p(m) / 12),
        min(1.0, (n - counts[32]) / max(m, 1) / 20),
        len(set(words)) / m if m else 1.0,
        sum(map(eq, words, words[1:])) / m if m else 0.0,
        min(1.0, np.log1p(len(lines)) / 8),
        len(set(lines)) / len(lines),
        min(1.0, m / len(lines) / 100),
        sum(len(w) == 1 for w in words) / m if m else 0.0,
        float(_UPPER2[after].sum()) / max(n, 1),
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Each feature as it is, its root, and steps, so that a linear model bends."""
    return np.hstack([x, np.sqrt(x), x > 0.02, x > 0.05, x > 0.1, x > 0.2, x > 0.35, x > 0.5]).astype(np.float64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((expand(x) - self.mean) / self.scale @ self.weights + self.bias)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 600, rate: float = 0.03, decay: float = 1e-4, beta: float = 0.0) -> Model:
    """Minimise the non-negative risk by Adam over the whole sample. Rows are features()."""
    xp, xu = expand(positive), expand(unlabelled)
    both = np.vstack([xp, xu])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    xp, xu = (xp - mean) / scale, (xu - mean) / scale
    w, b = np.zeros(xp.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, epochs + 1):
        zp, zu = xp @ w + b, xu @ w + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # gradients of the mean losses by z: l(z) = log(1 + exp(-z)), l(-z) = log(1 + exp(z))
        g_pos = prior * (sp - 1) / len(sp)
        g_neg_p, g_neg_u = -prior * sp / len(sp), su / len(su)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sign = 1.0 if negative >= -beta else -1.0
        dp, du = (g_pos + g_neg_p if sign > 0 else -g_neg_p), sign * g_neg_u
        g = np.append(xp.T @ dp + xu.T @ du + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(w, float(b), mean, scale, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, low: float = 0.05, sure: float = 0.1) -> float:
    """Share of positives among the unlabelled without any negative, by the best bin of a
    classifier's scores: above a cut that nearly no negative reaches, the share of unlabelled rows
    over the share of positives is the prior. The cut is the one with the least upper confidence
    bound of that ratio. Each half is scored by a model of the other half, since a model's own
    positives score higher than other positives do."""
    halves = lambda x: (x[::2], x[1::2]) if len(x) > 1 else (x, x)
    (p0, p1), (u0, u1) = halves(positive), halves(unlabelled)
    ratios = []
    for (p, u), (q, v) in (((p0, u0), (p1, u1)), ((p1, u1), (p0, u0))):
        model = fit_nnpu(p, u, 0.5, epochs=150)
        sp, su = np.sort(model.score(q)), np.sort(model.score(v))
        cut = np.unique(np.quantile(sp, np.linspace(0, 0.95, 96)))
        above_p = 1 - np.searchsorted(sp, cut, "left") / len(sp)
        above_u = 1 - np.searchsorted(su, cut, "left") / len(su)
        slack = np.sqrt(np.log(4 / sure) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
        best = np.argmin((above_u + slack) / above_p)
        ratios.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(ratios), low, 0.98))


def featurised(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in raw(b, "text")]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, features array<double>")


def train(docs: DataFrame, labels: DataFrame, n_positive: int = 6000, n_unlabelled: int = 12000, prior: float | None = None) -> Model | float:
    """A model from the positives among labels (doc_id, quality) and from docs (doc_id, text), both
    of training folds only. A plain number, the score of every row, if there is no positive."""
    docs = docs.select("doc_id", "text")
    # n_positive ids at most, whatever the labels: broadcast by that bound.
    trusted = F.broadcast(sampled(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct(), n_positive).select("doc_id"))
    positive, unlabelled = (
        np.array(sorted(r["features"] for r in featurised(rows).collect())).reshape(-1, len(FEATURES))  # n rows of features at most
        for rows in (sampled(docs.join(trusted, "doc_id", "left_semi"), n_positive), sampled(docs, n_unlabelled))
    )
    if not len(positive) or not len(unlabelled):
        return 0.5 if prior is None else float(prior)
    return fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled) if prior is None else float(prior))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if isinstance(model, float):
                s = np.full(b.num_rows, model)
            else:
                s = model.score(np.array([features(t) for t in raw(b, "text")]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score `threshold` or more, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if isinstance(model, float):
                good = np.full(b.num_rows, model >= threshold)
            else:
                good = model.score(np.array([features(t) for t in raw(b, "text")]).reshape(-1, len(FEATURES))) >= threshold
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Train on the rows that are not held out and score all: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = docs.where(~held_out())
    model = train(seen, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out()), **how)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pu_quality(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`; the prior and the model learn from the positives of two folds in three."""
    return classify(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "labels"))
