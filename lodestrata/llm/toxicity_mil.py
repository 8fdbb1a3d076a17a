"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability comes from a linear model over its
distinct words and their beginnings of four to six letters (inflected forms share them); a
sentence without any weighted word has none. The bag's probability is the sentences' noisy-or,
1 - prod(1 - p), so sentences without evidence add nothing, however many there are. Only
document labels train it: the gradient of the bag's likelihood falls on the sentences that
explain it. The sentences whose own probability reaches `locate` are the located offences.

The model fits on a bounded sample: `n_bags` labelled training rows (a parameter, 6,000) by the
hash of their columns. Candidate words are those that at least `least` distinct sentences of the
sample hold and that are clearly more frequent in toxic documents; Spark counts them, and the
driver gets `max_words` words and, for each bag, the sentences that hold one, as word numbers.
No text leaves the executors. Scoring covers every row and its whole text.

Defined results: a null or empty text has no sentence and scores 0, as does a text without a
weighted word; repeated rows get equal scores; without labelled rows of both classes every score
is 0; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import column, held_out, raw, rows_of, sampled, stored

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(words: set[str] | list[str]) -> set[str]:
    """Each word, and its beginnings marked by a star."""
    return {*words} | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) >= k}


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence that holds a word."""
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(text, *m.span())]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    @cached_property
    def heads(self) -> frozenset[str]:
        """The first letters, four at most, of whatever has a weight."""
        return frozenset(f.rstrip("*")[:4] for f in self.weights)

    def sentence(self, text: str) -> float:
        own = [self.weights[f] for f in features(words(text)) if f in self.weights]
        return 1 / (1 + np.exp(-min(max(self.bias + sum(own), -40), 40))) if own else 0.0

    def bag(self, text: str, locate: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and its offending sentences (start, end, probability)."""
        if not text or not self.weights:
            return 0.0, []
        found = {w for w in set(words(text)) if w[:4] in self.heads}
        if features(found).isdisjoint(self.weights):
            return 0.0, []
        spans = sentences(text)
        p = [self.sentence(text[a:b]) for a, b in spans]
        score = float(-np.expm1(sum(np.log1p(-min(x, 1 - 1e-12)) for x in p)))
        return score, [(a, b, float(x)) for (a, b), x in zip(spans, p, strict=True) if x >= locate]


def fit(bags: list[list[tuple[list[int], int]]], toxic: np.ndarray, prior: np.ndarray, epochs: int = 300, rate: float = 0.1, pull_back: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the noisy-or likelihood of the bags under a Gaussian prior
    around `prior` (full batch, Adam). A bag is its sentences that hold a word, as word numbers and
    how often the bag holds such a sentence.

    A label is also 1 by mistake with a rate that is learned along, so that a toxic label which
    no sentence explains raises that rate and not every sentence's probability.
    """
    y, k = np.asarray(toxic, np.float64), len(prior)
    bag_of, times, sent_of, word_of = [], [], [], []
    for i, bag in enumerate(bags):
        for own, n in bag:
            sent_of.extend([len(bag_of)] * len(own))
            word_of.extend(own)
            bag_of.append(i)
            times.append(n)
    bag_of, sent_of, word_of = np.array(bag_of, np.int64), np.array(sent_of, np.int64), np.array(word_of, np.int64)
    times, n_sent = np.array(times, np.float64), len(bag_of)
    # Word weights, bias, logit of the rate of mistakes. The prior keeps weight on each of several
    # words that often stand in one document, of which the likelihood alone needs only one.
    x = np.append(prior, [-6.0, -4.0])
    m, v = np.zeros(k + 2), np.zeros(k + 2)
    for t in range(1, epochs + 1):
        logit = x[k] + np.bincount(sent_of, x[word_of], n_sent)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        none = np.exp(np.bincount(bag_of, times * np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        mistake = 1 / (1 + np.exp(-x[k + 1]))
        some = 1 - (1 - mistake) * none
        # d log-likelihood / d logit of a sentence: p * P(none) / P(label) in a toxic bag, -p else
        pull = np.where(y == 1, (1 - mistake) * none / some, -1.0)[bag_of] * times * p / len(y)
        slip = np.where(y == 1, (1 - mistake) * mistake * none / some, -mistake).mean()
        g = np.concatenate([np.bincount(word_of, pull[sent_of], k) - pull_back * (x[:k] - prior), [pull.sum(), slip]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        root = np.sqrt(v / (1 - 0.999**t)) + 1e-6
        x = x + rate * (m / (1 - 0.9**t)) / root
        x[:k] = np.clip(x[:k], -16, 16)
        x[k] = np.clip(x[k], -10, -5)
    return x[:k], float(x[k])


def _evidence(bags: DataFrame, least: int, z_min: float, max_words: int) -> list[tuple[str, float]]:
    """The candidate words with their log odds, clearest first. Counted over distinct sentences:
    many copies of one text count once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, digest, held = [], [], []
            for y, t in zip(column(b, "toxic").to_pylist(), raw(b, "text"), strict=True):
                t = t.decode()
                for a, e in sentences(t):
                    label.append(y)
                    digest.append(xxhash.xxh64_intdigest(t[a:e]) - (1 << 63))
                    held.append(sorted(features(words(t[a:e]))))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(digest, pa.int64()), pa.array(held, pa.list_(pa.string()))], names=["toxic", "digest", "held"])

    rows = stored(bags.select("toxic", "text").mapInArrow(split, "toxic int, digest long, held array<string>").dropDuplicates(["toxic", "digest"]), "sentences")
    n = rows.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    t, c = F.lit(float(max(n["t"], 1))), F.lit(float(max(n["c"], 1)))
    count = rows.select("toxic", F.explode("held").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    count = count.where((F.col("a") > 0) & (F.col("a") + F.col("b") >= least)).withColumn("m", (F.col("a") + F.col("b")) / (t + c))
    z = (F.col("a") / t - F.col("b") / c) / F.sqrt(F.col("m") * (1 - F.col("m")) * (1 / t + 1 / c) + 1e-12)
    odds = F.log((F.col("a") + 0.5) / (t + 1)) - F.log((F.col("b") + 0.5) / (c + 1))
    best = count.select("word", z.alias("z"), odds.alias("odds")).where(F.col("z") > z_min).orderBy(F.col("z").desc(), "word").limit(max_words)
    return [(r["word"], r["odds"]) for r in best.collect()]


def _bags(rows: DataFrame, number: dict[str, int]) -> tuple[list, np.ndarray]:
    """Each row's sentences that hold a numbered word, as lists of numbers with their times."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in raw(b, "text"):
                t = t.decode()
                own = Counter(tuple(sorted(number[f] for f in features(words(t[a:e])) if f in number)) for a, e in sentences(t))
                out.append([{"own": list(x), "n": n} for x, n in sorted(own.items()) if x])
            yield pa.RecordBatch.from_arrays([column(b, "key"), column(b, "toxic"), pa.array(out, pa.list_(pa.struct([("own", pa.list_(pa.int32())), ("n", pa.int32())])))], names=["key", "toxic", "bag"])

    got = rows.select("key", "toxic", "text").mapInArrow(find, "key long, toxic int, bag array<struct<own:array<int>,n:int>>").collect()
    got.sort(key=lambda r: r["key"])
    return [[(s["own"], s["n"]) for s in r["bag"]] for r in got], np.array([r["toxic"] for r in got])


def train(docs: DataFrame, labels: DataFrame, n_bags: int = 6000, least: int = 5, z_min: float = 5.0, max_words: int = 3000, **how) -> Model:
    """From labels (doc_id, toxic) and docs (doc_id, text) of the training folds."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = F.broadcast(sampled(known, n_bags, "of").drop("of"))  # n_bags rows at most
    rows = stored(sampled(docs.join(picked, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"), n_bags), "bags")
    found = _evidence(rows, least, z_min, max_words)
    if not found or rows.where("toxic = 0").isEmpty():
        return Model({}, -10.0)
    bags, y = _bags(rows, {w: i for i, (w, _) in enumerate(found)})
    weights, bias = fit(bags, y, np.array([odds / 2 for _, odds in found]), **how)
    return Model({w: float(x) for (w, _), x in zip(found, weights, strict=True) if abs(x) > 0.05}, bias)


def score(docs: DataFrame, model: Model, locate: float = 0.5) -> DataFrame:
    """(doc_id, score, offences) for every row: offences are the located sentences."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.bag(t.decode(), locate) for t in raw(b, "text")]
            spans = [[{"start": a, "end": e, "p": p} for a, e, p in s] for _, s in got]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([x for x, _ in got], pa.float64()), pa.array(spans, span)], names=["doc_id", "score", "offences"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, offences array<struct<start:int,end:int,p:double>>")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """Train on the rows that are not held out and score all: doc_id, held_out, score, predicted,
    offences."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs.where(~held_out()), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out()), **how)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offences")


def op10_mil_toxicity(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`; the model learns from `labels` of two folds in three."""
    return classify(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "labels"))
