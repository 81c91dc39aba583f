"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the document has a label. A sentence's score is a
logistic function of its words and their beginnings; the document's is the noisy-or of its
sentences, one minus the product of their complements. Training maximises the likelihood of the
document labels alone, and the sentence scores that come out of it locate what offends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of training text for each label; whole texts are drawn by hash.
MAX_TRAIN_CHARS = 8_000_000
#: Features for training: those whose shares of documents differ between the labels by CONTRAST standard
#: errors or more, in LEAST_DOCUMENTS documents or more, the strongest ones if they are more than that.
MAX_FEATURES, CONTRAST, LEAST_DOCUMENTS = 50_000, 3.0, 4
EPOCHS = 200
THRESHOLD = 0.3
#: A sentence is named as offending from this score on.
OFFENDING = 0.5
PREFIXES = (4, 5, 6, 7)

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word, and each longer word's beginnings, marked as such."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class Scorer:
    """Sentence and document scores from feature weights; remembers what recent words add up to."""

    REMEMBERED = 300_000

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.values: dict[str, float] = {}

    def word(self, word: str) -> float:
        value = self.values.get(word)
        if value is None:
            if len(self.values) >= self.REMEMBERED:
                self.values.clear()
            value = self.values[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return value

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and log-odds of every sentence that has a word."""
        word, found = self.word, []
        for m in SENTENCE.finditer(text):
            words = WORD.findall(m[0].lower())
            if words:
                found.append((m.start(), m.end(), self.bias + sum(map(word, words))))
        return found

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """Noisy-or over the sentences, and the offending ones; 0 for a text without words."""
        if not text:
            return 0.0, []
        found = self.sentences(text)
        if not found:
            return 0.0, []
        odds = np.array([z for _, _, z in found])
        chances = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        spans = [
            {"start": found[i][0], "end": found[i][1], "score": float(chances[i])} for i in np.flatnonzero(chances >= OFFENDING)
        ]
        return float(-np.expm1(-np.logaddexp(0, odds).sum())), spans


def _contrasts(bags: list[tuple[int, float, list[Counter]]], max_features: int) -> list[str]:
    """The features whose share of documents differs most between the labels, in standard errors."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for label, _, sentences in bags:
        seen[label].update(set().union(*sentences))
    totals = [max(1, sum(label == k for label, _, _ in bags)) for k in (0, 1)]
    strength = {}
    for feature in seen[0].keys() | seen[1].keys():
        a, b = seen[0][feature], seen[1][feature]
        if a + b >= LEAST_DOCUMENTS:
            pooled = (a + b) / sum(totals)
            error = np.sqrt(pooled * (1 - pooled) * (1 / totals[0] + 1 / totals[1])) + 1e-9
            strength[feature] = abs(a / totals[0] - b / totals[1]) / error
    strong = [f for f, z in strength.items() if z >= CONTRAST]
    return sorted(strong, key=lambda f: (-strength[f], f))[:max_features]


@dataclass
class Bags:
    """Documents as bags of sentences: features (sentence_of, feature_of, times), doc_of each sentence, labels and shares of documents."""

    sentence_of: np.ndarray
    feature_of: np.ndarray
    times: np.ndarray
    doc_of: np.ndarray
    labels: np.ndarray
    shares: np.ndarray

    def _odds(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of every sentence, and of every document the negative logarithm that none is toxic."""
        z = w[-1] + np.bincount(self.sentence_of, w[self.feature_of] * self.times, len(self.doc_of))
        return z, np.bincount(self.doc_of, np.logaddexp(0, z), len(self.labels))

    def loss(self, w: np.ndarray) -> float:
        """Negative log-likelihood of the labels; the last weight is the bias."""
        _, clear = self._odds(w)
        toxic = np.log(np.clip(-np.expm1(-clear), 1e-9, 1))
        return float(-(self.shares * np.where(self.labels > 0, toxic, -clear)).sum())

    def slope(self, w: np.ndarray) -> np.ndarray:
        """The derivative of loss by each weight: a sentence's chance for a clean document, less (1 - P) / P of it for a toxic one."""
        z, clear = self._odds(w)
        p = np.clip(-np.expm1(-clear), 1e-9, 1)
        pull = self.shares * np.where(self.labels > 0, -(1 - p) / p, 1.0)
        dz = pull[self.doc_of] / (1 + np.exp(-z))
        return np.r_[np.bincount(self.feature_of, dz[self.sentence_of] * self.times, len(w) - 1), dz.sum()]


def fit(rows: list[tuple[int, float, str]], max_features: int, epochs: int) -> tuple[dict[str, float], float]:
    """Feature weights and bias from (label, row weight, text), by Adam on the noisy-or likelihood."""
    bags = []
    for label, row_weight, text in rows:
        sentences = [WORD.findall(s.lower()) for s in SENTENCE.findall(text)]
        bags.append((label, row_weight, [Counter(f for w in s for f in features(w)) for s in sentences if s]))
    names = _contrasts(bags, max_features)
    place = {f: i for i, f in enumerate(names)}
    sentence_of, feature_of, times, doc_of = [], [], [], []
    for d, (_, _, sentences) in enumerate(bags):
        for s in sentences:
            for f, n in s.items():
                if f in place:
                    sentence_of.append(len(doc_of))
                    feature_of.append(place[f])
                    times.append(n)
            doc_of.append(d)
    if not doc_of:
        return {}, -20.0
    row_weights = np.array([b[1] for b in bags])
    known = Bags(
        np.array(sentence_of, np.int64), np.array(feature_of, np.int64), np.array(times, np.float64), np.array(doc_of),
        np.array([b[0] for b in bags], float), row_weights / row_weights.sum(),
    )
    w = np.zeros(len(names) + 1)
    w[-1] = -6.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, epochs + 1):
        slope = known.slope(w)
        slope[:-1] += 1e-5 * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return {f: float(v) for f, v in zip(names, w, strict=False) if abs(v) > 1e-4}, float(w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_train_chars: int = MAX_TRAIN_CHARS,
    max_features: int = MAX_FEATURES,
    epochs: int = EPOCHS,
) -> Scorer:
    """A scorer from docs (doc_id, text) and labels (doc_id, toxic).

    Of each label about max_train_chars characters are drawn, whole texts by a hash of doc_id, and
    weighted back to their label's share, so one task holds a bounded sample. Lengths alone meet
    the labels first; then only drawn texts are shuffled. Rows with null text or label are left
    out; without any row every score is 0.
    """
    texts = docs.where("text is not null").select("doc_id", "text")
    marks = labels.where("toxic in (0, 1)").select("doc_id", "toxic")
    lengths = texts.select("doc_id", F.length("text").alias("n")).join(marks, "doc_id")
    sizes = {r["toxic"]: r["n"] for r in lengths.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    shares = {k: min(1.0, max_train_chars / max(1, sizes.get(k) or 0)) for k in (0, 1)}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    drawn = texts.where(draw < max(shares.values())).join(marks, "doc_id")
    sample = drawn.where(draw < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = []
        for batch in batches:
            drawn += [(y, 1 / shares[y], t) for y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        weights, bias = fit(sorted(drawn), max_features, epochs)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*weights, ""], pa.string()), pa.array([*weights.values(), bias], pa.float64())], ["feature", "weight"]
        )

    learned = sample.select("toxic", "text").repartition(1).mapInArrow(learn, "feature string, weight double").toArrow()
    weights = dict(zip(*(c.to_pylist() for c in learned.columns), strict=True))
    return Scorer({f: v for f, v in weights.items() if f}, weights.get("", -20.0))


SCORES = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,score:double>>"


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """A row for each row of docs (doc_id, text, held_out) with the spans of its offending sentences, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*shared.value)
        for batch in batches:
            found = [own.score(t) for t in batch.column(1).to_pylist()]
            scores = np.array([s for s, _ in found])
            columns = [
                batch.column(0),
                batch.column(2),
                pa.array(scores, pa.float64()),
                pa.array((scores >= THRESHOLD).astype(np.int32)),
                pa.array([x for _, x in found], spans),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "spans"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, SCORES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or wordless text scores 0. A doc_id with several labels is toxic if one of them says so."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", common.held_out(4).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return score_documents(docs, train(docs.where("not held_out"), labels))
