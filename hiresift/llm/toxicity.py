"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in the words it holds; a document is toxic if any of its sentences is, so its
probability is the noisy-or of theirs.  Weights are trained from document labels through that noisy-or, after which the
sentences of a high probability are the offending ones.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import WORD, by_arrow, columns, keep_rows, small_batches, text_of
from hiresift.llm.training import labelled_sample, remainder

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
MAX_ROWS = 16_000
MAX_WORDS = 1_024
MIN_DOCS = 5


def marks(text: str) -> set[str]:
    """The features of a text: its words, and the first four and five letters of longer ones, which inflected and
    compounded words share."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


@dataclass
class ToxicityModel:
    """Weights of words and the bias of a sentence that holds none of them."""

    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that hold a weighted word."""
        out = []
        for m in SENTENCE.finditer(text):
            held = self.weights.keys() & marks(m[0])
            if held:
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-max(-40.0, min(40.0, self.bias + sum(self.weights[w] for w in held)))))))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over all sentences of the whole text, and the scored sentences."""
        plain = 1 / (1 + math.exp(-self.bias))
        n = sum(1 for _ in SENTENCE.finditer(text))
        found = self.sentences(text) if self.weights.keys() & marks(text) else []
        clean = (n - len(found)) * math.log1p(-plain) + sum(math.log1p(-min(p, 1 - 1e-12)) for _, _, p in found)
        return min(1.0, max(0.0, -math.expm1(clean))), found


def telling_words(rows: DataFrame, max_words: int, min_docs: int) -> list[str]:
    """The words whose presence differs most between the classes, by chi-square over documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2000):
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(text_of(batch.column("text")), batch.column("y").to_pylist(), strict=True):
                seen[y].update(marks(text))
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({"word": words, "clean": pa.array([seen[0][w] for w in words], pa.int64()), "toxic": pa.array([seen[1][w] for w in words], pa.int64())})

    n = {int(r["y"]): int(r["count"]) for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return []
    counts = by_arrow(rows, count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("c") + F.col("t") >= min_docs)
    share = (F.col("c") + F.col("t")) / (n[0] + n[1])
    chi = F.pow(F.col("t") / n[1] - F.col("c") / n[0], F.lit(2)) / (share * (1 - share) + 1e-9)
    return [r["word"] for r in counts.orderBy(chi.desc(), "word").limit(max_words).select("word").collect()]


def bags(rows: DataFrame, words: list[str]) -> tuple[np.ndarray, ...]:
    """Per training document its label and its sentences without a telling word; per other sentence its document; per
    telling word in a sentence the sentence and the word's number."""
    number = {w: i for i, w in enumerate(words)}

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            plain, held = [], []
            for text in text_of(batch.column("text")):
                sets = [sorted(number[w] for w in marks(m[0]) if w in number) for m in SENTENCE.finditer(text)]
                held.append([s for s in sets if s])
                plain.append(len(sets) - len(held[-1]))
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "plain": pa.array(plain, pa.int32()), "held": pa.array(held, pa.list_(pa.list_(pa.int32())))})

    got = by_arrow(rows.select("text", "y"), collect, "y int, plain int, held array<array<int>>").toArrow().combine_chunks()
    held = pa.concat_arrays(got["held"].chunks) if got.num_rows else pa.array([], pa.list_(pa.list_(pa.int32())))
    sentences = held.flatten()
    doc = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
    sentence = np.repeat(np.arange(len(sentences)), np.diff(sentences.offsets.to_numpy()))
    return got["y"].to_numpy().astype(float), got["plain"].to_numpy().astype(float), doc, sentence, sentences.flatten().to_numpy().astype(np.int64)


def fit_noisy_or(data: tuple[np.ndarray, ...], n_words: int, rounds: int = 400, step: float = 0.1, ridge: float = 1e-5) -> tuple[float, np.ndarray]:
    """Bias and weights that maximise the noisy-or likelihood of `bags` (Adam over all of them; deterministic)."""
    y, plain, doc, sentence, word = data
    weight_of = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    theta = np.zeros(n_words + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(sentence, theta[word], len(doc))
        total = plain * np.logaddexp(0, theta[-1]) + np.bincount(doc, np.logaddexp(0, z), len(y)) + 1e-9
        slope = weight_of * np.where(y > 0, -1 / np.expm1(np.minimum(total, 700)), 1.0)
        dz = slope[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, dz[sentence], n_words), (slope * plain).sum() / (1 + np.exp(-theta[-1])) + dz.sum()) / len(y)
        grad[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int | None = 3, held_out: int | None = 1, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS) -> ToxicityModel:
    """Fit on at most `max_rows` labelled documents (half of each class) and `max_words` words; the only rows that
    reach the driver are those words and the training documents' word numbers.

    Without labels of both classes the model finds nothing toxic (or, if all labels are 1, everything).
    """
    rows, totals = labelled_sample(docs, labels, label, max_rows, modulus, held_out)
    if len(totals) < 2:
        return ToxicityModel(20.0 if set(totals) == {1} else -20.0)
    words = telling_words(rows, max_words, min_docs)
    data = bags(rows, words)
    if len(np.unique(data[0])) < 2:  # the labelled documents aren't at hand
        return ToxicityModel()
    bias, weights = fit_noisy_or(data, len(words))
    return ToxicityModel(bias, {w: float(x) for w, x in zip(words, weights, strict=True) if abs(x) > 1e-3})


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The columns `keep` with score, predicted and the offending sentences (start, end, probability of 0.5 or more).

    A null or empty text has no sentence and scores 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_words weights

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores, found = [], []
            for text in text_of(batch.column("scored_text")):
                p, sentences = shared.value.score(text)
                scores.append(p)
                found.append([{"start": a, "end": b, "probability": q} for a, b, q in sentences if q >= 0.5])
            out = {n: batch.column(n) for n in keep}
            out |= {"score": scores, "predicted": pa.array([int(p >= threshold) for p in scores], pa.int32()), "sentences": pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))}
            yield pa.RecordBatch.from_pydict(out)

    given = docs.select(*keep, F.col("text").alias("scored_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return by_arrow(given, apply, f"{kept}, score double, predicted int, sentences array<struct<start:int,end:int,probability:double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every document."""
    model = train(docs, labels)
    scored = score(columns(docs, "doc_id", "text"), model, ["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "sentences")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that are not predicted toxic, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return keep_rows(docs, lambda texts: [shared.value.score(t)[0] < threshold for t in texts])
