"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, neighbouring pairs, and pairs with one or two words between them that a text has
(repeats count once), hashed into 2^bits places. Training goes through a bounded sample of labelled rows
with a learning rate of its own for each coordinate and an L1 penalty that keeps most weights at nought;
the few others are broadcast, at most 2^bits numbers. Scoring covers every text whole.

Null and empty texts get the score of the bias alone. Labels are 0 or 1; null labels don't train; if a document has
several labels the largest counts, and of several texts the least. Without any labelled row every score is 0.5 - a hair, so
nothing is rejected. Rows return as often as they stand; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, bounded_sample, held_out, map_batches, map_columns, mix64, word_hashes

#: Rows that train at most, a third of them toxic at most: those whose salted id hashes lowest.
TRAIN_ROWS = 4500
#: Characters of texts that train at most: rows after these many, in the order of their hash, don't train.
TRAIN_CHARS = 64_000_000
_U64 = np.uint64


@dataclass
class Model:
    bits: int
    bias: float
    places: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, dtype=np.float32)
        out[self.places] = self.weights
        return out


def features(words: np.ndarray, bits: int) -> np.ndarray:
    """Places of all grams of a text, repeats kept."""
    out = [mix64(words)]
    for gap in (1, 2, 3):
        if len(words) > gap:
            out.append(mix64(words[:-gap] * _U64(0x9E3779B97F4A7C15) + words[gap:] + _U64(gap)))
    return (np.concatenate(out) >> _U64(64 - bits)).astype(np.int64)


def train(rows: list[tuple[str | None, int]], bits: int = 20, alpha: float = 3.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0, epochs: int = 10, least: int = 4, seed: int = 7) -> Model:
    """FTRL-proximal on (text, label) rows. Coordinates: 2^bits grams, and last the bias, which has no
    penalty. A gram takes part once `least` of the rows have it; rarer ones could only learn their rows by heart."""
    cache = WordHashes()
    size = 1 << bits
    sets = [(np.unique(features(word_hashes(t, cache), bits)), float(y)) for t, y in rows]
    seen = np.zeros(size, dtype=np.int64)
    for at, _ in sets:
        seen[at] += 1
    sets = [(at[seen[at] >= least], y) for at, y in sets]
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(sets)):
            at, y = sets[i]
            w, bias = weights(at), -bias_z / ((beta + bias_n**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            n_at = n[at]
            z[at] += g - (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / alpha * w
            n[at] += g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha * bias
            bias_n += g * g
    w = weights(np.arange(size))
    at = np.flatnonzero(w)
    return Model(bits, -bias_z / ((beta + bias_n**0.5) / alpha) if sets else -1e-6, at, w[at].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, **settings) -> Model:
    """Learns from documents outside the held-out fold; labels: doc_id and toxic. One text of each document, at most
    `rows` of them with about `chars` characters together, come to the driver."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = [bounded_sample(marks.where(F.col("toxic") == y), "doc_id", n, "toxicity").limit(n) for y, n in ((1, rows // 3), (0, rows - rows // 3))]
    picked = few[0].union(few[1]).withColumnRenamed("doc_id", "id")
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).groupBy("id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("id", F.lit("order")), "id"))  # over at most `rows` rows
    found = sample.withColumn("upto", upto).where(F.col("upto") <= chars).collect()
    return train([(r["text"], r["toxic"]) for r in sorted(found, key=lambda r: (r["id"], r["text"] or ""))], **settings)


def logits(texts: list[str | None], model: Model, dense: np.ndarray, cache: WordHashes) -> list[float]:
    out = []
    for text in texts:
        at = features(word_hashes(text, cache), model.bits)
        at = np.unique(at[np.flatnonzero(dense[at])])  # most grams have no weight, so few are left to sort
        out.append(model.bias + float(dense[at].sum(dtype=np.float64)))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        cache, model = WordHashes(), shared.value
        dense = model.dense()
        for batch in batches:
            x = np.array(logits(batch["text"], model, dense, cache), dtype=np.float64)
            yield {"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-np.clip(x, -35, 35)))}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, **settings))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that score 0.5 or more, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, model = WordHashes(), shared.value
        dense = model.dense()
        for batch in batches:
            keep = np.array(logits(batch.column("text").to_pylist(), model, dense, cache)) < 0
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return map_batches(docs, run, docs.schema)
