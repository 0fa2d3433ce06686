"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed counts of the 1- to 3-grams of the lower-cased letters of the whole text (other
characters count as one blank), weighted by inverse document frequency and scaled to length one.
The weights are learned with the follow-the-regularised-leader rule (per-coordinate rates, an L1
and an L2 penalty); a temperature fitted on rows kept out of that training calibrates the scores.

Document frequencies cover every training document: each task sums its own and the sums are merged
by bucket. The fit itself takes a bounded sample (parameter ``rows``: at most an equal number of rows
of each language, one at least, picked by a hash of the row); only its sparse features reach the
driver. The number of languages has no limit, but the driver holds about five tables of languages x
BUCKETS numbers while it learns, and each worker one.

Defined results: a null text or one without a letter is ``und`` with score 0; if nothing can be
learned, every text is; rows with a null language or text teach nothing; a tie goes to the first
language in alphabetical order; repeated rows count each. Other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fleetlens.llm.common import with_columns

BUCKETS = 1 << 14
UNKNOWN = "und"
# Odd multipliers that spread an n-gram's characters over the buckets.
SPREAD = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


@functools.cache
def letters() -> np.ndarray:
    """For every code point: itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None if it has no letter."""
    if not text:
        return None
    code = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    filled = code != 0
    if not filled.any():
        return None
    # A run of other characters is one blank, and the text starts and ends with one.
    stay = filled.copy()
    stay[1:] |= filled[:-1]
    code = np.concatenate([[0], code[stay], [0]]).astype(np.uint32)
    shift = np.uint32(32 - 14)
    total = np.zeros(BUCKETS, np.int64)
    mixed = np.zeros(len(code), np.uint32)
    for n, odd in enumerate(SPREAD):
        mixed = (mixed[: len(code) - n] * np.uint32(0x01000193) + code[n:] + np.uint32(1)) * odd
        mixed ^= mixed >> np.uint32(15)
        total += np.bincount((mixed * odd) >> shift, minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def vector(total: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a scaled TF-IDF vector."""
    at = np.flatnonzero(total)
    value = np.log1p(total[at]) * idf[at]
    return at, value / (np.sqrt((value * value).sum()) or 1.0)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """For every bucket the number of documents that have it, and the number of documents."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for found in map(counts, batch.column(0).to_pylist()):
                if found is not None:
                    total[:BUCKETS] += found > 0
                    total[BUCKETS] += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    merged = docs.select(text).mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS + 1, np.int64)
    for row in merged.collect():  # at most BUCKETS + 1 rows
        total[row.bucket] = row.n
    return total[:BUCKETS], int(total[BUCKETS])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4,
         alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x buckets) and bias by follow-the-regularised-leader, one row at a time."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[:, at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[:, at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value, y = rows[i]
            at, value = np.append(at, BUCKETS), np.append(value, 0.3)
            w = weights(at)
            p = w @ value
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1.0
            g = p[:, None] * value[None, :]
            old = n[:, at]
            new = old + g * g
            z[:, at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[:, at] = new
    final = weights(np.arange(BUCKETS + 1))
    return final[:, :BUCKETS], final[:, BUCKETS] * 0.3


def temperature(logits: np.ndarray, y: np.ndarray, smooth: float = 0.01) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    A small share of every label goes to all classes alike, so that rows without an error don't
    make the scores certain.
    """
    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(1, keepdims=True)
        x = x - np.log(np.exp(x).sum(1, keepdims=True))
        return float(-((1 - smooth) * x[np.arange(len(y)), y] + smooth * x.mean(1)).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = 4000) -> Model:
    """Model from the rows of ``docs``: document frequencies from all, weights from about ``rows`` of them.

    Every language is learned, from one row at least.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    total, n = document_frequencies(known, "text")
    idf = np.log((1 + n) / (1 + total)) + 1.0
    hashed = known.where(F.col("text").rlike(r"\p{L}")).withColumn("place", F.xxhash64("key", "text", "lang"))
    # One row for each language.
    sizes = hashed.groupBy("lang").agg(F.count("*").alias("size"), F.min("place").alias("least"))
    languages = sizes.count()
    if not languages or not n:
        return Model((), idf, np.zeros((0, BUCKETS)), np.zeros(0), 1.0)
    # The rows of least hash of each language: nearly all others go before they are ranked.
    share = max(1, rows // languages)
    bound = F.least(F.lit(1.0), F.lit(2.0 * share + 40) / F.col("size"))
    near = hashed.join(F.broadcast(sizes), "lang").where((F.col("place") == F.col("least")) | (F.col("place") / F.lit(2.0**64) + 0.5 <= bound))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "key")))
    chosen = ranked.where(F.col("rank") <= share).select("text", "lang")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(counts(x), y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            made = [(*vector(c, idf), y) for c, y in out if c is not None]
            yield pa.record_batch(
                [pa.array([a.astype(np.int32).tobytes() for a, _, _ in made], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v, _ in made], pa.binary()),
                 pa.array([y for _, _, y in made], pa.string())], names=["at", "value", "lang"])

    found = sorted((bytes(r.at), bytes(r.value), r.lang) for r in chosen.mapInArrow(features, "at binary, value binary, lang string").collect())
    names = tuple(sorted({y for _, _, y in found}))
    if not names:
        return Model((), idf, np.zeros((0, BUCKETS)), np.zeros(0), 1.0)
    number = {y: i for i, y in enumerate(names)}
    data = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32).astype(float), number[y]) for a, v, y in found]
    # Every fifth row of a language is kept out, never its first.
    seen = [0] * len(names)
    train, held = [], []
    for row in data:
        seen[row[2]] += 1
        (train if seen[row[2]] % 5 else held).append(row)
    held = held or data
    weights, bias = ftrl(train, len(names))
    logits = np.array([weights[:, a] @ v + bias for a, v, _ in held])
    return Model(names, idf, weights, bias, temperature(logits, np.array([y for _, _, y in held])))


def predict(df: DataFrame, model: Model, text: str = "text", into: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds ``into`` and ``score``, the calibrated probability of that language."""
    at = df.columns.index(text)
    # The model has a fixed size: languages x buckets.
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        m = sent.value
        names, scores = [], []
        for x in batch.column(at).to_pylist():
            found = counts(x) if m.languages else None
            if found is None:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            places, value = vector(found, m.idf)
            logits = (m.weights[:, places] @ value + m.bias) / m.temperature
            p = np.exp(logits - logits.max())
            best = int(p.argmax())
            names.append(m.languages[best])
            scores.append(float(p[best] / p.sum()))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    added = T.StructType([T.StructField(into, T.StringType()), T.StructField(score, T.DoubleType())])
    return with_columns(df, added, run)
