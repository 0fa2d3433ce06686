"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is cut
into blocks and every block is compressed under both; the difference of the summed sizes, divided
by the text's size, says which dictionary knows the text better. A logistic curve, fitted on
labelled rows that the dictionaries haven't seen, turns it into a score.

Bounds of the fit (parameters of ``fit``): at most ``rows`` labelled documents of each class, in
the order of a hash of the id, and at most ``blocks`` blocks of each, spread evenly over its whole
text. This sample is the only thing the driver sees; every document is scored whole.

Defined results: a null, empty or blank text has difference 0 and gets the curve's value there; if
one class has no labelled text, every score is the share of good rows among those seen (1 if there
are none); rows with a null label or id teach nothing; of a repeated id with differing labels each
row counts; repeated documents are scored each. Other columns pass through.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from fleetlens.llm.common import with_columns

BLOCK = 512  # bytes compressed at once, so that the dictionary counts along a long text
FLOOR = 64  # added to the size, so that a few bytes don't make an extreme share
DICTIONARY = 64 * 1024
# Matches of three bytes see short patterns such as marks after words.
SEARCH = dict(
    compression_level=3, min_match=3, strategy=zstandard.STRATEGY_GREEDY, hash_log=13, chain_log=13, window_log=18,
    write_checksum=False, write_content_size=False, write_dict_id=False,
)


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def dictionary(blocks: list[bytes]) -> bytes:
    """Trained on the blocks; of too few blocks for that, their content."""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[-DICTIONARY:].ljust(16)


class Sizer:
    """Compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = []
        params = zstandard.ZstdCompressionParameters(**SEARCH)
        for content in (good, bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(compression_params=params)
            self.packers.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))

    def difference(self, blocks: list[bytes]) -> float:
        """Below 0 if the good dictionary packs the blocks better, above 0 if the bad one does."""
        size = sum(map(len, blocks))
        if not size or not b"".join(blocks).strip():
            return 0.0
        good, bad = (sum(len(p.compress(b)) for b in blocks) for p in self.packers)
        return (good - bad) / (size + FLOOR)


def blocks_of(text: bytes | None) -> list[bytes]:
    """The whole text in blocks."""
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] if text else []


@functools.lru_cache(maxsize=2)
def sizer(good: bytes, bad: bytes) -> Sizer:
    return Sizer(good, bad)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a small penalty that keeps separable data finite."""
    scale = float(x.std()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + 1e-2 * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id",
        rows: int = 1500, blocks: int = 32) -> Model:
    """Model from the documents whose label is 1 (good) or 0 (bad)."""
    seen = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("y"))
    picked = [seen.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(rows) for y in (1, 0)]
    # At most 2 * rows ids: small enough to broadcast at any size of the tables.
    chosen = F.broadcast(picked[0].unionAll(picked[1]))
    raw = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("raw")).where("octet_length(raw) > 0").join(chosen, "k")
    cut = raw.select("k", "y", F.xxhash64("k", "raw").alias("place"), F.expr(
        f"transform(sequence(0, least({blocks - 1}, (octet_length(raw) - 1) div {BLOCK})), i -> substring(raw,"
        f" int(if(octet_length(raw) <= {BLOCK * blocks}, i * {BLOCK}L, i * (octet_length(raw) - {BLOCK}L) div {blocks - 1})) + 1, {BLOCK}))"
    ).alias("blocks"))
    # An id may have many documents: the bound of rows holds for these, too.
    cut = cut.where("y = 1").orderBy("place", "k").limit(rows).unionAll(cut.where("y = 0").orderBy("place", "k").limit(rows))
    sample = sorted((r.y, str(r.k), [bytes(b) for b in r.blocks]) for r in cut.collect())
    texts = {y: [b for label, _, b in sample if label == y and b"".join(b).strip()] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        share = len(texts[1]) / len(sample) if sample else 1.0
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share else -30.0))
    good, bad = (dictionary([b for t in texts[y][::2] for b in t]) for y in (1, 0))
    measure = Sizer(good, bad)
    unseen = {y: t[1::2] or t for y, t in texts.items()}
    x = np.array([measure.difference(t) for y in (0, 1) for t in unseen[y]])
    y = np.array([y for y in (0, 1) for _ in unseen[y]], float)
    slope, intercept = logistic(x, y)
    # The classes were drawn alike; the curve must hold for the shares that the labels have.
    n = {r.y: r["count"] for r in seen.where(F.col("y").isin(0, 1)).groupBy("y").count().collect()}
    intercept += float(np.log(n[1] / n[0]) - np.log(len(unseen[1]) / len(unseen[0])))
    return Model(good, bad, slope, intercept)


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds ``into``: 0 to 1, higher if the text looks more like the good ones."""
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> list:
        x = np.zeros(batch.num_rows)
        if model.good:
            measure = sizer(model.good, model.bad)
            x = np.array([measure.difference(blocks_of(t)) for t in batch.column(at).cast(pa.binary()).to_pylist()], float)
        return [pa.array(1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -30, 30))), pa.float64())]

    return with_columns(df, T.StructType([T.StructField(into, T.DoubleType())]), run)
