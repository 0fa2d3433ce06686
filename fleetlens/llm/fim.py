"""Fill-in-the-middle transformation with a learned rank index over line boundaries.

A text is cut into lines; the offsets at which its lines end are the boundaries, and a cut after k
lines is the k-th boundary. The index over a text's boundaries is a list of straight segments, each
fitted so that no boundary lies further than ``error`` code points from it (a cone of slopes is
narrowed boundary by boundary until it is empty), and what the rounded line leaves over for every
boundary. A cut is predicted from its segment and then corrected exactly by its residual.

The cuts and the form come from hashes of the id, so a row's result depends on nothing but the row.
A text in which one of the markers occurs, or that is empty, stays as it is; in all others the
markers can be told from the text, and ``restore`` rebuilds it from output and form.

Defined results: a null text is empty; a null id is hashed as empty text, so that equal ids get equal
draws; a text is handled by the task that reads it, in memory of a few times its size; repeated rows
and an empty table need nothing special; columns of the input stay, and one that has an added
column's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fleetlens.llm.common import unique_name, with_columns

# The markers in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 64
SEED = 7

ADDED = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
])


def boundaries(text: str) -> np.ndarray:
    """Code points before each cut: 0, then the end of every line."""
    lines = text.split("\n")
    ends = np.fromiter(map(len, lines), np.int64, len(lines))
    ends[:-1] += 1
    if not lines[-1]:
        ends = ends[:-1]
    return np.r_[0, np.cumsum(ends)]


@dataclass
class RankIndex:
    """Boundaries of one text as segments (first rank, offset there, slope) and residuals."""

    first: np.ndarray
    start: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        first, slopes = [], []
        at, n = 0, len(offsets)
        while at < n:
            low, high, end, width = -np.inf, np.inf, at + 1, 64
            while end < n:
                stop = min(end + width, n)
                ranks = np.arange(end - at, stop - at)
                rise = offsets[end:stop] - offsets[at]
                lows = np.maximum(np.maximum.accumulate((rise - error) / ranks), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / ranks), high)
                fits = int(np.argmax(np.r_[lows > highs, True]))
                if fits:
                    low, high, end = lows[fits - 1], highs[fits - 1], end + fits
                if end < stop:
                    break
                width *= 2
            first.append(at)
            slopes.append((low + high) / 2 if end > at + 1 else 0.0)
            at = end
        index = cls(np.array(first, np.int64), offsets[first], np.array(slopes), np.zeros(n, np.int32))
        left_over = offsets - index.predict(np.arange(n))
        index.residual = left_over.astype(np.int8 if error < 127 else np.int32)
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        of = np.searchsorted(self.first, ranks, "right") - 1
        return self.start[of] + np.floor(self.slope[of] * (ranks - self.first[of]) + 0.5).astype(np.int64)

    def __getitem__(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residual[ranks]


def cut(text: str, draws: tuple[int, int, int, int], rate: int, suffix_first: int, error: int) -> tuple:
    """(lines, form, prefix and middle code points, output) of one text."""
    offsets = boundaries(text)
    n = len(offsets) - 1
    if n == 0 or draws[2] % 100 >= rate or any(marker in text for marker in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = RankIndex.fit(offsets, error)[np.sort(np.array([draws[0] % (n + 1), draws[1] % (n + 1)]))].tolist()
    head, middle, tail = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that ``cut`` was given, from its output and form alone."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    at = output.index(second, len(PREFIX))
    last = output.index(MIDDLE, at)
    one, two, middle = output[len(PREFIX):at], output[at + len(second):last], output[last + len(MIDDLE):]
    return one + middle + two if form == "psm" else two + middle + one


def draw(key: str, seed: int, number: int) -> Column:
    """The ``number``-th (from 0) eight hex digits of the seeded hash of an id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def transform(
    df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = 100, suffix_first: int = 50, error: int = ERROR
) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output.

    ``rate`` is the percentage of texts that are rearranged, ``suffix_first`` that of these which
    have the suffix in front.
    """
    if not 1 <= error < 1 << 30:
        raise ValueError("error must be at least 1 and below 2**30")
    drawn = unique_name(df, "draws")
    rows = df.withColumn(drawn, F.array(*[draw(key, seed, i) for i in range(4)]))
    content, draws = rows.columns.index(text), len(rows.columns) - 1

    def run(batch: pa.RecordBatch) -> list:
        found = [cut(t or "", d, rate, suffix_first, error) for t, d in zip(batch.column(content).to_pylist(), batch.column(draws).to_pylist())]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]

    return with_columns(rows, ADDED, run).drop(drawn)


def restore(df: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """Adds ``into``: the exact text before the transformation."""
    written, kind = df.columns.index(output), df.columns.index(form)

    def run(batch: pa.RecordBatch) -> list:
        return [pa.array([rebuilt(*row) for row in zip(batch.column(written).to_pylist(), batch.column(kind).to_pylist())], pa.string())]

    return with_columns(df, T.StructType([T.StructField(into, T.StringType())]), run)
