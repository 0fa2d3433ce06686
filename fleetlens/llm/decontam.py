"""Benchmark decontamination by spaced seeds.

Words (A-Z in lower case) are hashed. A mask such as 11001011 marks which of the next words count:
the hash of those words is a seed, and words under a 0 may differ. Seeds of all benchmark items and
of all documents are joined; every hit names an item and a diagonal (document place minus item
place). Around a hit, document and item are compared word by word along the diagonal, without gaps.
A leak is a segment of at least LEAST words (or of the whole item, if that is shorter) of which at
least three quarters are equal; the longest one is reported, the first of equals, without the words
that differ at its ends as far as it stays that long.

While the benchmark has at most SENT_WORDS words, its seeds and words are sent to the tasks, where
the join and the comparison run next to the text. Beyond that the seeds of the documents are
joined with those of the benchmark by hash, and the hits with the texts around them by key.

Defined results: a null or empty text or item has no words and no leak; an item with fewer than
SHORTEST words is too short to be evidence and never matches; an item that occurs several
times in a document is reported once, at its best place, the first of equals; repeated documents and
items are reported each; null ids are passed on. The result has only the columns named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.llm.common import WordHashes, mix64, stage, unique_name, with_columns, words_of

# Five words count in every mask. Every way to replace up to a quarter of 7 to 12, 16 or 20
# words leaves a seed of one of them, and a longer leak has a part of 12 to 23 words that is one too.
MASKS = ["110111", "1111001", "1010111", "11001011", "11100101", "10011011", "111101", "11111"]
LEAST = 12
SHORTEST = 7
SENT_WORDS = 1 << 18
_OFFSETS = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in MASKS]
_ODD = np.random.default_rng(20240611).integers(1, 1 << 63, (len(MASKS), 5), dtype=np.uint64) | np.uint64(1)

_hashes = WordHashes()


def hashed(text: bytes | None) -> np.ndarray:
    return _hashes(words_of(text))


def seeds_of(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and seed hashes, mask by mask."""
    for mask, offsets, odd in zip(MASKS, _OFFSETS, _ODD):
        n = len(words) - len(mask) + 1
        if n > 0:
            total = np.zeros(n, np.uint64)
            for o, m in zip(offsets.tolist(), odd):
                total += words[o : o + n] * m
            yield np.arange(n), mix64(total)


def best_segment(words: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """Start in ``words``, length and equal words of the longest leak on a diagonal, None if there is none."""
    low, high = max(0, diagonal), min(len(words), diagonal + len(item))
    if high <= low:
        return None
    same = words[low:high] == item[low - diagonal : high - diagonal]
    # A segment is three quarters equal if the sums below don't fall from its start to its end. The
    # earliest start for an end is the first place at which the least sum so far is no greater.
    sums = np.r_[0, np.cumsum(np.where(same, 1, -3))]
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
    end = int(np.argmax(np.arange(len(sums)) - starts))
    start, least = int(starts[end]), min(LEAST, len(item))
    if end - start < least:
        return None
    while not same[start] and end - start > least:
        start += 1
    while not same[end - 1] and end - start > least:
        end -= 1
    return low + start, end - start, int(same[start:end].sum())


class Index:
    """Seeds of a benchmark of bounded size, and its items' words."""

    BITS = 24

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        cells = [(h, np.full(len(h), i), at) for i, item in enumerate(items) if len(item) >= SHORTEST for at, h in seeds_of(item)]
        seeds, whose, places = (np.concatenate(x) if cells else np.zeros(0, t) for x, t in zip(zip(*cells) if cells else ((), (), ()), (np.uint64, int, int)))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.whose, self.places = seeds[order], whose[order], places[order]
        self.filter = np.zeros(1 << self.BITS, bool)
        self.filter[self.seeds >> np.uint64(64 - self.BITS)] = True

    def leaks(self, words: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Best segment of every item that leaks into a document."""
        diagonals: set[tuple[int, int]] = set()
        for at, h in seeds_of(words):
            near = np.flatnonzero(self.filter[h >> np.uint64(64 - self.BITS)])
            if not len(near):
                continue
            low = np.searchsorted(self.seeds, h[near], "left")
            high = np.searchsorted(self.seeds, h[near], "right")
            for place, a, b in zip(at[near].tolist(), low.tolist(), high.tolist()):
                diagonals.update((int(self.whose[k]), place - int(self.places[k])) for k in range(a, b))
        found: dict[int, tuple[int, int, int]] = {}
        for item, diagonal in sorted(diagonals):
            segment = best_segment(words, self.items[item], diagonal)
            if segment and (item not in found or (segment[2], -segment[0]) > (found[item][2], -found[item][0])):
                found[item] = segment
        return found


def prepared(docs: DataFrame, benchmark: DataFrame, text: str, key: str, item: str) -> tuple[DataFrame, DataFrame, bool]:
    """Both tables with common names, and whether the benchmark is small enough to be sent."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    items = benchmark.select(F.col(item).alias("item_id"), F.col(text).cast("binary").alias("text")).where("text IS NOT NULL")
    # Words are counted in whole before anything is sent.
    size = items.agg(F.sum(F.size(F.split(F.col("text").cast("string"), r"\s+")))).first()[0] or 0
    return rows, items, size <= SENT_WORDS


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(doc_id, item_id, start_word, n_aligned, n_equal): one row for each document and item that leaks into it."""
    rows, items, small = prepared(docs, benchmark, text, key, item)
    return by_sending(rows, items) if small else by_joining(rows, items)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` into which no benchmark item leaks, with all their columns."""
    name = unique_name(docs, "leaked")
    rows, items, small = prepared(docs, benchmark, text, key, item)
    if not small:
        numbered = stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
        found = by_joining(numbered.select(F.col(name).alias("doc_id"), F.col(text).cast("binary").alias("text")), items)
        return numbered.join(found.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").drop(name).select(docs.columns)
    sent, made = send(items), []
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> list:
        if not made:
            made.append(Index([hashed(t) for t in sent.value[1]]))
        return [pa.array([bool(made[0].leaks(hashed(x and x.encode()))) for x in batch.column(at).to_pylist()], pa.bool_())]

    marked = with_columns(docs, T.StructType([T.StructField(name, T.BooleanType())]), run)
    return marked.where(~F.col(name)).drop(name)


def schema_of(rows: DataFrame, items: DataFrame) -> str:
    return (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()},"
            " start_word long, n_aligned long, n_equal long")


def send(items: DataFrame) -> Broadcast:
    """Ids and texts of at most SENT_WORDS words, for the tasks."""
    known = sorted(((r.item_id, bytes(r.text)) for r in items.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return items.sparkSession.sparkContext.broadcast(([i for i, _ in known], [t for _, t in known]))


def by_sending(rows: DataFrame, items: DataFrame) -> DataFrame:
    sent = send(items)
    made: list = []
    kind = to_arrow_schema(items.schema).field("item_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Index([hashed(t) for t in sent.value[1]]))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, doc in enumerate(batch.column(1).to_pylist()):
                for item, segment in made[0].leaks(hashed(doc)).items():
                    for column, x in zip(out, (i, sent.value[0][item], *segment)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], kind), *(pa.array(x, pa.int64()) for x in out[2:])],
                names=["doc_id", "item_id", "start_word", "n_aligned", "n_equal"])

    return rows.mapInArrow(run, schema_of(rows, items))


def seed_rows(rows: DataFrame) -> DataFrame:
    """(row, seed, place) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = hashed(doc)
                for at, h in seeds_of(found) if len(found) >= SHORTEST else ():
                    yield pa.record_batch([pa.array([row] * len(at), pa.int64()), pa.array(h.view(np.int64)), pa.array(at, pa.int64())], names=["row", "seed", "place"])

    return rows.select("row", "text").mapInArrow(run, "row long, seed long, place long")


def by_joining(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size."""
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    items = stage(items.withColumn("row", F.monotonically_increasing_id()), "items")
    hits = seed_rows(rows).alias("d").join(seed_rows(items).alias("b"), F.col("d.seed") == F.col("b.seed")).select(
        F.col("d.row").alias("doc_row"), F.col("b.row").alias("item_row"), (F.col("d.place") - F.col("b.place")).alias("diagonal"))
    grouped = hits.distinct().groupBy("doc_row", "item_row").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    both = grouped.join(rows.select(F.col("row").alias("doc_row"), "doc_id", F.col("text").alias("doc")), "doc_row").join(
        items.select(F.col("row").alias("item_row"), "item_id", F.col("text").alias("item")), "item_row").select("doc_id", "item_id", "doc", "item", "diagonals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (doc, item, diagonals) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                words, wanted = hashed(doc), hashed(item)
                segments = [s for s in (best_segment(words, wanted, d) for d in diagonals) if s]
                if segments:
                    at.append(i)
                    found.append(max(segments, key=lambda s: (s[2], -s[0])))
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))],
                names=["doc_id", "item_id", "start_word", "n_aligned", "n_equal"])

    return both.mapInArrow(run, schema_of(rows, items))
