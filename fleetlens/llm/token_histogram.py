"""Token counts: the exact histogram of encoded lengths and what its suffix sums answer.

``length_histogram`` counts documents by encoded length (one aggregate with partial sums, so a
common length is no hot key). ``limit_report`` gives one row for every length that occurs: how
many documents and tokens lie at or above it, and how many tokens stay if every document is cut
at that context limit. ``at_limits`` answers limits that don't occur as a length, and
``quantiles`` exact quantiles.

The running sums are taken in two steps, per chunk of lengths and then across chunk totals, so no
task holds the whole histogram.

Defined results: a null or empty text has length 0; no documents give an empty histogram; repeated
rows count each; the inputs' other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fleetlens.llm import bpe
from fleetlens.llm.common import with_columns

CHUNK = 1024  # lengths whose running sums one task takes


def encoded_lengths(df: DataFrame, text: str = "text", into: str = "length", path: str | None = None) -> DataFrame:
    """Adds ``into``: the number of tokens of the whole text."""
    path = path or bpe.default_vocabulary()
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> list:
        known = bpe.vocabulary(path)
        return [pa.array([len(x) // 4 for x in known.encode_many(batch.column(at).to_pylist())], pa.int64())]

    return with_columns(df, T.StructType([T.StructField(into, T.LongType())]), run)


def length_histogram(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(length, n_docs) over all documents."""
    lengths = encoded_lengths(df.select(F.col(text).alias("text")), path=path).select("length")
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds n_longer, tokens_longer (documents above the length) and n_total, n_upto (all, up to the length)."""
    h = histogram.select("length", "n_docs", F.floor(F.col("length") / CHUNK).alias("chunk"))
    totals = h.groupBy("chunk").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("length") * F.col("n_docs")).alias("tokens"))
    # One row per 1024 lengths: the longest document bounds this window.
    later = Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "chunk",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("earlier_docs"),
    )
    above = Window.partitionBy("chunk").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("chunk").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return h.join(totals, "chunk").select(
        "length", "n_docs",
        (F.coalesce(F.sum("n_docs").over(above), F.lit(0)) + F.col("later_docs")).alias("n_longer"),
        (F.coalesce(F.sum(F.col("length") * F.col("n_docs")).over(above), F.lit(0)) + F.col("later_tokens")).alias("tokens_longer"),
        (F.sum("n_docs").over(upto) + F.col("earlier_docs")).alias("n_upto"),
    )


def limit_report(histogram: DataFrame) -> DataFrame:
    """One row for every occurring length taken as the context limit.

    n_docs: documents of exactly that length; n_longer, tokens_longer: documents above it;
    tokens_cut: tokens lost by cutting at the limit; tokens_total: all tokens; tokens_kept: what
    remains; quantile: share of documents that fit whole.
    """
    sums = suffix_sums(histogram)
    docs = histogram.agg(F.sum("n_docs")).scalar()
    tokens = histogram.agg(F.sum(F.col("length") * F.col("n_docs"))).scalar()
    cut = F.col("tokens_longer") - F.col("n_longer") * F.col("length")
    return sums.select(
        F.col("length").alias("context_limit"), "n_docs", "n_longer", "tokens_longer",
        docs.alias("docs_total"), tokens.alias("tokens_total"),
        cut.alias("tokens_cut"), (tokens - cut).alias("tokens_kept"), (F.col("n_upto") / docs).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_longer, tokens_kept) for given limits, one aggregate over the histogram."""
    cells = [
        F.struct(
            F.lit(limit).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n_docs"))), F.lit(0)).alias("n_longer"),
            F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens_kept"),
        )
        for limit in limits
    ]
    return histogram.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of the documents doesn't exceed."""
    report = limit_report(histogram)
    cells = [
        F.struct(F.lit(s).cast("double").alias("share"), F.min(F.when(F.col("quantile") >= s, F.col("context_limit"))).alias("length"))
        for s in shares
    ]
    return report.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
