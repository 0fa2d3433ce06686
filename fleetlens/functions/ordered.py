"""Ordered concatenation of many rows into one text, in two steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

CHUNK = 1024
KEY_PREFIX = 32


def ordered_concat(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    chunk: Column,
    value: Column,
    separator: str,
    out: str,
    flag: Column | None = None,
    flag_out: str = "flag",
) -> DataFrame:
    """One row per key with the values joined in ``order``; NULL values are left out.

    ``chunk`` must not decrease along ``order``. Rows are first joined per (key, chunk), so a
    key with very many rows is spread over many tasks, and only the finished chunk texts
    meet in one place. ``flag``, when given, comes out as true if it is so for any row.
    """
    flag = F.lit(False) if flag is None else flag
    staged = df.select(
        *keys, order.alias("__order"), chunk.alias("__chunk"), value.alias("__value"), flag.alias("__flag")
    )
    parts = staged.groupBy(*keys, "__chunk").agg(
        F.array_sort(F.collect_list(F.struct("__order", "__value"))).alias("__items"), F.max("__flag").alias("__flag")
    ).withColumn("__text", F.when(
        F.exists("__items", lambda i: i["__value"].isNotNull()),
        F.array_join(F.transform("__items", lambda i: i["__value"]), separator),
    ))
    whole = parts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("__chunk", "__text"))).alias("__parts"), F.max("__flag").alias(flag_out)
    )
    text = F.array_join(F.transform("__parts", lambda c: c["__text"]), separator).alias(out)
    return whole.select(*keys, text, *([flag_out] if flag_out != "flag" else []))


def by_position(df: DataFrame, keys, position: Column, value: Column, separator: str, out: str) -> DataFrame:
    """``ordered_concat`` by an integer position."""
    return ordered_concat(df, keys, position, F.floor(position / F.lit(CHUNK)), value, separator, out)

