"""Query and oracle registry."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions import points as pf
from fleetlens.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; zone-less timestamps become UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def epoch(column: Column | str) -> Column:
    return F.unix_seconds(column)


def point_report(points: DataFrame) -> DataFrame:
    """Points in comparable form: series key instead of a map, seconds, rounded value."""
    return points.select(
        pf.series_key(F.col("metric"), F.col("tags")).alias("series_key"),
        epoch("ts").alias("ts_s"), r6("value").alias("value"),
    )
