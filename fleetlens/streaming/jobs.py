"""Streams of points (T1-T4): collection, duplicate suppression, downsampling, roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetlens.operators import points as op
from fleetlens.plans import metrics as plans
from fleetlens.session import new_work_dir

WATERMARK = "10 minutes"
TRIGGER = "5 seconds"

# Normalisers without aggregates, so they run on a stream as they are.
STREAM_NORMALISERS = {
    "hbase": plans.hbase_scrape_points,
    "hdfs": plans.hdfs_points,
    "node": plans.node_points,
    "mntr": plans.kv_points,
}


def read_landing(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Landed payload tables as a stream; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def collect_points(payloads: DataFrame, parser: str) -> DataFrame:
    """Landed payloads of one parser to points with series keys."""
    return op.with_series_key(STREAM_NORMALISERS[parser](payloads))


def dedupe(points: DataFrame, order: str = "seq", watermark: str = WATERMARK) -> DataFrame:
    """The row of the greatest ``order`` of each series and instant, once the watermark has
    passed it; a row later than the watermark is dropped and shows in ``numRowsDroppedByWatermark``."""
    return points.withWatermark("ts", watermark).groupBy("series_key", "ts").agg(
        F.max_by("value", order).alias("value"), F.max(order).alias(order))


def downsample(
    points: DataFrame, interval: str, keys: Sequence[str] = ("series_key",), watermark: str = WATERMARK
) -> DataFrame:
    """Closed buckets only, each once."""
    grouped = points.withWatermark("ts", watermark).groupBy(F.window("ts", interval).alias("w"), *keys)
    return grouped.agg(F.avg("value").alias("value")).select(
        *keys, F.col("w.start").alias("bucket"), F.col("w.end").alias("bucket_end"), "value"
    )


def region_rollup(
    regions: DataFrame,
    interval: str,
    scrape: Sequence[str] = ("cluster", "job", "host", "port"),
    watermark: str = WATERMARK,
) -> DataFrame:
    """T4: the roll-up of each closed window, in two stateful aggregates: region rows are summed to
    tables once, and the grouping sets run over what the first one emits when a window closes."""
    base = [*scrape, "region_metric"]
    summed = regions.withWatermark("ts", watermark).groupBy(F.window("ts", interval).alias("t"), *base, "namespace", "table").agg(
        F.sum("value").alias("value"), F.count("*").alias("regions"))
    # window_time carries the watermark on; a table sum falls into the window it was made in.
    again = summed.withColumn("w", F.window(F.window_time("t"), interval)).drop("t")
    base = ["w", *base]
    grouped = again.groupingSets(
        [[*base, "namespace", "table"], [*base, "namespace"], base], *base, "namespace", "table"
    ).agg(
        F.sum("value").alias("value"), F.sum("regions").alias("regions"),
        F.grouping("namespace").alias("no_namespace"), F.grouping("table").alias("no_table"),
    )
    level = F.when(F.col("no_namespace") == 1, "server").when(F.col("no_table") == 1, "namespace").otherwise("table")
    return grouped.select(
        F.col("w.start").alias("bucket"), *scrape, level.alias("level"), "namespace", "table",
        "region_metric", "value", "regions",
    )


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all available input into a Parquet table and read that table."""
    spark = stream.sparkSession
    root = new_work_dir(spark, label)
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/table")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


def start(stream: DataFrame, table_path: str, checkpoint: str, trigger: str = TRIGGER):
    """The long-running form: a partitioned Parquet table, exactly once."""
    out = stream.withColumn("date", F.to_date("ts"))
    return (
        out.writeStream.outputMode("append").format("parquet").partitionBy("date")
        .option("checkpointLocation", checkpoint).option("path", table_path)
        .trigger(processingTime=trigger).start()
    )
