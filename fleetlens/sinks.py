"""Sinks: points (K1), inventory snapshots (K2), configuration files (K3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import points as pf
from fleetlens.operators.templates import job_root_dir


def point_json(points: DataFrame) -> DataFrame:
    """K1: each point as the JSON object a time-series store takes; timestamps in seconds."""
    sorted_tags = F.map_from_entries(F.array_sort(F.map_entries("tags")))
    body = F.struct(
        "metric", F.unix_seconds("ts").alias("timestamp"), "value", sorted_tags.alias("tags")
    )
    return points.select(F.to_json(body).alias("point"))


def write_points(points: DataFrame, path: str, mode: str = "append") -> None:
    """K1: points as Parquet by metric family and date, the two columns readers filter on.

    Rows are dealt by a range over (family, date, series): a folder gets few files, and a family
    that holds most of the points is written by many tasks.
    """
    out = points.withColumn("metric_family", pf.metric_family(F.col("metric"))).withColumn(
        "date", F.to_date("ts")
    )
    order = ["metric_family", "date", *(["series_key"] if "series_key" in out.columns else []), "ts"]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    out.write.mode(mode).partitionBy("metric_family", "date").parquet(path)


def write_inventory(programs: DataFrame, path: str) -> None:
    """K2: the current state replaces the snapshot."""
    programs.write.mode("overwrite").parquet(path)


def config_path(root: Column, cluster: Column, job: Column, task_id: Column, file: Column) -> Column:
    """K3: a bare file name goes to the task's conf folder, a name with a folder stays."""
    bare = ~F.contains(file, F.lit("/"))
    return F.when(bare, F.concat(job_root_dir(root, cluster, job, task_id), F.lit("/conf/"), file)).otherwise(file)


def write_configs(files: DataFrame, path: str) -> None:
    """K3: (cluster, job, task_id, target, text) rows, ordered by target inside each file.

    Not partitioned by cluster: a fleet has too many clusters for a folder each, and the
    file statistics already let a reader skip to its targets.
    """
    files.sortWithinPartitions("target").write.mode("overwrite").parquet(path)
