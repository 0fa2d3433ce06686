"""K1: the point store. Points lie by metric family and date and name their series by a 64-bit id;
the series themselves are a table of their own.

``<path>/points/metric_family=.../date=...`` has (series_id, ts, value, priority, batch);
``<path>/series`` has (series_id, metric, tags, series_key).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions import points as pf
from fleetlens.operators import series
from fleetlens.session import stage

POINTS = "series_id bigint, ts timestamp, value double, priority int, batch bigint, metric_family string, date date"
SERIES = "series_id bigint, metric string, tags map<string,string>, series_key string"
FOLDER = ["metric_family", "date"]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table below ``path``, empty if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/points", POINTS)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/series", SERIES)


def _folder() -> Column:
    return F.concat("metric_family", F.lit("/"), F.col("date").cast("string"))


def _in_folders(points: DataFrame, folders: DataFrame) -> DataFrame:
    """The points of some folders: a list the scan asks for when it runs, so other folders stay closed."""
    wanted = folders.select(_folder().alias("f")).agg(F.collect_set("f")).scalar()
    return points.filter(F.array_contains(wanted, _folder()))


def _replace(points: DataFrame, path: str) -> None:
    """Puts ``points`` in place of what their folders hold. Rows are dealt by a range, so that a folder
    gets few files and one with most of the points is written by many tasks."""
    order = [*FOLDER, "series_id", "ts"]
    dealt = points.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*FOLDER).parquet(f"{path}/points")


def append_points(points: DataFrame, path: str, batch: int, priority: Column | int = 0) -> None:
    """Merges a batch of points (metric, ts, value, tags) into the store.

    Of points of one series and instant, stored or new, the one of the greatest priority stays (A9),
    then that of the later batch, then the greater value. So a batch that is written again changes
    nothing, and a late point finds its place. Only the folders that the batch touches are read and
    written, and each is left with few files. The merged folders are written beside the store first:
    a run that is lost halfway is repeated with the same result.
    """
    spark = points.sparkSession
    if "series_key" not in points.columns:
        points = points.withColumn("series_key", pf.series_key(F.col("metric"), F.col("tags")))
    rank = F.lit(priority) if isinstance(priority, int) else priority
    fresh = stage(points.select(
        pf.series_id(F.col("series_key")).alias("series_id"), "metric", "tags", "series_key", "ts", "value", rank.cast("int").alias("priority"),
        F.lit(batch).cast("bigint").alias("batch"), pf.metric_family(F.col("metric")).alias("metric_family"), F.to_date("ts").alias("date"),
    ).filter(F.col("value").isNotNull() & F.col("ts").isNotNull()), "batch")

    named = series.dictionary(fresh)
    known = read_series(spark, path)
    # Two series under one id are refused; with a million series the chance is one in 40 million.
    clash = named.join(known.select("series_id", F.col("series_key").alias("k")), "series_id", "left").groupBy("series_id").agg(
        F.min(F.least("series_key", F.coalesce("k", "series_key"))).alias("a"), F.max(F.greatest("series_key", F.coalesce("k", "series_key"))).alias("b"))
    if not clash.filter("a <> b").isEmpty():
        raise ValueError("two series have the same id")
    unseen = stage(named.join(known.select("series_id"), "series_id", "left_anti"), "series")
    unseen.write.mode("append").parquet(f"{path}/series")

    columns = ["series_id", "ts", "value", "priority", "batch", *FOLDER]
    stored = _in_folders(read_points(spark, path), fresh.select(*FOLDER).distinct()).select(*columns)
    merged = fresh.select(*columns).unionByName(stored).groupBy(*FOLDER, "series_id", "ts").agg(
        F.max(F.struct("priority", "batch", "value")).alias("best")).select("series_id", "ts", "best.value", "best.priority", "best.batch", *FOLDER)
    _replace(stage(merged, "merged"), path)


def compact(spark: SparkSession, path: str, most_files: int = 8) -> None:
    """Rewrites the folders of more than ``most_files`` files."""
    points = read_points(spark, path)
    files = points.select(*FOLDER, F.col("_metadata.file_path").alias("file")).distinct().groupBy(*FOLDER).agg(F.count("*").alias("n"))
    crowded = stage(files.filter(F.col("n") > most_files).select(*FOLDER), "crowded")
    if not crowded.isEmpty():
        _replace(stage(_in_folders(points, crowded), "compacted"), path)
