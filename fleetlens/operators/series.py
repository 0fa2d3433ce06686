"""Time-series operators over points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions import points as pf

# The time ranges a dashboard offers.
TIME_OPTIONS = ["5m", "15m", "1h", "6h", "12h", "24h", "2d", "7d", "30d"]

def span_seconds(expression: Column) -> Column:
    """Seconds in ``now-5m`` or ``5m`` style texts (s, m, h, d)."""
    amount = F.regexp_extract(expression, r"([0-9]+)([smhd])$", 1).try_cast("bigint")
    unit = F.regexp_extract(expression, r"([0-9]+)([smhd])$", 2)
    return amount * (
        F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    )


def time_range(points: DataFrame, as_of: Column, span: str) -> DataFrame:
    """points after ``as_of - span``. With a literal ``as_of`` this prunes date partitions."""
    amount, unit = int(span[:-1]), {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY"}[span[-1]]
    return points.filter(F.col("ts") > as_of - F.expr(f"INTERVAL '{amount}' {unit}"))


def dictionary(points: DataFrame) -> DataFrame:
    """(series_id, metric, tags, series_key): each series of ``points`` (metric, tags, series_key) once."""
    known = points if "series_id" in points.columns else points.withColumn("series_id", pf.series_id(F.col("series_key")))
    return known.groupBy("series_id", "metric", "tags", "series_key").agg(F.count("*").alias("n")).drop("n")


def match_series(series: DataFrame, targets: DataFrame) -> DataFrame:
    """F4 on a series dictionary: the columns of ``targets`` but its tags, the selector, and the series_id of
    every series whose metric agrees and which has all tags of the target.

    Each ``tag=value`` of a metric stands for the list of series that have it. A target is looked up
    in its shortest list alone, and its other tags are tested on the series found there, so a tag that
    everything has is never spread out. Only series take part, no points.
    """
    wanted = targets.withColumn("selector", pf.series_key(F.col("metric"), F.col("tags")))
    asked = wanted.select("selector", "metric", F.col("tags").alias("asked")).dropDuplicates(["selector"])

    def entries(tags: str) -> Column:
        return F.explode(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"])))

    lists = series.select("series_id", "metric", "tags", entries("tags").alias("entry"))
    sizes = lists.groupBy("metric", "entry").agg(F.count("*").alias("n"))
    shortest = asked.select("selector", "metric", entries("asked").alias("entry")).join(sizes, ["metric", "entry"], "left").groupBy("selector").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "entry"))["entry"].alias("entry"))
    tagged = asked.join(shortest, "selector").join(lists, ["metric", "entry"])
    bare = asked.filter(F.size("asked") == 0).join(series.select("series_id", "metric", "tags"), "metric")
    pairs = tagged.select("selector", "asked", "series_id", "tags").unionByName(bare.select("selector", "asked", "series_id", "tags")).filter(
        F.forall(F.map_entries("asked"), lambda e: F.try_element_at(F.col("tags"), e["key"]).eqNullSafe(e["value"])))
    return pairs.select("selector", "series_id").join(wanted.drop("tags"), "selector")


def tag_filter(points: DataFrame, targets: DataFrame) -> DataFrame:
    """F4 on points without a dictionary: (point, target) pairs whose metric agrees and whose target tags the point all has.

    Each point is projected on the tag names some target of its metric asks for. That gives the same
    selector text the target has, so the match is one equi-join. Points with a dictionary meet their
    targets through ``match_series`` instead.
    """
    wanted = targets.withColumn("selector", pf.series_key(F.col("metric"), F.col("tags")))
    shapes = targets.groupBy("metric").agg(F.collect_set(F.array_sort(F.map_keys("tags"))).alias("shapes"))
    shaped = points.join(shapes, "metric").withColumn("names", F.explode("shapes")).drop("shapes").filter(
        F.forall("names", lambda n: F.map_contains_key(F.col("tags"), n))
    )
    projected = F.transform("names", lambda n: F.concat(n, F.lit("="), F.try_element_at(F.col("tags"), n)))
    keyed = shaped.withColumn(
        "selector", F.concat("metric", F.lit("{"), F.array_join(projected, ","), F.lit("}"))
    ).drop("names")
    return keyed.join(wanted.drop("metric", "tags"), "selector")


def downsample(
    points: DataFrame, interval: str, keys: Sequence[str] = ("series_key",), ts: str = "ts"
) -> DataFrame:
    """A3: mean per series and time bucket; empty buckets stay absent.

    Partial sums are formed before the shuffle, so a series with many points costs one
    row per bucket and map task.
    """
    grouped = points.groupBy(*keys, F.window(ts, interval).alias("w")).agg(F.avg("value").alias("value"))
    return grouped.select(*keys, F.col("w.start").alias("bucket"), "value")


def series_avg(buckets: DataFrame, keys: Sequence[str], bucket: str = "bucket") -> DataFrame:
    """A2: mean over the series of a target at each instant."""
    return buckets.groupBy(*keys, bucket).agg(F.avg("value").alias("value"))


def series_first(points: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """A4: the value of the first series (in series-key order) at each instant."""
    return points.groupBy(*keys, ts).agg(F.min_by("value", "series_key").alias("value"))


def latest_per_second(points: DataFrame, order: str, keys: Sequence[str] = ("series_key",)) -> DataFrame:
    """Whole-second points, the last one by ``order`` for each series and second."""
    second = F.date_trunc("second", F.col("ts"))
    return points.groupBy(*keys, second.alias("ts")).agg(F.max_by("value", order).alias("value"))


def rate(
    points: DataFrame,
    keys: Sequence[str] = ("series_key",),
    counter: bool | Column = False,
    counter_max: float | Column | None = None,
    chunk_seconds: int = 3600,
    ts: str = "ts",
) -> DataFrame:
    """Change per second against the previous point of the series.

    With ``counter`` a falling value is a wrapped counter: ``counter_max`` is added when
    given, otherwise the row is dropped. Both may be columns over ``keys``. Expects one row per series
    and instant.

    A plain lag would sort a whole series in one task. Here a series is cut into time
    chunks, each chunk is its own window partition, and the last point of the previous
    chunk is added to it as a seed row. With whole-second points a chunk holds at most
    ``chunk_seconds`` rows however long the series is.
    """
    keys = list(keys)
    cut = points.select(
        *keys, ts, "value", F.floor(F.unix_seconds(ts) / F.lit(chunk_seconds)).alias("chunk")
    )
    last = cut.groupBy(*keys, "chunk").agg(F.max_by("value", ts).alias("value"), F.max(ts).alias(ts))
    following = F.lead("chunk").over(Window.partitionBy(*keys).orderBy("chunk"))
    seeds = last.withColumn("chunk", following).filter(F.col("chunk").isNotNull())
    rows = cut.withColumn("seed", F.lit(False)).unionByName(seeds.withColumn("seed", F.lit(True)))
    w = Window.partitionBy(*keys, "chunk").orderBy(ts)
    lagged = rows.select(
        *keys, ts, "value", "seed",
        F.lag("value").over(w).alias("prev"), F.lag(ts).over(w).alias("prev_ts"),
    ).filter(~F.col("seed"))
    delta = F.col("value") - F.col("prev")
    if isinstance(counter, Column) or counter:
        top = counter_max if isinstance(counter_max, Column) else F.lit(counter_max).cast("double")
        delta = F.when((delta < 0) & (counter if isinstance(counter, Column) else F.lit(True)), delta + top).otherwise(delta)
    seconds = (F.unix_micros(ts) - F.unix_micros("prev_ts")) / F.lit(1e6)
    return lagged.select(*keys, ts, F.try_divide(delta, seconds).alias("rate")).filter(
        F.col("rate").isNotNull()
    )
