"""Streaming jobs over the given tables, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import points as op
from fleetlens.session import new_work_dir
from fleetlens.sources import payloads as src
from fleetlens.streaming import jobs as sj, keyed
from fleetlens.workload import adapters as ad, metrics as mq, timeseries as tq
from fleetlens.workload.registry import epoch, point_report, query, r6


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _table_stream(spark, sf, name):
    """A given table as a file stream; the pattern fits a single file and a folder of files."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _landed_stream(spark, payloads, label):
    """Derived payloads, landed as files first and then read as a stream."""
    path = new_work_dir(spark, label)
    payloads.write.parquet(path)
    return sj.read_landing(spark, path, payloads.schema)


def _user_stream(spark, sf):
    return _table_stream(spark, sf, "events").select(
        _text("user", F.col("user_id")).alias("series_key"), F.col("ts").cast("timestamp").alias("ts"),
        "value", F.col("event_id").alias("seq"),
    )


@query("stream_points", mq._with(mq.SCRAPES) + mq._union([*mq._SYSTEM, *mq._NETWORK, *mq._DISK, *mq._GC]))
def stream_points(spark, sf):
    landing = _landed_stream(spark, ad.node_payloads(spark, sf), "node-landing")
    return point_report(sj.run_available(sj.collect_points(landing, "node"), "stream-points"))


@query("stream_dedupe", """SELECT 'user' || user_id AS series_key, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS ts_s,
round(arg_max(value, event_id), 6) AS value FROM events GROUP BY ALL
HAVING max(date_trunc('hour', ts)) < (SELECT max(date_trunc('hour', ts)) FROM events) - INTERVAL 10 MINUTE""")
def stream_dedupe(spark, sf):
    points = _user_stream(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    deduped = sj.run_available(sj.dedupe(points), "stream-dedupe")
    return deduped.select("series_key", epoch("ts").alias("ts_s"), r6("value").alias("value"))


@query("stream_downsample", f"""SELECT 'user' || user_id AS series_key, {tq.HOUR} AS bucket_s, round(avg(value), 6) AS value
FROM events GROUP BY 1, 2 HAVING max(date_trunc('hour', ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_downsample(spark, sf):
    closed = sj.run_available(sj.downsample(_user_stream(spark, sf), "1 hour"), "stream-downsample")
    return closed.select("series_key", epoch("bucket").alias("bucket_s"), r6("value").alias("value"))


@query("stream_rollup", mq._with(mq.SCRAPES, mq.REGIONS) + mq._union([
    f"""SELECT cluster, 'rs' || sk AS host, {mq.TS.replace('ts_s', 'bucket_s')}, '{level}' AS level, ns AS namespace, tbl AS "table",
m AS region_metric, sum(v) AS value, count(*) AS regions
FROM (SELECT cluster, sk, q, {cols}, m, v FROM regions WHERE q < (SELECT max(q) FROM regions)) GROUP BY ALL"""
    for level, cols in mq._LEVELS.items()
]))
def stream_rollup(spark, sf):
    landing = _landed_stream(spark, ad.jmx_hbase(spark, sf), "jmx-landing")
    regions = op.region_values(src.explode_beans(src.parse_jmx(landing)))
    rolled = sj.run_available(sj.region_rollup(regions, "1 hour"), "stream-rollup")
    return rolled.select(
        "cluster", "host", epoch("bucket").alias("bucket_s"), "level", "namespace", "table", "region_metric",
        "value", "regions",
    )


@query("stream_rate", f"WITH {tq._LAGGED} SELECT series_key, ts_s, round(delta / dt, 6) + 0.0 AS rate FROM d WHERE dt > 0 "
       "AND ts_s - ts_s % 3600 + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events)")
def stream_rate(spark, sf):
    # Rates of closed hours; the hours within the watermark are still open when the input ends.
    rates = keyed.stream_rate(_user_stream(spark, sf), "seq")
    return rates.select("series_key", epoch("ts").alias("ts_s"), r6("rate").alias("rate"))


def _order_reports(spark, sf):
    """Orders as status reports of their customers, in the order of date and then order key."""
    ts = F.col("o_orderdate").cast("timestamp")
    return _table_stream(spark, sf, "orders").select(
        _text("c", F.col("o_custkey")).alias("key"),
        (F.datediff(ts, F.lit("1990-01-01").cast("timestamp")).cast("bigint") * F.lit(10**12) + F.col("o_orderkey")).alias("seq"),
        ts.alias("ts"), F.when(F.col("o_orderstatus") == "O", "Running").otherwise("Stopped").alias("status"),
    )


@query("stream_timeline", """WITH s AS (SELECT 'c' || o_custkey AS key, o_orderdate AS d, o_orderstatus AS st,
lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM orders)
SELECT key, epoch_us(d) AS ts_us, CASE WHEN st = 'O' THEN 'Running' ELSE 'Stopped' END AS status FROM s
UNION ALL SELECT key, epoch_us(d + INTERVAL 90 DAY) AS ts_us, 'Unknown' AS status FROM s
WHERE d + INTERVAL 90 DAY < coalesce(later, (SELECT max(o_orderdate) FROM orders) - INTERVAL 10 MINUTE)""")
def stream_timeline(spark, sf):
    found = keyed.stream_timeline(_order_reports(spark, sf), 90 * 86400)
    return found.select("key", F.unix_micros("ts").alias("ts_us"), "status")


@query("stream_status", """WITH s AS (SELECT 'c' || o_custkey AS key, max(o_orderdate) AS d,
arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY 1)
SELECT key, CASE WHEN d < TIMESTAMP '2001-01-01' THEN 'Unknown' WHEN st = 'O' THEN 'Running' ELSE 'Stopped' END AS status FROM s""")
def stream_status(spark, sf):
    as_of = F.lit("2001-01-31").cast("timestamp")
    return keyed.stream_status(_order_reports(spark, sf), 30 * 86400, as_of).select("key", "status")
