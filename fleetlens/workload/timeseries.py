"""Time-series operators and panels over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import points as pf
from fleetlens import store
from fleetlens.operators import panels as pn, series as sr
from fleetlens.plans import metrics as plans
from fleetlens.session import new_work_dir
from fleetlens.sources import documents as docs
from fleetlens.workload import adapters as ad
from fleetlens.workload.registry import epoch, query, r6, table

KEY = """'events.' || event_type || '{k=' || (props->>'$.k') || ',user=' || user_id || '}'"""
EVENTS = f"e AS (SELECT *, {KEY} AS series_key, props->>'$.k' AS k FROM events)"
HOUR = "CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT)"
DAY = "CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT)"
SECOND = "CAST(floor(epoch(ts)) AS BIGINT)"


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("tag_filter", f"""WITH {EVENTS}
SELECT 'events.click{{user=' || user_id || '}}' AS selector, count(*) AS points, round(sum(value), 6) AS total
FROM e WHERE event_type = 'click' GROUP BY 1
UNION ALL
SELECT 'events.view{{k=' || k || ',user=' || user_id || '}}' AS selector, count(*) AS points, round(sum(value), 6) AS total
FROM e WHERE event_type = 'view' GROUP BY 1""")
def tag_filter(spark, sf):
    points = ad.event_points(spark, sf)
    events = table(spark, sf, "events")
    user, k = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    clicks = events.select(user.alias("user")).distinct().select(
        F.lit("events.click").alias("metric"), F.create_map(F.lit("user"), "user").alias("tags")
    )
    views = events.select(user.alias("user"), k.alias("k")).distinct().select(
        F.lit("events.view").alias("metric"), F.create_map(F.lit("user"), "user", F.lit("k"), "k").alias("tags")
    )
    targets = clicks.unionByName(views)
    matched = sr.tag_filter(points, targets)
    return matched.groupBy("selector").agg(F.count("*").alias("points"), r6(F.sum("value")).alias("total"))


@query("time_range", "SELECT event_id, value FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def time_range(spark, sf):
    events = table(spark, sf, "events")
    as_of = events.agg(F.max("ts")).scalar()
    return sr.time_range(events, as_of, "7d").select("event_id", "value")


@query("downsample", f"""SELECT 'user' || user_id AS series_key, {HOUR} AS bucket_s, round(avg(value), 6) AS value
FROM events GROUP BY 1, 2""")
def downsample(spark, sf):
    buckets = sr.downsample(ad.user_points(spark, sf), "1 hour")
    return buckets.select("series_key", epoch("bucket").alias("bucket_s"), r6("value").alias("value"))


@query("series_avg", f"""WITH {EVENTS}, b AS (SELECT series_key, event_type, {DAY} AS bucket_s, avg(value) AS v FROM e GROUP BY 1, 2, 3)
SELECT 'events.' || event_type AS metric, bucket_s, round(avg(v), 6) AS value FROM b GROUP BY 1, 2""")
def series_avg(spark, sf):
    buckets = sr.downsample(ad.event_points(spark, sf), "1 day", ["metric", "series_key"])
    return sr.series_avg(buckets, ["metric"]).select("metric", epoch("bucket").alias("bucket_s"), r6("value").alias("value"))


@query("series_first", f"""WITH {EVENTS}, b AS (SELECT series_key, event_type, {HOUR} AS ts_s, avg(value) AS v FROM e GROUP BY 1, 2, 3)
SELECT 'events.' || event_type AS metric, ts_s, round(arg_min(v, series_key), 6) AS value FROM b GROUP BY 1, 2""")
def series_first(spark, sf):
    buckets = sr.downsample(ad.event_points(spark, sf), "1 hour", ["metric", "series_key"])
    firsts = sr.series_first(buckets, ["metric"], "bucket")
    return firsts.select("metric", epoch("bucket").alias("ts_s"), r6("value").alias("value"))


_LAGGED = """s AS (SELECT 'user' || user_id AS series_key, date_trunc('second', ts) AS ts, arg_max(value, event_id) AS value
FROM events GROUP BY 1, 2), d AS (SELECT series_key, CAST(epoch(ts) AS BIGINT) AS ts_s,
value - lag(value) OVER w AS delta, epoch(ts) - epoch(lag(ts) OVER w) AS dt FROM s
WINDOW w AS (PARTITION BY series_key ORDER BY ts))"""


@query("series_rate", f"WITH {_LAGGED} SELECT series_key, ts_s, round(delta / dt, 6) + 0.0 AS rate FROM d WHERE dt > 0")
def series_rate(spark, sf):
    points = sr.latest_per_second(ad.user_points(spark, sf), "seq")
    return sr.rate(points).select("series_key", epoch("ts").alias("ts_s"), r6("rate").alias("rate"))


@query("counter_rate", f"""WITH {_LAGGED}
SELECT 'wrap' AS mode, series_key, ts_s, round(CASE WHEN delta < 0 THEN delta + 1000 ELSE delta END / dt, 6) + 0.0 AS rate FROM d WHERE dt > 0
UNION ALL SELECT 'drop' AS mode, series_key, ts_s, round(delta / dt, 6) + 0.0 AS rate FROM d WHERE dt > 0 AND delta >= 0""")
def counter_rate(spark, sf):
    points = sr.latest_per_second(ad.user_points(spark, sf), "seq")
    modes = {
        "wrap": sr.rate(points, counter=True, counter_max=1000.0),
        "drop": sr.rate(points, counter=True),
    }
    parts = [
        df.select(F.lit(m).alias("mode"), "series_key", epoch("ts").alias("ts_s"), r6("rate").alias("rate"))
        for m, df in modes.items()
    ]
    return parts[0].unionByName(parts[1])


# -- panels ---------------------------------------------------------------------------

DISKS, INTERFACES = ["/dev/so", "/dev/sf"], ["ethA", "ethN", "ethR"]


def _values(panels, first_only):
    rows = []
    for p in panels:
        for i, t in enumerate(p.targets[:1] if first_only else p.targets):
            rows.append(
                f"('{p.title}', {i}, '{t.metric}', '{t.aggregator}', {str(t.rate).lower()}, "
                f"{str(t.counter).lower()}, {str(t.raw).lower()})"
            )
    return "(VALUES " + ", ".join(rows) + ") AS p(title, target_pos, metric, aggregator, rate, counter, raw)"


def _supplier_host(key: str = "s_suppkey", nation: str = "s_nationkey"):
    return _text("node", F.col(key), ".dc", F.col(nation), ".example")


def _device_values(names):
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") AS dv(device)"


_HOSTS = """h AS (SELECT 'node' || s_suppkey || '.dc' || s_nationkey || '.example' AS host, n_name AS cluster
FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT 'host-' || replace(host, '.', '-') AS uid, host FROM h UNION ALL SELECT 'nodes-' || cluster AS uid, host FROM h)"""
_ROLES = {
    "AUTOMOBILE": ("hbase", "regionserver"), "BUILDING": ("hdfs", "namenode"),
    "FURNITURE": ("hdfs", "datanode"), "HOUSEHOLD": ("zookeeper", "zkServer"), "MACHINERY": ("hbase", "master"),
}
_ROLE_SQL = "(VALUES " + ", ".join(f"('{s}', '{p}', '{j}')" for s, (p, j) in _ROLES.items()) + ") AS r(seg, project, rjob)"
SERVICE_TEMPLATES = {
    "hdfs": [
        pn.Panel("hdfs.namenode.fs.BlocksTotal", [pn.Target("hdfs.namenode.fs.BlocksTotal")]),
        pn.Panel("hdfs.datanode.activity.BytesRead", [pn.Target("hdfs.datanode.activity.BytesRead", rate=True)]),
        pn.Panel("hdfs.jvm.ThreadCount", [pn.Target("hdfs.jvm.ThreadCount")]),
    ],
    "zookeeper": [pn.Panel("zookeeper.zkServer.zk_size", [pn.Target("zookeeper.zkServer.zk_size")])],
    "hbase": [pn.Panel("hbase.regionserver.regionCount", [pn.Target("hbase.regionserver.regionCount")])],
}
_COLS = "title, CAST(target_pos AS BIGINT) AS target_pos, metric, aggregator, rate, counter, raw"
_PLAIN = "title NOT LIKE 'sys.disk.%' AND title NOT LIKE 'sys.net.%'"
_HP, _GP = _values(pn.HOST_PANELS, True), _values(pn.GC_PANELS, False)
_HDFS = SERVICE_TEMPLATES["hdfs"]


def _service(project, job, shift, panels):
    return (
        f"SELECT 'cluster-{project}-' || cluster AS uid, {_COLS}, metric || '{{cluster=' || cluster || "
        f"',hostAndPort=host' || c_custkey || '-' || (c_custkey + {10000 + shift}) || ',job={job}}}' AS selector "
        f"FROM t JOIN {_ROLE_SQL} ON c_mktsegment = seg, {_values(panels, True)} WHERE rjob = '{job}'"
    )


@query("panel_fanout", f"""WITH {_HOSTS}, t AS (SELECT c_custkey, c_mktsegment, n_name AS cluster FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT uid, {_COLS}, metric || '{{host=' || host || '}}' AS selector FROM u, {_HP} WHERE {_PLAIN}
UNION ALL SELECT uid, {_COLS}, metric || '{{disk=' || device || ',host=' || host || '}}' AS selector
FROM u, {_HP}, {_device_values(DISKS)} WHERE title LIKE 'sys.disk.%'
UNION ALL SELECT uid, {_COLS}, metric || '{{host=' || host || ',if=' || device || '}}' AS selector
FROM u, {_HP}, {_device_values(INTERFACES)} WHERE title LIKE 'sys.net.%'
UNION ALL SELECT 'jvm-' || cluster || '-' || c_mktsegment || '-' || c_custkey AS uid, {_COLS},
metric || '{{cluster=' || cluster || ',job=' || c_mktsegment || ',task=' || c_custkey || '}}' AS selector FROM t, {_GP}
UNION ALL SELECT uid, {_COLS}, selector FROM (SELECT DISTINCT 'cluster-hdfs-' || cluster AS uid, cluster,
'hdfs.namenode.fs.BlocksTotal{{cluster=' || cluster || ',job=namenode}}' AS selector
FROM t JOIN {_ROLE_SQL} ON c_mktsegment = seg WHERE project = 'hdfs'), {_values(_HDFS[:1], True)}
UNION ALL {_service('hdfs', 'datanode', 1, _HDFS[1:2])}
UNION ALL {_service('zookeeper', 'zkServer', 0, SERVICE_TEMPLATES['zookeeper'])}
UNION ALL {_service('hbase', 'regionserver', 1, SERVICE_TEMPLATES['hbase'])}""")
def panel_fanout(spark, sf):
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    hosts = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        _supplier_host().alias("host"), F.col("n_name").alias("cluster")
    )
    boards = hosts.select(pn.host_dashboard_uid(F.col("host")).alias("uid"), "host").unionByName(
        hosts.select("cluster", "host").distinct().select(_text("nodes-", F.col("cluster")).alias("uid"), "host")
    )
    tasks = ad.declared_tasks(spark, sf)
    seg = F.col("job")
    project, job = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (p, j) in _ROLES.items():
        project, job = F.when(seg == name, p).otherwise(project), F.when(seg == name, j).otherwise(job)
    services = tasks.select(project.alias("project"), "cluster", job.alias("job"), "host", "base_port")
    targets = (
        pn.host_targets(boards, DISKS, INTERFACES)
        .unionByName(pn.gc_targets(tasks))
        .unionByName(pn.cluster_targets(services, SERVICE_TEMPLATES))
    )
    return targets.select(
        "uid", "title", F.col("target_pos").cast("bigint").alias("target_pos"), "metric", "aggregator",
        "rate", "counter", "raw", pf.series_key(F.col("metric"), F.col("tags")).alias("selector"),
    )


def _dashboards(spark, sf):
    """One dashboard document per supplier host."""
    host = _supplier_host()
    panels = F.array(*[
        F.struct(
            F.lit(p.title).alias("title"), F.lit("graph").alias("type"),
            F.array(*[
                F.struct(
                    F.lit("A").alias("refId"), F.lit(t.metric).alias("metric"), F.lit(t.aggregator).alias("aggregator"),
                    F.lit("avg").alias("downsampleAggregator"), F.lit("none").alias("downsampleFillPolicy"),
                    F.lit(t.raw).alias("disableDownsampling"), F.lit(t.rate).alias("shouldComputeRate"),
                    F.create_map(F.lit("host"), host).alias("tags"),
                )
                for t in p.targets
            ]).alias("targets"),
        )
        for p in pn.HOST_PANELS
    ])
    board = F.struct(
        pn.host_dashboard_uid(host).alias("uid"), host.alias("title"), panels.alias("panels"),
        F.struct(F.lit(pn.HOST_RANGE).alias("from"), F.lit("now").alias("to")).alias("time"),
    )
    return table(spark, sf, "supplier").select(F.to_json(board).alias("value"))


@query("panel_spec_scan", f"""WITH {_HOSTS} SELECT 'host-' || replace(host, '.', '-') AS uid, 'now-5m' AS time_from, title, metric, aggregator,
raw AS disable_downsampling, rate AS compute_rate, 'host=' || host AS tags FROM h, {_HP}""")
def panel_spec_scan(spark, sf):
    rows = docs.panel_rows(_dashboards(spark, sf))
    return rows.select(
        "uid", "time_from", "title", "metric", "aggregator",
        F.col("disableDownsampling").alias("disable_downsampling"), F.col("shouldComputeRate").alias("compute_rate"),
        F.regexp_replace(pf.series_key(F.lit(""), F.col("tags")), r"^\{|\}$", "").alias("tags"),
    )


@query("panel_eval", f"""WITH {EVENTS},
b AS (SELECT series_key, event_type, user_id, date_trunc('hour', ts) AS ts, avg(value) AS v FROM e
  WHERE event_type IN ('click', 'view') AND epoch(ts) > (SELECT floor(epoch(max(ts))) FROM events) - 864000 - 3600 GROUP BY 1, 2, 3, 4),
c AS (SELECT event_type, user_id, ts, avg(v) AS v FROM b WHERE epoch(ts) > (SELECT floor(epoch(max(ts))) FROM events) - 864000 GROUP BY 1, 2, 3),
d AS (SELECT user_id, ts, v - lag(v) OVER w AS delta, epoch(ts) - epoch(lag(ts) OVER w) AS dt FROM c WHERE event_type = 'view'
  WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT 'user-' || user_id AS uid, 'clicks' AS title, epoch_us(ts) AS ts_us, round(v, 6) AS value FROM c WHERE event_type = 'click'
UNION ALL SELECT 'user-' || user_id AS uid, 'views' AS title, epoch_us(ts) AS ts_us, round(delta / dt, 6) + 0.0 AS value FROM d WHERE dt > 0
UNION ALL SELECT 'user-' || user_id AS uid, 'errors' AS title, epoch_us(ts) AS ts_us, round(arg_min(value, series_key), 6) AS value
FROM e WHERE event_type = 'error' AND floor(epoch(ts)) > (SELECT floor(epoch(max(ts))) FROM events) - 864000 GROUP BY 1, 2, 3""")
def panel_eval(spark, sf):
    events = table(spark, sf, "events")
    users = events.select("user_id").distinct()
    specs = [("clicks", "events.click", "avg", False, False), ("views", "events.view", "avg", True, False),
             ("errors", "events.error", "first", False, True)]
    panels = F.array(*[
        F.struct(F.lit(t).alias("title"), F.lit(m).alias("metric"), F.lit(a).alias("aggregator"),
                 F.lit(r).alias("rate"), F.lit(w).alias("raw"))
        for t, m, a, r, w in specs
    ])
    targets = users.select("user_id", F.explode(panels).alias("p")).select(
        _text("user-", F.col("user_id")).alias("uid"), "p.*", F.lit(0).alias("target_pos"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"),
        F.lit("now-10d").alias("time_from"),
    )
    as_of = events.agg(F.max("ts")).scalar()
    values = plans.evaluate_panels(ad.event_points(spark, sf).drop("seq"), targets, as_of)
    return values.select("uid", "title", F.unix_micros("ts").alias("ts_us"), r6("value").alias("value"))


# -- stored points --------------------------------------------------------------------

def _stored(spark, sf):
    """Events in two batches: a part of the first has wrong values, which the late second one corrects
    with a higher priority. The first is then written again."""
    points, path = ad.event_points(spark, sf), new_work_dir(spark, "store")
    late = (F.col("seq") % 10 == 3) | (F.col("seq") % 7 == 0)
    first = points.filter(F.col("seq") % 10 != 3).withColumn("value", F.when(F.col("seq") % 7 == 0, F.col("value") + 1000).otherwise(F.col("value")))
    store.append_points(first, path, batch=1)
    store.append_points(points.filter(late), path, batch=2, priority=1)
    store.append_points(first, path, batch=1)
    return store.read_points(spark, path), store.read_series(spark, path)


_KEPT = f"""{EVENTS}, s AS (SELECT series_key, event_type, user_id, ts, max(late) AS late, arg_max(value, late * 1e9 + value) AS value
FROM (SELECT *, CAST(event_id % 10 = 3 OR event_id % 7 = 0 AS INTEGER) AS late FROM e) GROUP BY 1, 2, 3, 4)"""


@query("point_store", f"""WITH {_KEPT} SELECT series_key, split_part(series_key, '{{', 1) AS metric_family, epoch_us(ts) AS ts_us, late AS priority,
round(value, 6) AS value FROM s""")
def point_store(spark, sf):
    points, series = _stored(spark, sf)
    return points.join(series, "series_id").select(
        "series_key", "metric_family", F.unix_micros("ts").alias("ts_us"), "priority", r6("value").alias("value"))


def _user_dashboards(spark, sf):
    """A dashboard document per user: an average by the default interval, a counter's rate in steps of six
    hours, single values, and daily sums."""
    user = F.col("user_id").cast("string")

    def panel(title, metric, aggregator, **fields):
        target = {"metric": F.lit(metric), "aggregator": F.lit(aggregator), "tags": F.create_map(F.lit("user"), user), **fields}
        return _text('{"title":"', title, '","targets":[', F.to_json(F.struct(*[v.alias(k) for k, v in target.items()])), "]}")

    yes = F.lit(True)
    panels = [
        panel("clicks", "events.click", "avg"),
        panel("views", "events.view", "avg", shouldComputeRate=yes, isCounter=yes, counterMax=F.lit("1000"), downsampleInterval=F.lit("6h")),
        panel("errors", "events.error", "first", disableDownsampling=yes, downsampleInterval=F.lit("1s")),
        panel("buys", "events.purchase", "sum", isCounter=F.lit(False), counterMax=F.lit(""), downsampleInterval=F.lit("1d")),
    ]
    document = _text('{"uid":"user-', user, '","time":{"from":"now-10d","to":"now"},"panels":[', F.concat_ws(",", *panels), "]}")
    return table(spark, sf, "events").select("user_id").distinct().select(document.alias("value"))


def _bucket(hours: int) -> str:
    return f"CAST(floor(epoch(ts) / {hours * 3600}) AS BIGINT) * {hours * 3600}"


@query("dashboard_values", f"""WITH {_KEPT}, now AS (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) - 864000 AS oldest FROM events),
b AS (SELECT event_type, user_id, series_key, CASE event_type WHEN 'click' THEN {_bucket(1)} WHEN 'view' THEN {_bucket(6)}
ELSE {_bucket(24)} END AS at_s, avg(value) AS v FROM s WHERE event_type IN ('click', 'view', 'purchase') AND floor(epoch(ts)) > (SELECT oldest FROM now) GROUP BY 1, 2, 3, 4),
c AS (SELECT event_type, user_id, at_s, CASE WHEN event_type = 'purchase' THEN sum(v) ELSE avg(v) END AS v FROM b
WHERE at_s > (SELECT oldest FROM now) GROUP BY 1, 2, 3),
d AS (SELECT user_id, at_s, v - lag(v) OVER w AS delta, at_s - lag(at_s) OVER w AS dt FROM c WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY at_s))
SELECT 'user-' || user_id AS uid, 'clicks' AS title, at_s * 1000000 AS ts_us, round(v, 6) AS value FROM c WHERE event_type = 'click'
UNION ALL SELECT 'user-' || user_id, 'buys', at_s * 1000000, round(v, 6) FROM c WHERE event_type = 'purchase'
UNION ALL SELECT 'user-' || user_id, 'views', at_s * 1000000, round(CASE WHEN delta < 0 THEN delta + 1000 ELSE delta END / dt, 6) + 0.0 FROM d WHERE dt > 0
UNION ALL SELECT 'user-' || user_id, 'errors', epoch_us(ts), round(arg_min(value, series_key), 6) FROM s
WHERE event_type = 'error' AND floor(epoch(ts)) > (SELECT oldest FROM now) GROUP BY 1, 2, 3""")
def dashboard_values(spark, sf):
    points, series = _stored(spark, sf)
    targets = plans.dashboard_targets(docs.panel_rows(_user_dashboards(spark, sf)))
    as_of = table(spark, sf, "events").agg(F.max("ts")).scalar()
    values = plans.evaluate_panels(points, targets, as_of, dictionary=series)
    return values.select("uid", "title", F.unix_micros("ts").alias("ts_us"), r6("value").alias("value"))
