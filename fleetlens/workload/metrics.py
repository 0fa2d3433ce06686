"""Scans, normalisers, roll-up and point operators over derived payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import sinks
from fleetlens.functions import points as pf, text as tf
from fleetlens.operators import points as op, rollup, rules as rl
from fleetlens.plans import metrics as plans
from fleetlens.sources import payloads as src
from fleetlens.workload import adapters as ad
from fleetlens.workload.registry import epoch, point_report, query, r6, table

# -- SQL pieces -----------------------------------------------------------------------

_MEASURES = ",\n".join(
    f"""count(*) FILTER (WHERE l_returnflag = '{f}') AS n_{f.lower()},
CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = '{f}'), 0) AS BIGINT) AS q_{f.lower()},
CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_returnflag = '{f}'), 0) AS BIGINT) AS p_{f.lower()}"""
    for f in ad.FLAGS
)
_STATUS = ",\n".join(
    f"""count(*) FILTER (WHERE l_linestatus = '{s}') AS n_s{s.lower()},
CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_linestatus = '{s}'), 0) AS BIGINT) AS q_s{s.lower()}"""
    for s in ("O", "F")
)
SCRAPES = f"""scrapes AS (
SELECT l_suppkey AS sk, date_trunc('quarter', l_shipdate) AS q, replace(r_name, ' ', '_') AS cluster,
n_name AS nation, count(*) AS n, max(CAST(l_quantity AS BIGINT)) AS max_q, {_MEASURES}, {_STATUS}
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4)"""
TS = "CAST(epoch(q) AS BIGINT) AS ts_s"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _hbase(metric: str, value: str, extra: str = "''", where: str = "true", source: str = "scrapes") -> str:
    return (
        f"SELECT {metric} || '{{cluster=' || cluster || ',hostAndPort=rs' || sk || '-16031,job=regionserver' "
        f"|| {extra} || '}}' AS series_key, {TS}, round(CAST({value} AS DOUBLE), 6) AS value "
        f"FROM {source} WHERE {where}"
    )


_REGIONS = _union([
    f"""SELECT sk, q, cluster, nation, cluster AS ns, nation || '.{f}' AS tbl,
lower(to_hex(sk)) || '{f.lower()}' AS region, '{metric}' AS m, CAST({col}_{f.lower()} AS DOUBLE) AS v
FROM scrapes WHERE n_{f.lower()} > 0"""
    for f in ad.FLAGS
    for metric, col in {"storeCount": "n", "readRequestCount": "q", "memStoreSize": "p"}.items()
])
REGIONS = f"regions AS ({_REGIONS})"
_LEVELS = {
    "table": "ns, tbl", "namespace": "ns, NULL AS tbl", "server": "NULL AS ns, NULL AS tbl",
}

_WAL = [
    _hbase("'hbase.regionserver.wal.SyncTime_num_ops'", "n"),
    _hbase("'hbase.regionserver.wal.SyncTime_99th_percentile'", "max_q"),
    _hbase("'hbase.regionserver.wal.AppendTime_75th_percentile'", "n_a / 4.0"),
]
_SERVER = [
    _hbase("'hbase.regionserver.regionCount'", "3"),
    _hbase("'hbase.regionserver.storeCount'", "n"),
    _hbase("'hbase.regionserver.hlogFileCount'", "n_so"),
    _hbase("'hbase.regionserver.hlogFileSize'", "q_sf", where="n_sf > 0"),
    _hbase("'hbase.regionserver.storeFileCount'", "n_sf"),
    _hbase("'hbase.regionserver.memStoreSize'", "p_a + p_n + p_r"),
    _hbase("'hbase.regionserver.Mutate_75th_percentile'", "q_a / 4.0"),
    _hbase("'hbase.regionserver.Get_99th_percentile'", "max_q"),
]
_THREADS = _hbase("'hbase.jvm.ThreadCount'", "n", where="n_r > 0")

ORDERS = """o AS (SELECT 'hdfs-' || substr(o_orderpriority, 1, 1) AS cluster, o_custkey AS ck, o_orderkey AS ok,
o_orderstatus AS st, o_orderpriority AS pr, CAST(epoch(o_orderdate) AS BIGINT) AS ts_s,
CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""
_ACTIVE = "NOT (st = 'F' OR (st = 'P' AND pr < '3'))"


def _hdfs(metric: str, value: str, job: str) -> str:
    host, port, where = ("nn", 50070, _ACTIVE) if job == "namenode" else ("dn", 50075, "true")
    return (
        f"SELECT '{metric}{{cluster=' || cluster || ',hostAndPort={host}' || ck || '-{port},job={job}}}' AS series_key, "
        f"ts_s, round(CAST({value} AS DOUBLE), 6) AS value FROM o WHERE {where}"
    )


_NAMENODE = [
    _hdfs("hdfs.namenode.fs.MissingBlocks", "0", "namenode"),
    _hdfs("hdfs.namenode.fs.CapacityTotal", "cents", "namenode"),
    _hdfs("hdfs.namenode.fs.CapacityUsed", "cents / 4.0", "namenode"),
    _hdfs("hdfs.namenode.fs.BlocksTotal", "ok", "namenode"),
    _hdfs("hdfs.namenode.activity.SyncsAvgTime", "ck / 4.0", "namenode"),
    _hdfs("hdfs.namenode.activity.SyncsNumOps", "ok", "namenode"),
    _hdfs("hdfs.namenode.fs.state.NumLiveDataNodes", "ck", "namenode"),
    _hdfs("hdfs.namenode.fs.state.NumDeadDataNodes", "0", "namenode"),
]
_CONVERTED = [
    _hdfs("hdfs.datanode.activity.FsyncAvgTime", "cents / 1e6", "datanode"),
    _hdfs("hdfs.datanode.activity.FlushAvgTime", "ok / 1e6", "datanode"),
]
_DATANODE = [
    _hdfs("hdfs.datanode.fs.state.Capacity", "cents", "datanode"),
    _hdfs("hdfs.datanode.fs.state.DfsUsed", "cents / 4.0", "datanode"),
    _hdfs("hdfs.datanode.fs.state.Remaining", "cents - 1", "datanode"),
    _hdfs("hdfs.datanode.activity.BytesWritten", "cents", "datanode"),
    _hdfs("hdfs.datanode.activity.BlocksRead", "ok", "datanode"),
    _hdfs("hdfs.datanode.activity.FlushNanosNumOps", "ck", "datanode"),
    *_CONVERTED,
]


def _node(metric: str, value: str, extra: str = "", where: str = "true") -> str:
    """Tags of a host snapshot in key order; ``disk`` sorts before ``host``, ``if`` after."""
    tags = f"{extra},host=" if extra.startswith("disk") else "host="
    after = f" || ',{extra}'" if extra.startswith("if") else ""
    return (
        f"SELECT '{metric}{{{tags}node' || sk{after} || '}}' AS series_key, {TS}, "
        f"round(CAST({value} AS DOUBLE), 6) AS value FROM scrapes WHERE {where}"
    )


_SYSTEM = [
    _node("sys.cpu.percent", "n"), _node("sys.cpu.load1", "n_a / 4.0"), _node("sys.cpu.load5", "n_n / 4.0"),
    _node("sys.cpu.load15", "n_r / 4.0"), _node("sys.mem.free", "q_a"), _node("sys.mem.available", "q_n"),
    _node("sys.mem.total", "q_a + q_n + q_r"), _node("sys.mem.used", "q_r"), _node("sys.mem.usedPercent", "max_q"),
]
_NETWORK = [
    _node(f"sys.net.{key}", value.format(f=f.lower()), f"if=eth{f}")
    for f in ad.FLAGS
    for key, value in {
        "bytesRecv": "p_{f}", "bytesSent": "q_{f}", "packetsRecv": "n_{f}", "packetsSent": "n_{f} * 2",
        "dropin": "0", "dropout": "1", "errin": "2", "errout": "3",
    }.items()
]
_DISK = [
    _node(f"sys.disk.{key}", value.format(s=s), f"disk=/dev/{s}")
    for s in ("so", "sf")
    for key, value in {
        "free": "n", "total": "q_{s} + n", "used": "q_{s}", "usedPercent": "n_{s} / 4.0",
    }.items()
]
_GC = [
    f"SELECT 'node.jvm.gc.{key}{{cluster=' || cluster || ',host=node' || sk || ',job=' || nation || ',task=' || sk || '}}' "
    f"AS series_key, {TS}, round(CAST({value} AS DOUBLE), 6) AS value FROM scrapes WHERE n_r > 0"
    for key, value in {"young.gc.count": "n_so", "young.gc.time": "n_sf / 4.0"}.items()
]


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# -- scans ----------------------------------------------------------------------------

_KEY_COUNTS = [
    (0, f"'{rl.THREADING}'", "2"),
    (1, f"'{rl.REGIONS}'", "2 + 4 * (CAST(n_a > 0 AS INT) + CAST(n_n > 0 AS INT) + CAST(n_r > 0 AS INT))"),
    (2, f"'{rl.WAL}'", "5"), (3, f"'{rl.SERVER}'", "11"), (4, f"'{rl.IPC}'", "2"), (5, "NULL", "2"),
]


@query("jmx_bean_scan", _with(SCRAPES) + _union([
    f"SELECT 'rs' || sk AS host, {TS}, CAST({pos} AS BIGINT) AS bean_pos, {name} AS bean_name, "
    f"CAST({keys} AS BIGINT) AS n_keys FROM scrapes" for pos, name, keys in _KEY_COUNTS
]))
def jmx_bean_scan(spark, sf):
    beans = src.explode_beans(src.parse_jmx(ad.jmx_hbase(spark, sf)))
    return beans.select(
        "host", epoch("ts").alias("ts_s"), F.col("bean_pos").cast("bigint").alias("bean_pos"), "bean_name",
        F.size("props").cast("bigint").alias("n_keys"),
    )


@query("node_payload_scan", _with(SCRAPES) + f"""SELECT 'node' || sk AS host, {TS}, CAST(n AS DOUBLE) AS cpu,
n_n / 4.0 AS load5, CAST(q_a + q_n + q_r AS DOUBLE) AS mem_total, CAST(3 AS BIGINT) AS interfaces,
CAST(4 AS BIGINT) AS disk_keys, CAST(CASE WHEN n_r > 0 THEN 2 ELSE 0 END AS BIGINT) AS jvm_labels FROM scrapes""".replace(
    "n_n / 4.0", "CAST(n_n / 4.0 AS DOUBLE)"))
def node_payload_scan(spark, sf):
    nodes = src.parse_node(ad.node_payloads(spark, sf))
    return nodes.select(
        "host", epoch("ts").alias("ts_s"), F.col("node.CpuPercents").alias("cpu"),
        F.col("node.Load.load5").alias("load5"), F.col("node.memory.total").alias("mem_total"),
        F.size("node.Network").cast("bigint").alias("interfaces"),
        F.size("node.DiskUsage").cast("bigint").alias("disk_keys"),
        F.coalesce(F.size("node.JavaMetrics"), F.lit(0)).cast("bigint").alias("jvm_labels"),
    ).withColumn("jvm_labels", F.greatest("jvm_labels", F.lit(0)))


_KV_LINES = {
    "zk_size": "CAST(p_size AS VARCHAR)", "zk_brand": "p_brand", "zk_price": "CAST(p_retailprice AS VARCHAR)",
    "zk_lead": "' ' || p_size", "zk_plus": "'+' || p_partkey", "zk_neg": "'-' || p_size",
    "zk_big": "'99999999999999' || lpad(CAST(p_partkey AS VARCHAR), 10, '0')",
}


@query("kv_text_scan", _union([
    f"SELECT 'zk' || p_partkey AS host, '{key}' AS key, {value} AS raw FROM part" for key, value in _KV_LINES.items()
]))
def kv_text_scan(spark, sf):
    return src.kv_lines(ad.kv_payloads(spark, sf)).select("host", "key", "raw")


_KV = [
    f"SELECT 'zookeeper.zkServer.{key}{{cluster=' || p_type || ',hostAndPort=zk' || p_partkey || '-2181,job=zkServer}}' AS series_key, "
    f"CAST(1704067200 AS BIGINT) AS ts_s, CAST({value} AS DOUBLE) AS value FROM part"
    for key, value in {"zk_size": "p_size", "zk_plus": "p_partkey", "zk_neg": "-p_size"}.items()
]


@query("kv_points", _union(_KV))
def kv_points(spark, sf):
    return point_report(plans.kv_points(ad.kv_payloads(spark, sf)))


_JSTAT_OK = "o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND o_totalprice >= 2000"


def _gc_value(i: int) -> str:
    return f"round(CAST(CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * {i} AS VARCHAR) AS FLOAT) AS DOUBLE), 6)"


@query("jstat_scan", f"""SELECT o_orderkey AS payload_id, ({_JSTAT_OK}) AS accepted,
CASE WHEN {_JSTAT_OK} THEN {_gc_value(1)} END AS first_value,
CASE WHEN {_JSTAT_OK} THEN {_gc_value(17)} END AS last_value FROM orders""")
def jstat_scan(spark, sf):
    return src.parse_jstat(ad.jstat_payloads(spark, sf)).select(
        "payload_id", F.col("gc").isNotNull().alias("accepted"),
        r6(F.get("gc", F.lit(0))).alias("first_value"), r6(F.get("gc", F.lit(16))).alias("last_value"),
    )


@query("jstat_unpivot", _union([
    f"SELECT o_orderkey AS payload_id, '{name}' AS name, {_gc_value(i + 1)} AS value FROM orders WHERE {_JSTAT_OK}"
    for i, name in enumerate(src.GC_COLUMNS)
]))
def jstat_unpivot(spark, sf):
    return op.gc_members(src.parse_jstat(ad.jstat_payloads(spark, sf))).select(
        "payload_id", "name", r6("value").alias("value")
    )


@query("line_file_scan", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, trim(line, ' ') AS line FROM l
WHERE trim(line, ' ') <> '' AND NOT starts_with(trim(line, ' '), '#')""")
def line_file_scan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("value"))
    return src.clean_lines(docs).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


# -- JMX ------------------------------------------------------------------------------

def _hbase_beans(spark, sf):
    return src.explode_beans(src.parse_jmx(ad.jmx_hbase(spark, sf)))


_ROUTED = [(name, pos) for pos, name, _ in _KEY_COUNTS if name != "NULL"]


@query("bean_routing", _with(SCRAPES, ORDERS) + _union(
    [f"SELECT 'hbase' AS service, {name} AS bean_class, count(*) AS beans FROM scrapes" for name, _ in _ROUTED]
    + [
        f"SELECT 'hdfs' AS service, '{name}' AS bean_class, count(*) AS beans FROM o"
        for name in (rl.DATASET_STATE, rl.DATANODE_ACTIVITY, rl.NAMESYSTEM, rl.NAMENODE_ACTIVITY, rl.NAMESYSTEM_STATE)
    ]
    + [f"SELECT 'hdfs' AS service, '{rl.THREADING}' AS bean_class, 2 * count(*) AS beans FROM o"]
))
def bean_routing(spark, sf):
    hdfs = ad.jmx_namenode(spark, sf).unionByName(ad.jmx_datanode(spark, sf))
    routed = rl.route_beans(_hbase_beans(spark, sf), rl.HBASE).unionByName(
        rl.route_beans(src.explode_beans(src.parse_jmx(hdfs)), rl.HDFS)
    )
    return routed.groupBy("service", "bean_class").agg(F.count("*").alias("beans"))




@query("bean_whitelist", _with(SCRAPES) + _union(
    [
        f"SELECT '{bean}' AS bean_class, '{key}' AS key, count(*) AS n, "
        f"count(*) FILTER (WHERE {missing}) AS without_number FROM scrapes"
        for bean, key, missing in [
            (rl.THREADING, "ThreadCount", "n_r = 0"),
            *[(rl.WAL, k, "false") for k in ("SyncTime_num_ops", "SyncTime_99th_percentile", "AppendTime_75th_percentile")],
            *[
                (rl.SERVER, k, "n_sf = 0" if k == "hlogFileSize" else "false")
                for k in (
                    "regionCount", "storeCount", "hlogFileCount", "hlogFileSize", "storeFileCount", "memStoreSize",
                    "Mutate_75th_percentile", "Get_99th_percentile",
                )
            ],
        ]
    ]
))
def bean_whitelist(spark, sf):
    routed = rl.route_beans(_hbase_beans(spark, sf), rl.HBASE)
    ruled = rl.apply_rules(src.bean_entries(routed), rl.rule_table(spark))
    return ruled.groupBy("bean_class", "key").agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("without_number")
    )


@query("standby_drop", _with(ORDERS) + f"SELECT 'nn' || ck AS host, ts_s, count(*) AS payloads FROM o WHERE {_ACTIVE} GROUP BY 1, 2")
def standby_drop(spark, sf):
    kept = rl.drop_standby(src.parse_jmx(ad.jmx_namenode(spark, sf)))
    return kept.groupBy("host", epoch("ts").alias("ts_s")).agg(F.count("*").alias("payloads"))


@query("thread_count", _with(SCRAPES, ORDERS) + _union([
    _THREADS, _hdfs("hdfs.jvm.ThreadCount", "ck", "namenode"), _hdfs("hdfs.jvm.ThreadCount", "ok", "datanode"),
]))
def thread_count(spark, sf):
    hdfs = ad.jmx_namenode(spark, sf).unionByName(ad.jmx_datanode(spark, sf))
    hdfs_beans = src.explode_beans(rl.drop_standby(src.parse_jmx(hdfs)))
    return point_report(op.union_points([
        op.rule_points(_hbase_beans(spark, sf), rl.HBASE, [rl.THREADING]),
        op.rule_points(hdfs_beans, rl.HDFS, [rl.THREADING]),
    ]))


@query("wal_points", _with(SCRAPES) + _union(_WAL))
def wal_points(spark, sf):
    return point_report(op.rule_points(_hbase_beans(spark, sf), rl.HBASE, [rl.WAL]))


@query("server_points", _with(SCRAPES) + _union(_SERVER))
def server_points(spark, sf):
    return point_report(op.rule_points(_hbase_beans(spark, sf), rl.HBASE, [rl.SERVER]))


@query("rule_rejects", _with(SCRAPES) + f"""SELECT 'rs' || sk || '@' || CAST(epoch(q) AS BIGINT) AS payload_id,
'{rl.SERVER}/hlogFileSize' AS path, 'n/a' AS raw, 'not a number' AS reason FROM scrapes WHERE n_sf = 0""")
def rule_rejects(spark, sf):
    payload_id = F.concat("host", F.lit("@"), F.unix_seconds("ts").cast("string"))
    return op.rule_rejects(_hbase_beans(spark, sf), rl.HBASE, payload_id)


@query("namenode_points", _with(ORDERS) + _union(_NAMENODE))
def namenode_points(spark, sf):
    beans = src.explode_beans(rl.drop_standby(src.parse_jmx(ad.jmx_namenode(spark, sf))))
    return point_report(op.rule_points(
        beans, rl.HDFS, [rl.NAMESYSTEM, rl.NAMENODE_ACTIVITY, rl.NAMESYSTEM_STATE]
    ))


@query("datanode_points", _with(ORDERS) + _union(_DATANODE))
def datanode_points(spark, sf):
    beans = src.explode_beans(src.parse_jmx(ad.jmx_datanode(spark, sf)))
    return point_report(op.rule_points(beans, rl.HDFS, [rl.DATASET_STATE, rl.DATANODE_ACTIVITY]))


@query("unit_convert", _with(ORDERS) + _union(_CONVERTED))
def unit_convert(spark, sf):
    beans = src.explode_beans(src.parse_jmx(ad.jmx_datanode(spark, sf)))
    points = op.rule_points(beans, rl.HDFS, [rl.DATANODE_ACTIVITY])
    return point_report(points.filter(F.col("metric").endswith("AvgTime")))


@query("region_name_parse", _with(SCRAPES, REGIONS) + f"""SELECT 'rs' || sk AS host, {TS}, ns AS namespace,
tbl AS "table", region, m AS region_metric, v AS value FROM regions""")
def region_name_parse(spark, sf):
    return op.region_values(_hbase_beans(spark, sf)).select(
        "host", epoch("ts").alias("ts_s"), "namespace", "table", "region", "region_metric", "value"
    )


@query("region_rollup", _with(SCRAPES, REGIONS) + _union([
    f"""SELECT cluster, 'rs' || sk AS host, {TS}, '{level}' AS level, ns AS namespace, tbl AS "table",
m AS region_metric, sum(v) AS value, count(*) AS regions
FROM (SELECT cluster, sk, q, {cols}, m, v FROM regions) GROUP BY ALL""" for level, cols in _LEVELS.items()
]))
def region_rollup(spark, sf):
    rolled = rollup.region_rollup(op.region_values(_hbase_beans(spark, sf)))
    return rolled.select(
        "cluster", "host", epoch("ts").alias("ts_s"), "level", "namespace", "table", "region_metric", "value", "regions"
    )


_ROLLED = [
    _hbase("'hbase.regionserver.' || m", "v", source="(SELECT cluster, sk, q, m, sum(v) AS v FROM regions GROUP BY ALL)"),
    _hbase(
        "'hbase.regionserver.namespace.' || m", "v", "',namespace=' || ns",
        source="(SELECT cluster, sk, q, ns, m, sum(v) AS v FROM regions GROUP BY ALL)",
    ),
    _hbase(
        "'hbase.regionserver.table.' || m", "v", "',namespace=' || ns || ',table=' || tbl",
        source="(SELECT cluster, sk, q, ns, tbl, m, sum(v) AS v FROM regions GROUP BY ALL)",
    ),
]
_REGION_POINTS = _hbase(
    "'hbase.regionserver.regions.' || m", "v", "',namespace=' || ns || ',regions=' || region || ',table=' || tbl",
    source="regions",
)


@query("rollup_points", _with(SCRAPES, REGIONS) + _union([*_ROLLED, _REGION_POINTS]))
def rollup_points(spark, sf):
    regions = op.region_values(_hbase_beans(spark, sf))
    return point_report(op.union_points([
        rollup.rollup_points(rollup.region_rollup(regions)), op.region_points(regions),
    ]))


# -- host snapshots -------------------------------------------------------------------

def _nodes(spark, sf):
    return src.parse_node(ad.node_payloads(spark, sf))


@query("sys_gauges", _with(SCRAPES) + _union(_SYSTEM))
def sys_gauges(spark, sf):
    return point_report(op.system_points(_nodes(spark, sf)))


@query("net_explode", _with(SCRAPES) + _union(_NETWORK))
def net_explode(spark, sf):
    return point_report(op.network_points(_nodes(spark, sf)))


@query("disk_explode", _with(SCRAPES) + _union(_DISK))
def disk_explode(spark, sf):
    return point_report(op.disk_points(_nodes(spark, sf)))


@query("jvm_gc_explode", _with(SCRAPES) + _union(_GC))
def jvm_gc_explode(spark, sf):
    return point_report(op.jvm_points(_nodes(spark, sf)))


# -- all points -----------------------------------------------------------------------

_REPORTED = [
    _THREADS, *_WAL, *_SERVER, _REGION_POINTS, *_NAMENODE, _hdfs("hdfs.jvm.ThreadCount", "ck", "namenode"),
    *_DATANODE, _hdfs("hdfs.jvm.ThreadCount", "ok", "datanode"), *_SYSTEM, *_NETWORK, *_DISK, *_GC, *_KV,
]


# A server's own value stands in for the sum of its regions where it reports both.
@query("all_points", _with(SCRAPES, REGIONS, ORDERS) + "SELECT split_part(series_key, '{', 1) AS metric, "
       "count(*) AS points, count(DISTINCT series_key) AS series, round(sum(value), 2) AS total FROM ("
       + _union(_REPORTED) + " UNION ALL SELECT * FROM (" + _union(_ROLLED) + ") r WHERE NOT EXISTS (SELECT 1 FROM ("
       + _union(_SERVER) + ") s WHERE s.series_key = r.series_key AND s.ts_s = r.ts_s)) GROUP BY 1")
def all_points(spark, sf):
    points = plans.all_points({
        "hbase": ad.jmx_hbase(spark, sf), "hdfs": ad.jmx_namenode(spark, sf).unionByName(ad.jmx_datanode(spark, sf)),
        "node": ad.node_payloads(spark, sf), "mntr": ad.kv_payloads(spark, sf),
    })
    return points.groupBy("metric").agg(
        F.count("*").alias("points"), F.count_distinct("series_key").alias("series"),
        F.round(F.sum("value"), 2).alias("total"),
    )


# Bean values outrank roll-up values of the same name; both exist for these two metrics.
@query("point_dedupe", _with(SCRAPES, REGIONS) + "SELECT series_key, ts_s, value FROM (SELECT *, row_number() OVER "
       "(PARTITION BY series_key, ts_s ORDER BY pri DESC) AS rn FROM (SELECT *, 1 AS pri FROM ("
       + _union(_SERVER) + ") UNION ALL SELECT *, 0 AS pri FROM (" + _union(_ROLLED) + "))) WHERE rn = 1")
def point_dedupe(spark, sf):
    beans = _hbase_beans(spark, sf)
    server = op.rule_points(beans, rl.HBASE, [rl.SERVER]).withColumn("priority", F.lit(1))
    rolled = rollup.rollup_points(rollup.region_rollup(op.region_values(beans))).withColumn("priority", F.lit(0))
    points = op.with_series_key(server.unionByName(rolled)).select("series_key", "ts", "value", "priority")
    deduped = op.dedupe_points(points, "priority")
    return deduped.select("series_key", epoch("ts").alias("ts_s"), r6("value").alias("value"))


_EVENT_KEY = """'events.' || event_type || '{k=' || (props->>'$.k') || ',user=' || user_id || '}'"""


@query("make_points", f"SELECT {_EVENT_KEY} AS series_key, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, value FROM events")
def make_points(spark, sf):
    return point_report(ad.event_points(spark, sf))


@query("point_json_export", """SELECT '{"metric":"events.' || event_type || '","timestamp":' || CAST(floor(epoch(ts)) AS BIGINT) ||
',"value":' || value || ',"tags":{"k":"' || (props->>'$.k') || '","user":"' || user_id || '"}}' AS point FROM events""")
def point_json_export(spark, sf):
    return sinks.point_json(ad.event_points(spark, sf))


@query("tag_builder", """SELECT event_id, 'cluster=' || event_type || ',hostAndPort=h' || user_id || '-8080,job=' ||
CASE WHEN value > 100 THEN 'hot' ELSE 'web' END || CASE WHEN value > 100 THEN ',zone=z' || (props->>'$.k') ELSE '' END AS tags FROM events""")
def tag_builder(spark, sf):
    events = table(spark, sf, "events")
    base = pf.service_tags(
        F.col("event_type"), F.lit("web"), F.concat(F.lit("h"), F.col("user_id").cast("string")), F.lit(8080)
    )
    extra = F.when(
        F.col("value") > 100,
        F.create_map(
            F.lit("job"), F.lit("hot"), F.lit("zone"), F.concat(F.lit("z"), F.get_json_object("props", "$.k"))
        ),
    ).otherwise(F.create_map().cast("map<string,string>"))
    tags = pf.series_key(F.lit(""), pf.merge_tags(extra, base))
    return events.select("event_id", F.regexp_replace(tags, r"^\{|\}$", "").alias("tags"))


# -- string grammars ------------------------------------------------------------------

_LABEL = """l AS (SELECT c_custkey AS custkey, c_mktsegment AS seg, n_name AS nation, c_acctbal AS b, CASE
WHEN c_acctbal < 0 THEN 'c=' || c_mktsegment || '/job=' || n_name || '/task_id=' || c_custkey
WHEN c_acctbal > 9000 THEN 'job=' || n_name || '/task_id=' || c_custkey
WHEN c_acctbal > 8000 THEN 'cluster=' || c_mktsegment || '/' || n_name || '/task_id=' || c_custkey
WHEN c_acctbal > 7000 THEN 'cluster=' || c_mktsegment || '/job=' || n_name || '/task=' || c_custkey
WHEN c_acctbal > 6000 THEN 'cluster=' || c_mktsegment || '/job=' || n_name || '/task_id=t' || c_custkey
ELSE 'cluster=' || c_mktsegment || '/job=' || n_name || '/task_id=' || c_custkey END AS label
FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_GOOD_LABEL = "b >= 0 AND b <= 7000"


@query("label_parse", _with(_LABEL) + f"""SELECT custkey, CASE WHEN {_GOOD_LABEL} THEN seg ELSE '' END AS cluster,
CASE WHEN {_GOOD_LABEL} THEN nation ELSE '' END AS job,
CASE WHEN b >= 0 AND b <= 6000 THEN custkey ELSE 0 END AS task,
CASE WHEN b < 0 THEN 'no cluster part: ' || label WHEN b > 9000 THEN 'not three parts: ' || label
WHEN b > 8000 THEN 'no job part: ' || label WHEN b > 7000 THEN 'no task_id part: ' || label END AS error FROM l""")
def label_parse(spark, sf):
    labels = ad.endpoint_labels(spark, sf)
    return labels.select("custkey", tf.parse_task_label(F.col("label")).alias("p")).select("custkey", "p.*")


@query("host_from_url", """SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host,
regexp_extract(url, '^https?://([^/:]+)', 1) AS host_with_port FROM pages""")
def host_from_url(spark, sf):
    url = F.col("url")
    with_port = F.regexp_replace(url, r"(example\.[a-z]+)/", "$1:8080/")
    return table(spark, sf, "pages").select(
        "page_id", tf.host_from_url(url).alias("host"), tf.host_from_url(with_port).alias("host_with_port")
    )


_EP_BAD = """CASE WHEN c_acctbal < -500 THEN 'bad address' WHEN c_acctbal < 0 THEN 'port is not an integer'
WHEN c_acctbal > 9500 THEN 'bad key-value pair' WHEN c_acctbal > 9000 THEN 'id is not an integer'
WHEN c_acctbal > 8500 THEN 'id is negative' WHEN c_acctbal > 8000 THEN 'base_port is not positive' END"""


@query("endpoint_parse", f"""WITH e AS (SELECT c_custkey AS custkey, c_acctbal AS b, {_EP_BAD} AS error FROM customer)
SELECT custkey, error, CASE WHEN error IS NULL THEN 'http://h' || custkey || ':9001' END AS http,
CASE WHEN error IS NULL THEN 'h' || custkey || ':9001/id=' || CASE WHEN b > 5000 THEN 0 ELSE custkey END END AS key,
CASE WHEN error IS NULL THEN 'http://h' || custkey || ':' || CASE WHEN b > 5000 THEN 10001 ELSE 7001 END || '/jmx' END AS jmx,
CASE WHEN error IS NULL AND b <= 5000 THEN 'z2' END AS zone,
CASE WHEN b < 0 THEN 'agent port is not an integer' WHEN b > 9000 THEN 'bad host format' WHEN b > 8500 THEN 'ssh port is not an integer'
WHEN b > 8000 THEN 'bad agent port format' END AS ssh_error,
CASE WHEN b >= 0 AND b <= 8000 THEN CASE WHEN b > 5000 THEN 22 ELSE 2222 END END AS ssh_port,
CASE WHEN b >= 0 AND b <= 8000 THEN CASE WHEN b > 5000 THEN 9001 ELSE 9100 END END AS ssh_agent_port FROM e""".replace(
    "END END AS ssh_port", "END END::BIGINT AS ssh_port").replace("END END AS ssh_agent_port", "END END::BIGINT AS ssh_agent_port"))
def endpoint_parse(spark, sf):
    b, key = F.col("c_acctbal"), F.col("c_custkey").cast("string")

    def cat(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    endpoint = (
        F.when(b < -500, cat("h", key, "/id=", key))
        .when(b < 0, cat("h", key, ":x/id=", key))
        .when(b > 9500, cat("h", key, ":9001/id=", key, "/abc"))
        .when(b > 9000, cat("h", key, ":9001/id=x", key))
        .when(b > 8500, cat("h", key, ":9001/id=-1", key))
        .when(b > 8000, cat("h", key, ":9001/id=1/base_port=0"))
        .when(b > 5000, cat("h", key, ":9001"))
        .otherwise(cat("h", key, ":9001/id=", key, "/base_port=7000/zone=z1/zone=z2"))
    )
    ssh = (
        F.when(b < 0, cat("h", key, "/agentPort=x"))
        .when(b > 9000, cat("h", key, ":1:2"))
        .when(b > 8500, cat("h", key, ":x/agentPort=1"))
        .when(b > 8000, cat("h", key, "/port=9"))
        .when(b > 5000, cat("h", key))
        .otherwise(cat("h", key, ":2222/agentPort=9100"))
    )
    parsed = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), tf.parse_endpoint(endpoint).alias("e"), tf.parse_ssh_endpoint(ssh).alias("s")
    )
    ok, ssh_ok = F.col("e.error").isNull(), F.col("s.error").isNull()
    return parsed.select(
        "custkey", F.col("e.error").alias("error"),
        F.when(ok, tf.agent_url(F.col("e.host"), F.col("e.agent_port"))).alias("http"),
        F.when(ok, tf.endpoint_key(F.col("e.host"), F.col("e.agent_port"), F.col("e.task_id"))).alias("key"),
        F.when(ok, tf.jmx_url(F.col("e.host"), F.col("e.base_port"))).alias("jmx"),
        F.when(ok, F.try_element_at("e.attributes", F.lit("zone"))).alias("zone"),
        F.col("s.error").alias("ssh_error"),
        F.when(ssh_ok, F.col("s.ssh_port")).alias("ssh_port"),
        F.when(ssh_ok, F.col("s.agent_port")).alias("ssh_agent_port"),
    )


_TAIL = "regexp_replace(url, '^https?://', '')"


@query("name_texts", f"""WITH p AS (SELECT page_id, url, {_TAIL} AS tail, split_part({_TAIL}, '/', 1) AS host,
', ' || replace({_TAIL}, '/', ',') || ', ' || chr(10) AS setting FROM pages)
SELECT page_id, replace(replace(replace(url, '.', '_'), '-', '_'), '/', '_') AS id,
array_to_string(string_split(trim(trim(trim(setting, ' '), chr(10)), ','), ','), '|') AS items,
CASE page_id % 4 WHEN 0 THEN substr(rtrim(tail, '/'), length(host) + 2) WHEN 1 THEN '../../' || substr(rtrim(tail, '/'), length(host) + 2)
WHEN 2 THEN '.' ELSE 'srv/' || rtrim(tail, '/') END AS relative FROM p""")
def name_texts(spark, sf):
    """Element ids, list settings and relative paths, all from the addresses of pages."""
    tail = F.regexp_replace("url", "^https?://", "")
    host = F.split_part(tail, F.lit("/"), F.lit(1))
    setting = F.concat(F.lit(", "), F.replace(tail, F.lit("/"), F.lit(",")), F.lit(", \n"))
    path, kind = F.concat(F.lit("/srv/"), tail), F.col("page_id") % 4
    root = (
        F.when(kind == 0, F.concat(F.lit("/srv/"), host)).when(kind == 1, F.concat(F.lit("/srv/"), host, F.lit("/x1/x2/")))
        .when(kind == 2, path).otherwise(F.lit("/"))
    )
    return table(spark, sf, "pages").select(
        "page_id", tf.html_id(F.col("url")).alias("id"), F.array_join(tf.setting_list(setting), "|").alias("items"),
        tf.relative_path(root, path).alias("relative"),
    )


@query("bean_yield", _with(SCRAPES) + _union([
    f"SELECT '{bean}' AS bean_class, (SELECT count(*) FROM scrapes) AS beans, (SELECT count(*) FROM ({_union(points)})) AS points"
    for bean, points in ((rl.THREADING, [_THREADS]), (rl.WAL, _WAL), (rl.SERVER, _SERVER))
] + [f"SELECT '{rl.IPC}' AS bean_class, count(*) AS beans, 0 AS points FROM scrapes"]))
def bean_yield(spark, sf):
    """Routed beans and the rule points they give; the IPC bean is routed and gives none."""
    routed = rl.route_beans(_hbase_beans(spark, sf), rl.HBASE).filter(F.col("bean_class") != rl.REGIONS)
    ruled = src.bean_entries(routed).join(F.broadcast(rl.rule_table(spark)), ["service", "bean_class", "key"], "left")
    a_point = F.col("metric").isNotNull() & F.col("raw").try_cast("double").isNotNull()
    # Every bean has exactly one entry for its name.
    return ruled.groupBy("bean_class").agg(F.count_if(F.col("key") == "name").alias("beans"), F.count_if(a_point).alias("points"))
