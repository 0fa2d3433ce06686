"""Inventory, status, lifecycle, packages and trash."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import sinks
from fleetlens.functions import text as tf
from fleetlens.operators import fleet as fl, lifecycle as lc
from fleetlens.session import new_work_dir
from fleetlens.sources import documents as docs
from fleetlens.workload import adapters as ad
from fleetlens.workload.registry import epoch, query, table


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


TASKS = """tasks AS (SELECT n_name AS cluster, c_mktsegment AS job, c_custkey AS task_id, 'host' || c_custkey AS host,
c_acctbal AS balance, CAST(n_regionkey AS VARCHAR) AS project FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
LAST = """last AS (SELECT o_custkey AS task_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st,
arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS ok FROM orders GROUP BY 1)"""
PROGRAMS = f"""{TASKS}, up AS (SELECT o_custkey AS task_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st,
arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS ok, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price
FROM orders GROUP BY 1),
programs AS (SELECT cluster, job, up.task_id, CASE WHEN st = 'O' THEN 'Running' ELSE 'Stopped' END AS status, ok AS pid,
CASE WHEN price > 200000 THEN '/opt/java/bin/java' ELSE '/bin/sh' END AS bin FROM up JOIN tasks ON up.task_id = tasks.task_id)"""


# -- inventory ------------------------------------------------------------------------

@query("inventory_scan", f"""WITH {PROGRAMS} SELECT 'cluster=' || cluster || '/job=' || job || '/task_id=' || task_id AS task_key,
cluster AS name, job, task_id, bin, '-Xmx1g|' || pid AS args, 'id=' || task_id AS myid, pid, status FROM programs""")
def inventory_scan(spark, sf):
    p = ad.programs(spark, sf)
    program = F.struct(
        F.col("cluster").alias("name"), "job", "task_id", "bin",
        F.array(F.lit("-Xmx1g"), F.col("pid").cast("string")).alias("args"),
        F.create_map(F.lit("myid"), _text("id=", F.col("task_id"))).alias("configs"), "pid", "status",
    )
    key = tf.task_label(F.col("cluster"), F.col("job"), F.col("task_id"))
    landed = p.select(F.to_json(F.create_map(key, program)).alias("value"))
    rows = docs.inventory_rows(landed)
    return rows.select(
        "task_key", "name", "job", F.col("task_id").cast("bigint").alias("task_id"), "bin",
        F.array_join("args", "|").alias("args"), F.try_element_at("configs", F.lit("myid")).alias("myid"),
        F.col("pid").cast("bigint").alias("pid"), "status",
    )


_STATUS = f"""WITH {PROGRAMS}, {LAST} SELECT t.cluster, t.job, t.task_id, CASE WHEN last.st IS NULL OR last.st = 'P' THEN 'Unknown'
WHEN p.status IS NULL THEN 'NotBootstrap' ELSE p.status END AS status FROM tasks t
LEFT JOIN programs p ON p.task_id = t.task_id LEFT JOIN last ON last.task_id = t.task_id"""


@query("task_status", _STATUS)
def task_status(spark, sf):
    tasks = ad.declared_tasks(spark, sf).withColumn("agent", F.col("host"))
    agents = ad.latest_orders(spark, sf).select(
        _text("host", F.col("task_id")).alias("agent"), (F.col("o_orderstatus") != "P").alias("reachable")
    )
    status = fl.task_status(tasks, ad.programs(spark, sf), agents)
    return status.select("cluster", "job", "task_id", "status")


@query("task_select", f"""WITH {TASKS} SELECT 'job' AS scope, cluster, job, task_id FROM tasks WHERE project = '3' AND job = 'BUILDING'
UNION ALL SELECT 'task' AS scope, cluster, job, task_id FROM tasks WHERE cluster = (SELECT n_name FROM nation WHERE n_nationkey = 7)""")
def task_select(spark, sf):
    tasks = ad.declared_tasks(spark, sf)
    of_job = fl.select_tasks(fl.visible_jobs(tasks), project="3", job="BUILDING")
    of_cluster = fl.select_tasks(tasks, cluster="NATION_7", task_id=-1)
    return of_job.select(F.lit("job").alias("scope"), "cluster", "job", "task_id").unionByName(
        of_cluster.select(F.lit("task").alias("scope"), "cluster", "job", "task_id")
    )


@query("job_listing", f"""WITH {TASKS} SELECT cluster, job, count(*) AS n_tasks FROM tasks WHERE task_id % 5 <> 0 GROUP BY ALL""")
def job_listing(spark, sf):
    """F8: every fifth task belongs to its cluster's template job, which listings hide."""
    template = F.when(F.col("task_id") % 5 == 0, fl.TEMPLATE_JOB).otherwise(F.col("job"))
    jobs = fl.visible_jobs(ad.declared_tasks(spark, sf).withColumn("job", template))
    return jobs.groupBy("cluster", "job").agg(F.count("*").alias("n_tasks"))


@query("jvm_program_filter", f"""WITH {PROGRAMS} SELECT o_orderkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT task_id FROM programs WHERE bin LIKE '%java%' AND status = 'Running')""")
def jvm_program_filter(spark, sf):
    tasks = ad.declared_tasks(spark, sf).select("cluster", "job", "task_id")
    gc = table(spark, sf, "orders").withColumnRenamed("o_custkey", "task_id").join(tasks, "task_id")
    return fl.jvm_programs(ad.programs(spark, sf), gc).select("o_orderkey", "o_totalprice")


@query("liveness", f"""WITH {PROGRAMS}, seen AS (SELECT o_custkey AS task_id, max(o_orderdate) AS last_seen FROM orders GROUP BY 1)
SELECT cluster, job, p.task_id, CASE WHEN last_seen >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY
THEN 'Running' ELSE 'Stopped' END AS status FROM programs p LEFT JOIN seen ON p.task_id = seen.task_id""")
def liveness(spark, sf):
    tasks = ad.declared_tasks(spark, sf).select("cluster", "job", "task_id")
    orders = table(spark, sf, "orders")
    beats = orders.select(F.col("o_custkey").alias("task_id"), F.col("o_orderdate").alias("ts")).join(tasks, "task_id")
    as_of = orders.agg(F.max("o_orderdate")).scalar()
    return fl.liveness(ad.programs(spark, sf), beats, as_of, 90 * 86400).select("cluster", "job", "task_id", "status")


@query("upsert_latest", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER
(PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'""")
def upsert_latest(spark, sf):
    changes = table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("deleted")
    )
    return fl.upsert_latest(changes, ["user_id"], "event_id", "deleted")


@query("inventory_snapshot", f"WITH {PROGRAMS} SELECT cluster, job, task_id, status, pid, bin FROM programs")
def inventory_snapshot(spark, sf):
    programs = ad.programs(spark, sf).withColumn("pid", F.col("pid").cast("bigint"))
    path = new_work_dir(spark, "inventory")
    sinks.write_inventory(programs, path)
    return spark.read.schema(programs.schema).parquet(path).select("cluster", "job", "task_id", "status", "pid", "bin")


@query("host_distinct", """SELECT 'agents' AS scope, '' AS cluster, 'http://supp' || l_suppkey || ':9001' AS host FROM lineitem GROUP BY 3
UNION ALL SELECT DISTINCT 'hosts' AS scope, 'o' || l_orderkey AS cluster, 'supp' || l_suppkey AS host FROM lineitem""")
def host_distinct(spark, sf):
    tasks = table(spark, sf, "lineitem").select(
        _text("o", F.col("l_orderkey")).alias("cluster"), _text("supp", F.col("l_suppkey")).alias("host"),
        F.lit(9001).alias("agent_port"),
    )
    agents = fl.distinct_agents(tasks).select(F.lit("agents").alias("scope"), F.lit("").alias("cluster"), F.col("agent").alias("host"))
    return agents.unionByName(fl.cluster_hosts(tasks).select(F.lit("hosts").alias("scope"), "cluster", "host"))


@query("inventory_count", f"WITH {PROGRAMS} SELECT cluster, status, count(*) AS n FROM programs GROUP BY 1, 2")
def inventory_count(spark, sf):
    return fl.inventory_counts(ad.programs(spark, sf), "cluster", "status")


@query("program_sort", f"WITH {PROGRAMS} SELECT cluster AS name, job, pid, task_id FROM programs ORDER BY 1, 2, 3")
def program_sort(spark, sf):
    programs = ad.programs(spark, sf).select(
        F.col("cluster").alias("name"), "job", F.col("pid").cast("bigint").alias("pid"), "task_id"
    )
    return fl.sort_programs(programs)


@query("package_sort", "SELECT 'doc-' || doc_id AS package_name, lang AS version FROM documents ORDER BY 1")
def package_sort(spark, sf):
    return fl.sort_packages(ad.manifest(spark, sf).select("package_name", "version"))


@query("host_sort", f"WITH {TASKS} SELECT cluster, job, task_id, host FROM tasks ORDER BY 1, 2, 3")
def host_sort(spark, sf):
    return fl.sort_hosts(ad.declared_tasks(spark, sf).select("cluster", "job", "task_id", "host"))


@query("task_result_report", f"""WITH {TASKS}, res AS (SELECT o_orderpriority AS action, o_custkey AS task_id, o_orderkey AS ok, o_orderstatus AS st FROM orders),
hits AS (SELECT action, cluster, job, r.task_id, ok, st FROM res r JOIN tasks t ON r.task_id = t.task_id),
req AS (SELECT a.action, cluster, job FROM (SELECT DISTINCT cluster, job FROM tasks) JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('noop')) AS a(action) ON true)
SELECT req.action, req.cluster, req.job, h.task_id, CASE WHEN h.ok IS NULL THEN 'No task found' WHEN st = 'F' THEN 'Failed: stop ' || ok
WHEN st = 'O' THEN 'Running' ELSE 'Success' END AS report FROM req LEFT JOIN hits h
ON h.action = req.action AND h.cluster = req.cluster AND h.job = req.job""")
def task_result_report(spark, sf):
    tasks = ad.declared_tasks(spark, sf).select("cluster", "job", "task_id")
    st = F.col("o_orderstatus")
    results = table(spark, sf, "orders").withColumnRenamed("o_custkey", "task_id").join(tasks, "task_id").select(
        F.col("o_orderpriority").alias("action"), "cluster", "job", "task_id",
        F.when(st == "F", _text("stop ", F.col("o_orderkey"))).alias("error"),
        F.when(st == "O", "Running").alias("program_status"),
    )
    actions = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("noop"))
    requests = tasks.select("cluster", "job").distinct().withColumn("action", F.explode(actions))
    return fl.task_report(requests, results)


# -- lifecycle ------------------------------------------------------------------------

# Event types as actions; an event with a value over 150 is a start that failed.
_ACTIONS = {"click": "start", "view": "stop", "signup": "bootstrap", "purchase": "rolling_update", "error": "cleanup"}


def _actions(spark, sf):
    action = F.lit(None).cast("string")
    for event, name in _ACTIONS.items():
        action = F.when(F.col("event_type") == event, name).otherwise(action)
    return table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("seq"), action.alias("action"), (F.col("value") <= 150).alias("ok")
    )


_REPLAY = """WITH RECURSIVE a AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'stop'
WHEN 'signup' THEN 'bootstrap' WHEN 'purchase' THEN 'rolling_update' ELSE 'cleanup' END AS action, value <= 150 AS ok,
row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, '' AS action, 'absent' AS state, false AS refused
FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT a.user_id, a.rn, a.seq, a.action,
CASE a.action WHEN 'bootstrap' THEN CASE WHEN state <> 'absent' THEN state WHEN ok THEN 'Running' ELSE 'Stopped' END
WHEN 'start' THEN CASE WHEN state <> 'Stopped' THEN state WHEN ok THEN 'Running' ELSE 'Stopped' END
WHEN 'stop' THEN CASE WHEN state = 'Running' THEN 'Stopped' ELSE state END
WHEN 'rolling_update' THEN CASE WHEN state = 'absent' THEN state WHEN ok THEN 'Running' ELSE 'Stopped' END
ELSE CASE WHEN state = 'Stopped' THEN 'absent' ELSE state END END AS state,
CASE a.action WHEN 'bootstrap' THEN state <> 'absent' WHEN 'start' THEN state <> 'Stopped' WHEN 'stop' THEN state <> 'Running'
WHEN 'rolling_update' THEN state = 'absent' ELSE state <> 'Stopped' END AS refused
FROM s JOIN a ON a.user_id = s.user_id AND a.rn = s.rn + 1)"""


@query("lifecycle_replay", f"{_REPLAY} SELECT user_id, seq, action, state, refused FROM s WHERE rn > 0")
def lifecycle_replay(spark, sf):
    return lc.replay(_actions(spark, sf), ["user_id"])


@query("lifecycle_final", f"{_REPLAY} SELECT user_id, arg_max(state, rn) AS state FROM s GROUP BY 1")
def lifecycle_final(spark, sf):
    return lc.final_states(_actions(spark, sf), ["user_id"])


# -- scrape coverage ------------------------------------------------------------------

_JOBS = {"AUTOMOBILE": "regionserver", "BUILDING": "namenode", "FURNITURE": "datanode", "HOUSEHOLD": "zkServer", "MACHINERY": "master"}
_JOB_SQL = "CASE job " + " ".join(f"WHEN '{s}' THEN '{j}'" for s, j in _JOBS.items()) + " END"


@query("scrape_coverage", f"""WITH {TASKS}, j AS (SELECT *, {_JOB_SQL} AS role FROM tasks),
targets AS (SELECT CASE role WHEN 'regionserver' THEN 'hbase' WHEN 'zkServer' THEN 'mntr' ELSE 'hdfs' END AS parser, cluster, role AS job, host, task_id,
CAST(CASE WHEN role = 'zkServer' THEN 10000 ELSE 10001 END AS BIGINT) AS port FROM j WHERE role <> 'master'
UNION ALL SELECT 'node', '', '', host, task_id, 9001 FROM j),
slots AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-01-01', INTERVAL 1 YEAR)) AS slot),
hits AS (SELECT o_custkey AS task_id, CASE WHEN o_orderstatus = 'O' THEN 9001 ELSE 10001 END AS port, date_trunc('year', o_orderdate) AS slot,
count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT parser, cluster, job, host, t.port, CAST(epoch(s.slot) AS BIGINT) AS slot_s, coalesce(n, 0) AS payloads
FROM targets t JOIN slots s ON true LEFT JOIN hits h ON h.task_id = t.task_id AND h.port = t.port AND h.slot = s.slot""")
def scrape_coverage(spark, sf):
    role = F.lit(None).cast("string")
    for segment, name in _JOBS.items():
        role = F.when(F.col("job") == segment, name).otherwise(role)
    tasks = ad.declared_tasks(spark, sf).withColumn("job", role).withColumn("base_port", F.lit(10000).cast("bigint"))
    landed = table(spark, sf, "orders").select(
        _text("host", F.col("o_custkey")).alias("host"),
        F.when(F.col("o_orderstatus") == "O", 9001).otherwise(10001).cast("bigint").alias("port"),
        F.col("o_orderdate").alias("ts"),
    )
    cover = fl.scrape_coverage(fl.scrape_targets(tasks), landed, "1995-01-01", "2002-01-01", "1 YEAR")
    return cover.select("parser", "cluster", "job", "host", "port", epoch("slot").alias("slot_s"), "payloads")


# -- packages -------------------------------------------------------------------------

MANIFEST = """m AS (SELECT 'doc-' || d.doc_id AS package_name, text, lang, source,
CASE WHEN quality = 0 AND toxic = 1 THEN md5(upper(lang)) ELSE md5(text) END AS md5sum,
strlen(text) + CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END AS size,
quality = 1 AND toxic = 1 AS lost, coalesce(quality = 0, false) AS wrong, coalesce(toxic = 1, false) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("manifest_scan", f"WITH {MANIFEST} SELECT package_name, lang AS version, '2024-01-01' AS date, md5sum, size, 'http://pkg/' || source AS link FROM m")
def manifest_scan(spark, sf):
    m = ad.manifest(spark, sf)
    record = F.struct(*[c for c in m.columns if c != "package_name"])
    landed = m.select(F.to_json(F.create_map("package_name", record)).alias("value"))
    return docs.manifest_rows(landed)


@query("manifest_verify", f"""WITH {MANIFEST} SELECT package_name, CASE WHEN lost THEN 'missing' WHEN wrong AND NOT toxic THEN 'size_mismatch'
WHEN wrong AND toxic THEN 'md5_mismatch' ELSE 'ok' END AS verdict FROM m""")
def manifest_verify(spark, sf):
    digests = fl.file_digests(ad.landed_files(spark, sf))
    return fl.verify_manifest(ad.manifest(spark, sf), digests).select("package_name", "verdict")


@query("packages_to_fetch", f"WITH {MANIFEST} SELECT package_name, 'http://pkg/' || source AS link FROM m WHERE lost OR wrong")
def packages_to_fetch(spark, sf):
    digests = fl.file_digests(ad.landed_files(spark, sf))
    return fl.packages_to_fetch(ad.manifest(spark, sf), digests).select("package_name", "link")


@query("package_pin", f"""WITH {MANIFEST}, pins AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'pkg-' ELSE 'doc-' END || d.doc_id AS package_name,
CASE WHEN quality = 1 THEN md5(text) ELSE md5(lang) END AS pinned_md5 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT pins.package_name, CASE WHEN m.md5sum IS NULL THEN 'not_found' WHEN m.md5sum <> pinned_md5 THEN 'md5_mismatch' ELSE 'ok' END AS state
FROM pins LEFT JOIN m ON m.package_name = pins.package_name""")
def package_pin(spark, sf):
    text = table(spark, sf, "documents").select("doc_id", "text", "lang")
    pins = table(spark, sf, "labels").join(text, "doc_id").select(
        _text(F.when(F.col("toxic") == 1, "pkg-").otherwise("doc-"), F.col("doc_id")).alias("package_name"),
        F.when(F.col("quality") == 1, F.md5("text")).otherwise(F.md5("lang")).alias("pinned_md5"),
    )
    return fl.pin_lookup(pins, ad.manifest(spark, sf)).select("package_name", "state")


@query("package_dedupe", "SELECT md5(text) AS md5, min('doc-' || doc_id) AS package_name, count(*) AS copies FROM documents GROUP BY 1")
def package_dedupe(spark, sf):
    packages = table(spark, sf, "documents").select(
        _text("doc-", F.col("doc_id")).alias("package_name"), F.md5("text").alias("md5")
    )
    return fl.package_cache(packages)


@query("cluster_listing", """WITH d AS (SELECT l_orderkey, string_agg('s' || l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) AS dependencies
FROM lineitem GROUP BY 1) SELECT 'o' || o_orderkey AS cluster, o_orderpriority AS package_name, coalesce(dependencies, '') AS dependencies
FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""")
def cluster_listing(spark, sf):
    clusters = table(spark, sf, "orders").select(
        _text("o", F.col("o_orderkey")).alias("cluster"), F.col("o_orderpriority").alias("package_name")
    )
    dependencies = table(spark, sf, "lineitem").select(
        _text("o", F.col("l_orderkey")).alias("cluster"),
        (F.col("l_linenumber") * F.lit(10**12) + F.col("l_suppkey")).alias("ordinal"),
        _text("s", F.col("l_suppkey")).alias("dep_cluster"),
    )
    return fl.cluster_listing(clusters, dependencies)


# -- trash ----------------------------------------------------------------------------

def _trash(spark, sf):
    status = F.col("o_orderstatus")
    name = F.when(status == "P", _text("job.", F.col("o_orderkey"))).otherwise(
        _text(".trash.j-", F.lower(status), ".", F.col("o_orderkey"), ".", F.unix_seconds("o_orderdate"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", _text("/agent/c", F.col("o_custkey"), "/", name).alias("path"), name.alias("name"),
        (F.col("o_orderpriority") != "5-LOW").alias("is_dir"), F.lit(2).alias("depth"),
    )


@query("trash_parse", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS epoch_s,
o_orderstatus <> 'P' AS is_trash FROM orders""")
def trash_parse(spark, sf):
    value = tf.trash_epoch(F.col("name"))
    return _trash(spark, sf).select("o_orderkey", value.alias("epoch_s"), (value >= 0).alias("is_trash"))


@query("trash_folders", """WITH t AS (SELECT 'n' || c_nationkey AS home, CASE WHEN c_acctbal < 0 THEN 'live-' || c_mktsegment
ELSE 'j.trash.' || lower(c_mktsegment) || '.' || c_nationkey || '.' || CAST(floor(c_acctbal / 1000) AS BIGINT) * 1000 END AS name, c_acctbal FROM customer)
SELECT 'home=' || home || '/folder=' || name AS folder, CAST(split_part(name, '.', 5) AS BIGINT) AS epoch_s, true AS has_files
FROM t WHERE c_acctbal >= 0 AND CAST(split_part(name, '.', 5) AS BIGINT) + 3600 <= 8600 GROUP BY 1, 2""")
def trash_folders(spark, sf):
    # A tree of folders two levels below a root; a few are no trash. Only the listing is read.
    root = new_work_dir(spark, "agent")
    balance = F.col("c_acctbal")
    name = F.when(balance < 0, _text("live-", F.col("c_mktsegment"))).otherwise(_text(
        "j.trash.", F.lower("c_mktsegment"), ".", F.col("c_nationkey"), ".", F.floor(balance / 1000).cast("bigint") * 1000))
    files = table(spark, sf, "customer").select(_text("n", F.col("c_nationkey")).alias("home"), name.alias("folder"), F.col("c_name").alias("value"))
    files.repartition("home").write.partitionBy("home", "folder").text(root)
    expired = fl.expired_trash(docs.list_folders(spark, root), F.lit(8600), 3600)
    return expired.select(
        F.substring_index("path", "/", -2).alias("folder"), F.col("epoch").alias("epoch_s"), (F.col("files") > 0).alias("has_files"))


@query("retention_expired", """SELECT '/agent/c' || o_custkey || '/.trash.j-' || lower(o_orderstatus) || '.' || o_orderkey || '.' ||
CAST(epoch(o_orderdate) AS BIGINT) AS path, CAST(epoch(o_orderdate) AS BIGINT) AS epoch_s FROM orders
WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND epoch(o_orderdate) + 31536000 <= epoch(TIMESTAMP '2000-01-01')""")
def retention_expired(spark, sf):
    as_of = F.unix_seconds(F.lit("2000-01-01").cast("timestamp"))
    return fl.expired_trash(_trash(spark, sf), as_of, 31536000).select("path", F.col("epoch").alias("epoch_s"))
