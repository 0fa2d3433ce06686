"""Fleet state and integrity: tasks, programs, packages, trash (J1, J8, J9, J11, A5, A7, A8,
W4, F6, F8, F9, L1-L3, P22, R1, R2, R4, X9)."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions import ordered, text as tf

TASK = ["cluster", "job", "task_id"]

# The states of a task.
RUNNING, STOPPED, NOT_BOOTSTRAP, UNKNOWN = "Running", "Stopped", "NotBootstrap", "Unknown"
TEMPLATE_JOB = "job_common"


def task_status(tasks: DataFrame, programs: DataFrame, agents: DataFrame) -> DataFrame:
    """Declared tasks with the state their agent reports.

    ``tasks`` (cluster, job, task_id, agent), ``programs`` (cluster, job, task_id, status),
    ``agents`` (agent, reachable). An agent without a row counts as unreachable.
    """
    joined = tasks.join(programs.select(*TASK, "status"), TASK, "left").join(agents, "agent", "left")
    status = (
        F.when(~F.coalesce("reachable", F.lit(False)), UNKNOWN)
        .when(F.col("status").isNull(), NOT_BOOTSTRAP)
        .otherwise(F.col("status"))
    )
    return joined.select(*tasks.columns, status.alias("status"))


def select_tasks(
    tasks: DataFrame, project: str | None = None, cluster: str | None = None,
    job: str | None = None, task_id: int = -1,
) -> DataFrame:
    """entity predicates; a negative task id means all tasks."""
    out = tasks
    for column, wanted in (("project", project), ("cluster", cluster), ("job", job)):
        if wanted is not None:
            out = out.filter(F.col(column) == wanted)
    return out if task_id < 0 else out.filter(F.col("task_id") == task_id)


def visible_jobs(jobs: DataFrame) -> DataFrame:
    """F8: listings hide the template job."""
    return jobs.filter(F.col("job") != TEMPLATE_JOB)


def jvm_programs(programs: DataFrame, gc: DataFrame) -> DataFrame:
    """GC rows of programs that run java and are alive."""
    alive = programs.filter(F.contains("bin", F.lit("java")) & (F.col("status") == RUNNING))
    return gc.join(alive.select(*TASK), TASK, "left_semi")


def liveness(programs: DataFrame, heartbeats: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Running when the last heartbeat is within the ttl of ``as_of``, else Stopped."""
    seen = heartbeats.groupBy(*TASK).agg(F.max("ts").alias("last_seen"))
    fresh = F.col("last_seen") >= as_of - F.expr(f"INTERVAL '{int(ttl_seconds)}' SECOND")
    return programs.join(seen, TASK, "left").withColumn(
        "status", F.when(F.coalesce(fresh, F.lit(False)), RUNNING).otherwise(STOPPED)
    )


def upsert_latest(changes: DataFrame, keys: Sequence[str], seq: str, deleted: str | None = None) -> DataFrame:
    """The last change of each key; a last change that is a delete removes the key."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("last")).select(*keys, "last.*")
    return last if deleted is None else last.filter(~F.col(deleted)).drop(deleted)


def distinct_agents(tasks: DataFrame) -> DataFrame:
    """A5: the distinct agent addresses of a fleet."""
    return tasks.select(tf.agent_url(F.col("host"), F.col("agent_port")).alias("agent")).distinct()


def cluster_hosts(tasks: DataFrame) -> DataFrame:
    """A5: the distinct hosts of each cluster, one row each."""
    return tasks.select("cluster", "host").distinct()


def inventory_counts(programs: DataFrame, *by: str) -> DataFrame:
    """A7."""
    return programs.groupBy(*by).agg(F.count("*").alias("n"))


def sort_programs(programs: DataFrame) -> DataFrame:
    """L1: by name, job and pid; the task id only settles ties."""
    return programs.orderBy("name", "job", "pid", "task_id")


def sort_packages(manifest: DataFrame) -> DataFrame:
    """L2."""
    return manifest.orderBy("package_name")


def sort_hosts(tasks: DataFrame) -> DataFrame:
    """L3: the hosts of each job by task id."""
    return tasks.orderBy(*TASK)


def sort_host_array(hosts: Column) -> Column:
    """L3 on an ``array<struct<task_id, ...>>`` column."""
    order = lambda a, b: F.when(a["task_id"] < b["task_id"], -1).when(a["task_id"] > b["task_id"], 1).otherwise(0)
    return F.array_sort(hosts, order)


def task_report(requests: DataFrame, results: DataFrame) -> DataFrame:
    """One line per result of a requested (action, cluster, job).

    An error wins, then the status of a returned program, else Success; a request without
    any result reads ``No task found``.
    """
    keys = ["action", "cluster", "job"]
    report = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("Failed: "), "error"))
        .when(F.col("program_status").isNotNull(), F.col("program_status"))
        .otherwise("Success")
    )
    # An inner join, in which a request with very many results can be split, and the requests
    # that have none.
    found = results.join(requests.select(*keys), keys).select(*keys, "task_id", report.alias("report"))
    none = requests.select(*keys).join(results.select(*keys).distinct(), keys, "left_anti")
    missing = none.select(*keys, F.lit(None).cast(results.schema["task_id"].dataType).alias("task_id"), F.lit("No task found").alias("report"))
    return found.unionByName(missing)


# -- scrape planning ------------------------------------------------------------------

# The jobs that are polled, their parser and the offset of the polled port.
DISPATCH = [
    ("regionserver", "hbase", 1),
    ("namenode", "hdfs", 1),
    ("datanode", "hdfs", 1),
    ("zkServer", "mntr", 0),
]


def dispatch_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{job}', '{parser}', {shift})" for job, parser, shift in DISPATCH)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS dispatch(job, parser, port_shift)")


def scrape_targets(tasks: DataFrame) -> DataFrame:
    """The (parser, cluster, job, host, port) targets a fleet asks for: one per task of a
    polled job, and one node target per distinct agent."""
    polled = tasks.join(F.broadcast(dispatch_table(tasks.sparkSession)), "job").select(
        "parser", "cluster", "job", "host", (F.col("base_port") + F.col("port_shift")).cast("bigint").alias("port")
    )
    nodes = tasks.select("host", "agent_port").distinct().select(
        F.lit("node").alias("parser"), F.lit("").alias("cluster"), F.lit("").alias("job"),
        "host", F.col("agent_port").cast("bigint").alias("port"),
    )
    return polled.unionByName(nodes)


def scrape_coverage(
    targets: DataFrame, payloads: DataFrame, start: str, end: str, interval: str
) -> DataFrame:
    """Payload count per target and interval in [start, end); 0 marks a missed interval.

    The expected (target, interval) rows come from a generated sequence of each target, and
    payloads are counted before the join, so a busy target adds one row per interval.
    """
    keys = ["host", "port"]
    step = F.expr(f"INTERVAL {interval}")
    stops = F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") - F.expr("INTERVAL 1 SECOND"), step)
    expected = targets.withColumn("slot", F.explode(stops))
    slot = F.lit(start).cast("timestamp")
    inside = payloads.filter((F.col("ts") >= slot) & (F.col("ts") < F.lit(end).cast("timestamp")))
    # The latest slot start that is not after the payload. Slots of a fixed length are computed;
    # months and years differ in length, but are few.
    origin = F.unix_micros(slot)
    length = F.unix_micros(slot + step) - origin
    latest = (
        F.array_max(F.filter(stops, lambda s: s <= F.col("ts"))) if re.search("month|year", interval, re.IGNORECASE)
        else F.timestamp_micros(origin + F.floor((F.unix_micros("ts") - origin) / length) * length)
    )
    counted = inside.withColumn("slot", latest).groupBy(*keys, "slot").agg(F.count("*").alias("payloads"))
    return expected.join(counted, [*keys, "slot"], "left").withColumn(
        "payloads", F.coalesce("payloads", F.lit(0)).cast("bigint")
    )


# -- packages -------------------------------------------------------------------------

def file_digests(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(name, length, md5) of file contents; only digests are ever shuffled."""
    return files.select(
        F.col(name).alias("package_name"), F.octet_length(content).cast("bigint").alias("length"),
        F.md5(F.col(content)).alias("md5"),
    )


def read_package_files(spark: SparkSession, lib_dir: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(lib_dir)
    return file_digests(files.withColumn("name", tf.base_name(F.col("path"))))


def verify_manifest(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Missing, size_mismatch, md5_mismatch or ok per package, checked in that order."""
    joined = manifest.join(digests, "package_name", "left")
    verdict = (
        F.when(F.col("md5").isNull(), "missing")
        .when(F.col("length") != F.col("size"), "size_mismatch")
        .when(F.col("md5") != F.col("md5sum"), "md5_mismatch")
        .otherwise("ok")
    )
    return joined.select(*manifest.columns, verdict.alias("verdict"))


def packages_to_fetch(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Packages without a correct local copy."""
    good = digests.select(
        "package_name", F.col("length").alias("size"), F.col("md5").alias("md5sum")
    )
    return manifest.join(good, ["package_name", "size", "md5sum"], "left_anti")


def pin_lookup(pins: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each pinned (package_name, pinned_md5) against the manifest."""
    known = manifest.select("package_name", "md5sum")
    joined = pins.join(known, "package_name", "left")
    state = (
        F.when(F.col("md5sum").isNull(), "not_found")
        .when(F.col("md5sum") != F.col("pinned_md5"), "md5_mismatch")
        .otherwise("ok")
    )
    return joined.select(*pins.columns, state.alias("state"))


def package_cache(packages: DataFrame) -> DataFrame:
    """One stored copy per checksum, under the least name, with the number of names."""
    return packages.groupBy("md5").agg(
        F.min("package_name").alias("package_name"), F.count("*").alias("copies")
    )


# -- trash ----------------------------------------------------------------------------

def expired_trash(listing: DataFrame, as_of: Column, ttl_seconds: int = 6 * 3600) -> DataFrame:
    """R2: trash directories at depth 2 whose epoch + ttl has passed ``as_of`` (epoch seconds).

    ``listing``: (path, is_dir, depth). Deleting is up to the caller.
    """
    rows = listing.filter(F.col("is_dir") & (F.col("depth") == 2)).withColumn(
        "epoch", tf.trash_epoch(tf.base_name(F.col("path")))
    )
    return rows.filter((F.col("epoch") >= 0) & (F.col("epoch") + ttl_seconds <= as_of))


# -- listings -------------------------------------------------------------------------

def cluster_listing(clusters: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Each cluster with its package and its dependencies in order."""
    lists = ordered.by_position(
        dependencies, ["cluster"], F.col("ordinal"), F.col("dep_cluster"), ",", "dependencies"
    )
    return clusters.join(lists, "cluster", "left").withColumn(
        "dependencies", F.coalesce("dependencies", F.lit(""))
    )
