"""Dashboard panels: fixed templates, fan-out over hosts, tasks and devices."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Target(NamedTuple):
    metric: str
    aggregator: str = "avg"
    rate: bool = False
    counter: bool = False
    raw: bool = False  # downsampling disabled


class Panel(NamedTuple):
    title: str
    targets: list[Target]


# The host and JVM dashboards.
HOST_PANELS = [
    Panel("sys.mem.available", [Target("sys.mem.available")]),
    Panel("sys.cpu.percent", [Target("sys.cpu.percent", aggregator="first", raw=True)]),
    Panel("sys.cpu.load1", [Target("sys.cpu.load1")]),
    Panel("sys.cpu.load5", [Target("sys.cpu.load5")]),
    Panel("sys.cpu.load15", [Target("sys.cpu.load15")]),
    Panel("sys.mem.usedPercent", [Target("sys.mem.usedPercent")]),
    Panel("sys.disk.usedPercent", [Target("sys.disk.usedPercent")]),
    Panel("sys.disk.used", [Target("sys.disk.used")]),
    Panel("sys.disk.free", [Target("sys.disk.free")]),
    Panel("sys.net.bytesSent", [Target("sys.net.bytesSent", rate=True)]),
    Panel("sys.net.bytesRecv", [Target("sys.net.bytesRecv", rate=True)]),
]
HOST_RANGE = "now-5m"

GC_PANELS = [
    Panel("node.jvm.gc.survivor0", [Target("node.jvm.gc.survivor0.capacity"), Target("node.jvm.gc.survivor0.usage")]),
    Panel("node.jvm.gc.survivor1", [Target("node.jvm.gc.survivor1.capacity"), Target("node.jvm.gc.survivor1.usage")]),
    Panel("node.jvm.gc.eden", [Target("node.jvm.gc.eden.capacity"), Target("node.jvm.gc.eden.usage")]),
    Panel("node.jvm.gc.old.space", [Target("node.jvm.gc.old.space.capacity"), Target("node.jvm.gc.old.space.usage")]),
    Panel("node.jvm.gc.young.gc.count", [Target("node.jvm.gc.young.gc.count", counter=True)]),
    Panel("node.jvm.gc.full.gc.count", [Target("node.jvm.gc.full.gc.count", counter=True)]),
    Panel("node.jvm.gc.young.gc.time", [Target("node.jvm.gc.young.gc.time")]),
    Panel("node.jvm.gc.full.gc.time", [Target("node.jvm.gc.full.gc.time")]),
    Panel("node.jvm.gc.metaspace", [Target("node.jvm.gc.metaspace.capacity"), Target("node.jvm.gc.metaspace.usage")]),
    Panel("node.jvm.gc.compressed.class.space", [Target("node.jvm.gc.compressed.class.space.capacity"), Target("node.jvm.gc.compressed.class.space.usage")]),
]
GC_RANGE = "now-3h"


def _target(pos: int, t: Target) -> Column:
    return F.struct(
        F.lit(pos).alias("target_pos"), F.lit(t.metric).alias("metric"),
        F.lit(t.aggregator).alias("aggregator"), F.lit(t.rate).alias("rate"),
        F.lit(t.counter).alias("counter"), F.lit(t.raw).alias("raw"),
    )


def _panel(pos: int, p: Panel, first_target_only: bool) -> Column:
    targets = p.targets[:1] if first_target_only else p.targets
    return F.struct(
        F.lit(pos).alias("panel_pos"), F.lit(p.title).alias("title"),
        F.array(*[_target(i, t) for i, t in enumerate(targets)]).alias("targets"),
    )


def _literal_panels(panels: Sequence[Panel], first_target_only: bool) -> Column:
    return F.array(*[_panel(i, p, first_target_only) for i, p in enumerate(panels)])


OUT = [
    "uid", "panel_pos", "title", "target_pos", "metric", "aggregator", "rate", "counter", "raw", "tags",
]


def _expand(rows: DataFrame, panels: Sequence[Panel], first_target_only: bool) -> DataFrame:
    """Rows x panels x targets by exploding a literal: the template list has a fixed size."""
    keep = [F.col(c) for c in rows.columns]
    with_panels = rows.select(*keep, F.explode(_literal_panels(panels, first_target_only)).alias("p"))
    return with_panels.select(
        *keep, "p.panel_pos", "p.title", F.explode("p.targets").alias("t")
    ).select(*keep, "panel_pos", "title", "t.*")


def host_dashboard_uid(host: Column) -> Column:
    return F.concat(F.lit("host-"), F.replace(host, F.lit("."), F.lit("-")))


def host_targets(
    hosts: DataFrame, disks: Sequence[str], interfaces: Sequence[str], panels: Sequence[Panel] = HOST_PANELS
) -> DataFrame:
    """Targets for (uid, host) rows: one per panel and host, for disk and network panels
    also one per device. Only the first template target of a panel is used."""
    def devices(names: Sequence[str]) -> Column:
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    rows = _expand(hosts.select("uid", "host"), panels, True)
    is_disk, is_net = F.col("title").startswith("sys.disk."), F.col("title").startswith("sys.net.")
    choice = (
        F.when(is_disk, devices(disks)).when(is_net, devices(interfaces))
        .otherwise(F.array(F.lit(None).cast("string")))
    )
    spread = rows.withColumn("device", F.explode(choice))
    tags = (
        F.when(is_disk, F.create_map(F.lit("host"), F.col("host"), F.lit("disk"), F.col("device")))
        .when(is_net, F.create_map(F.lit("host"), F.col("host"), F.lit("if"), F.col("device")))
        .otherwise(F.create_map(F.lit("host"), F.col("host")))
    )
    return spread.withColumn("tags", tags).select(*OUT)


def gc_targets(tasks: DataFrame, panels: Sequence[Panel] = GC_PANELS) -> DataFrame:
    """Targets for (cluster, job, task_id) rows: every template target, with the task's tags."""
    task = F.col("task_id").cast("string")
    rows = tasks.select(
        F.concat_ws("-", F.lit("jvm"), "cluster", "job", task).alias("uid"),
        F.create_map(
            F.lit("cluster"), F.col("cluster"), F.lit("job"), F.col("job"), F.lit("task"), task
        ).alias("tags"),
    )
    return _expand(rows, panels, False).select(*OUT)


def cluster_targets(tasks: DataFrame, templates: dict[str, Sequence[Panel]]) -> DataFrame:
    """Service dashboards for (project, cluster, job, host, base_port) task rows.

    ``templates`` maps project (hdfs, zookeeper, hbase) to panels. Name-node panels have one
    target for the cluster; the others one per task: zookeeper on the base port, the rest on
    base port + 1. HDFS panels with another title have none.
    """
    uid = F.concat_ws("-", F.lit("cluster"), "project", "cluster")

    def per_task(project: str, job: str, shift: int, panels: Sequence[Panel]) -> DataFrame:
        address = F.concat(F.col("host"), F.lit("-"), (F.col("base_port") + shift).cast("string"))
        rows = tasks.filter((F.col("project") == project) & (F.col("job") == job)).select(
            uid.alias("uid"),
            F.create_map(
                F.lit("cluster"), F.col("cluster"), F.lit("job"), F.col("job"),
                F.lit("hostAndPort"), address,
            ).alias("tags"),
        )
        return _expand(rows, panels, True).select(*OUT)

    out = None

    def add(part: DataFrame) -> None:
        nonlocal out
        out = part if out is None else out.unionByName(part)

    if "hdfs" in templates:
        of = {
            job: [p for p in templates["hdfs"] if p.title.startswith(f"hdfs.{job}")]
            for job in ("namenode", "datanode")
        }
        if of["namenode"]:
            rows = tasks.filter(F.col("project") == "hdfs").select("project", "cluster").distinct().select(
                uid.alias("uid"),
                F.create_map(
                    F.lit("cluster"), F.col("cluster"), F.lit("job"), F.lit("namenode")
                ).alias("tags"),
            )
            add(_expand(rows, of["namenode"], True).select(*OUT))
        if of["datanode"]:
            add(per_task("hdfs", "datanode", 1, of["datanode"]))
    if "zookeeper" in templates:
        add(per_task("zookeeper", "zkServer", 0, templates["zookeeper"]))
    if "hbase" in templates:
        add(per_task("hbase", "regionserver", 1, templates["hbase"]))
    return out
