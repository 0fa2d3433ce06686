"""Points and the normalisers that produce them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import points as pf, text as tf
from fleetlens.operators import rules as rl
from fleetlens.sources import payloads as src

POINT_COLUMNS = ["metric", "ts", "value", "tags"]

# Member names of host snapshots.
NETWORK_KEYS = [
    "bytesRecv", "bytesSent", "packetsRecv", "packetsSent", "dropin", "dropout", "errin", "errout",
]
DISK_KEYS = ["free", "total", "used", "usedPercent"]
SYSTEM_GAUGES = {
    "sys.cpu.percent": "CpuPercents",
    "sys.cpu.load1": "Load.load1",
    "sys.cpu.load5": "Load.load5",
    "sys.cpu.load15": "Load.load15",
    "sys.mem.free": "memory.free",
    "sys.mem.available": "memory.available",
    "sys.mem.total": "memory.total",
    "sys.mem.used": "memory.used",
    "sys.mem.usedPercent": "memory.usedPercent",
}
DISK_USAGE_PREFIX = "usage:"


def make_points(df: DataFrame, metric: Column, ts: Column, value: Column, tags: Column, *extra) -> DataFrame:
    """The point envelope. Rows without a value are not points."""
    return df.select(
        metric.alias("metric"), ts.alias("ts"), value.alias("value"), tags.alias("tags"), *extra
    ).filter(F.col("value").isNotNull())


# A column that points may carry: ``pf.tag_text`` of their tags, which their source builds more cheaply.
TAG_TEXT = "tag_text"


def with_series_key(points: DataFrame) -> DataFrame:
    if TAG_TEXT in points.columns:
        return points.withColumn("series_key", F.concat("metric", TAG_TEXT)).drop(TAG_TEXT)
    return points.withColumn("series_key", pf.series_key(F.col("metric"), F.col("tags")))


def union_points(parts: Sequence[DataFrame]) -> DataFrame:
    """One point table out of many normalisers."""
    return reduce(DataFrame.unionByName, parts)


def dedupe_points(points: DataFrame, order: str, keys: Sequence[str] = ("series_key", "ts")) -> DataFrame:
    """One row per series and instant, the one with the greatest ``order``.

    An aggregate rather than a window: duplicates are combined before the shuffle, so a
    series holding most of the rows does not land in one task. Metric and tags follow from
    the series key, so they are grouped on; that leaves fixed-width buffers and a hash
    aggregate.
    """
    fixed = [*keys, *[c for c in ("metric", "tags") if c in points.columns and c not in keys]]
    rest = [c for c in points.columns if c not in fixed]
    if rest == ["value", order]:
        best = points.groupBy(*fixed).agg(F.max_by("value", order).alias("value"), F.max(order).alias(order))
    else:
        best = points.groupBy(*fixed).agg(F.max_by(F.struct(*rest), order).alias("b")).select(*fixed, "b.*")
    return best.select(*points.columns)


def _service_tags() -> Column:
    return pf.service_tags(F.col("cluster"), F.col("job"), F.col("host"), F.col("port"))


def service_text(job: Column | None = None, **more: Column) -> Column:
    return pf.service_tag_text(F.col("cluster"), F.col("job") if job is None else job, F.col("host"), F.col("port"), **more).alias(TAG_TEXT)


def region_text() -> Column:
    """The text of an entry's tags; entries that aren't a region's lack these names."""
    return service_text(regions=F.col("region"), namespace=F.col("namespace"), table=F.col("table"))


# -- JMX ------------------------------------------------------------------------------

def rule_points(beans: DataFrame, service: str, classes: Sequence[str] | None = None, *extra) -> DataFrame:
    """Whitelisted numeric bean keys as points, optionally of some classes only."""
    routed = rl.route_beans(beans, service).filter(F.col("bean_class") != rl.REGIONS)
    if classes is not None:
        routed = routed.filter(F.col("bean_class").isin(list(classes)))
    ruled = rl.apply_rules(src.bean_entries(routed), rl.rule_table(beans.sparkSession))
    return make_points(ruled, F.col("metric"), F.col("ts"), F.col("value"), _service_tags(), *extra)


def rule_rejects(beans: DataFrame, service: str, payload_id: Column) -> DataFrame:
    """Whitelisted keys whose value is present but no number."""
    routed = rl.route_beans(beans, service).filter(F.col("bean_class") != rl.REGIONS)
    ruled = rl.apply_rules(src.bean_entries(routed), rl.rule_table(beans.sparkSession))
    return ruled.filter(F.col("value").isNull() & F.col("raw").isNotNull()).select(
        payload_id.cast("string").alias("payload_id"),
        F.concat("bean_class", F.lit("/"), "key").alias("path"),
        "raw",
        F.lit("not a number").alias("reason"),
    )


# Fixed value: how a region server names its per-region metrics.
REGION_PATTERN = r"Namespace_([a-zA-Z0-9_\-\.]+)_table_([a-zA-Z0-9_\-\.]+)_region_([a-z0-9]+)_metric_([a-zA-Z0-9_]+)"


def region_values(beans: DataFrame) -> DataFrame:
    """(namespace, table, region, region_metric, value) of every region key.

    A key counts when the pattern occurs in it exactly once and the metric is listed.
    """
    entries = src.bean_entries(beans.filter(F.col("bean_name") == rl.REGIONS).drop("bean_name"))
    key = F.col("key")
    # The literal test is cheap and spares the regex on the other keys of the bean.
    hits = entries.filter(key.contains("Namespace_")).filter(
        F.size(F.regexp_extract_all(key, F.lit(REGION_PATTERN), F.lit(0))) == 1
    )
    named = hits.select(
        *[c for c in entries.columns if c not in ("key", "raw")],
        *[
            F.regexp_extract(key, REGION_PATTERN, i + 1).alias(name)
            for i, name in enumerate(["namespace", "table", "region", "region_metric"])
        ],
        F.col("raw").try_cast("double").alias("value"),
    )
    return named.filter(F.col("region_metric").isin(rl.REGION_METRICS) & F.col("value").isNotNull())


def region_points(regions: DataFrame) -> DataFrame:
    extra = F.create_map(
        F.lit("regions"), F.col("region"), F.lit("namespace"), F.col("namespace"),
        F.lit("table"), F.col("table"),
    )
    return make_points(
        regions, F.concat(F.lit("hbase.regionserver.regions."), "region_metric"),
        F.col("ts"), F.col("value"), pf.merge_tags(extra, _service_tags()),
    )


def region_parts(key: Column) -> Column:
    """What stands before, the four names and what stands after: six parts if the pattern occurs in ``key``
    exactly once. The pattern is looked for once, and no name has the character that parts them."""
    marked = F.regexp_replace(F.translate(key, "\x01", " "), REGION_PATTERN, "\x01$1\x01$2\x01$3\x01$4\x01")
    return F.split(marked, "\x01")


ENTRY_COLUMNS = ["cluster", "job", "host", "port", "ts", "metric", "namespace", "table", "region", "region_metric", "value"]


def service_entries(beans: DataFrame, service: str) -> DataFrame:
    """Whitelisted and region keys of all beans as plain columns; every bean entry is exploded once.

    A rule entry has a metric, a region entry has namespace, table, region and region_metric.
    """
    entries = src.bean_entries(rl.route_beans(beans, service))
    rules = rl.rule_table(beans.sparkSession)
    ruled = entries.join(F.broadcast(rules), ["service", "bean_class", "key"], "left")
    key, context = F.col("key"), ["cluster", "job", "host", "port", "ts", "metric"]
    a_region = (F.col("bean_class") == rl.REGIONS) & key.contains("Namespace_") & F.col("metric").isNull()
    # Names and other texts aren't tried: a text that is no number costs as much as many numbers.
    value = F.when(F.col("metric").isNotNull() | a_region, F.col("raw").try_cast("double") / F.coalesce("divisor", F.lit(1.0)))
    rows = src.computed_once(ruled.select(*context, F.when(a_region, region_parts(key)).alias("parts"), value.alias("value")), "parts", "value")
    names = {name: F.when(F.size("parts") == 6, F.get("parts", F.lit(i + 1))) for i, name in enumerate(["namespace", "table", "region", "region_metric"])}
    listed = F.coalesce(names["region_metric"].isin(rl.REGION_METRICS), F.lit(False))
    return rows.filter((F.col("metric").isNotNull() | listed) & F.col("value").isNotNull()).select(
        *context, *[part.alias(name) for name, part in names.items()], "value")


def entry_points(entries: DataFrame, *extra) -> DataFrame:
    """Rule and region entries as points."""
    is_region = F.col("region_metric").isNotNull()
    tags = F.create_map(
        F.lit("regions"), F.col("region"), F.lit("namespace"), F.col("namespace"), F.lit("table"), F.col("table"),
    )
    metric = F.coalesce(F.col("metric"), F.concat(F.lit("hbase.regionserver.regions."), "region_metric"))
    return make_points(
        entries, metric, F.col("ts"), F.col("value"),
        F.when(is_region, pf.merge_tags(tags, _service_tags())).otherwise(_service_tags()), *extra,
    )


def service_points(beans: DataFrame, service: str) -> DataFrame:
    """Rule points and region points together."""
    return entry_points(service_entries(beans, service))


# -- host snapshots -------------------------------------------------------------------

# What tells the groups of a snapshot's cells apart, besides the host.
LABELS = {"system": [], "network": ["if"], "disk": ["disk"], "jvm": ["cluster", "job", "task"]}
GROUP = "struct<kind:string,cluster:string,disk:string,if:string,job:string,task:string,members:array<struct<metric:string,value:double>>>"


def _group(kind: str, members: Column, **labels: Column) -> Column:
    """Cells with common tags: (metric, value) members and the labels that the tags are made of."""
    names = [n for own in LABELS.values() for n in own]
    return F.struct(
        F.lit(kind).alias("kind"), *[labels.get(n, F.lit(None)).cast("string").alias(n) for n in sorted(names)], members.alias("members"))


def _members(values: dict[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(metric).alias("metric"), value.alias("value")) for metric, value in values.items()])


def _tags(**pairs: Column) -> Column:
    return F.create_map(*[c for name, value in pairs.items() for c in (F.lit(name), value)])


def _system_cells() -> Column:
    return F.array(_group("system", _members({metric: F.col(f"node.{path}") for metric, path in SYSTEM_GAUGES.items()})))


def _network_cells() -> Column:
    return F.transform(
        "node.Network",
        lambda n: _group("network", _members({f"sys.net.{k}": n[k] for k in NETWORK_KEYS}), **{"if": n["name"]}),
    )


def _disk_cells() -> Column:
    usage = F.filter(F.map_entries("node.DiskUsage"), lambda e: e["key"].startswith(DISK_USAGE_PREFIX))
    return F.transform(
        usage,
        lambda e: _group(
            "disk", _members({f"sys.disk.{k}": e["value"][k] for k in DISK_KEYS}),
            disk=F.substring(e["key"], len(DISK_USAGE_PREFIX) + 1, 2**31 - 1)),
    )


def _jvm_cells() -> Column:
    labelled = F.transform(
        F.map_entries("node.JavaMetrics"),
        lambda e: F.struct(tf.parse_task_label(e["key"]).alias("l"), e["value"].alias("members")),
    )
    good = F.filter(labelled, lambda x: x["l"]["error"].isNull())
    return F.transform(
        good,
        lambda x: _group(
            "jvm",
            F.transform(
                F.map_entries(x["members"]),
                lambda m: F.struct(F.concat(F.lit("node.jvm.gc."), m["key"]).alias("metric"), m["value"].alias("value")),
            ),
            cluster=x["l"]["cluster"], job=x["l"]["job"], task=x["l"]["task"],
        ),
    )


def _cell_points(nodes: DataFrame, *cells: Column) -> DataFrame:
    """A snapshot is parsed once and all its groups of cells leave by one explode, then the cells of each
    group, whose tags are made once; a missing member (NULL array) adds nothing."""
    empty = F.array().cast(f"array<{GROUP}>")
    together = F.concat(*[F.coalesce(c, empty) for c in cells])
    # Outer, so that the optimiser does not build the cells a second time for an emptiness test.
    groups = nodes.select("host", "ts", F.explode_outer(together).alias("g"))
    tags = F.lit(None)
    for kind, names in LABELS.items():
        tags = F.when(F.col("g.kind") == kind, _tags(host=F.col("host"), **{n: F.col(f"g.{n}") for n in names})).otherwise(tags)
    # Labels that a kind hasn't are NULL and drop out of the text.
    text = pf.named_tag_text(host=F.col("host"), **{n: F.col(f"g.{n}") for own in LABELS.values() for n in own})
    exploded = groups.select("ts", tags.alias("tags"), text.alias(TAG_TEXT), F.explode_outer("g.members").alias("cell"))
    return make_points(exploded, F.col("cell.metric"), F.col("ts"), F.col("cell.value"), F.col("tags"), TAG_TEXT)


def system_points(nodes: DataFrame) -> DataFrame:
    """The nine CPU, load and memory gauges."""
    return _cell_points(nodes, _system_cells())


def network_points(nodes: DataFrame) -> DataFrame:
    """Eight counters per interface."""
    return _cell_points(nodes, _network_cells())


def disk_points(nodes: DataFrame) -> DataFrame:
    """Four gauges per ``usage:`` entry of the disk map."""
    return _cell_points(nodes, _disk_cells())


def jvm_points(nodes: DataFrame) -> DataFrame:
    """P5: JVM gauges per task label; a label that does not parse is skipped."""
    return _cell_points(nodes, _jvm_cells())


def node_points(nodes: DataFrame) -> DataFrame:
    """P2-P5 in one pass."""
    return _cell_points(nodes, _system_cells(), _network_cells(), _disk_cells(), _jvm_cells())


def gc_members(parsed: DataFrame) -> DataFrame:
    """The 17 positional values under their names; rejected records give no rows."""
    cells = F.arrays_zip(
        F.array(*[F.lit(c) for c in src.GC_COLUMNS]).alias("name"), F.col("gc").alias("value")
    )
    keep = [c for c in parsed.columns if c != "gc"]
    # The outer form keeps the optimiser from testing, and so computing, the array beforehand.
    rows = parsed.select(*keep, F.explode_outer(cells).alias("cell")).filter(F.col("cell").isNotNull())
    return rows.select(*keep, F.col("cell.name").alias("name"), F.col("cell.value").alias("value"))


# -- key/value text -------------------------------------------------------------------

def kv_points(lines: DataFrame) -> DataFrame:
    """Integer values of key/value lines; everything else is skipped."""
    value = tf.strict_int(F.col("raw")).cast("double")
    job = F.lit("zkServer")
    tags = pf.service_tags(F.col("cluster"), job, F.col("host"), F.col("port"))
    return make_points(lines, F.concat(F.lit("zookeeper.zkServer."), "key"), F.col("ts"), value, tags, service_text(job))
