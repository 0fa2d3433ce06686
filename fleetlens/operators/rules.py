"""Which bean keys become which metrics, as a small fixed table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.sources.payloads import computed_once

HBASE, HDFS = "hbase", "hdfs"

# Bean names and key lists of the monitored services.
THREADING = "java.lang:type=Threading"
REGIONS = "Hadoop:service=HBase,name=RegionServer,sub=Regions"
WAL = "Hadoop:service=HBase,name=RegionServer,sub=WAL"
SERVER = "Hadoop:service=HBase,name=RegionServer,sub=Server"
IPC = "Hadoop:service=HBase,name=RegionServer,sub=IPC"
NAMESYSTEM = "Hadoop:service=NameNode,name=FSNamesystem"
NAMENODE_ACTIVITY = "Hadoop:service=NameNode,name=NameNodeActivity"
NAMESYSTEM_STATE = "Hadoop:service=NameNode,name=FSNamesystemState"
DATASET_STATE = "Hadoop:service=DataNode,name=FSDatasetState"
DATANODE_ACTIVITY = "Hadoop:service=DataNode,name=DataNodeActivity"

WAL_KEYS = [
    "SyncTime_num_ops", "SyncTime_75th_percentile", "SyncTime_90th_percentile", "SyncTime_95th_percentile", "SyncTime_99th_percentile",
    "AppendTime_num_ops", "AppendTime_75th_percentile", "AppendTime_90th_percentile", "AppendTime_95th_percentile", "AppendTime_99th_percentile",
]
SERVER_KEYS = [
    "regionCount", "storeCount", "hlogFileCount", "hlogFileSize", "storeFileCount", "memStoreSize",
    "Mutate_75th_percentile", "Mutate_90th_percentile", "Mutate_95th_percentile", "Mutate_99th_percentile",
    "Increment_75th_percentile", "Increment_90th_percentile", "Increment_95th_percentile", "Increment_99th_percentile",
    "FlushTime_75th_percentile", "FlushTime_90th_percentile", "FlushTime_95th_percentile", "FlushTime_99th_percentile",
    "Delete_75th_percentile", "Delete_90th_percentile", "Delete_95th_percentile", "Delete_99th_percentile",
    "Get_75th_percentile", "Get_90th_percentile", "Get_95th_percentile", "Get_99th_percentile",
    "ScanNext_75th_percentile", "ScanNext_90th_percentile", "ScanNext_95th_percentile", "ScanNext_99th_percentile",
    "Append_75th_percentile", "Append_90th_percentile", "Append_95th_percentile", "Append_99th_percentile",
]
NAMESYSTEM_KEYS = [
    "MissingBlocks", "CapacityTotal", "CapacityUsed", "CapacityRemaining", "BlocksTotal", "FilesTotal",
]
NAMENODE_ACTIVITY_KEYS = ["SyncsAvgTime", "SyncsNumOps"]
NAMESYSTEM_STATE_KEYS = ["NumLiveDataNodes", "NumDeadDataNodes", "NumDecomLiveDataNodes"]
DATASET_STATE_KEYS = ["Capacity", "DfsUsed", "Remaining"]
DATANODE_ACTIVITY_KEYS = [
    "BytesWritten", "BytesRead", "BlocksWritten", "BlocksRead",
    "ReadsFromLocalClient", "ReadsFromRemoteClient",
    "WritesFromLocalClient", "WritesFromRemoteClient",
    "FlushNanosNumOps", "FsyncNanosNumOps",
]
NANOSECOND_KEYS = ["FsyncNanosAvgTime", "FlushNanosAvgTime", "SendDataPacketTransferNanosAvgTime"]
REGION_METRICS = [
    "storeCount", "storeFileCount", "memStoreSize", "storeFileSize", "readRequestCount",
    "writeRequestCount", "get_num_ops", "scanNext_num_ops", "deleteCount", "mutateCount",
]

# service -> (exact bean names, bean name prefixes); prefixes are tried after the names.
ROUTES = {
    HBASE: ([THREADING, REGIONS, WAL, SERVER, IPC], []),
    HDFS: (
        [THREADING, NAMESYSTEM, NAMENODE_ACTIVITY, NAMESYSTEM_STATE],
        [DATASET_STATE, DATANODE_ACTIVITY],
    ),
}


class Rule(NamedTuple):
    service: str
    bean: str
    key: str
    metric: str
    divisor: float


def _rules() -> list[Rule]:
    def plain(service: str, bean: str, prefix: str, keys: list[str]) -> list[Rule]:
        return [Rule(service, bean, key, prefix + key, 1.0) for key in keys]

    return [
        *plain(HBASE, THREADING, "hbase.jvm.", ["ThreadCount"]),
        *plain(HBASE, WAL, "hbase.regionserver.wal.", WAL_KEYS),
        *plain(HBASE, SERVER, "hbase.regionserver.", SERVER_KEYS),
        *plain(HDFS, THREADING, "hdfs.jvm.", ["ThreadCount"]),
        *plain(HDFS, NAMESYSTEM, "hdfs.namenode.fs.", NAMESYSTEM_KEYS),
        *plain(HDFS, NAMENODE_ACTIVITY, "hdfs.namenode.activity.", NAMENODE_ACTIVITY_KEYS),
        *plain(HDFS, NAMESYSTEM_STATE, "hdfs.namenode.fs.state.", NAMESYSTEM_STATE_KEYS),
        *plain(HDFS, DATASET_STATE, "hdfs.datanode.fs.state.", DATASET_STATE_KEYS),
        *plain(HDFS, DATANODE_ACTIVITY, "hdfs.datanode.activity.", DATANODE_ACTIVITY_KEYS),
        # Nanoseconds in, milliseconds out, and the unit leaves the name.
        *[
            Rule(HDFS, DATANODE_ACTIVITY, k, "hdfs.datanode.activity." + k.replace("Nanos", ""), 1e6)
            for k in NANOSECOND_KEYS
        ],
    ]


RULES = _rules()


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a local relation of fixed size (under a hundred rows)."""
    values = ", ".join(
        f"('{r.service}', '{r.bean}', '{r.key}', '{r.metric}', {r.divisor:.1f}D)" for r in RULES
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(service, bean_class, key, metric, divisor)")


def bean_class(service: str, name: Column) -> Column:
    """the routed bean class, NULL for a bean nobody handles (or one without a name)."""
    exact, prefixes = ROUTES[service]
    routed = F.when(name.isin(exact), name)
    for prefix in prefixes:
        routed = routed.when(name.startswith(prefix), F.lit(prefix))
    return routed


def route_beans(beans: DataFrame, service: str) -> DataFrame:
    return (
        beans.withColumn("service", F.lit(service))
        .withColumn("bean_class", bean_class(service, F.col("bean_name")))
        .filter(F.col("bean_class").isNotNull())
    )


def apply_rules(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """keep whitelisted keys and attach metric name and scaled value.

    The rule table has a fixed size, so broadcasting it is safe at any input size. ``value``
    is NULL where the raw text is no number: those rows are for the rejects.
    """
    joined = entries.join(F.broadcast(rules), ["service", "bean_class", "key"])
    return joined.withColumn("value", F.col("raw").try_cast("double") / F.col("divisor")).drop("divisor")


def is_standby(beans: Column) -> Column:
    """some NameNodeActivity bean has the key ``tag.HAState`` with a value other than ``active``.

    An explicit null counts as other; an absent key does not.
    """
    return F.exists(
        beans,
        lambda b: F.try_element_at(b, F.lit("name")).eqNullSafe(NAMENODE_ACTIVITY)
        & F.map_contains_key(b, "tag.HAState")
        & ~F.try_element_at(b, F.lit("tag.HAState")).eqNullSafe("active"),
    )


def drop_standby(parsed: DataFrame) -> DataFrame:
    """Drops whole payloads of standby name nodes, before any bean is exploded."""
    return computed_once(parsed, "beans").filter(~F.coalesce(is_standby(F.col("beans")), F.lit(False)))
