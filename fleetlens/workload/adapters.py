"""Payloads, documents and inventories derived from the given tables.

These only shape the input; the operators know nothing about these tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions import text as tf
from fleetlens.operators import rules as rl
from fleetlens.operators.points import with_series_key
from fleetlens.workload.registry import table

FLAGS = ["A", "N", "R"]


def scrapes(spark: SparkSession, sf: str) -> DataFrame:
    """One scrape per supplier and ship quarter: counts, quantities and cents by flag and status."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    quantity = F.col("l_quantity").cast("bigint")

    def where(cond: Column, value) -> Column:
        return F.sum(F.when(cond, value).otherwise(0)).cast("bigint")

    measures = []
    for f in FLAGS:
        cond = F.col("l_returnflag") == f
        low = f.lower()
        measures += [
            where(cond, 1).alias(f"n_{low}"), where(cond, quantity).alias(f"q_{low}"),
            where(cond, cents).alias(f"p_{low}"),
        ]
    for s in ("O", "F"):
        cond = F.col("l_linestatus") == s
        measures += [
            where(cond, 1).alias(f"n_s{s.lower()}"), where(cond, quantity).alias(f"q_s{s.lower()}"),
        ]
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"
    )
    sums = lines.groupBy("l_suppkey", F.date_trunc("quarter", "l_shipdate").alias("ts")).agg(
        F.count("*").alias("n"), F.max(quantity).alias("max_q"), *measures
    )
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    return (
        sums.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.replace("r_name", F.lit(" "), F.lit("_")).alias("cluster"), F.col("n_name").alias("nation"),
            F.col("l_suppkey").alias("sk"), "ts", "n", "max_q",
            *[f"{m}_{f.lower()}" for f in FLAGS for m in ("n", "q", "p")],
            "n_so", "q_so", "n_sf", "q_sf",
        )
    )


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _object(members: dict[str, Column]) -> Column:
    """``"k":v`` members joined by commas; values are raw JSON text, NULL members are left out."""
    cells = [_text(f'"{k}":', v) for k, v in members.items()]
    return _text("{", F.concat_ws(",", *cells), "}")


def _bean(name, members: dict[str, Column]) -> Column:
    label = name if isinstance(name, Column) else F.lit(name)
    return _object({"name": _text('"', label, '"'), **members})


def _beans(*beans: Column) -> Column:
    return _text('{"beans":[', F.concat_ws(",", *beans), "]}")


def jmx_hbase(spark: SparkSession, sf: str) -> DataFrame:
    """Region-server payloads: (cluster, job, host, port, ts, value)."""
    c = F.col
    region_cells = []
    for f in FLAGS:
        low = f.lower()
        stem = _text(
            '"Namespace_', c("cluster"), "_table_", c("nation"), f".{f}_region_", c("hex"), f"{low}_metric_",
        )
        cells = [
            _text(stem, f'{metric}":', value)
            for metric, value in {
                "storeCount": c(f"n_{low}"), "readRequestCount": c(f"q_{low}"),
                "memStoreSize": c(f"p_{low}"), "blockCacheHitCount": c(f"n_{low}"),
            }.items()
        ]
        region_cells.append(F.when(c(f"n_{low}") > 0, F.concat_ws(",", *cells)))
    regions = _text(
        f'{{"name":"{rl.REGIONS}",', F.concat_ws(",", *region_cells), ',"numRegions":', c("n"), "}"
    )
    value = _beans(
        _bean(rl.THREADING, {"ThreadCount": F.when(c("n_r") == 0, "null").otherwise(c("n").cast("string"))}),
        regions,
        _bean(rl.WAL, {
            "SyncTime_num_ops": c("n"), "SyncTime_99th_percentile": c("max_q"), "SyncTime_min": c("n"),
            "AppendTime_75th_percentile": c("n_a") / 4,
        }),
        _bean(rl.SERVER, {
            "regionCount": F.lit(3), "storeCount": c("n"), "hlogFileCount": c("n_so"),
            "hlogFileSize": F.when(c("n_sf") == 0, '"n/a"').otherwise(c("q_sf").cast("string")),
            "storeFileCount": c("n_sf"), "memStoreSize": c("p_a") + c("p_n") + c("p_r"),
            "Mutate_75th_percentile": c("q_a") / 4, "Get_99th_percentile": c("max_q"),
            "tag.Context": F.lit('"regionserver"'), "percentFilesLocal": F.lit(100),
        }),
        _bean(rl.IPC, {"queueSize": c("n")}),
        _object({"modelerType": F.lit('"x"'), "ThreadCount": c("n")}),
    )
    return scrapes(spark, sf).withColumn("hex", F.lower(F.hex("sk"))).select(
        "cluster", F.lit("regionserver").alias("job"), _text("rs", c("sk")).alias("host"),
        F.lit(16031).alias("port"), "ts", value.alias("value"),
    )


def _order_scrapes(spark: SparkSession, sf: str) -> DataFrame:
    # A number of their own, so that adaptive execution, which goes by bytes, doesn't put millions of
    # orders into one task: the payloads made of them are some thirty times as large.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice"
    ).repartition(parts, "o_orderkey")
    return orders.select(
        _text("hdfs-", F.substring("o_orderpriority", 1, 1)).alias("cluster"),
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.col("o_orderdate").alias("ts"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )


def jmx_namenode(spark: SparkSession, sf: str) -> DataFrame:
    """Name-node payloads, one per order. Status F is standby; status P has an explicit null
    state on urgent and high orders and no state otherwise."""
    c = F.col
    state = (
        F.when(c("o_orderstatus") == "O", '"active"')
        .when(c("o_orderstatus") == "F", '"standby"')
        .when(c("o_orderpriority") < "3", "null")
    )
    value = _beans(
        _bean(rl.THREADING, {"ThreadCount": c("o_custkey")}),
        _bean(rl.NAMESYSTEM, {
            "MissingBlocks": F.lit(0), "CapacityTotal": c("cents"), "CapacityUsed": c("cents") / 4,
            "BlocksTotal": c("o_orderkey"), "Snapshots": F.lit(1),
        }),
        _bean(rl.NAMENODE_ACTIVITY, {
            "tag.HAState": state, "SyncsAvgTime": c("o_custkey") / 4, "SyncsNumOps": c("o_orderkey"),
        }),
        _bean(rl.NAMESYSTEM_STATE, {"NumLiveDataNodes": c("o_custkey"), "NumDeadDataNodes": F.lit(0)}),
        _object({"modelerType": F.lit('"x"')}),
    )
    return _order_scrapes(spark, sf).select(
        "cluster", F.lit("namenode").alias("job"), _text("nn", c("o_custkey")).alias("host"),
        F.lit(50070).alias("port"), "ts", value.alias("value"),
    )


def jmx_datanode(spark: SparkSession, sf: str) -> DataFrame:
    """Data-node payloads, one per order; bean names carry an instance suffix."""
    c = F.col
    value = _beans(
        _bean(rl.THREADING, {"ThreadCount": c("o_orderkey")}),
        _bean(_text(rl.DATASET_STATE, "-ds", c("o_custkey")), {
            "Capacity": c("cents"), "DfsUsed": c("cents") / 4, "Remaining": c("cents") - 1,
            "NumFailedVolumes": F.lit(0),
        }),
        _bean(_text(rl.DATANODE_ACTIVITY, "-dn", c("o_custkey"), "-50010"), {
            "BytesWritten": c("cents"), "BlocksRead": c("o_orderkey"), "FlushNanosNumOps": c("o_custkey"),
            "FsyncNanosAvgTime": c("cents"), "FlushNanosAvgTime": c("o_orderkey"), "VolumeFailures": F.lit(0),
        }),
    )
    return _order_scrapes(spark, sf).select(
        "cluster", F.lit("datanode").alias("job"), _text("dn", c("o_custkey")).alias("host"),
        F.lit(50075).alias("port"), "ts", value.alias("value"),
    )


def node_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Host snapshots: (host, ts, value). One of the two task labels does not parse; hosts
    without returned lines report no JavaMetrics."""
    c = F.col
    interfaces = [
        _object({
            "name": F.lit(f'"eth{f}"'), "bytesRecv": c(f"p_{f.lower()}"), "bytesSent": c(f"q_{f.lower()}"),
            "packetsRecv": c(f"n_{f.lower()}"), "packetsSent": c(f"n_{f.lower()}") * 2,
            "dropin": F.lit(0), "dropout": F.lit(1), "errin": F.lit(2), "errout": F.lit(3),
        })
        for f in FLAGS
    ]
    disks = {}
    for s in ("so", "sf"):
        disks[f"/dev/{s}"] = F.lit(f'{{"device":"/dev/{s}"}}')
        disks[f"usage:/dev/{s}"] = _object({
            "path": F.lit('"/"'), "free": c("n"), "total": c(f"q_{s}") + c("n"), "used": c(f"q_{s}"),
            "usedPercent": c(f"n_{s}") / 4,
        })
    gc = _object({"young.gc.count": c("n_so"), "young.gc.time": c("n_sf") / 4})
    good = _text('"cluster=', c("cluster"), "/job=", c("nation"), "/task_id=", c("sk"), '":', gc)
    broken = _text('"cluster=', c("cluster"), "/", c("nation"), "/task_id=", c("sk"), '":', gc)
    value = _object({
        "CpuPercents": c("n"),
        "CpuTimeStat": F.lit('{"user":1}'),
        "Load": _object({"load1": c("n_a") / 4, "load5": c("n_n") / 4, "load15": c("n_r") / 4}),
        "memory": _object({
            "free": c("q_a"), "available": c("q_n"), "total": c("q_a") + c("q_n") + c("q_r"),
            "used": c("q_r"), "usedPercent": c("max_q"),
        }),
        "Network": _text("[", F.concat_ws(",", *interfaces), "]"),
        "DiskIO": F.lit("{}"),
        "DiskUsage": _object(disks),
        "JavaMetrics": F.when(c("n_r") > 0, _text("{", good, ",", broken, "}")),
    })
    return scrapes(spark, sf).select(_text("node", c("sk")).alias("host"), "ts", value.alias("value"))


def kv_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Key/value replies, one per part, with every kind of line that must be skipped."""
    c = F.col
    value = F.concat_ws(
        "\n",
        _text("zk_size\t", c("p_size")), _text("zk_brand\t", c("p_brand")),
        _text("zk_price\t", c("p_retailprice")), _text("zk_lead\t ", c("p_size")),
        _text("zk_plus\t+", c("p_partkey")), _text("zk_neg\t-", c("p_size")),
        _text("zk_big\t99999999999999", F.lpad(c("p_partkey").cast("string"), 10, "0")),
        _text("zk_three\t", c("p_size"), "\t1"), F.lit("no tab here"), F.lit(""),
    )
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice").repartition("p_partkey").select(
        c("p_type").alias("cluster"), _text("zk", c("p_partkey")).alias("host"), F.lit(2181).alias("port"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"), value.alias("value"),
    )


def jstat_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Collector texts, one per order: status P has 16 columns, low priority has no final
    newline, a total below 2000 has a word among the numbers."""
    c = F.col
    price = c("o_totalprice").cast("decimal(18,2)")
    numbers = [(price * i).cast("string") for i in range(1, 17)]
    tail = F.when(c("o_orderstatus") == "P", "").when(c("o_totalprice") < 2000, "  n/a").otherwise(
        _text("  ", (price * 17).cast("string"))
    )
    value = _text(
        "S0C  S1C  S0U  GCT\n   ", F.concat_ws("  ", *numbers), tail,
        F.when(c("o_orderpriority") == "5-LOW", "").otherwise("\n   "),
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").repartition("o_orderkey")
    return orders.select(c("o_orderkey").alias("payload_id"), value.alias("value"))


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    """Events as points: tags user and k, ``seq`` is the arrival order."""
    events = table(spark, sf, "events")
    return with_series_key(events.select(
        _text("events.", F.col("event_type")).alias("metric"), "ts", "value",
        F.create_map(
            F.lit("user"), F.col("user_id").cast("string"),
            F.lit("k"), F.get_json_object("props", "$.k"),
        ).alias("tags"),
        F.col("event_id").alias("seq"),
    ))


def user_points(spark: SparkSession, sf: str) -> DataFrame:
    """Events as one series per user."""
    events = table(spark, sf, "events")
    return events.select(
        _text("user", F.col("user_id")).alias("series_key"), "ts", "value", F.col("event_id").alias("seq")
    )


# -- fleet ----------------------------------------------------------------------------

def declared_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tasks: cluster = nation, job = market segment, task id = customer key."""
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("cluster"), F.col("c_mktsegment").alias("job"),
        F.col("c_custkey").alias("task_id"), _text("host", F.col("c_custkey")).alias("host"),
        F.lit(9001).cast("bigint").alias("agent_port"),
        (F.col("c_custkey") + 10000).cast("bigint").alias("base_port"),
        F.col("c_acctbal").alias("balance"), F.col("n_regionkey").cast("string").alias("project"),
    )


def latest_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The last order of each customer (by date, then key)."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("o")
    ).select(F.col("o_custkey").alias("task_id"), "o.*")


def programs(spark: SparkSession, sf: str) -> DataFrame:
    """Programs the agents report: the last order of a customer, O running, else stopped."""
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")).alias("o")
    ).select(F.col("o_custkey").alias("task_id"), "o.*")
    tasks = declared_tasks(spark, sf).select("cluster", "job", "task_id")
    return last.join(tasks, "task_id").select(
        "cluster", "job", "task_id",
        F.when(F.col("o_orderstatus") == "O", "Running").otherwise("Stopped").alias("status"),
        F.col("o_orderkey").cast("bigint").alias("pid"),
        F.when(F.col("o_totalprice") > 200000, "/opt/java/bin/java").otherwise("/bin/sh").alias("bin"),
    )


def line_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as tasks: cluster = order, job = return flag, task id = line number."""
    lines = table(spark, sf, "lineitem")
    once = lines.groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.min("l_suppkey").alias("sk"))
    host, base = _text("supp", F.col("sk")), F.col("l_linenumber") + 10000
    return once.select(
        _text("o", F.col("l_orderkey")).alias("cluster"), F.col("l_returnflag").alias("job"),
        F.col("l_linenumber").cast("bigint").alias("task_id"), host.alias("host"),
        base.cast("bigint").alias("base_port"),
        F.create_map(
            F.lit("host"), host, F.lit("port"), F.lit("9001"), F.lit("base_port"), base.cast("string"),
        ).alias("attributes"),
    )


def order_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Each order depends on the order whose key is its customer key."""
    return table(spark, sf, "orders").select(
        _text("o", F.col("o_orderkey")).alias("cluster"), F.lit(0).cast("bigint").alias("ordinal"),
        _text("o", F.col("o_custkey")).alias("dep_cluster"),
    )


def order_templates(spark: SparkSession, sf: str) -> DataFrame:
    """One text per order; the priority picks the placeholders."""
    c = F.col("o_orderpriority")
    text = (
        F.when(c == "1-URGENT", "n=%{cluster.name};a=%{A.1.host}:%{A.1.base_port+10};a=%{A.1.host}")
        .when(c == "2-HIGH", "l=%{A.server_list}|%{dependencies.0.cluster_name}")
        .when(
            c == "3-MEDIUM",
            F.when(F.col("o_orderstatus") == "P", "d=%{dependencies.1.cluster_name}").otherwise(
                "d=%{dependencies.0.N.server_list}"
            ),
        )
        .when(c == "4-NOT SPECIFIED", "%{dependencies.0.R.2.base_port+1}/%{dependencies.0.R.2.host}%{dependencies.1.cluster-name}")
        .otherwise("x=%{N.x.host}:%{N.x.base_port+3}${keep}")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").repartition("o_orderkey")
    return orders.select(
        F.col("o_orderkey").alias("doc"), _text("o", F.col("o_orderkey")).alias("cluster"),
        (F.col("o_custkey") % 7 + 1).cast("bigint").alias("task_id"), text.alias("text"),
    )


def config_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as config lines: one file per order, its format picked by the priority.
    Layer 0 holds open lines, layer 1 finished ones; quantity 50 gives a line without ``=``."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", "l_quantity"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    p = F.substring("o_orderpriority", 1, 1)
    file = (
        F.when(p == "1", "site.xml").when(p == "2", "zoo.cfg").when(p == "3", "a.properties")
        .when(p == "4", "myid").otherwise("app.conf")
    )
    key = _text("k", F.col("l_linenumber"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("doc"), file.alias("file"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).cast("bigint").alias("layer"),
        (F.col("l_linenumber") * F.lit(10**10) + F.col("l_partkey")).cast("bigint").alias("pos"),
        F.when(F.col("l_quantity") == 50, key).otherwise(_text(key, "=", F.col("l_partkey"), "=x")).alias("line"),
    )


def file_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A cluster document per customer with a file list, an idle job and a deep tree, and the files
    (one per nation but the seventh). A balance above 9000 breaks the host, one above 8000 adds a
    file of an unknown format."""
    customer, nation = table(spark, sf, "customer").repartition("c_custkey"), table(spark, sf, "nation")
    b = F.col("c_acctbal")
    deep = "".join(f'{{"l{i}":' for i in range(9)) + '["end"]' + "}" * 9
    value = _text(
        '{"cluster":{"cluster_name":"', F.col("c_name"), '"},"notes":', deep, ',"jobs":{"idle":{"config":{}},"web":{"hosts":["',
        F.when(b > 9000, "nohost").otherwise(_text("h", F.col("c_custkey"), ":9001")), '"],"config":{"app.cfg":["peers=[%{idle.server_list}]"],',
        F.when(b > 8000, '"app.yaml":["x"],').otherwise(""), '"log.properties":{"file":"/etc/log-', F.col("c_nationkey"), '"}}}}}',
    )
    docs = customer.select(F.col("c_custkey").alias("doc"), F.lit(0).alias("layer"), value.alias("value"))
    texts = nation.filter("n_nationkey != 7").select(
        _text("/etc/log-", F.col("n_nationkey")).alias("path"), _text("# log\n level=", F.col("n_name"), " \n\nsize=1").alias("value"))
    return docs, texts


def layer_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A three-layer cluster document per customer: customer over nation over region."""
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    customer = customer.repartition("c_custkey")
    c = F.col
    quote = lambda col: _text('"', col, '"')
    # A negative balance makes the hosts a string, which conflicts with the list below it.
    hosts = F.when(c("c_acctbal") < 0, '"none"').otherwise(
        _text('["h', c("c_custkey"), ':9001/id=1/base_port=9101","h', c("c_custkey"), ':9001/id=0"]')
    )
    near = customer.select(
        c("c_custkey").alias("doc"), F.lit(0).alias("layer"),
        _object({
            "cluster": _object({
                "cluster_name": quote(c("c_name")), "project": F.lit("null"),
                "package_name": quote(c("c_mktsegment")),
            }),
            "jobs": _object({
                "web": _object({
                    "super_job": F.lit('"job_common"'), "hosts": hosts,
                    "jvm_opts": _text('["-Xmx', c("c_custkey"), 'm","-server"]'),
                    "config": F.lit(
                        '{"web.cfg":["name=%{cluster.name}","id=$TaskId","port=%{web.x.base_port+1}"],'
                        '"site.xml":["a=near","b=%{web.server_list}"]}'
                    ),
                }),
            }),
        }).alias("value"),
    )
    of_nation = customer.join(nation, c("c_nationkey") == c("n_nationkey")).select(
        c("c_custkey").alias("doc"), F.lit(1).alias("layer"),
        _object({
            "cluster": _object({
                "cluster_name": quote(c("n_name")), "project": quote(_text("p", c("n_regionkey"))),
                "main_process": F.lit('"/usr/bin/java"'),
            }),
            "jobs": F.lit(
                '{"web":{"hosts":["far:9001/id=2"],"jvm_opts":["-server","-verbose"],'
                '"config":{"site.xml":["a=far","c=1"]}}}'
            ),
        }).alias("value"),
    )
    of_region = (
        customer.join(nation, c("c_nationkey") == c("n_nationkey"))
        .join(region, c("n_regionkey") == c("r_regionkey"))
        .select(
            c("c_custkey").alias("doc"), F.lit(2).alias("layer"),
            _object({
                "cluster": _object({"project": F.lit('"base"'), "package_md5sum": quote(F.md5(c("r_name")))}),
                "jobs": F.lit(
                    '{"job_common":{"jvm_opts":["-verbose","-ea","-ea"],'
                    '"config":{"web.cfg":["name=common","log=$AgentRootDir/log"],"myid":["$TaskId"]}}}'
                ),
            }).alias("value"),
        )
    )
    return near.unionByName(of_nation).unionByName(of_region)


def program_documents(spark: SparkSession, sf: str) -> DataFrame:
    """``layer_documents`` with what a command line takes: properties, class paths, and for four customers in five an entry."""
    k = F.col("doc")
    entry = F.when(k % 5 == 0, "").otherwise('"main_entry":{"java_class":" org.x.Main ","extra_args":"start  now "},')
    more = _text('"super_job":"job_common",', entry, '"classpath":[" lib/* ","","conf"],"jvm_properties":["a=1"," ","k=', k, '"]')
    return layer_documents(spark, sf).withColumn("value", F.when(
        F.col("layer") == 0, F.replace("value", F.lit('"super_job":"job_common"'), more)).otherwise(F.col("value")))


def chained_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(path, value): a document per customer on chains of 50. The base, named through a variable, is the
    customer before; of the first of 50 it is nothing, the last of the 50 (every seventh chain, a circle),
    or a document that isn't there (every eleventh). A few documents use an unknown variable, are no
    JSON, or have a list for a base."""
    c, block = F.col("c_custkey"), F.floor(F.col("c_custkey") / 50)
    first = c % 50 == 0
    base = F.when(~first, _text("/", c - 1)).when(block % 7 == 3, _text("/", c + 49)).when(block % 11 == 5, "/gone")
    value = F.when(c % 331 == 7, '{"base":"{{.Home}}/x"}').when(c % 331 == 20, "{").when(c % 331 == 40, '{"base":["x"]}').otherwise(
        _text('{"base":', F.coalesce(_text('"{{.ConfRootDir}}', base, '"'), F.lit("null")), ',"cluster":{"n":', c, "}}"))
    return table(spark, sf, "customer").select(_text("/conf/", c).alias("path"), value.alias("value"))


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(path, value): the documents of ``layer_documents`` as files. A customer's base is its nation's, that
    one's its region's. Customers depend on the one of the next lower full ten, and name it in a file."""
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey")
    hub = k - k % 10
    near = layer_documents(spark, sf).filter("layer = 0").join(customer, F.col("doc") == k)
    linked = F.replace(
        F.replace("value", F.lit('"cluster":{'), _text('"cluster":{"dependencies":["/conf/c/', hub, '"],')),
        F.lit('"config":{'), F.lit('"config":{"peer.txt":["%{dependencies.0.cluster_name}=%{dependencies.0.web.server_list}"],'))
    based = lambda value, base: F.concat(F.lit('{"base":"'), base, F.lit('",'), F.substring(value, 2, 1 << 30))
    mine = near.select(
        _text("/conf/c/", k).alias("path"),
        based(F.when(k % 10 == 0, F.col("value")).otherwise(linked), _text("{{.ConfRootDir}}/n/", F.col("c_nationkey"))).alias("value"))
    of_nation = nation.select(
        _text("/conf/n/", F.col("n_nationkey")).alias("path"), _object({
            "base": _text('"{{.ConfRootDir}}/r/', F.col("n_regionkey"), '"'),
            "cluster": _object({
                "cluster_name": _text('"', F.col("n_name"), '"'), "project": _text('"p', F.col("n_regionkey"), '"'), "main_process": F.lit('"/usr/bin/java"')}),
            "jobs": F.lit('{"web":{"hosts":["far:9001/id=2"],"jvm_opts":["-server","-verbose"],"config":{"site.xml":["a=far","c=1"]}}}'),
        }).alias("value"))
    of_region = region.select(
        _text("/conf/r/", F.col("r_regionkey")).alias("path"), _object({
            "cluster": _object({"project": F.lit('"base"'), "package_md5sum": _text('"', F.md5(F.col("r_name")), '"')}),
            "jobs": F.lit(
                '{"job_common":{"jvm_opts":["-verbose","-ea","-ea"],'
                '"config":{"web.cfg":["name=common","log=$AgentRootDir/log"],"myid":["$TaskId"]}}}'),
        }).alias("value"))
    return mine.unionByName(of_nation).unionByName(of_region)


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as packages; a label of low quality states a wrong size, or a wrong checksum
    when the text is also toxic."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf, "labels")
    low = F.coalesce(F.col("quality") == 0, F.lit(False))
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    size = F.octet_length("text").cast("bigint")
    return docs.join(labels, "doc_id", "left").select(
        _text("doc-", F.col("doc_id")).alias("package_name"), F.col("lang").alias("version"),
        F.lit("2024-01-01").alias("date"),
        F.when(low & toxic, F.md5(F.upper("lang"))).otherwise(F.md5("text")).alias("md5sum"),
        F.when(low & ~toxic, size + 1).otherwise(size).alias("size"),
        _text("http://pkg/", F.col("source")).alias("link"),
    )


def landed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The package files that arrived: toxic texts of good quality did not."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lost = table(spark, sf, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 1))
    return docs.join(lost, "doc_id", "left_anti").select(
        _text("doc-", F.col("doc_id")).alias("name"), F.col("text").alias("content")
    )


def endpoint_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Task labels of customers; the balance picks which part is broken."""
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    seg, name, key, b = F.col("c_mktsegment"), F.col("n_name"), F.col("c_custkey"), F.col("c_acctbal")
    label = (
        F.when(b < 0, _text("c=", seg, "/job=", name, "/task_id=", key))
        .when(b > 9000, _text("job=", name, "/task_id=", key))
        .when(b > 8000, _text("cluster=", seg, "/", name, "/task_id=", key))
        .when(b > 7000, _text("cluster=", seg, "/job=", name, "/task=", key))
        .when(b > 6000, _text("cluster=", seg, "/job=", name, "/task_id=t", key))
        .otherwise(tf.task_label(seg, name, key))
    )
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("custkey"), label.alias("label")
    )
