"""Payload scans and normalisers on hand-made payloads."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fleetlens.functions import points as pf
from fleetlens.operators import points as op, rollup, rules as rl
from fleetlens.plans import metrics as plans
from fleetlens.sources import payloads as src
from fleetlens.workload import adapters as ad

SCHEMA = "cluster string, job string, host string, port int, ts timestamp, value string"


def landed(spark, *beans_per_payload, job="regionserver"):
    rows = [
        ("c1", job, f"h{i}", 16031, None, json.dumps({"beans": beans})) for i, beans in enumerate(beans_per_payload)
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))


def report(points):
    return sorted(
        tuple(r) for r in points.select(pf.series_key(F.col("metric"), F.col("tags")), "value").collect()
    )


def region_bean(**values):
    return {"name": rl.REGIONS, **values}


def key(ns, table, region, metric):
    return f"Namespace_{ns}_table_{table}_region_{region}_metric_{metric}"


def test_nested_values_stay_text_and_null_is_kept(spark):
    beans = src.explode_beans(src.parse_jmx(landed(spark, [{"name": "n", "a": {"b": [1, 2]}, "c": None}])))
    props = beans.head()["props"]
    assert props == {"name": "n", "a": '{"b":[1,2]}', "c": None}


def test_payload_that_is_not_json_becomes_a_reject(spark):
    df = spark.createDataFrame([("p1", "nope"), ("p2", '{"beans":[]}')], "id string, value string")
    parsed = df.withColumn("raw", F.col("value")).transform(src.parse_jmx)
    good, rejects = src.split_rejects(parsed, F.col("beans").isNull(), F.col("id"), "beans", F.col("raw"), "not a payload")
    assert [r["id"] for r in good.collect()] == ["p2"]
    assert [tuple(r) for r in rejects.collect()] == [("p1", "beans", "nope", "not a payload")]


def test_threads_skip_null_and_absent_and_ipc_is_silent(spark):
    payloads = landed(
        spark,
        [{"name": rl.THREADING, "ThreadCount": 7}, {"name": rl.IPC, "queueSize": 3}],
        [{"name": rl.THREADING, "ThreadCount": None}],
        [{"name": rl.THREADING}, {"ThreadCount": 4}],
    )
    beans = src.explode_beans(src.parse_jmx(payloads))
    assert report(op.rule_points(beans, rl.HBASE)) == [
        ("hbase.jvm.ThreadCount{cluster=c1,hostAndPort=h0-16031,job=regionserver}", 7.0)
    ]
    assert op.rule_points(beans, rl.HBASE, [rl.IPC]).count() == 0


def test_region_names(spark):
    payloads = landed(spark, [region_bean(**{
        key("n.s-1", "t_a.b-c", "0af", "storeCount"): 2,
        key("n", "t", "1", "notListed"): 5,
        key("n", "t", "1", "storeCount") + "|" + key("n", "u", "2", "storeCount"): 9,
        "prefix_" + key("n", "t", "2", "get_num_ops") + "-suffix": 4,
        key("n", "t", "3", "storeCount"): "broken",
        "numRegions": 4,
    })])
    regions = op.region_values(src.explode_beans(src.parse_jmx(payloads)))
    got = sorted(tuple(r) for r in regions.select("namespace", "table", "region", "region_metric", "value").collect())
    assert got == [("n", "t", "2", "get_num_ops", 4.0), ("n.s-1", "t_a.b-c", "0af", "storeCount", 2.0)]


def test_rollup_sums_all_regions_and_ignores_row_order(spark):
    beans = [region_bean(**{
        key("n1", "t1", "a", "storeCount"): 1, key("n1", "t1", "b", "storeCount"): 2,
        key("n1", "t2", "c", "storeCount"): 4, key("n2", "t1", "d", "storeCount"): 8,
    })]
    regions = op.region_values(src.explode_beans(src.parse_jmx(landed(spark, beans, beans))))
    expected = {
        ("server", None, None): 15.0, ("namespace", "n1", None): 7.0, ("namespace", "n2", None): 8.0,
        ("table", "n1", "t1"): 3.0, ("table", "n1", "t2"): 4.0, ("table", "n2", "t1"): 8.0,
    }
    for df in (regions, regions.orderBy(F.rand(3)).repartition(3)):
        rolled = rollup.region_rollup(df).filter("host = 'h1'").collect()
        assert {(r["level"], r["namespace"], r["table"]): r["value"] for r in rolled} == expected
    names = {r[0] for r in report(rollup.rollup_points(rollup.region_rollup(regions))) if "h0" in r[0]}
    assert "hbase.regionserver.storeCount{cluster=c1,hostAndPort=h0-16031,job=regionserver}" in names
    assert (
        "hbase.regionserver.table.storeCount{cluster=c1,hostAndPort=h0-16031,job=regionserver,namespace=n2,table=t1}"
        in names
    )


def test_one_pass_service_points_equal_the_separate_ones(spark):
    payloads = landed(spark, [
        {"name": rl.SERVER, "regionCount": 3, "storeCount": "x", "other": 1},
        {"name": rl.WAL, "SyncTime_num_ops": 2.5},
        region_bean(**{key("n", "t", "1", "storeCount"): 2, key("n", "t", "1", "zzz"): 2}),
    ])
    beans = src.explode_beans(src.parse_jmx(payloads))
    both = op.union_points([op.rule_points(beans, rl.HBASE), op.region_points(op.region_values(beans))])
    assert report(op.service_points(beans, rl.HBASE)) == report(both)
    assert len(report(both)) == 3
    rejects = op.rule_rejects(beans, rl.HBASE, F.col("host")).collect()
    assert [tuple(r) for r in rejects] == [("h0", f"{rl.SERVER}/storeCount", "x", "not a number")]


def namenode(state):
    activity = {"name": rl.NAMENODE_ACTIVITY, "SyncsNumOps": 1, **state}
    return [{"name": rl.NAMESYSTEM, "FilesTotal": 5}, activity]


def test_standby_drops_the_whole_payload(spark):
    payloads = landed(
        spark, namenode({"tag.HAState": "active"}), namenode({"tag.HAState": "standby"}),
        namenode({"tag.HAState": None}), namenode({}),
        [{"name": rl.NAMESYSTEM, "FilesTotal": 5, "tag.HAState": "standby"}], job="namenode",
    )
    hosts = {r["host"] for r in rl.drop_standby(src.parse_jmx(payloads)).collect()}
    assert hosts == {"h0", "h3", "h4"}
    assert len(report(plans.hdfs_points(payloads))) == 5


def test_datanode_prefix_and_unit(spark):
    payloads = landed(spark, [
        {"name": rl.DATASET_STATE + "-ds1", "Capacity": 10},
        {"name": rl.DATANODE_ACTIVITY + "-h-1", "FsyncNanosAvgTime": 2500000, "FlushNanosNumOps": 3},
        {"name": rl.NAMESYSTEM + "X", "FilesTotal": 1},
    ], job="datanode")
    tags = "{cluster=c1,hostAndPort=h0-16031,job=datanode}"
    assert report(plans.hdfs_points(payloads)) == [
        (f"hdfs.datanode.activity.FlushNanosNumOps{tags}", 3.0),
        (f"hdfs.datanode.activity.FsyncAvgTime{tags}", 2.5),
        (f"hdfs.datanode.fs.state.Capacity{tags}", 10.0),
    ]


def test_rule_table_sizes():
    per_bean = {}
    for rule in rl.RULES:
        per_bean.setdefault((rule.service, rule.bean), []).append(rule.metric)
    assert len(per_bean[rl.HBASE, rl.WAL]) == 10
    assert len(per_bean[rl.HBASE, rl.SERVER]) == 34
    assert len(per_bean[rl.HDFS, rl.DATANODE_ACTIVITY]) == 13
    assert len({(r.service, r.bean, r.key) for r in rl.RULES}) == len(rl.RULES)


def test_kv_lines(spark):
    text = "a\t1\nb\tx\nc\t 5\nd\t+5\ne\t1.5\nf\t99999999999999999999\ng\t1\t2\nplain\n\nh\t-2"
    rows = [("c", "h", 2181, text)]
    df = spark.createDataFrame(rows, "cluster string, host string, port int, value string").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp")
    )
    assert src.kv_lines(df).count() == 7
    tags = "{cluster=c,hostAndPort=h-2181,job=zkServer}"
    assert report(plans.kv_points(df)) == [
        (f"zookeeper.zkServer.{k}{tags}", v) for k, v in [("a", 1.0), ("d", 5.0), ("h", -2.0)]
    ]


def test_long_kv_reply_is_read_whole(spark):
    text = "\n".join(f"key{i}\t{i}" for i in range(2000))
    df = spark.createDataFrame([(text,)], "value string")
    assert src.kv_lines(df).count() == 2000


def test_jstat(spark):
    header = "S0C S1C"
    numbers = " ".join(str(i + 0.1) for i in range(17))
    texts = [
        f"{header}\n   {numbers}  \n ", f"{header}\n{numbers}", f"{header}\n{numbers} 5\n",
        f"{header}\n{numbers.replace('3.1', 'x')}\n", f"{header}\n\n",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, value string")
    parsed = src.parse_jstat(df)
    assert [r["id"] for r in parsed.filter("gc is not null").collect()] == [0]
    members = {r["name"]: r["value"] for r in op.gc_members(parsed).collect()}
    assert len(members) == 17 and members["survivor0.capacity"] == 0.10000000149011612
    assert members["total.gc.time"] == 16.100000381469727


def test_node_snapshot(spark):
    gauge = {"free": 1, "available": 2, "total": 3, "used": 4, "usedPercent": 5.5}
    net = {k: i for i, k in enumerate(op.NETWORK_KEYS)}
    node = {
        "CpuPercents": 9.5, "Load": {"load1": 1, "load5": 2, "load15": 3}, "memory": gauge,
        "Network": [{"name": "lo", **net}, {"name": "en0", **net}],
        "DiskUsage": {"/dev/a": {"device": "/dev/a"}, "usage:/dev/a": gauge},
        "JavaMetrics": {"cluster=c/job=j/task_id=1": {"eden.usage": 2.5}, "bad": {"eden.usage": 1}},
    }
    bare = {k: node[k] for k in ("CpuPercents", "Load", "memory")}
    df = spark.createDataFrame([("h1", json.dumps(node)), ("h2", json.dumps(bare))], "host string, value string").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp")
    )
    got = report(plans.node_points(df))
    assert len([r for r in got if "host=h1" in r[0]]) == 9 + 8 * 2 + 4 + 1
    assert len([r for r in got if "host=h2" in r[0]]) == 9
    assert ("node.jvm.gc.eden.usage{cluster=c,host=h1,job=j,task=1}", 2.5) in got
    assert ("sys.disk.usedPercent{disk=/dev/a,host=h1}", 5.5) in got


def test_line_files(spark):
    df = spark.createDataFrame([("# top\n a \n\n  # in\nb # not a comment\nlast",)], "value string")
    assert [(r["pos"], r["line"]) for r in src.clean_lines(df).orderBy("pos").collect()] == [
        (1, "a"), (4, "b # not a comment"), (5, "last"),
    ]


def test_tags_override_and_dedupe(spark):
    row = spark.range(1).select(pf.series_key(F.lit("m"), pf.merge_tags(
        F.create_map(F.lit("job"), F.lit("x")), F.create_map(F.lit("job"), F.lit("y"), F.lit("a"), F.lit("1"))
    )).alias("k")).head()
    assert row["k"] == "m{a=1,job=x}"
    points = spark.createDataFrame(
        [("s", 1, 5.0, 0), ("s", 1, 6.0, 1), ("s", 2, 7.0, 0)], "series_key string, ts int, value double, priority int"
    )
    got = sorted((r["ts"], r["value"]) for r in op.dedupe_points(points, "priority").collect())
    assert got == [(1, 6.0), (2, 7.0)]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_parsed_and_region_names_looked_for_once(spark):
    payloads = landed(spark, namenode({})).repartition("host")
    assert optimized(plans.hdfs_points(payloads)).count("from_json") == 1
    entries = op.service_entries(src.explode_beans(src.parse_jmx(payloads)), rl.HBASE)
    assert optimized(entries).count("regexp_") == 1


def test_region_entries_of_odd_names(spark):
    one, odd = key("n", "t_table_u", "1", "storeCount"), key("n", "t", "2", "memStoreSize")
    names = {
        one: 1, f"x-{odd}": 2, f"{odd}-y.z": 3, f"{odd} {odd}": 4, f"\x01{odd}\x01": 5, f"{odd}\x01{odd}": 6, "Namespace_n_table_t_region_R": 7,
        key("n", "t", "3", "storeCount") + "\n": "no number", "Namespace__table_t_region_1_metric_storeCount": 8,
    }
    beans = src.explode_beans(src.parse_jmx(landed(spark, [region_bean(**names), {"name": rl.WAL, **names}])))
    columns = ["namespace", "table", "region", "region_metric", "value"]
    got = [tuple(r) for r in op.service_entries(beans, rl.HBASE).select(*columns).collect()]
    assert sorted(got) == sorted(tuple(r) for r in op.region_values(beans).select(*columns).collect())
    assert ("n_table_t", "u", "1", "storeCount", 1.0) in got and sorted(r[-1] for r in got) == [1.0, 2.0, 3.0, 5.0]


def test_tag_texts_are_those_of_the_tags(spark):
    beans = [
        {"name": rl.SERVER, "regionCount": 3, "storeCount": 4}, region_bean(**{key("n", "t", r, "storeCount"): 2 for r in "12"}),
        {"name": rl.NAMESYSTEM, "FilesTotal": 5}, {"name": rl.THREADING, "ThreadCount": 1}]
    jmx = landed(spark, beans, beans)
    jmx = jmx.unionByName(jmx.withColumn("cluster", F.lit(None).cast("string")))
    net = {k: i for i, k in enumerate(op.NETWORK_KEYS)}
    node = {
        "CpuPercents": 9.5, "Network": [{"name": "lo", **net}, net], "DiskUsage": {"usage:/dev/a": {"free": 1}},
        "JavaMetrics": {"cluster=c/job=j/task_id=1": {"eden.usage": 2.5}, "cluster=c/job=j/task_id=2": {}}}
    nodes = spark.createDataFrame([("h1", json.dumps(node)), (None, json.dumps(node)), ("h2", "{}"), ("h3", None)], "host string, value string").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp"))
    lines = jmx.withColumn("value", F.lit("zk_a\t5\nzk_b\tx"))
    points = plans.all_points({"hbase": jmx, "hdfs": jmx, "node": nodes, "mntr": lines})
    assert points.columns == ["metric", "ts", "value", "tags", "priority", "series_key"]
    rows = points.select("series_key", pf.series_key(F.col("metric"), F.col("tags")).alias("plain"), "tags").collect()
    assert len(rows) > 60 and all(r.series_key == r.plain for r in rows)
    assert {r.tags.get("job") for r in rows} == {"regionserver", "zkServer", "j", None} and {len(r.tags) for r in rows} == {1, 2, 3, 4, 5, 6}
    assert any("if" in r.tags and r.tags["if"] is None for r in rows) and any(r.tags.get("cluster", "") is None for r in rows)
    assert "map_entries(tags" not in optimized(points.select("series_key", "value"))


def test_orders_stay_dealt_over_all_partitions(spark, tmp_path):
    spark.range(400).select(
        F.col("id").alias("o_custkey"), F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"),
        F.lit("2024-01-01").cast("timestamp").alias("o_orderdate"), F.lit(1.5).alias("o_totalprice"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    for payloads in (ad.jmx_namenode(spark, str(tmp_path)), ad.jmx_datanode(spark, str(tmp_path))):
        dealt = payloads.groupBy(F.spark_partition_id().alias("part")).count().collect()
        assert len(dealt) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in dealt) == 400
