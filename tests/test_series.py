"""Time-series operators against brute force."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import points as pf
from fleetlens.operators import panels as pn, points as op, series as sr
from fleetlens.plans import metrics as plans

START = datetime(2024, 1, 1)


def sample(seed, n=400, span=20000):
    rng = random.Random(seed)
    # One series holds a third of the points; some neighbours are far apart.
    out = []
    for seq in range(n):
        name = "hot" if rng.random() < 0.34 else f"s{rng.randrange(6)}"
        out.append((name, START + timedelta(seconds=rng.randrange(span)), round(rng.uniform(0, 50), 2), seq))
    return out


def frame(spark, data):
    df = spark.createDataFrame([(s, int((t - datetime(1970, 1, 1)).total_seconds()), v, q) for s, t, v, q in data],
                               "series_key string, sec bigint, value double, seq bigint")
    return df.select("series_key", F.timestamp_seconds("sec").alias("ts"), "value", "seq")


def brute_rate(data, counter=False, counter_max=None):
    latest = {}
    for s, t, v, q in sorted(data, key=lambda r: r[3]):
        latest[s, t] = v
    per_series = defaultdict(list)
    for (s, t), v in sorted(latest.items()):
        per_series[s].append((t, v))
    out = []
    for s, points in per_series.items():
        for (t0, v0), (t1, v1) in zip(points, points[1:]):
            delta = v1 - v0
            if counter and delta < 0:
                if counter_max is None:
                    continue
                delta += counter_max
            out.append((s, t1, round(delta / (t1 - t0).total_seconds(), 6) + 0.0))
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, 60, 3600, 10**7])
@pytest.mark.parametrize("counter, top", [(False, None), (True, None), (True, 100.0)])
def test_rate_in_chunks_equals_plain_rate(spark, chunk, counter, top):
    data = sample(chunk)
    points = sr.latest_per_second(frame(spark, data), "seq")
    got = sr.rate(points, counter=counter, counter_max=top, chunk_seconds=chunk)
    rows = sorted(
        (r["series_key"], START + timedelta(seconds=r["s"]), round(r["rate"], 6) + 0.0)
        for r in got.select(
            "series_key", (F.unix_seconds("ts") - int(START.replace(tzinfo=timezone.utc).timestamp())).alias("s"), "rate"
        ).collect()
    )
    assert rows == brute_rate(data, counter, top)


def test_rate_drops_first_point_and_zero_steps(spark):
    points = frame(spark, [("a", START, 1.0, 0), ("a", START, 5.0, 1), ("b", START, 1.0, 2)])
    assert sr.rate(points).count() == 0


def test_downsample_has_no_empty_buckets_and_any_row_order(spark):
    data = [("a", START, 1.0, 0), ("a", START + timedelta(minutes=59), 3.0, 1), ("a", START + timedelta(hours=5), 7.0, 2)]
    for df in (frame(spark, data), frame(spark, data[::-1])):
        got = sorted(r["value"] for r in sr.downsample(df, "1 hour").collect())
        assert got == [2.0, 7.0]


def test_series_first_takes_the_least_key(spark):
    df = frame(spark, [("b", START, 1.0, 0), ("a", START, 2.0, 1)]).withColumn("metric", F.lit("m"))
    assert [r["value"] for r in sr.series_first(df, ["metric"]).collect()] == [2.0]


def test_span_seconds(spark):
    spans = {"now-5m": 300, "now-3h": 10800, **dict(zip(sr.TIME_OPTIONS, [300, 900, 3600, 21600, 43200, 86400, 172800, 604800, 2592000]))}
    df = spark.createDataFrame([(k,) for k in spans], "s string").select("s", sr.span_seconds(F.col("s")).alias("n"))
    assert {r["s"]: r["n"] for r in df.collect()} == spans


def points_with_tags(spark, rows):
    df = spark.createDataFrame(rows, "metric string, sec bigint, value double, tags map<string,string>")
    return op.with_series_key(df.select("metric", F.timestamp_seconds("sec").alias("ts"), "value", "tags"))


def test_tag_filter_needs_all_target_tags_and_allows_more(spark):
    points = points_with_tags(spark, [
        ("m", 0, 1.0, {"host": "a", "if": "x"}), ("m", 0, 2.0, {"host": "a"}), ("m", 0, 4.0, {"host": "b"}),
        ("n", 0, 8.0, {"host": "a"}), ("m", 0, 16.0, {}),
    ])
    targets = spark.createDataFrame(
        [("m", {"host": "a"}), ("m", {"host": "a", "if": "x"}), ("m", {}), ("m", {"rack": "r"})],
        "metric string, tags map<string,string>",
    )
    got = defaultdict(float)
    for r in sr.tag_filter(points, targets).collect():
        got[r["selector"]] += r["value"]
    assert dict(got) == {"m{host=a}": 3.0, "m{host=a,if=x}": 1.0, "m{}": 23.0}


def test_panels_evaluate_avg_first_and_rate(spark):
    points = points_with_tags(spark, [
        ("m", 0, 1.0, {"h": "a", "d": "1"}), ("m", 1800, 3.0, {"h": "a", "d": "1"}), ("m", 60, 10.0, {"h": "a", "d": "2"}),
        ("m", 3600, 20.0, {"h": "a", "d": "2"}), ("m", 60, 99.0, {"h": "b"}),
    ])
    targets = spark.createDataFrame(
        [("u", "avg", 0, "m", "avg", False, False, {"h": "a"}), ("u", "rate", 0, "m", "avg", True, False, {"h": "a"}),
         ("u", "first", 0, "m", "first", False, True, {"h": "a"})],
        "uid string, title string, target_pos int, metric string, aggregator string, rate boolean, raw boolean, "
        "tags map<string,string>",
    )
    values = plans.evaluate_panels(points, targets)
    got = sorted((r["title"], r["s"], r["value"]) for r in values.select("title", F.unix_seconds("ts").alias("s"), "value").collect())
    # Hour 0: series means 2 and 10, their mean 6; hour 1: 20.
    assert got == [
        ("avg", 0, 6.0), ("avg", 3600, 20.0),
        ("first", 0, 1.0), ("first", 60, 10.0), ("first", 1800, 3.0), ("first", 3600, 20.0),
        ("rate", 3600, 14.0 / 3600),
    ]


def test_panel_templates_have_the_known_shape():
    assert [len(pn.HOST_PANELS), len(pn.GC_PANELS)] == [11, 10]
    assert [p.title for p in pn.HOST_PANELS if p.targets[0].rate] == ["sys.net.bytesSent", "sys.net.bytesRecv"]
    assert [p.title for p in pn.HOST_PANELS if p.targets[0].aggregator == "first"] == ["sys.cpu.percent"]
    assert sum(len(p.targets) for p in pn.GC_PANELS) == 16


def test_fan_out(spark):
    hosts = spark.createDataFrame([("host-a-b", "a.b"), ("nodes-c", "a.b")], "uid string, host string")
    rows = pn.host_targets(hosts, ["d1", "d2"], ["lo"]).withColumn("k", pf.series_key(F.col("metric"), F.col("tags")))
    keys = [r["k"] for r in rows.filter("uid = 'nodes-c'").collect()]
    assert len(keys) == 6 + 3 * 2 + 2
    assert "sys.disk.used{disk=d2,host=a.b}" in keys and "sys.net.bytesSent{host=a.b,if=lo}" in keys
    tasks = spark.createDataFrame([("c", "j", 4)], "cluster string, job string, task_id int")
    gc = pn.gc_targets(tasks)
    assert gc.count() == 16 and {r["uid"] for r in gc.collect()} == {"jvm-c-j-4"}
    services = spark.createDataFrame(
        [("hdfs", "h1", "namenode", "n1", 100), ("hdfs", "h1", "namenode", "n2", 100), ("hdfs", "h1", "datanode", "d1", 200),
         ("zookeeper", "z1", "zkServer", "s1", 300), ("hbase", "b1", "regionserver", "r1", 400), ("hbase", "b1", "master", "m", 1)],
        "project string, cluster string, job string, host string, base_port int",
    )
    templates = {
        "hdfs": [pn.Panel("hdfs.namenode.x", [pn.Target("nn"), pn.Target("second")]), pn.Panel("hdfs.datanode.x", [pn.Target("dn")]),
                 pn.Panel("hdfs.other", [pn.Target("ot")])],
        "zookeeper": [pn.Panel("zk", [pn.Target("zk")])], "hbase": [pn.Panel("rs", [pn.Target("rs")])],
    }
    got = sorted((r["uid"], r["k"]) for r in pn.cluster_targets(services, templates).withColumn(
        "k", pf.series_key(F.col("metric"), F.col("tags"))).collect())
    assert got == [
        ("cluster-hbase-b1", "rs{cluster=b1,hostAndPort=r1-401,job=regionserver}"),
        ("cluster-hdfs-h1", "dn{cluster=h1,hostAndPort=d1-201,job=datanode}"),
        ("cluster-hdfs-h1", "nn{cluster=h1,job=namenode}"),
        ("cluster-zookeeper-z1", "zk{cluster=z1,hostAndPort=s1-300,job=zkServer}"),
    ]
