"""Inventory, lifecycle, closure, packages, trash."""

from __future__ import annotations

import hashlib
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens import sinks
from fleetlens.operators import closure as cl, fleet as fl, lifecycle as lc, points as op
from fleetlens.sources import documents as docs


def brute_replay(events):
    """Plain rules, written from the description of the actions."""
    states, out = {}, []
    for task, seq, action, ok in sorted(events, key=lambda e: e[1]):
        state = states.get(task, "absent")
        started = "Running" if ok else "Stopped"
        allowed = {
            "bootstrap": state == "absent", "start": state == "Stopped", "stop": state == "Running",
            "restart": state != "absent", "rolling_update": state != "absent", "cleanup": state == "Stopped",
        }.get(action, False)
        if allowed:
            state = {"stop": "Stopped", "cleanup": "absent"}.get(action, started)
        states[task] = state
        out.append((task, seq, action, state, not allowed))
    return sorted(out), sorted(states.items())


@pytest.mark.parametrize("chunk, levels", [(1, 3), (3, 2), (7, 3), (1024, 3)])
def test_replay_in_chunks_equals_plain_replay(spark, rows, chunk, levels):
    rng = random.Random(chunk)
    names = [*lc.TRANSITIONS, "unknown"]
    seqs = rng.sample(range(5000), 300)
    # One task holds a third of the actions.
    events = [
        ("hot" if rng.random() < 0.34 else f"t{rng.randrange(9)}", s, rng.choice(names), rng.random() < 0.8) for s in seqs
    ]
    df = spark.createDataFrame(events, "task string, seq bigint, action string, ok boolean").repartition(5)
    replayed, final = brute_replay(events)
    assert rows(lc.replay(df, ["task"], chunk, levels)) == sorted(
        replayed, key=lambda t: tuple((v is None, str(v)) for v in t)
    )
    assert rows(lc.final_states(df, ["task"], chunk, levels)) == final


def test_known_sequences(spark, rows):
    steps = [("a", "bootstrap"), ("a", "stop"), ("a", "restart"), ("a", "stop"), ("a", "cleanup"),
             ("b", "bootstrap"), ("b", "start"), ("b", "rolling_update"), ("b", "cleanup")]
    df = spark.createDataFrame([(t, i, a, True) for i, (t, a) in enumerate(steps)], "task string, seq bigint, action string, ok boolean")
    refused = {(r["task"], r["action"]) for r in lc.replay(df, ["task"]).collect() if r["refused"]}
    assert refused == {("b", "start"), ("b", "cleanup")}
    assert rows(lc.final_states(df, ["task"])) == [("a", "absent"), ("b", "Running")]


TASKS = "cluster string, job string, task_id bigint, agent string"


def test_task_status(spark, rows):
    tasks = spark.createDataFrame([("c", "j", i, f"a{i}") for i in range(4)], TASKS)
    programs = spark.createDataFrame([("c", "j", 0, "Running"), ("c", "j", 2, "Stopped")], "cluster string, job string, task_id bigint, status string")
    agents = spark.createDataFrame([("a0", True), ("a1", True), ("a2", False)], "agent string, reachable boolean")
    assert rows(fl.task_status(tasks, programs, agents), "task_id", "status") == [
        (0, "Running"), (1, "NotBootstrap"), (2, "Unknown"), (3, "Unknown"),
    ]


def test_selection_and_hidden_jobs(spark, rows):
    tasks = spark.createDataFrame(
        [("p", "c", "j", 0), ("p", "c", "j", 1), ("p", "c", "job_common", 0), ("q", "c", "j", 0)],
        "project string, cluster string, job string, task_id int",
    )
    assert fl.select_tasks(tasks, "p", "c", "j").count() == 2
    assert rows(fl.select_tasks(tasks, "p", "c", "j", 1), "task_id") == [(1,)]
    assert fl.visible_jobs(tasks).count() == 3


def test_jvm_filter_and_liveness(spark, rows):
    programs = spark.createDataFrame(
        [("c", "j", 0, "/x/java", "Running"), ("c", "j", 1, "/x/java", "Stopped"), ("c", "j", 2, "/bin/sh", "Running")],
        "cluster string, job string, task_id bigint, bin string, status string",
    )
    gc = programs.select("cluster", "job", "task_id").withColumn("v", F.lit(1.0))
    assert rows(fl.jvm_programs(programs, gc), "task_id") == [(0,)]
    beats = spark.createDataFrame(
        [("c", "j", 0, datetime(2024, 1, 1, 0, 0, 50)), ("c", "j", 1, datetime(2024, 1, 1))], "cluster string, job string, task_id bigint, ts timestamp"
    )
    as_of = F.lit(datetime(2024, 1, 1, 0, 1, 0))
    assert rows(fl.liveness(programs, beats, as_of, 10), "task_id", "status") == [(0, "Running"), (1, "Stopped"), (2, "Stopped")]


def test_upsert_and_snapshot(spark, rows, tmp_path):
    changes = spark.createDataFrame(
        [("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "z", False), ("b", 2, "z", True)], "k string, seq int, v string, gone boolean"
    )
    latest = fl.upsert_latest(changes, ["k"], "seq", "gone")
    assert rows(latest, "k", "v") == [("a", "y")]
    path = str(tmp_path / "snap")
    sinks.write_inventory(changes.select("k", "v"), path)
    sinks.write_inventory(latest.select("k", "v"), path)
    assert rows(spark.read.parquet(path)) == [("a", "y")]


def test_inventory_text(spark, tmp_path, rows):
    program = {"name": "c", "job": "j", "task_id": 0, "bin": "java", "args": ["-x"], "configs": {"f": "t"}, "pid": 7, "status": "Running"}
    path = tmp_path / "db.json"
    path.write_text(json.dumps({"cluster=c/job=j/task_id=0": program}))
    got = docs.read_inventory(spark, str(path)).head()
    assert (got["task_key"], got["pid"], got["args"], got["configs"], got["hooks"]) == (
        "cluster=c/job=j/task_id=0", 7, ["-x"], {"f": "t"}, None,
    )
    assert docs.read_inventory(spark, str(tmp_path / "none.json")).count() == 0


def test_sorts(spark):
    programs = spark.createDataFrame([("b", "j", 1, 0), ("a", "k", 9, 0), ("a", "j", 10, 0), ("a", "j", 9, 0)], "name string, job string, pid int, task_id int")
    assert [(r["name"], r["job"], r["pid"]) for r in fl.sort_programs(programs).collect()] == [("a", "j", 9), ("a", "j", 10), ("a", "k", 9), ("b", "j", 1)]
    hosts = spark.range(1).select(fl.sort_host_array(F.array(*[F.struct(F.lit(i).alias("task_id")) for i in (3, 1, 2)])).alias("h"))
    assert [h["task_id"] for h in hosts.head()["h"]] == [1, 2, 3]


def test_report(spark, rows):
    requests = spark.createDataFrame([("stop", "c", "j"), ("stop", "c", "idle")], "action string, cluster string, job string")
    results = spark.createDataFrame(
        [("stop", "c", "j", 0, "boom", "Running"), ("stop", "c", "j", 1, None, "Stopped"), ("stop", "c", "j", 2, None, None)],
        "action string, cluster string, job string, task_id int, error string, program_status string",
    )
    assert rows(fl.task_report(requests, results), "job", "task_id", "report") == [
        ("idle", None, "No task found"), ("j", 0, "Failed: boom"), ("j", 1, "Stopped"), ("j", 2, "Success"),
    ]


def test_scrape_targets_and_coverage(spark, rows):
    tasks = spark.createDataFrame(
        [("c", "regionserver", "h1", 9001, 100), ("c", "zkServer", "h1", 9001, 200), ("c", "master", "h2", 9001, 300)],
        "cluster string, job string, host string, agent_port int, base_port int",
    )
    targets = fl.scrape_targets(tasks)
    assert rows(targets, "parser", "job", "host", "port") == [
        ("hbase", "regionserver", "h1", 101), ("mntr", "zkServer", "h1", 200), ("node", "", "h1", 9001), ("node", "", "h2", 9001),
    ]
    landed = spark.createDataFrame(
        [("h1", 101, datetime(2024, 1, 1, 0, 0, 4)), ("h1", 101, datetime(2024, 1, 1, 0, 0, 5)), ("h1", 101, datetime(2024, 1, 1, 0, 0, 6)),
         ("h1", 101, datetime(2024, 1, 1, 0, 1))],
        "host string, port bigint, ts timestamp",
    )
    cover = fl.scrape_coverage(targets, landed, "2024-01-01 00:00:00", "2024-01-01 00:00:15", "5 SECOND")
    assert rows(cover.filter("port = 101"), "payloads") == [(0,), (1,), (2,)]
    assert cover.count() == 12


def test_hosts(spark, rows):
    tasks = spark.createDataFrame([("a", "h1", 1), ("a", "h1", 1), ("b", "h2", 1), ("b", "h1", 2)], "cluster string, host string, agent_port int")
    assert rows(fl.distinct_agents(tasks)) == [("http://h1:1",), ("http://h1:2",), ("http://h2:1",)]
    # Hosts of one cluster never leak into another.
    assert rows(fl.cluster_hosts(tasks)) == [("a", "h1"), ("b", "h1"), ("b", "h2")]


def test_packages(spark, rows, tmp_path):
    for name, text in {"ok": "abc", "short": "ab", "wrong": "abd", "copy": "abc"}.items():
        (tmp_path / name).write_text(text)
    good = hashlib.md5(b"abc").hexdigest()
    manifest = spark.createDataFrame([(n, 3, good) for n in ("ok", "short", "wrong", "absent")], "package_name string, size bigint, md5sum string")
    digests = fl.read_package_files(spark, str(tmp_path))
    assert rows(fl.verify_manifest(manifest, digests), "package_name", "verdict") == [
        ("absent", "missing"), ("ok", "ok"), ("short", "size_mismatch"), ("wrong", "md5_mismatch"),
    ]
    assert rows(fl.packages_to_fetch(manifest, digests), "package_name") == [("absent",), ("short",), ("wrong",)]
    assert rows(fl.package_cache(digests).filter("copies > 1"), "package_name", "copies") == [("copy", 2)]
    pins = spark.createDataFrame([("ok", good), ("ok", "x"), ("zz", good)], "package_name string, pinned_md5 string")
    assert rows(fl.pin_lookup(pins, manifest), "package_name", "state") == [("ok", "md5_mismatch"), ("ok", "ok"), ("zz", "not_found")]


def test_manifest_documents(spark, rows):
    text = json.dumps({"a.tar.gz": {"version": "1", "date": "d", "md5sum": "m", "size": 5, "link": "l"}, "b.tar.gz": {"size": 6}})
    df = spark.createDataFrame([(text,)], "value string")
    assert rows(docs.manifest_rows(df), "package_name", "version", "size") == [("a.tar.gz", "1", 5), ("b.tar.gz", None, 6)]


def test_retention(spark, rows):
    listing = spark.createDataFrame(
        [("/r/a/.trash.a.0.100", True, 2), ("/r/a/.trash.f.0.100", False, 2), ("/r/b/.trash.b.0.900", True, 2),
         ("/r/b/b.0", True, 2), ("/r/.trash.c.0.1", True, 1)],
        "path string, is_dir boolean, depth int",
    )
    assert rows(fl.expired_trash(listing, F.lit(150), 50), "path") == [("/r/a/.trash.a.0.100",)]


def test_closure_stops_on_cycles(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("s", "s"), ("a", "d")], "src string, dst string")
    closed = cl.transitive_closure(edges)
    reach = {}
    for src, dst, depth in rows(closed, "src", "dst", "depth"):
        reach.setdefault(src, {})[dst] = depth
    assert reach == {
        "a": {"b": 1, "c": 2, "a": 3, "d": 1}, "b": {"c": 1, "a": 2, "b": 3, "d": 3}, "c": {"a": 1, "b": 2, "c": 3, "d": 2},
        "x": {"a": 1, "b": 2, "c": 3, "d": 2}, "s": {"s": 1},
    }
    assert rows(cl.cycle_edges(edges, closed), "src", "dst") == [("a", "b"), ("b", "c"), ("c", "a"), ("s", "s")]
    assert rows(cl.transitive_closure(edges, max_depth=1), "src", "dst") == rows(edges.distinct())


def test_listing(spark, rows):
    clusters = spark.createDataFrame([("a", "p"), ("b", "p")], "cluster string, package_name string")
    deps = spark.createDataFrame([("a", 10, "y"), ("a", 2, "x")], "cluster string, ordinal bigint, dep_cluster string")
    assert rows(fl.cluster_listing(clusters, deps), "cluster", "dependencies") == [("a", "x,y"), ("b", "")]


def test_corpus(spark, rows, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "c.yaml").write_text("cluster:\n  project: p1\n")
    (tmp_path / "p1" / "bad.yaml").write_text("cluster: [\n")
    (tmp_path / "p1" / "deep").mkdir()
    (tmp_path / "p1" / "deep" / "no.yaml").write_text("x: 1\n")
    (tmp_path / "top.yaml").write_text("x: 1\n")
    parsed = docs.yaml_to_json(docs.read_corpus(spark, str(tmp_path)))
    assert rows(parsed.select("project", "file", "value", F.col("error").isNull())) == [
        ("p1", "bad.yaml", None, False), ("p1", "c.yaml", '{"cluster": {"project": "p1"}}', True),
    ]


def test_point_sink(spark, rows, tmp_path):
    points = op.with_series_key(spark.createDataFrame(
        [("sys.cpu.load1", datetime(2024, 1, 1), 1.5, {"host": "a"}), ("sys.mem.free", datetime(2024, 1, 2), 2.0, {"host": "a"})],
        "metric string, ts timestamp, value double, tags map<string,string>",
    ))
    path = str(tmp_path / "points")
    sinks.write_points(points, path)
    back = spark.read.parquet(path)
    assert rows(back, "metric", "value", "metric_family") == [("sys.cpu.load1", 1.5, "sys.cpu"), ("sys.mem.free", 2.0, "sys.mem")]
    pruned = back.filter("metric_family = 'sys.cpu' AND date = '2024-01-01'")
    assert "PartitionFilters: [" in pruned._jdf.queryExecution().toString() and pruned.count() == 1
    assert json.loads(sinks.point_json(points).orderBy("point").head()["point"]) == {
        "metric": "sys.cpu.load1", "timestamp": 1704067200, "value": 1.5, "tags": {"host": "a"},
    }


def test_config_paths(spark):
    def path(file):
        return spark.range(1).select(sinks.config_path(F.lit("/r"), F.lit("c"), F.lit("j"), F.lit(1), F.lit(file)).alias("p")).head()["p"]

    assert path("zoo.cfg") == "/r/c/j.1/conf/zoo.cfg" and path("/tmp/x/myid") == "/tmp/x/myid"


def test_coverage_of_fixed_slots(spark, rows):
    targets = spark.createDataFrame([("a", 1), ("b", 1)], "host string, port long")
    payloads = spark.createDataFrame([("a", 1, s) for s in (0, 9, 10, 29, 30, 35, 41, -1)], "host string, port long, sec long").select(
        "host", "port", F.timestamp_seconds(F.col("sec") + 86400).alias("ts"))
    got = fl.scrape_coverage(targets, payloads, "1970-01-02 00:00:00", "1970-01-02 00:00:40", "10 SECOND")
    assert rows(got, "host", F.unix_seconds("slot").alias("s"), "payloads") == [
        ("a", 86400, 2), ("a", 86410, 1), ("a", 86420, 1), ("a", 86430, 2),
        ("b", 86400, 0), ("b", 86410, 0), ("b", 86420, 0), ("b", 86430, 0)]
