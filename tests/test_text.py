"""String grammars and format dispatch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import text as tf


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("label, expected", [
    ("cluster=c1/job=j1/task_id=3", ("c1", "j1", 3, None)),
    ("cluster=c1/job=j1/task_id=x", ("c1", "j1", 0, None)),
    ("cluster=c1/job=j1/task_id= 3", ("c1", "j1", 0, None)),
    ("job=j1/task_id=3", ("", "", 0, "not three parts: job=j1/task_id=3")),
    ("k=c1/job=j1/task_id=3", ("", "", 0, "no cluster part: k=c1/job=j1/task_id=3")),
    ("cluster=c1/j1/task_id=3", ("", "", 0, "no job part: cluster=c1/j1/task_id=3")),
    ("cluster=c1/job=j1/id=3", ("", "", 0, "no task_id part: cluster=c1/job=j1/id=3")),
    ("", ("", "", 0, "not three parts: ")),
])
def test_task_label(spark, label, expected):
    assert tuple(one(spark, tf.parse_task_label(F.lit(label)))) == expected


@pytest.mark.parametrize("key, http, short", [
    ("10.1.0.4:2001/id=0/base_port=9001", "http://10.1.0.4:2001", "10.1.0.4:2001/id=0"),
    ("a.example.org:9001", "http://a.example.org:9001", "a.example.org:9001/id=0"),
    ("a:9001/id=1/base_port=7/x=y", "http://a:9001", "a:9001/id=1"),
    ("a:9001/id=1/cpu=16/mem=2G/id=2", "http://a:9001", "a:9001/id=2"),
    ("a:port/id=0", None, None),
    ("a/id=0/base_port=9001", None, None),
    ("a:1:2", None, None),
    ("a:9001/id=x", None, None),
    ("a:9001/id=-1", None, None),
    ("a:9001/base_port=-3", None, None),
    ("a:9001/base_port=0", None, None),
    ("a:9001/id=1/word", None, None),
    ("a:9001/k=v=w", None, None),
])
def test_endpoint(spark, key, http, short):
    e = one(spark, tf.parse_endpoint(F.lit(key)))
    if http is None:
        assert e.error is not None
        return
    assert e.error is None
    got = spark.createDataFrame([(e.host, e.agent_port, e.task_id)], "h string, p bigint, t bigint").select(
        tf.agent_url(F.col("h"), F.col("p")), tf.endpoint_key(F.col("h"), F.col("p"), F.col("t"))
    ).head()
    assert tuple(got) == (http, short)


def test_endpoint_attributes_and_defaults(spark):
    e = one(spark, tf.parse_endpoint(F.lit("h:9001/zone=a/zone=b")))
    assert e.base_port == 10000 and e.task_id == 0
    assert e.attributes == {"host": "h", "port": "9001", "zone": "b"}
    assert one(spark, tf.jmx_url(F.lit("h"), F.lit(10000))) == "http://h:10001/jmx"


@pytest.mark.parametrize("text, expected", [
    ("h", ("h", 22, 9001)), ("h:2200", ("h", 2200, 9001)), ("h/agentPort=7", ("h", 22, 7)),
    ("h:2200/agentPort=7", ("h", 2200, 7)), ("h:x", None), ("h:1:2", None), ("h/port=7", None),
    ("h/agentPort=x", None), ("  ", None),
])
def test_ssh_endpoint(spark, text, expected):
    e = one(spark, tf.parse_ssh_endpoint(F.lit(text)))
    assert (e.error is None) == (expected is not None)
    if expected:
        assert (e.host, e.ssh_port, e.agent_port) == expected


@pytest.mark.parametrize("url, host", [
    ("http://h.example:9001/api", "h.example"), ("https://h.example", "h.example"), ("h:1", "h"), ("h/x:1", "h"),
    ("http://https://h:1", "h"),
])
def test_host_from_url(spark, url, host):
    assert one(spark, tf.host_from_url(F.lit(url))) == host


@pytest.mark.parametrize("name, epoch", [
    (".trash.master.0.1525000000", 1525000000), (".trash.a-b_c.10.0", 0), ("x.trash.m.1.5", 5),
    ("master.0", -1), (".test.master.0.123", -1), (".trash.m.0.99999999999999999999999", -1),
])
def test_trash_epoch(spark, name, epoch):
    assert one(spark, tf.trash_epoch(F.lit(name))) == epoch


@pytest.mark.parametrize("name, kind", [
    ("zoo.cfg", "ini"), ("a.properties", "ini"), ("app.conf", "ini"), ("hdfs-site.xml", "xml"), ("myid", "plain"),
    ("notes.txt", "plain"), ("/tmp/agent.d/myid", "plain"), ("x.yaml", None), ("/etc/site.xml", "xml"),
])
def test_config_format(spark, name, kind):
    assert one(spark, tf.config_format(F.lit(name))) == kind


def test_small_helpers(spark):
    assert one(spark, tf.single_precision(F.lit("17315.1"))) == 17315.099609375
    assert one(spark, tf.single_precision(F.lit("1.5f"))) is None
    pointer = tf.json_pointer(F.lit("/a"), F.lit("x/y~z"))
    assert one(spark, pointer) == "/a/x~1y~0z"
    assert one(spark, tf.pointer_part(pointer, 2)) == "x/y~z"


@pytest.mark.parametrize("text, value", [("5", 5), ("+5", 5), ("-5", -5), (" 5", None), ("5.0", None), ("", None),
                                         ("99999999999999999999", None)])
def test_strict_int(spark, text, value):
    assert one(spark, tf.strict_int(F.lit(text))) == value


def test_relative_paths(spark):
    cases = [
        ("/a/b", "/a/b/c/d", "c/d"), ("/a/b/", "/a/b", "."), ("/a/b/c", "/a/x", "../../x"), ("/", "/a", "a"),
        ("/a", "/", ".."), ("/", "/", "."), ("/ab", "/a/b", "../a/b"), (None, "/a", None), ("/a", None, None),
    ]
    df = spark.createDataFrame(cases, "root string, path string, expected string")
    got = df.select("expected", tf.relative_path(F.col("root"), F.col("path")).alias("got")).collect()
    assert [r.got for r in got] == [r.expected for r in got]


def test_setting_lists_trim_the_ends_only(spark):
    cases = [("a,b", ["a", "b"]), (" a, b ", ["a", " b"]), (",,a,,b,", ["a", "", "b"]), ("", [""]), ("a ,\n", ["a "]), (None, None)]
    df = spark.createDataFrame(cases, "setting string, expected array<string>")
    got = df.select("expected", tf.setting_list(F.col("setting")).alias("got")).collect()
    assert [r.got for r in got] == [r.expected for r in got]
