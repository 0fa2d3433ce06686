"""Layered documents, job inheritance, config files, variables and placeholders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import ordered
from fleetlens.operators import jobs as jb, layers as ly, templates as tp
from fleetlens.plans import config as plan, validation
from fleetlens.sources import documents as docs


def layered(spark, *layers, doc="d"):
    rows = [(doc, i, json.dumps(layer)) for i, layer in enumerate(layers)]
    return spark.createDataFrame(rows, "doc string, layer int, value string")


def merged(spark, *layers):
    """Merged leaves as {path: scalar or list}; None when the document is rejected."""
    kept, rejects = ly.overlay(docs.flatten_documents(layered(spark, *layers)))
    if rejects.count():
        return None
    out = {}
    for r in kept.orderBy("path", "layer", "pos").collect():
        if r["kind"] == "scalar":
            out[r["path"]] = r["value"]
        elif r["kind"] == "list":
            out.setdefault(r["path"], [])
            if r["pos"] is not None:
                out[r["path"]].append(r["value"])
    return out


def test_flatten_kinds_and_escapes(spark, rows):
    value = {"a": {"n": None, "l": [1, "x"], "e": []}, "f/~": 2, "b": True}
    got = rows(docs.flatten_documents(layered(spark, value)), "path", "kind", "pos", "value")
    assert got == sorted([
        ("", "map", None, None), ("/a", "map", None, None), ("/a/n", "null", None, None), ("/a/l", "list", 0, "1"),
        ("/a/l", "list", 1, "x"), ("/a/e", "list", None, None), ("/f~1~0", "scalar", None, "2"), ("/b", "scalar", None, "true"),
    ], key=lambda t: tuple((v is None, str(v)) for v in t))


def test_flatten_opens_a_tree_to_its_end(spark, rows):
    value, path = [7, "x"], ""
    for i in range(20):
        value, path = {f"k{i}": value}, f"/k{i}{path}"
    got = rows(docs.flatten_documents(layered(spark, value)).filter("kind != 'map'"), "path", "kind", "pos", "value")
    assert got == [(path, "list", 0, "7"), (path, "list", 1, "x")]


@pytest.mark.parametrize("value", ["{", json.dumps({"l": [{"x": 1}]}), json.dumps({"l": [1.5]})])
def test_flatten_errors(spark, value):
    df = spark.createDataFrame([("d", 0, value)], "doc string, layer int, value string")
    assert docs.flatten_documents(df).filter("kind = 'error'").count() == 1


def test_overlay_first_layer_wins_and_lists_unite(spark):
    near = {"jobs": {"zk": "near", "hosts": ["a1", "b1"]}, "tasks": ["a", "b"]}
    far = {"jobs": {"zk": "far", "hosts": ["a3"]}, "tasks": ["c", "b"], "extra": "d"}
    assert merged(spark, near, far) == {
        "/jobs/zk": "near", "/jobs/hosts": ["a1", "b1", "a3"], "/tasks": ["a", "b", "c"], "/extra": "d",
    }
    assert merged(spark, near, near) == merged(spark, near)


def test_overlay_repeats_and_three_layers(spark):
    assert merged(spark, {"l": ["a", "a"]}, {"l": ["b", "b", "a"]}, {"l": ["c", "b"]}) == {"/l": ["a", "a", "b", "b", "c"]}


def test_overlay_nulls_never_override(spark):
    assert merged(spark, {"a": None, "b": 1}, {"a": 2, "b": None}) == {"/a": "2", "/b": "1"}


def test_overlay_kind_conflicts(spark):
    assert merged(spark, {"a": 1}, {"a": [1]}) is None
    assert merged(spark, {"a": [1]}, {"a": {"b": 1}}) is None
    assert merged(spark, {"a": 1}, {"a": {"b": 1}}) is None
    # A scalar below a map or list is ignored, and a later map then still fits.
    assert merged(spark, {"a": {"b": 1}}, {"a": 5}, {"a": {"c": 2}}) == {"/a/b": "1", "/a/c": "2"}


def arrays(spark, column, *values):
    df = spark.createDataFrame([values], "a array<string>, b array<string>")
    return df.select(column.alias("x")).head()["x"]


def test_list_unions(spark):
    a, b = ["x", "y"], ["z", "x", "z"]
    assert arrays(spark, ly.ordered_union(F.col("a"), F.col("b")), a, b) == ["x", "y", "z", "z"]
    assert arrays(spark, ly.inherit_union(F.col("a"), F.col("b")), a, b) == ["x", "y", "z"]


def test_job_inheritance_is_one_level_and_ignores_unknown_parents(spark):
    schema = "cluster string, job string, super_job string, jvm_opts array<string>, jvm_properties array<string>, classpath array<string>"
    jobs = spark.createDataFrame([
        ("c", "a", "b", ["1"], None, ["p"]), ("c", "b", "root", ["2", "1", "2"], ["q=1"], []),
        ("c", "root", None, ["3"], [], []), ("c", "x", "remote", ["9"], [], []), ("d", "a", "b", [], [], []),
    ], schema)
    got = {(r["cluster"], r["job"]): (r["jvm_opts"], r["jvm_properties"]) for r in jb.inherit_jobs(jobs).collect()}
    assert got["c", "a"] == (["1", "2"], ["q=1"])
    assert got["c", "b"] == (["2", "1", "2", "3"], ["q=1"])
    assert got["c", "x"] == (["9"], []) and got["d", "a"] == ([], [])


def test_arg_vector(spark):
    argv = jb.arg_vector(
        F.lit("/bin/java"), F.array(F.lit(" -Xmx1g "), F.lit(" ")), F.array(F.lit("a=b")),
        F.array(F.lit("./*"), F.lit(" lib ")), F.lit(" Main "), F.lit("x  y "),
    )
    row = spark.range(1).select(argv.alias("v")).head()
    assert row["v"] == ["/bin/java", "-Xmx1g", "-Da=b", "-cp", "./*:lib", "Main", "x", "y"]
    bare = jb.arg_vector(F.lit("p"), F.lit(None).cast("array<string>"), F.array().cast("array<string>"),
                         F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert spark.range(1).select(bare.alias("v")).head()["v"] == ["p"]


def file_lines(spark, rows_):
    """(file, side, layer, line) in order."""
    data = [("k", f, side, layer, i, line) for i, (f, side, layer, line) in enumerate(rows_)]
    return spark.createDataFrame(data, "doc string, file string, side int, layer bigint, pos bigint, line string")


def rendered(spark, rows_):
    out = jb.render_files(jb.merge_config_sets(file_lines(spark, rows_), ["doc"]), ["doc"])
    return {r["file"]: r["text"] for r in out.collect()}


def block(*pairs):
    body = "".join(f"  <property>\n    <name>{k}</name>\n    <value>{v}</value>\n  </property>\n" for k, v in pairs)
    return f"<configuration>\n{body}</configuration>"


@pytest.mark.parametrize("file, lines, text", [
    ("a.cfg", [None], ""), ("a.cfg", ["c=d", "a=b"], "c=d\na=b"), ("a.conf", ["k=====", "k=1"], "k=====\nk=1"),
    ("a.xml", ["u=jdbc:x?y=z"], block(("u", "jdbc:x?y=z"))), ("a.xml", [None], block()),
    ("a.xml", ["b=1", "a=2", "b=3"], block(("a", "2"), ("b", "3"))), ("myid", ["2", "1"], "2\n1"), ("myid.txt", ["k=="], "k=="),
    ("a.xml", ["b=1", "word"], None),
])
def test_render_one_file(spark, file, lines, text):
    assert rendered(spark, [(file, 0, 0, line) for line in lines]) == {file: text}


def test_two_opposite_winners(spark):
    # Layers of one job: the farther line comes later in the union, so xml takes the base value.
    layers = [("s.xml", 0, 0, "a=near"), ("s.xml", 0, 1, "a=base")]
    assert rendered(spark, layers) == {"s.xml": block(("a", "base"))}
    # Child and parent job: the child wins, for xml and ini alike.
    jobs = [("s.xml", 0, 0, "a=child"), ("s.xml", 1, 0, "a=parent"), ("s.xml", 1, 0, "b=2"),
            ("z.cfg", 0, 0, "b=1"), ("z.cfg", 0, 1, "b=0"), ("z.cfg", 1, 0, "a=9"), ("z.cfg", 1, 5, "b=7"),
            ("only.cfg", 1, 0, "y=1"), ("only.cfg", 1, 0, "y=1"), ("myid", 0, 0, "1"), ("myid", 1, 0, "2")]
    assert rendered(spark, jobs) == {
        "s.xml": block(("a", "child"), ("b", "2")), "z.cfg": "a=9\nb=0", "only.cfg": "y=1\ny=1", "myid": "1\n2",
    }


def test_pairs_without_sign_are_set_apart(spark, rows):
    lines = file_lines(spark, [("a.cfg", 0, 0, "k=v=w"), ("a.cfg", 0, 0, "word"), ("a.cfg", 0, 0, "=x"), ("a.cfg", 0, 0, "k=")])
    good, bad = jb.split_pairs(lines)
    assert rows(good, "key", "value") == [("", "x"), ("k", ""), ("k", "v=w")]
    assert rows(bad, "line") == [("word",)]


def test_ordered_concat_over_many_chunks(spark):
    n = 3 * ordered.CHUNK + 7
    df = spark.range(n).select(F.lit("k").alias("k"), "id").orderBy(F.rand(1))
    text = ordered.by_position(df, ["k"], F.col("id"), F.col("id").cast("string"), ",", "t").head()["t"]
    assert text == ",".join(str(i) for i in range(n))


# -- variables ------------------------------------------------------------------------

def test_env_variables(spark):
    names = {n: F.lit(v) for n, v in {"ConfRootDir": "../", "PkgLogDir": "/log", "PkgDataDir": "/data"}.items()}

    def go(text):
        return spark.range(1).select(tp.substitute_env(F.lit(text), names).alias("t")).head()["t"]

    assert go("java, {{.ConfRootDir}}") == "java, ../"
    assert go("{,{{.PkgLogDir}}{{.PkgDataDir}}") == "{,/log/data"
    assert go("{{.Nope}}") is None


def test_runtime_program(spark):
    df = spark.createDataFrame(
        [("c", "j", 3, "$AgentRootDir/b", ["$TaskId", "x"])],
        "name string, job string, task_id int, bin string, args array<string>",
    ).withColumn("configs", F.create_map(F.lit("a.$TaskId"), F.lit("1"), F.lit("a.3"), F.lit("$AgentRootDir")))
    r = tp.render_program(df, "/root").head()
    assert (r["bin"], r["args"], r["root_dir"]) == ("/root/b", ["3", "x"], "/root/c/j.3")
    assert r["configs"] == {"a.3": "/root"}


def fleet(spark):
    hosts = [("www.example.org", 7001, 0), ("www.example.org", 8001, 1)]
    rows_ = [
        (c, "job1", t, h, p, {"host": h, "port": "9001", "base_port": str(p), "id": str(t), "word": "abc"})
        for c in ("test", "root") for h, p, t in hosts
    ]
    tasks = spark.createDataFrame(rows_, "cluster string, job string, task_id bigint, host string, base_port bigint, attributes map<string,string>")
    deps = spark.createDataFrame([("test", 0, "root")], "cluster string, ordinal bigint, dep_cluster string")
    return tasks, deps


SERVERS = "www.example.org:7001,www.example.org:8001"


@pytest.mark.parametrize("skip_host", [False, True])
def test_placeholders(spark, skip_host):
    cases = {
        "k=%{cluster.name}": "k=test", "k=%{nojob.0.host}": None, "k=%{job1.99999999999999.host}": None,
        "k=%{job1.0.nothing}": None, "k=%{job1.0.host}": "k=www.example.org", "k=%{job1.2.host}": None,
        "k=%{job1.0.base_port+100}": "k=7101", "k=%{job1.0.word+1}": None, "k=%{job1.1.base_port+00100}": "k=8101",
        "k=%{dependencies.0.job1.server_list}": f"k={SERVERS}", "%{dependencies.0.job1.0.host}:%{dependencies.0.job1.0.base_port}": "www.example.org:7001",
        "%{dependencies.1.job1.0.host}": None, "%{dependencies.0.nojob.0.host}": None, "%{dependencies.0.job1.1.base_port+1}": "8002",
        "%{dependencies.0.cluster_name}": "root", "%{dependencies.1.cluster_name}": None,
        "%{dependencies.1.cluster-name}": "%{dependencies.1.cluster-name}", "%{dependencies.0.word}": "%{dependencies.0.word}",
        "%{job1.server_list}": SERVERS, "%{nojob.server_list}": None, "%{job1.y.host}": "%{job1.y.host}",
        "%{dependencies.0.nojob.server_list}": None, "%{job1.0.host}%{job1.0.host}x": "www.example.orgwww.example.orgx",
        "no placeholders $1 \\": "no placeholders $1 \\", "": "", "%{cluster.name} and %{nojob.1.host}": None,
    }
    host = {
        "%{job1.x.host}": "www.example.org", "%{nojob.x.host}": None, "%{job1.x.nothing}": None,
        "%{job1.x.base_port+200}": "8201", "%{dependencies.x.host}": None,
    }
    cases |= {k: k for k in host} if skip_host else host
    tasks, deps = fleet(spark)
    texts = spark.createDataFrame([(i, "test", 1, t) for i, t in enumerate(cases)], "doc int, cluster string, task_id bigint, text string")
    out = {r["doc"]: (r["ok"], r["text"]) for r in tp.render_templates(texts, ["doc"], tasks, deps, skip_host=skip_host).collect()}
    for i, (text, expected) in enumerate(cases.items()):
        assert out[i] == (expected is not None, expected), text


def test_host_placeholder_of_a_missing_task(spark):
    tasks, deps = fleet(spark)
    texts = spark.createDataFrame([(0, "test", 100, "%{job1.x.host}")], "doc int, cluster string, task_id bigint, text string")
    assert not tp.render_templates(texts, ["doc"], tasks, deps).head()["ok"]


def test_values_are_not_expanded_again(spark):
    tasks = spark.createDataFrame(
        [("c", "j", 0, "h", 1, {"a": "%{j.0.b}", "b": "B"})],
        "cluster string, job string, task_id bigint, host string, base_port bigint, attributes map<string,string>",
    )
    deps = spark.createDataFrame([], "cluster string, ordinal bigint, dep_cluster string")
    texts = spark.createDataFrame([(0, "c", 0, "%{j.0.a}%{j.0.b}")], "doc int, cluster string, task_id bigint, text string")
    assert tp.render_templates(texts, ["doc"], tasks, deps).head()["text"] == "%{j.0.b}B"


def test_job_without_tasks_has_an_empty_server_list(spark):
    tasks, deps = fleet(spark)
    jobs = tasks.select("cluster", "job").distinct().unionByName(spark.createDataFrame([("test", "idle")], "cluster string, job string"))
    texts = spark.createDataFrame([(0, "test", 0, "<%{idle.server_list}>")], "doc int, cluster string, task_id bigint, text string")
    assert tp.render_templates(texts, ["doc"], tasks, deps, jobs).head()["text"] == "<>"


# -- whole documents ------------------------------------------------------------------

def cluster_doc(**changes):
    cluster = {"project": "p", "cluster_name": "c", "main_process": "m", "package_name": "n", "package_md5sum": "5"}
    doc = {"base": "b", "cluster": cluster, "jobs": {}}
    for key, value in changes.items():
        (cluster if key in cluster else doc)[key] = value
    return json.dumps(doc)


@pytest.mark.parametrize("value, reason", [
    (cluster_doc(), None), (cluster_doc(base=None), None), (cluster_doc(base=3), "base is not a string"),
    (cluster_doc(cluster=None), "cluster section does not exist"), (cluster_doc(cluster=[]), "cluster section is not a map"),
    (cluster_doc(project=None), "required key project does not exist"), (cluster_doc(package_name=1), "package_name is not a string"),
    (cluster_doc(jobs=None), "jobs section does not exist"), (cluster_doc(jobs="x"), "jobs section is not a map"), ("{", "not JSON"),
])
def test_validation(spark, value, reason):
    df = spark.createDataFrame([(value,)], "value string")
    assert ly.validate_clusters(df).head()["reason"] == reason


def test_layered_cluster_documents(spark):
    base = {"jobs": {"zk": {"jvm_opts": ["-Xmx4g"], "config": {"zoo.cfg": ["dir=/d"]}, "classpath": ["./*"]}}}
    mid = {"cluster": {"cluster_name": "tst"}, "jobs": {"zk": {"hosts": ["h:9001/id=1/base_port=9002"], "config": {"zoo.cfg": ["tick=2"]}}}}
    near = {"jobs": {"zk": {"hosts": ["h:9001/id=1/base_port=9003"], "jvm_opts": ["-Xmn1g"]}}}
    got = merged(spark, near, mid, base)
    assert got["/jobs/zk/jvm_opts"] == ["-Xmn1g", "-Xmx4g"]
    assert got["/jobs/zk/config/zoo.cfg"] == ["tick=2", "dir=/d"]
    assert got["/cluster/cluster_name"] == "tst" and got["/jobs/zk/classpath"] == ["./*"]


def test_effective_config(spark):
    near = {"cluster": {"cluster_name": "c1"}, "jobs": {"web": {
        "super_job": "job_common", "hosts": ["h1:9001/id=0/base_port=10", "h2:9001/id=1/base_port=20"],
        "config": {"a.cfg": ["p=%{web.x.base_port+1}", "d=%{dependencies.0.zk.server_list}"], "site.xml": []}}}}
    base = {"jobs": {"job_common": {"config": {"a.cfg": ["p=0", "n=%{cluster.name}"], "$AgentRootDir/myid": ["$TaskId"]}}}}
    other = {"cluster": {"cluster_name": "z1"}, "jobs": {"zk": {"hosts": ["z:9001/id=0/base_port=2181"], "config": {"bad": ["%{zk.5.host}"]}}}}
    layer_docs = layered(spark, near, base, doc="A").unionByName(layered(spark, other, doc="B"))
    deps = spark.createDataFrame([("A", 0, "B")], "cluster string, ordinal bigint, dep_cluster string")
    got = {(r["cluster_name"], r["task_id"], r["file"]): r["text"] for r in plan.effective_config(layer_docs, deps, "/ag").collect()}
    assert got == {
        ("c1", 0, "a.cfg"): "d=z:2181\nn=c1\np=11", ("c1", 1, "a.cfg"): "d=z:2181\nn=c1\np=21",
        ("c1", 0, "/ag/myid"): "0", ("c1", 1, "/ag/myid"): "1",
        ("c1", 0, "site.xml"): block(), ("c1", 1, "site.xml"): block(), ("z1", 0, "bad"): None,
    }
    kept = plan.effective_config(layer_docs, deps, "/ag", skip_host=True).filter("file = 'a.cfg' AND task_id = 0").head()
    assert kept["text"] == "d=z:2181\nn=c1\np=%{web.x.base_port+1}"


def test_effective_files_and_rejects(spark):
    doc = {"cluster": {"cluster_name": "c"}, "jobs": {"idle": {"config": {}}, "web": {
        "hosts": ["h:9001/id=3000000000", "nohost"],
        "config": {"log.properties": {"file": "/etc/log"}, "gone.cfg": {"file": "/etc/gone"}, "empty.cfg": {"file": "/etc/empty"},
                   "a.cfg": ["peers=[%{idle.server_list}]"], "app.yaml": ["x"]}}},
        "notes": {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": ["deep"]}}}}}}}}}
    texts = spark.createDataFrame([("/etc/log", "# no\n level=info \n\nsize=1"), ("/etc/empty", "# no")], "path string, value string")
    layers = layered(spark, doc, doc="A")
    deps = spark.createDataFrame([], "cluster string, ordinal bigint, dep_cluster string")
    got = {r["file"]: (r["task_id"], r["ok"], r["text"]) for r in plan.effective_config(layers, deps, "/ag", texts=texts).collect()}
    assert got == {
        "log.properties": (3000000000, True, "level=info\nsize=1"), "a.cfg": (3000000000, True, "peers=[]"),
        "empty.cfg": (3000000000, True, ""), "app.yaml": (3000000000, False, None),
    }
    rejects = {(r["job"], r["item"], r["reason"]) for r in plan.effective_rejects(layers, texts).collect()}
    assert rejects == {("web", "nohost", "bad address"), ("web", "gone.cfg", "no such file: /etc/gone"), ("web", "app.yaml", "unknown format")}


def test_yaml(spark, rows):
    df = spark.createDataFrame([("a", "x:\n  - 1\n  - two\n"), ("b", "x: [")], "path string, value string")
    out = docs.yaml_to_json(df)
    assert rows(out.filter("error is null"), "path", "value") == [("a", '{"x": [1, "two"]}')]
    assert rows(out.filter("error is not null"), "path") == [("b",)]


def test_chains_of_bases(spark):
    import random

    from fleetlens.operators import chains

    rng = random.Random(1)
    base = {f"d{i}": f"d{i - 1}" if i % 40 else None for i in range(200)}
    base |= {f"h{i}": "d39" for i in range(300)} | {"a": "b", "b": "c", "c": "a", "x": "a", "own": "own", "gone": "nowhere"}
    base |= {f"r{i}": rng.choice([None, f"r{rng.randrange(60)}"]) for i in range(60)}
    want, around = set(), set()
    for doc in base:
        at, layer, rows = doc, 0, set()
        while at in base and layer <= len(base):
            rows.add((doc, layer, at))
            at, layer = base[at], layer + 1
        if layer > len(base):
            around.add(doc)
        else:
            want |= rows
    links = spark.createDataFrame(list(base.items()), "doc string, base string")
    rows, circling = chains.ancestor_layers(links)
    assert {tuple(r) for r in rows.collect()} == want and rows.count() == len(want)
    assert {r.doc for r in circling.collect()} == around
    some = spark.createDataFrame([("d39",), ("a",), ("h1",), ("h1",)], "doc string")
    assert {tuple(r) for r in chains.ancestor_layers(links, some)[0].collect()} == {w for w in want if w[0] in ("d39", "h1")}
    assert chains.ancestor_layers(links.limit(0))[0].count() == 0


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    from fleetlens.operators import chains

    made = []
    monkeypatch.setattr(chains, "stage", lambda df, label: made.append(label) or spark.createDataFrame(df.collect(), df.schema))
    links = spark.createDataFrame([(i, i - 1 if i else None) for i in range(500)], "doc long, base long")
    assert chains.ancestor_layers(links, spark.createDataFrame([(499,)], "doc long"))[0].count() == 500
    assert made.count("jump") == 10 and made.count("layers") == 9


def test_documents_that_cannot_be_loaded(spark):
    from fleetlens.plans import config as plan

    rows = [
        ("/a", '{"base":"{{.ConfRootDir}}/base","cluster":{"dependencies":["/b","/c"]}}'), ("/etc/base", '{"cluster":{"cluster_name":"n"}}'),
        ("/b", '{"cluster":{"dependencies":["/bad"]}}'), ("/bad", '{"base":"{{.Nope}}"}'), ("/c", "{}"), ("/d", '{"cluster":{"dependencies":["/d"]}}'),
        ("/e", '{"base":null,"cluster":{"dependencies":["/c"]}}'), ("/f", '{"base":7}'), ("/g", '{"base":"/f"}'),
    ]
    documents = spark.createDataFrame(rows, "path string, value string")
    _, rejects = plan.effective_from_documents(documents, {"ConfRootDir": F.lit("/etc")}, "/agent")
    assert {tuple(r) for r in rejects.collect()} == {
        ("/bad", "/bad", "unknown variable"), ("/f", "/f", "base is not a string"), ("/g", "/f", "base is not a string"),
        ("/b", "/bad", "dependency is not there"), ("/a", "/bad", "dependency is not there"), ("/d", "/d", "circle of dependencies"),
    }
    layers, _ = plan.document_layers(documents, {"ConfRootDir": F.lit("/etc")})
    assert {(r.layer, r.path) for r in layers.filter("doc = '/a'").collect()} == {(0, "/a"), (1, "/etc/base")}


def test_commands_against_brute_force(spark):
    import random

    from fleetlens.plans import programs

    rng, docs_, want = random.Random(4), [], {}
    for d in range(12):
        jobs = {}
        for j in ("base", "a", "b"):
            jobs[j] = {"hosts": [f"h{j}:9001/id=1", f"h{j}:9001/id=0"]} | {
                s: [rng.choice(["x", " y ", "z", "", "w w"]) for _ in range(rng.randrange(5))]
                for s in ("jvm_opts", "jvm_properties", "classpath") if rng.random() < 0.8}
            if j != "base" and rng.random() < 0.7:
                jobs[j]["super_job"] = "base"
            if rng.random() < 0.6:
                jobs[j]["main_entry"] = {"java_class": " M ", "extra_args": "a  b"}
        docs_.append((d, 0, json.dumps({"cluster": {"main_process": "java"}, "jobs": jobs})))
        for j, job in jobs.items():
            parent = jobs.get(job.get("super_job"), {})
            parts = {}
            for s in ("jvm_opts", "jvm_properties", "classpath"):
                own = list(job.get(s, []))
                own += [x for i, x in enumerate(parent.get(s, [])) if x not in own and x not in parent[s][:i]]
                parts[s] = [x.strip() for x in own if x.strip()]
            entry = job.get("main_entry")
            want[d, j] = ["java", *parts["jvm_opts"], *["-D" + x for x in parts["jvm_properties"]],
                          *(["-cp", ":".join(parts["classpath"])] if parts["classpath"] else []), *(["M", "a", "b"] if entry else [])]
    leaves, _ = plan.merged_leaves(spark.createDataFrame(docs_, "doc bigint, layer int, value string"))
    got = {(r.doc, r.job, r.task_id, r.host): r.args for r in programs.task_commands(leaves).collect()}
    assert got == {(d, j, t, f"h{j}"): args for (d, j), args in want.items() for t in (0, 1)}


def test_a_large_corpus_file_is_split(spark, tmp_path):
    folder = tmp_path / "p1"
    folder.mkdir()
    (folder / "big.json").write_text("".join(f'{{"n":{i},"x":"{"y" * 90}"}}\n\n' for i in range(20000)))
    (folder / "deep").mkdir()
    (folder / "deep" / "no.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        lines = docs.read_corpus_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 6
        assert lines.count() == 20000 and {(r.project, r.file) for r in lines.select("project", "file").distinct().collect()} == {("p1", "big.json")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folders_are_listed_without_content(spark, tmp_path):
    for path in ("a/one.trash.j.1.5/x/y.txt", "a/one.trash.j.1.5/z.txt", "b/live/q.txt", "top.txt", "a/file.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("12345")
    listed = docs.list_folders(spark, str(tmp_path))
    got = {(r.path.removeprefix(str(tmp_path)), r.files, r.bytes, r.depth) for r in listed.collect()}
    assert got == {("/a/one.trash.j.1.5", 2, 10, 2), ("/b/live", 1, 5, 2)}
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


def faults(spark, *values):
    df = spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "doc int, value string")
    return sorted((r["doc"], r["path"], r["reason"]) for r in validation.validate_documents(df).collect())


def test_validation_lists_every_fault_of_a_document(spark):
    cluster = {name: "x" for name in ly.REQUIRED_FIELDS}
    good = {"base": None, "cluster": {**cluster, "dependencies": 7}, "jobs": {
        "j": {"hosts": ["h:1/id=0", 5], "hooks": [1], "config": {"a": ["k=v"], "none": None, "file": {"file": "f"}}, "main_entry": {"java_class": None}},
        "empty": {}}}
    assert faults(spark, good) == []
    bad = {"base": 1, "cluster": {**cluster, "project": None, "main_process": True}, "jobs": {
        "~/": None, "j": {"super_job": [], "hosts": ["h", None, 1.5], "classpath": {"file": 3}, "jvm_properties": {}, "config": [], "main_entry": "x"},
        "k": {"config": {"f/g": 1, "h": {"no": "file"}}, "main_entry": {"extra_args": ["a"]}}}}
    element = "an element is neither a string nor an integer"
    assert faults(spark, bad) == sorted((0, path, reason) for path, reason in [
        ("/base", "not a string"), ("/cluster/project", "missing"), ("/cluster/main_process", "not a string"), ("/jobs/~0~1", "not a map"),
        ("/jobs/j/super_job", "not a string"), ("/jobs/j/hosts", element), ("/jobs/j/classpath/file", "not a string"),
        ("/jobs/j/jvm_properties/file", "missing"), ("/jobs/j/config", "not a map"), ("/jobs/j/main_entry", "not a map"),
        ("/jobs/k/config/f~1g", "not a list"), ("/jobs/k/config/h/file", "missing"), ("/jobs/k/main_entry/extra_args", "not a string")])
    # Below what is no map nothing is missed.
    assert faults(spark, "{", "[1]", {}, {"cluster": [], "jobs": 1}, "null") == [
        (0, "", "not JSON"), (1, "", "not a map"), (2, "/cluster", "missing"), (2, "/jobs", "missing"),
        (3, "/cluster", "not a map"), (3, "/jobs", "not a map"), (4, "", "not a map")]


def test_first_fault_agrees_with_the_document_check(spark):
    cluster = {name: "x" for name in ly.REQUIRED_FIELDS}
    values = [{"cluster": cluster, "jobs": {}}, {"cluster": {}, "jobs": {}}, {"cluster": cluster}, {"base": 2, "cluster": cluster, "jobs": {}}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "doc int, value string")
    first = {r["doc"] for r in ly.validate_clusters(df).filter("reason IS NOT NULL").collect()}
    assert {doc for doc, _, _ in faults(spark, *values)} == first == {1, 2, 3}
