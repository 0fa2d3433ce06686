"""Layered documents, config files and placeholders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import sinks
from fleetlens.functions import text as tf
from fleetlens.operators import closure as cl, jobs as jb, layers as ly, templates as tp
from fleetlens.plans import config as plan, programs, validation
from fleetlens.session import new_work_dir, stage
from fleetlens.sources import documents as docs
from fleetlens.workload import adapters as ad
from fleetlens.workload.registry import query, table


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# -- layered documents ----------------------------------------------------------------

_K = "c_custkey"
_LEAVES = [
    # layer, path, kind, pos, value
    *[(layer, path, "map", "NULL", "NULL") for layer, paths in {
        0: ["", "/cluster", "/jobs", "/jobs/web", "/jobs/web/config"],
        1: ["", "/cluster", "/jobs", "/jobs/web", "/jobs/web/config"],
        2: ["", "/cluster", "/jobs", "/jobs/job_common", "/jobs/job_common/config"],
    }.items() for path in paths],
    (0, "/cluster/cluster_name", "scalar", "NULL", "c_name"),
    (0, "/cluster/project", "null", "NULL", "NULL"),
    (0, "/cluster/package_name", "scalar", "NULL", "c_mktsegment"),
    (0, "/jobs/web/super_job", "scalar", "NULL", "'job_common'"),
    (0, "/jobs/web/jvm_opts", "list", "0", f"'-Xmx' || {_K} || 'm'"),
    (0, "/jobs/web/jvm_opts", "list", "1", "'-server'"),
    (0, "/jobs/web/config/web.cfg", "list", "0", "'name=%{cluster.name}'"),
    (0, "/jobs/web/config/web.cfg", "list", "1", "'id=$TaskId'"),
    (0, "/jobs/web/config/web.cfg", "list", "2", "'port=%{web.x.base_port+1}'"),
    (0, "/jobs/web/config/site.xml", "list", "0", "'a=near'"),
    (0, "/jobs/web/config/site.xml", "list", "1", "'b=%{web.server_list}'"),
    (1, "/cluster/cluster_name", "scalar", "NULL", "n_name"),
    (1, "/cluster/project", "scalar", "NULL", "'p' || n_regionkey"),
    (1, "/cluster/main_process", "scalar", "NULL", "'/usr/bin/java'"),
    (1, "/jobs/web/hosts", "list", "0", "'far:9001/id=2'"),
    (1, "/jobs/web/jvm_opts", "list", "0", "'-server'"),
    (1, "/jobs/web/jvm_opts", "list", "1", "'-verbose'"),
    (1, "/jobs/web/config/site.xml", "list", "0", "'a=far'"),
    (1, "/jobs/web/config/site.xml", "list", "1", "'c=1'"),
    (2, "/cluster/project", "scalar", "NULL", "'base'"),
    (2, "/cluster/package_md5sum", "scalar", "NULL", "md5(r_name)"),
    (2, "/jobs/job_common/jvm_opts", "list", "0", "'-verbose'"),
    (2, "/jobs/job_common/jvm_opts", "list", "1", "'-ea'"),
    (2, "/jobs/job_common/jvm_opts", "list", "2", "'-ea'"),
    (2, "/jobs/job_common/config/web.cfg", "list", "0", "'name=common'"),
    (2, "/jobs/job_common/config/web.cfg", "list", "1", "'log=$AgentRootDir/log'"),
    (2, "/jobs/job_common/config/myid", "list", "0", "'$TaskId'"),
]
_HOST_LEAVES = [
    ("scalar", "NULL", "'none'", "c_acctbal < 0"),
    ("list", "0", f"'h' || {_K} || ':9001/id=1/base_port=9101'", "c_acctbal >= 0"),
    ("list", "1", f"'h' || {_K} || ':9001/id=0'", "c_acctbal >= 0"),
]


def _leaf(layer, path, kind, pos, value, where="true"):
    return (
        f"SELECT {_K} AS doc, CAST({layer} AS BIGINT) AS layer, '{path}' AS path, '{kind}' AS kind, "
        f"CAST({pos} AS BIGINT) AS pos, CAST({value} AS VARCHAR) AS value FROM base WHERE {where}"
    )


_BASE = """base AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey)"""
LEAVES = f"{_BASE}, leaves AS (" + "\nUNION ALL ".join(
    [_leaf(*x) for x in _LEAVES] + [_leaf(0, "/jobs/web/hosts", k, p, v, w) for k, p, v, w in _HOST_LEAVES]
) + ")"


@query("doc_flatten", f"WITH {LEAVES} SELECT * FROM leaves")
def doc_flatten(spark, sf):
    leaves = docs.flatten_documents(ad.layer_documents(spark, sf))
    return leaves.select("doc", F.col("layer").cast("bigint").alias("layer"), "path", "kind", "pos", "value")


_JUDGED = """known AS (SELECT *, first_value(kind) OVER (PARTITION BY doc, path ORDER BY layer) AS won,
min(layer) OVER (PARTITION BY doc, path) AS near, min(layer) OVER (PARTITION BY doc, path, value) AS item_near
FROM leaves WHERE kind <> 'null'),
bad AS (SELECT DISTINCT doc, path FROM known WHERE kind <> won AND kind <> 'scalar')"""


@query("overlay_merge", f"""WITH {LEAVES}, {_JUDGED} SELECT doc, layer, path, kind, pos, value FROM known
WHERE doc NOT IN (SELECT doc FROM bad) AND kind = won AND CASE WHEN kind = 'list' THEN layer = item_near ELSE layer = near END""")
def overlay_merge(spark, sf):
    merged, _ = plan.merged_leaves(ad.layer_documents(spark, sf))
    return merged.select("doc", F.col("layer").cast("bigint").alias("layer"), "path", "kind", "pos", "value")


@query("overlay_rejects", f"WITH {LEAVES}, {_JUDGED} SELECT doc, path, 'kind conflict' AS reason FROM bad")
def overlay_rejects(spark, sf):
    _, rejects = plan.merged_leaves(ad.layer_documents(spark, sf))
    return rejects.distinct()


@query("ordered_union", """WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS a,
[p_type, p_brand, split_part(p_name, ' ', 1), p_brand] AS b FROM part)
SELECT p_partkey, array_to_string(list_concat(a, list_filter(b, lambda v: NOT list_contains(a, v))), '|') AS items FROM x""")
def ordered_union(spark, sf):
    a = F.split("p_name", " ")
    b = F.array("p_type", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand")
    return table(spark, sf, "part").select("p_partkey", F.array_join(ly.ordered_union(a, b), "|").alias("items"))


_JOBS = """jobs AS (SELECT p_type AS cluster, 'job' || p_partkey AS job, 'job' || p_size AS super_job,
['-Xmx' || p_size || 'm', p_brand, p_brand] AS jvm_opts, string_split(p_name, ' ') AS jvm_properties,
['./*', p_name] AS classpath FROM part)"""


def _jobs(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_type").alias("cluster"), _text("job", F.col("p_partkey")).alias("job"),
        _text("job", F.col("p_size")).alias("super_job"),
        F.array(_text("-Xmx", F.col("p_size"), "m"), "p_brand", "p_brand").alias("jvm_opts"),
        F.split("p_name", " ").alias("jvm_properties"), F.array(F.lit("./*"), "p_name").alias("classpath"),
    )


def _duck_inherit(name):
    return (
        f"array_to_string(list_concat(c.{name}, list_filter(coalesce(p.{name}, []), lambda v, i: "
        f"NOT list_contains(c.{name}, v) AND list_position(p.{name}, v) = i)), '|') AS {name}"
    )


@query("job_inherit", f"""WITH {_JOBS} SELECT c.cluster, c.job, {', '.join(_duck_inherit(n) for n in jb.INHERITED)}
FROM jobs c LEFT JOIN jobs p ON c.cluster = p.cluster AND c.super_job = p.job""")
def job_inherit(spark, sf):
    merged = jb.inherit_jobs(_jobs(spark, sf))
    return merged.select("cluster", "job", *[F.array_join(c, "|").alias(c) for c in jb.INHERITED])


@query("inherit_union", """WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS a,
[p_type, p_brand, split_part(p_name, ' ', 1), p_brand] AS b FROM part)
SELECT p_partkey, array_to_string(list_concat(a, list_filter(b, lambda v, i: NOT list_contains(a, v) AND list_position(b, v) = i)), '|') AS items FROM x""")
def inherit_union(spark, sf):
    a = F.split("p_name", " ")
    b = F.array("p_type", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand")
    return table(spark, sf, "part").select("p_partkey", F.array_join(ly.inherit_union(a, b), "|").alias("items"))


@query("arg_vector", """SELECT p_partkey, '/usr/bin/java|-Xmx' || p_size || 'm|-D' || p_brand || CASE WHEN p_size > 25
THEN '|-cp|./*:' || p_type ELSE '' END || CASE WHEN p_size > 10 THEN '|org.' || p_type ELSE '' END || '|' ||
replace(p_name, ' ', '|') AS argv FROM part""")
def arg_vector(spark, sf):
    size, none = F.col("p_size"), F.array().cast("array<string>")
    argv = jb.arg_vector(
        F.lit("/usr/bin/java"), F.array(_text(" -Xmx", size, "m\t"), F.lit("  ")), F.array(F.col("p_brand")),
        F.when(size > 25, F.array(F.lit("./*"), F.lit(""), F.col("p_type"))).otherwise(none),
        F.when(size > 10, _text(" org.", F.col("p_type"), " ")), F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))),
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(argv, "|").alias("argv"))


# -- config files ---------------------------------------------------------------------

CONFIG = """cfg AS (SELECT l_orderkey AS doc, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'site.xml'
WHEN '2' THEN 'zoo.cfg' WHEN '3' THEN 'a.properties' WHEN '4' THEN 'myid' ELSE 'app.conf' END AS file,
CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'xml' WHEN '4' THEN 'plain' ELSE 'ini' END AS format,
CAST(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS BIGINT) AS layer,
l_linenumber * 10000000000 + l_partkey AS pos, 'k' || l_linenumber AS key,
CASE WHEN l_quantity = 50 THEN NULL ELSE l_partkey || '=x' END AS value,
CASE WHEN l_quantity = 50 THEN 'k' || l_linenumber ELSE 'k' || l_linenumber || '=' || l_partkey || '=x' END AS line
FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("kv_collapse", f"""WITH {CONFIG} SELECT doc, file, key, arg_max(value, layer * 1000000000000 + pos) AS value
FROM cfg WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def kv_collapse(spark, sf):
    pairs, _ = jb.split_pairs(ad.config_lines(spark, sf))
    return jb.collapse_pairs(pairs, ["doc", "file"])


@query("kv_rejects", f"WITH {CONFIG} SELECT doc, file, layer, pos, line FROM cfg WHERE value IS NULL")
def kv_rejects(spark, sf):
    _, bad = jb.split_pairs(ad.config_lines(spark, sf))
    return bad


@query("kv_merge", f"""WITH {CONFIG}, side AS (SELECT doc, file, layer, key, arg_max(value, pos) AS value
FROM cfg WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT coalesce(c.doc, p.doc) AS doc, coalesce(c.file, p.file) AS file, coalesce(c.key, p.key) AS key,
coalesce(c.value, p.value) AS value FROM (SELECT * FROM side WHERE layer = 0) c FULL JOIN
(SELECT * FROM side WHERE layer = 1) p ON c.doc = p.doc AND c.key = p.key""")
def kv_merge(spark, sf):
    pairs, _ = jb.split_pairs(ad.config_lines(spark, sf))
    keys = ["doc", "file"]
    child = jb.collapse_pairs(pairs.filter("layer = 0"), keys)
    parent = jb.collapse_pairs(pairs.filter("layer = 1"), keys)
    return jb.merge_pairs(child, parent, keys)


_SETS = f"""WITH {CONFIG}, s AS (SELECT *, min(layer) OVER (PARTITION BY doc) <> max(layer) OVER (PARTITION BY doc) AS shared FROM cfg),
sets AS (SELECT doc, file, format, shared AND format <> 'plain' AS merged, layer AS side, pos, line, key, value FROM s
WHERE NOT shared OR format = 'plain' OR value IS NULL
UNION ALL SELECT doc, file, format, true AS merged, min(layer) AS side, arg_max(pos, (1 - layer) * 1000000000000 + pos) AS pos,
key || '=' || arg_max(value, (1 - layer) * 1000000000000 + pos) AS line, key, arg_max(value, (1 - layer) * 1000000000000 + pos) AS value
FROM s WHERE shared AND format <> 'plain' AND value IS NOT NULL GROUP BY doc, file, format, key)"""


def _config_sets(spark, sf):
    lines = ad.config_lines(spark, sf).withColumn("side", F.col("layer"))
    return jb.merge_config_sets(lines, ["doc"])


@query("config_set_merge", f"{_SETS} SELECT doc, file, format, merged, side, pos, line FROM sets")
def config_set_merge(spark, sf):
    return _config_sets(spark, sf).select("doc", "file", "format", "merged", "side", "pos", "line")


@query("config_render", f"""{_SETS}, f AS (SELECT doc, file, format,
bool_or(value IS NULL AND (format = 'xml' OR merged)) AS broken FROM sets GROUP BY 1, 2, 3),
pairs AS (SELECT doc, file, key, arg_max(value, side * 1000000000000 + pos) AS value FROM sets
WHERE format = 'xml' AND value IS NOT NULL GROUP BY 1, 2, 3),
body AS (SELECT doc, file, string_agg('  <property>' || chr(10) || '    <name>' || key || '</name>' || chr(10) || '    <value>' ||
value || '</value>' || chr(10) || '  </property>', chr(10) ORDER BY key) AS t FROM pairs GROUP BY 1, 2
UNION ALL SELECT doc, file, string_agg(line, chr(10) ORDER BY CASE WHEN merged THEN key ELSE '' END, side, pos, line) AS t
FROM sets WHERE format <> 'xml' GROUP BY 1, 2)
SELECT f.doc, f.file, f.format, CASE WHEN broken THEN NULL WHEN f.format = 'xml' THEN '<configuration>' || chr(10) ||
coalesce(t || chr(10), '') || '</configuration>' ELSE t END AS text FROM f LEFT JOIN body b ON f.doc = b.doc AND f.file = b.file""")
def config_render(spark, sf):
    return jb.render_files(_config_sets(spark, sf), ["doc"])


@query("format_dispatch", """WITH x AS (SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '/etc/conf.d/site.xml'
WHEN '2' THEN 'zoo' || CASE o_orderstatus WHEN 'O' THEN '.cfg' WHEN 'F' THEN '.properties' ELSE '.conf' END
WHEN '3' THEN '/var/agent.1/myid' WHEN '4' THEN 'notes.txt' ELSE 'app.yaml' END AS file FROM orders)
SELECT o_orderkey, file, CASE WHEN file LIKE '%.xml' THEN 'xml' WHEN file LIKE 'zoo%' THEN 'ini'
WHEN file LIKE '%myid' OR file LIKE '%.txt' THEN 'plain' END AS format FROM x""")
def format_dispatch(spark, sf):
    p, s = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    suffix = F.when(s == "O", ".cfg").when(s == "F", ".properties").otherwise(".conf")
    file = (
        F.when(p == "1", "/etc/conf.d/site.xml").when(p == "2", _text("zoo", suffix))
        .when(p == "3", "/var/agent.1/myid").when(p == "4", "notes.txt").otherwise("app.yaml")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", file.alias("file"))
    return orders.withColumn("format", tf.config_format(F.col("file")))


# -- variables and placeholders -------------------------------------------------------

@query("env_substitute", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'dir=$AgentRootDir/o' || o_orderkey ||
'/log,../conf;{,' || o_orderpriority END AS text FROM orders""")
def env_substitute(spark, sf):
    root = _text("$AgentRootDir/o", F.col("o_orderkey"))
    variables = {"ConfRootDir": F.lit("../conf")}
    variables |= {name: F.concat(root, F.lit("/" + folder)) for name, folder in tp.TASK_FOLDERS.items()}
    text = _text(
        "dir={{.PkgLogDir}},{{.ConfRootDir}};{,", F.col("o_orderpriority"),
        F.when(F.col("o_orderstatus") == "P", "{{.Unknown}}").otherwise(""),
    )
    return table(spark, sf, "orders").select("o_orderkey", tp.substitute_env(text, variables).alias("text"))


@query("runtime_vars", """SELECT o_orderkey, '/agent/c' || o_custkey || '/' || o_orderstatus || '.' || o_orderkey AS root_dir,
'/agent/bin/run' AS bin, '-d|/agent/data/' || o_orderkey AS args, 'id=' || o_orderkey || ' of /agent$Task' AS myid,
o_orderpriority AS other FROM orders""")
def runtime_vars(spark, sf):
    programs = table(spark, sf, "orders").select(
        _text("c", F.col("o_custkey")).alias("name"), F.col("o_orderstatus").alias("job"),
        F.col("o_orderkey").alias("task_id"), F.lit("$AgentRootDir/bin/run").alias("bin"),
        F.array(F.lit("-d"), F.lit("$AgentRootDir/data/$TaskId")).alias("args"),
        F.create_map(
            F.lit("$AgentRootDir/$TaskId/myid"), F.lit("id=$TaskId of $AgentRootDir$Task"),
            F.lit("other"), F.col("o_orderpriority"),
        ).alias("configs"),
    )
    done = tp.render_program(programs, "/agent")
    return done.select(
        F.col("task_id").alias("o_orderkey"), "root_dir", "bin", F.array_join("args", "|").alias("args"),
        F.try_element_at("configs", _text("/agent/", F.col("task_id"), "/myid")).alias("myid"),
        F.try_element_at("configs", F.lit("other")).alias("other"),
    )


TASKS = """t AS (SELECT 'o' || l_orderkey AS cluster, l_returnflag AS job, l_linenumber AS task_id, min(l_suppkey) AS sk
FROM lineitem GROUP BY 1, 2, 3),
lists AS (SELECT cluster, job, string_agg('supp' || sk || ':' || (10000 + task_id), ',' ORDER BY task_id) AS server_list FROM t GROUP BY 1, 2),
o AS (SELECT o_orderkey AS doc, 'o' || o_orderkey AS cluster, 'o' || o_custkey AS dep, o_custkey % 7 + 1 AS x,
substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS st FROM orders)"""


@query("server_list", f"WITH {TASKS} SELECT * FROM lists")
def server_list(spark, sf):
    return tp.server_lists(ad.line_tasks(spark, sf))


@query("placeholder_resolve", f"""WITH {TASKS}, r AS (SELECT o.doc, CASE p
WHEN '1' THEN 'n=' || o.cluster || ';a=supp' || a1.sk || ':10011;a=supp' || a1.sk
WHEN '2' THEN 'l=' || la.server_list || '|' || o.dep
WHEN '3' THEN CASE WHEN st <> 'P' THEN 'd=' || ln.server_list END
WHEN '4' THEN '10003/supp' || r2.sk || '%{{dependencies.1.cluster-name}}'
ELSE 'x=supp' || nx.sk || ':' || (10003 + x) || '${{keep}}' END AS text FROM o
LEFT JOIN t a1 ON a1.cluster = o.cluster AND a1.job = 'A' AND a1.task_id = 1
LEFT JOIN lists la ON la.cluster = o.cluster AND la.job = 'A'
LEFT JOIN lists ln ON ln.cluster = o.dep AND ln.job = 'N'
LEFT JOIN t r2 ON r2.cluster = o.dep AND r2.job = 'R' AND r2.task_id = 2
LEFT JOIN t nx ON nx.cluster = o.cluster AND nx.job = 'N' AND nx.task_id = x)
SELECT doc, text IS NOT NULL AS ok, text FROM r""")
def placeholder_resolve(spark, sf):
    rendered = tp.render_templates(
        ad.order_templates(spark, sf), ["doc"], ad.line_tasks(spark, sf), ad.order_dependencies(spark, sf)
    )
    return rendered.select("doc", "ok", "text")


def _lookups(spark, sf, forms):
    found = tp.extract_placeholders(ad.order_templates(spark, sf), ["doc"])
    resolved = tp.resolve_placeholders(
        found.filter(F.col("form").isin(forms)), ad.line_tasks(spark, sf), ad.order_dependencies(spark, sf)
    )
    return resolved.select("doc", "token", "value")


@query("local_attr", f"""WITH {TASKS} SELECT o.doc, '%{{A.1.host}}' AS token, 'supp' || sk AS value FROM o
LEFT JOIN t ON t.cluster = o.cluster AND job = 'A' AND task_id = 1 WHERE p = '1'
UNION ALL SELECT o.doc, '%{{A.1.base_port+10}}' AS token, CASE WHEN sk IS NOT NULL THEN '10011' END AS value FROM o
LEFT JOIN t ON t.cluster = o.cluster AND job = 'A' AND task_id = 1 WHERE p = '1'""")
def local_attr(spark, sf):
    return _lookups(spark, sf, ["attr", "attr_plus"])


@query("host_attr", f"""WITH {TASKS} SELECT o.doc, '%{{N.x.host}}' AS token, 'supp' || sk AS value FROM o
LEFT JOIN t ON t.cluster = o.cluster AND job = 'N' AND task_id = x WHERE p = '5'
UNION ALL SELECT o.doc, '%{{N.x.base_port+3}}' AS token, CASE WHEN sk IS NOT NULL THEN CAST(10003 + x AS VARCHAR) END AS value FROM o
LEFT JOIN t ON t.cluster = o.cluster AND job = 'N' AND task_id = x WHERE p = '5'""")
def host_attr(spark, sf):
    return _lookups(spark, sf, ["host_attr", "host_attr_plus"])


@query("dependency_attr", f"""WITH {TASKS} SELECT o.doc, '%{{dependencies.0.R.2.host}}' AS token, 'supp' || sk AS value FROM o
LEFT JOIN t ON t.cluster = o.dep AND job = 'R' AND task_id = 2 WHERE p = '4'
UNION ALL SELECT o.doc, '%{{dependencies.0.R.2.base_port+1}}' AS token, CASE WHEN sk IS NOT NULL THEN '10003' END AS value FROM o
LEFT JOIN t ON t.cluster = o.dep AND job = 'R' AND task_id = 2 WHERE p = '4'
UNION ALL SELECT doc, '%{{dependencies.0.cluster_name}}' AS token, dep AS value FROM o WHERE p = '2'
UNION ALL SELECT doc, '%{{dependencies.1.cluster_name}}' AS token, NULL AS value FROM o WHERE p = '3' AND st = 'P'""")
def dependency_attr(spark, sf):
    return _lookups(spark, sf, ["dep_attr", "dep_attr_plus", "dep_cluster_name"])


# -- closure --------------------------------------------------------------------------

_EDGES = """edges AS (SELECT 'o/' || o_orderkey AS src, 'c/' || o_custkey AS dst FROM orders
UNION SELECT 'c/' || c_custkey, 'n/' || c_nationkey FROM customer
UNION SELECT 'n/' || n_nationkey, 'n/' || n_regionkey FROM nation)"""
_CLOSURE = f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT src, dst, 1 AS depth FROM edges
UNION SELECT walk.src, edges.dst, depth + 1 FROM walk JOIN edges ON walk.dst = edges.src WHERE depth < 6),
closure AS (SELECT src, dst, min(depth) AS depth FROM walk GROUP BY 1, 2)"""


def _edges(spark, sf):
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return (
        orders.select(_text("o/", F.col("o_orderkey")).alias("src"), _text("c/", F.col("o_custkey")).alias("dst"))
        .unionByName(customer.select(_text("c/", F.col("c_custkey")).alias("src"), _text("n/", F.col("c_nationkey")).alias("dst")))
        .unionByName(nation.select(_text("n/", F.col("n_nationkey")).alias("src"), _text("n/", F.col("n_regionkey")).alias("dst")))
    )


@query("dependency_closure", f"{_CLOSURE} SELECT src, dst, CAST(depth AS BIGINT) AS depth FROM closure")
def dependency_closure(spark, sf):
    return cl.transitive_closure(_edges(spark, sf)).select("src", "dst", F.col("depth").cast("bigint").alias("depth"))


@query("dependency_cycles", f"""{_CLOSURE} SELECT e.src, e.dst, 'cycle' AS reason FROM edges e
WHERE EXISTS (SELECT 1 FROM closure c WHERE c.src = e.dst AND c.dst = e.src)""")
def dependency_cycles(spark, sf):
    edges = _edges(spark, sf)
    return cl.cycle_edges(edges, cl.transitive_closure(edges))


# -- whole documents ------------------------------------------------------------------

@query("doc_validate", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'required key package_md5sum does not exist'
WHEN c_acctbal > 9000 THEN 'main_process is not a string' WHEN c_acctbal > 8000 THEN 'jobs section is not a map'
WHEN c_acctbal > 7000 THEN 'cluster section does not exist' WHEN c_acctbal > 6500 THEN 'not JSON'
WHEN c_acctbal > 6000 THEN 'base is not a string' END AS reason FROM customer""")
def doc_validate(spark, sf):
    b = F.col("c_acctbal")
    cluster = _text(
        '{"project":"p","cluster_name":"', F.col("c_name"), '","package_name":"', F.col("c_mktsegment"), '","main_process":',
        F.when(b > 9000, "7").otherwise('"java"'),
        F.when(b < 0, ',"package_md5sum":null').otherwise(',"package_md5sum":"d4"'), "}",
    )
    value = _text(
        F.when((b > 6500) & (b <= 7000), "{").otherwise(""),
        '{"base":', F.when((b > 6000) & (b <= 6500), "[1]").otherwise('"b.yaml"'),
        F.when((b > 7000) & (b <= 8000), "").otherwise(_text(',"cluster":', cluster)),
        ',"jobs":', F.when((b > 8000) & (b <= 9000), "[]").otherwise("{}"), "}",
    )
    return ly.validate_clusters(table(spark, sf, "customer").select("c_custkey", value.alias("value"))).select(
        "c_custkey", "reason"
    )


_FAULTS = {
    "": [("c_acctbal > 9500", "not JSON")],
    "/base": [("c_custkey % 7 = 1", "not a string")],
    "/cluster": [("c_custkey % 11 = 2", "missing")],
    "/cluster/package_md5sum": [("c_custkey % 11 <> 2 AND c_custkey % 3 = 0", "missing")],
    "/cluster/main_process": [("c_custkey % 11 <> 2 AND c_custkey % 4 = 0", "not a string")],
    "/jobs/web": [("c_custkey % 13 = 5", "not a map")],
    "/jobs/zk/hosts": [("c_custkey % 5 = 0", "an element is neither a string nor an integer")],
    "/jobs/zk/classpath/file": [("c_custkey % 6 = 1", "missing")],
    "/jobs/zk/jvm_opts": [("c_custkey % 8 = 3", "not a list")],
    "/jobs/zk/main_entry/java_class": [("c_custkey % 9 = 4", "not a string")],
    "/jobs/zk/config/a~1b.cfg": [("c_custkey % 10 = 6", "not a list")],
}


@query("doc_validate_all", " UNION ALL ".join(
    f"""SELECT c_custkey AS doc, '{path}' AS path, '{reason}' AS reason FROM customer
WHERE {condition}{" AND c_acctbal <= 9500" if path else ""}""" for path, faults in _FAULTS.items() for condition, reason in faults))
def doc_validate_all(spark, sf):
    k = F.col("c_custkey")

    def at(divisor, rest, broken, sound):
        return F.when(k % divisor == rest, broken).otherwise(sound)

    cluster = _text(
        '"cluster":{"project":"p","cluster_name":"', F.col("c_name"), '","package_name":"x","main_process":', at(4, 0, "7", '"java"'),
        ',"package_md5sum":', at(3, 0, "null", '"d4"'), "},",
    )
    value = _text(
        F.when(F.col("c_acctbal") > 9500, "{").otherwise(""), '{"base":', at(7, 1, "[1]", "null"), ",", at(11, 2, "", cluster),
        '"jobs":{"web":', at(13, 5, "null", "{}"), ',"zk":{"hosts":["h', k, '",', at(5, 0, "{}", "1"), '],"classpath":',
        at(6, 1, "{}", '{"file":"paths.txt"}'), ',"jvm_opts":', at(8, 3, '"-ea"', "[]"), ',"main_entry":{"java_class":', at(9, 4, "true", '"org.x.Main"'),
        '},"config":{"a/b.cfg":', at(10, 6, "1", '["a=1","b=2"]'), ',"none.cfg":null}}}}',
    )
    return validation.validate_documents(table(spark, sf, "customer").select(k.alias("doc"), value.alias("value")))


def _effective(spark, sf):
    none = spark.createDataFrame([], "cluster bigint, ordinal bigint, dep_cluster bigint")
    return plan.effective_config(ad.layer_documents(spark, sf), none, "/agent")


_EFFECTIVE = f"""WITH d AS (SELECT c_custkey AS doc, c_name AS cluster_name FROM customer WHERE c_acctbal >= 0),
k AS (SELECT doc, cluster_name, 'web' AS job, CAST(i AS BIGINT) AS task_id FROM d, (VALUES (0), (1), (2)) AS v(i)),
files AS (SELECT *, 'web.cfg' AS file, CASE WHEN task_id = 1 THEN 'id=1' || chr(10) || 'log=/agent/log' || chr(10) || 'name=' ||
cluster_name || chr(10) || 'port=9102' END AS text FROM k
UNION ALL SELECT *, 'myid' AS file, CAST(task_id AS VARCHAR) AS text FROM k
UNION ALL SELECT *, 'site.xml' AS file, '<configuration>' || {" || ".join(
    f"chr(10) || '  <property>' || chr(10) || '    <name>{n}</name>' || chr(10) || '    <value>' || {v} || '</value>' || chr(10) || '  </property>'"
    for n, v in [("a", "'far'"), ("b", "'h' || doc || ':10000,h' || doc || ':9101,far:10000'"), ("c", "'1'")]
)} || chr(10) || '</configuration>' AS text FROM k)"""


@query("effective_config", f"{_EFFECTIVE} SELECT doc, cluster_name, job, task_id, file, text IS NOT NULL AS ok, text FROM files")
def effective_config(spark, sf):
    return _effective(spark, sf)


@query("config_export", f"""{_EFFECTIVE} SELECT cluster_name AS cluster, job, task_id,
'/agent/' || cluster_name || '/' || job || '.' || task_id || '/conf/' || file AS target, text FROM files WHERE text IS NOT NULL""")
def config_export(spark, sf):
    files = _effective(spark, sf).filter("ok").select(
        F.col("cluster_name").alias("cluster"), "job", "task_id",
        sinks.config_path(F.lit("/agent"), F.col("cluster_name"), F.col("job"), F.col("task_id"), F.col("file")).alias("target"),
        "text",
    )
    path = new_work_dir(spark, "configs")
    sinks.write_configs(files, path)
    return spark.read.schema(files.schema).parquet(path)


@query("effective_files", """WITH d AS (SELECT c_custkey AS doc, c_acctbal AS b, c_nationkey AS n, n_name FROM customer
JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal <= 9000)
SELECT doc, 'app.cfg' AS file, true AS ok, 'peers=[]' AS text FROM d
UNION ALL SELECT doc, 'app.yaml', false, NULL FROM d WHERE b > 8000
UNION ALL SELECT doc, 'log.properties', true, 'level=' || n_name || chr(10) || 'size=1' FROM d WHERE n <> 7""")
def effective_files(spark, sf):
    layers, texts = ad.file_documents(spark, sf)
    none = spark.createDataFrame([], "cluster bigint, ordinal bigint, dep_cluster bigint")
    return plan.effective_config(layers, none, "/agent", texts=texts).select("doc", "file", "ok", "text")


@query("effective_rejects", """SELECT c_custkey AS doc, 'web' AS job, 'nohost' AS item, 'bad address' AS reason FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT c_custkey, 'web', 'app.yaml', 'unknown format' FROM customer WHERE c_acctbal > 8000
UNION ALL SELECT c_custkey, 'web', 'log.properties', 'no such file: /etc/log-7' FROM customer WHERE c_nationkey = 7""")
def effective_rejects(spark, sf):
    return plan.effective_rejects(*ad.file_documents(spark, sf))


_CHAIN = """WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey // 50 AS b FROM customer),
own AS (SELECT k, CASE WHEN k % 331 = 7 THEN 'unknown variable' WHEN k % 331 = 20 THEN 'not JSON'
WHEN k % 331 = 40 THEN 'base is not a string' END AS fault,
CASE WHEN k % 331 IN (7, 20, 40) THEN NULL WHEN k % 50 > 0 THEN k - 1 WHEN b % 7 = 3 THEN k + 49 END AS up,
CASE WHEN k % 331 IN (7, 20, 40) OR k % 50 > 0 OR b % 7 = 3 THEN NULL WHEN b % 11 = 5 THEN '/conf/gone' END AS gone FROM c),
links AS (SELECT k, CASE WHEN up IN (SELECT k FROM c) THEN up END AS up, fault,
CASE WHEN gone IS NOT NULL THEN gone WHEN up IS NOT NULL AND up NOT IN (SELECT k FROM c) THEN '/conf/' || up END AS gone FROM own),
walk AS (SELECT k, 0 AS layer, k AS anc FROM links
UNION ALL SELECT w.k, layer + 1, l.up FROM walk w JOIN links l ON w.anc = l.k WHERE l.up IS NOT NULL AND layer < 60),
circles AS (SELECT DISTINCT k FROM walk WHERE layer = 60),
bad AS (SELECT w.k, '/conf/' || anc AS item, fault AS reason FROM walk w JOIN links l ON w.anc = l.k
WHERE fault IS NOT NULL AND w.k NOT IN (SELECT k FROM circles)
UNION ALL SELECT w.k, '/conf/' || anc, 'no such document: ' || gone FROM walk w JOIN links l ON w.anc = l.k
WHERE gone IS NOT NULL AND w.k NOT IN (SELECT k FROM circles)
UNION ALL SELECT k, '/conf/' || k, 'circle of bases' FROM circles)"""


def _chains(spark, sf):
    return plan.document_layers(ad.chained_documents(spark, sf), {"ConfRootDir": F.lit("/conf")})


@query("config_chain", f"""{_CHAIN} SELECT '/conf/' || k AS doc, CAST(layer AS BIGINT) AS layer, '/conf/' || anc AS path,
'{{"base":' || CASE WHEN up IS NULL THEN 'null' ELSE '"/conf/' || up || '"' END || ',"cluster":{{"n":' || anc || '}}}}' AS value
FROM walk JOIN (SELECT k AS anc, up FROM links) USING (anc) WHERE k NOT IN (SELECT k FROM bad)""")
def config_chain(spark, sf):
    return _chains(spark, sf)[0]


@query("config_chain_rejects", f"{_CHAIN} SELECT '/conf/' || k AS doc, item, reason FROM bad")
def config_chain_rejects(spark, sf):
    return _chains(spark, sf)[1]


def _from_documents(spark, sf):
    wanted = table(spark, sf, "customer").select(_text("/conf/c/", F.col("c_custkey")).alias("doc"))
    return plan.effective_from_documents(ad.raw_documents(spark, sf), {"ConfRootDir": F.lit("/conf")}, "/agent", wanted=wanted)


_HUBS = """hubs AS (SELECT c_custkey AS k, c_name, c_custkey - c_custkey % 10 AS hub FROM customer),
stuck AS (SELECT k FROM hubs h WHERE k % 10 > 0 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = h.hub AND c_acctbal >= 0))"""


@query("effective_from_documents", f"""{_EFFECTIVE}, {_HUBS}, peers AS (SELECT *, 'peer.txt' AS file, h.c_name || '=h' || hub || ':10000,h' || hub || ':9101,far:10000' AS text
FROM k JOIN (SELECT a.k AS doc, a.hub, b.c_name FROM hubs a JOIN hubs b ON a.hub = b.k WHERE a.k % 10 > 0) h USING (doc))
SELECT '/conf/c/' || doc AS doc, cluster_name, job, task_id, file, text IS NOT NULL AS ok, text FROM (
SELECT doc, cluster_name, job, task_id, file, text FROM files UNION ALL SELECT doc, cluster_name, job, task_id, file, text FROM peers)
WHERE doc NOT IN (SELECT k FROM stuck)""")
def effective_from_documents(spark, sf):
    return _from_documents(spark, sf)[0]


@query("document_rejects", f"""WITH {_HUBS} SELECT '/conf/c/' || c_custkey AS doc, '/jobs/web/hosts' AS item, 'kind conflict' AS reason FROM customer WHERE c_acctbal < 0
UNION ALL SELECT '/conf/c/' || k, '/conf/c/' || hub, 'dependency is not there' FROM stuck JOIN hubs USING (k)
JOIN customer ON c_custkey = k WHERE c_acctbal >= 0""")
def document_rejects(spark, sf):
    return _from_documents(spark, sf)[1]


@query("task_commands", """SELECT c_custkey AS doc, 'web' AS job, CAST(i AS BIGINT) AS task_id, CASE WHEN i = 2 THEN 'far' ELSE 'h' || c_custkey END AS host,
'/usr/bin/java -Xmx' || c_custkey || 'm -server -verbose -ea -Da=1 -Dk=' || c_custkey || ' -cp lib/*:conf' ||
CASE WHEN c_custkey % 5 > 0 THEN ' org.x.Main start now' ELSE '' END AS args FROM customer, (VALUES (0), (1), (2)) AS v(i) WHERE c_acctbal >= 0""")
def task_commands(spark, sf):
    leaves = stage(plan.merged_leaves(ad.program_documents(spark, sf))[0], "merged")
    return programs.task_commands(leaves).select("doc", "job", "task_id", "host", F.array_join("args", " ").alias("args"))


@query("config_corpus_scan", """SELECT 'n' || s_nationkey AS project, s_name AS cluster_name, 's' || s_suppkey AS job,
'h' || s_suppkey || ':9001/id=0' AS first_host, true AS parsed, count(*) AS documents FROM supplier WHERE s_acctbal >= 0 GROUP BY 1, 2, 3, 4
UNION ALL SELECT 'n' || s_nationkey AS project, NULL, NULL, NULL, false AS parsed, count(*) AS documents FROM supplier WHERE s_acctbal < 0 GROUP BY 1""")
def config_corpus_scan(spark, sf):
    # JSON documents, one to a line, landed in files one folder below a root. A negative balance
    # leaves a bracket open.
    key = F.col("s_suppkey")
    value = _text(
        '{"cluster":{"cluster_name":"', F.col("s_name"), '"},"jobs":{"s', key, '":{"hosts":["h', key, ':9001/id=0","h', key, ':9001/id=1"]',
        F.when(F.col("s_acctbal") < 0, "").otherwise("}}}"),
    )
    root = new_work_dir(spark, "corpus")
    texts = table(spark, sf, "supplier").select(_text("n", F.col("s_nationkey")).alias("project"), value.alias("value"))
    # A project's documents are dealt over some files, however many it has.
    dealt = texts.repartition("project", F.pmod(F.xxhash64("value"), F.lit(4)))
    dealt.write.partitionBy("project").text(root)
    lines = docs.read_corpus_lines(spark, root)
    v = F.try_parse_json("value")
    job = F.get(F.map_keys(F.try_variant_get(v, "$.jobs", "map<string,variant>")), F.lit(0))
    hosts = F.map_values(F.try_variant_get(v, "$.jobs", "map<string,struct<hosts:array<string>>>"))
    fields = lines.select(
        F.split_part("project", F.lit("="), F.lit(2)).alias("project"),
        F.try_variant_get(v, "$.cluster.cluster_name", "string").alias("cluster_name"),
        job.alias("job"), F.get(F.get(hosts, F.lit(0))["hosts"], F.lit(0)).alias("first_host"), v.isNotNull().alias("parsed"),
    )
    return fields.groupBy(*fields.columns).agg(F.count("*").alias("documents"))
