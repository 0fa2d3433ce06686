"""From layered cluster documents to the effective files of every task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import text as tf
from fleetlens.operators import chains, closure, jobs as jb, layers, templates as tp
from fleetlens.session import stage
from fleetlens.sources.documents import flatten_documents
from fleetlens.sources.payloads import clean_lines


def document_layers(
    documents: DataFrame, variables: Mapping[str, Column], wanted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Raw documents (path, value) to their layers (doc, layer, path, value), nearest
    first, and the rejects (doc, item, reason).

    Variables are filled in before a document is parsed, so a base may be named by one. A document
    is left out as a whole if it or any of its bases has an unknown variable, is no JSON, names a
    base that is no string or doesn't exist, or if its bases run in a circle. ``wanted`` (doc) are
    the paths to list. Only paths travel through the rounds; the texts meet their layers at the end.
    """
    filled = documents.select("path", tp.substitute_env(F.col("value"), variables).alias("value"))
    parsed = F.try_parse_json("value")
    base = F.try_variant_get(parsed, F.lit("$.base"), "variant")
    kind = F.regexp_extract(F.schema_of_variant(base), "^[A-Z]+", 0)
    has_base = base.isNotNull() & (kind != "VOID")
    read = stage(filled.select(
        F.col("path").alias("doc"), F.when(has_base & (kind == "STRING"), base.cast("string")).alias("base"),
        F.when(F.col("value").isNull(), "unknown variable").when(parsed.isNull(), "not JSON")
        .when(has_base & (kind != "STRING"), "base is not a string").alias("fault"),
    ), "documents")
    rows, circling = chains.ancestor_layers(read.select("doc", "base"), wanted)
    missing = read.filter(F.col("base").isNotNull()).join(
        read.select(F.col("doc").alias("base")), "base", "left_anti"
    ).select("doc", F.concat(F.lit("no such document: "), "base").alias("fault"))
    faults = read.filter(F.col("fault").isNotNull()).select("doc", "fault").unionByName(missing)
    spoiled = rows.join(faults.select(F.col("doc").alias("ancestor"), "fault"), "ancestor").select(
        "doc", F.col("ancestor").alias("item"), F.col("fault").alias("reason"))
    if wanted is not None:
        circling = circling.join(wanted.select("doc"), "doc", "left_semi")
    rejects = stage(spoiled.unionByName(circling.select("doc", F.col("doc").alias("item"), F.lit("circle of bases").alias("reason"))), "rejects")
    good = rows.join(rejects.select("doc").distinct(), "doc", "left_anti")
    texts = filled.select(F.col("path").alias("ancestor"), "value")
    return good.join(texts, "ancestor").select("doc", "layer", F.col("ancestor").alias("path"), "value"), rejects


def declared_dependencies(leaves: DataFrame) -> DataFrame:
    """(cluster, ordinal, dep_cluster) of the dependency lists of merged documents, in list order."""
    listed = leaves.filter((F.col("path") == "/cluster/dependencies") & (F.col("kind") == "list") & F.col("pos").isNotNull())
    lists = listed.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("layer", "pos", "value"))).alias("items"))
    return lists.select(F.col("doc").alias("cluster"), F.posexplode("items").alias("ordinal", "item")).select(
        "cluster", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("item.value").alias("dep_cluster"))


def unloadable(clusters: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(doc, item, reason) of the ``clusters`` (doc) that depend, over however many steps, on something
    that is none of them or on themselves."""
    edges = dependencies.select(F.col("cluster").alias("src"), F.col("dep_cluster").alias("dst"))
    reached = closure.transitive_closure(edges)
    absent = reached.join(clusters.select(F.col("doc").alias("dst")), "dst", "left_anti").select(
        F.col("src").alias("doc"), F.col("dst").alias("item"), F.lit("dependency is not there").alias("reason"))
    own = reached.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("dst"))
    around = reached.join(own, "dst", "left_semi").select(
        F.col("src").alias("doc"), F.col("dst").alias("item"), F.lit("circle of dependencies").alias("reason"))
    return absent.unionByName(around)


def merged_leaves(layer_docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, layer, value JSON) -> (merged leaf rows, rejects)."""
    return layers.overlay(flatten_documents(layer_docs))


def cluster_fields(leaves: DataFrame) -> DataFrame:
    """One row per document with the fields of its cluster section."""
    fields = leaves.filter((F.col("kind") == "scalar") & F.col("path").startswith("/cluster/")).withColumn(
        "field", tf.pointer_part(F.col("path"), 2)
    )
    return fields.groupBy("doc").agg(*[
        F.max(F.when(F.col("field") == name, F.col("value"))).alias(name) for name in layers.REQUIRED_FIELDS
    ])


def job_leaves(leaves: DataFrame) -> DataFrame:
    """The leaves below ``/jobs``, with job, section and item out of their paths."""
    return leaves.filter(F.col("path").startswith("/jobs/")).select(
        "doc", tf.pointer_part(F.col("path"), 2).alias("job"),
        tf.pointer_part(F.col("path"), 3).alias("section"),
        tf.pointer_part(F.col("path"), 4).alias("item"),
        "layer", "kind", "pos", "value", F.col("path").alias("leaf_path"),
    )


def declared_jobs(leaves: DataFrame) -> DataFrame:
    """(cluster, job) of every job section, with or without hosts."""
    return job_leaves(leaves).filter(F.col("job") != "").select(F.col("doc").alias("cluster"), "job").distinct()


def effective_rejects(layer_docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc, job, item, reason) of what ``effective_config`` leaves out: documents that don't
    merge, hosts that don't parse, files that are missing, and files that have no text."""
    merged, bad = merged_leaves(layer_docs)
    leaves = stage(merged, "merged")
    none = F.lit(None).cast("string")
    _, hosts = task_rows(leaves)
    references = file_references(leaves)
    missing = references if texts is None else references.join(texts.select("path").distinct(), "path", "left_anti")
    files = job_files(leaves, texts).filter(F.col("text").isNull())
    return (
        bad.select("doc", none.alias("job"), F.col("path").alias("item"), "reason")
        .unionByName(hosts.select("doc", "job", F.col("endpoint").alias("item"), "reason"))
        .unionByName(missing.select("doc", "job", "item", F.concat(F.lit("no such file: "), "path").alias("reason")))
        .unionByName(files.select("doc", "job", F.col("file").alias("item"), F.when(
            tf.config_format(F.col("file")).isNull(), "unknown format").otherwise("line without =").alias("reason")))
    )


def task_rows(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, job, task_id, host, agent_port, base_port, attributes) of every ``hosts`` entry;
    the second frame has the entries that do not parse."""
    hosts = job_leaves(leaves).filter(
        (F.col("section") == "hosts") & (F.col("kind") == "list") & F.col("pos").isNotNull()
    )
    parsed = hosts.select("doc", "job", F.col("value").alias("endpoint"), tf.parse_endpoint(F.col("value")).alias("e"))
    good = parsed.filter(F.col("e.error").isNull()).select("doc", "job", "e.*").drop("error")
    return good, parsed.filter(F.col("e.error").isNotNull()).select(
        "doc", "job", "endpoint", F.col("e.error").alias("reason")
    )


def file_references(leaves: DataFrame) -> DataFrame:
    """(doc, job, section, item, layer, path) of every ``{file: path}`` that stands for a list."""
    return job_leaves(leaves).withColumn("part", tf.pointer_part(F.col("leaf_path"), 5)).filter(
        (F.col("section") == "config") & (F.col("kind") == "scalar") & (F.col("part") == "file")
    ).select("doc", "job", "section", "item", "layer", F.col("value").alias("path"))


def config_lines(leaves: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc, job, file, layer, pos, line) of every ``config`` entry; an empty file has one row
    with NULL line. ``texts`` (path, value) holds the files that ``{file: path}`` entries name."""
    listed = job_leaves(leaves).filter((F.col("section") == "config") & (F.col("kind") == "list")).select(
        "doc", "job", F.col("item").alias("file"), "layer", "pos", F.col("value").alias("line")
    )
    if texts is None:
        return listed
    lines = clean_lines(texts.select("path", "value")).select("path", "pos", "line")
    # A file that exists without a line left stands for an empty list.
    found = file_references(leaves).join(texts.select("path").distinct(), "path").join(lines, "path", "left")
    return listed.unionByName(found.select("doc", "job", F.col("item").alias("file"), "layer", F.col("pos").cast("bigint").alias("pos"), "line"))


def job_files(leaves: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The files of each job with those of its parent merged in, rendered: (doc, job, file, text)."""
    lines = config_lines(leaves, texts).withColumn("pos", F.coalesce("pos", F.lit(0)))
    own = lines.select("doc", "job", "file", F.lit(0).alias("side"), "layer", "pos", "line")
    # Read from the leaves, so that a job without files of its own inherits too.
    heirs = job_leaves(leaves).filter((F.col("section") == "super_job") & (F.col("kind") == "scalar")).select(
        "doc", "job", F.col("value").alias("parent")
    )
    inherited = heirs.join(own.withColumnRenamed("job", "parent"), ["doc", "parent"]).select(
        "doc", "job", "file", F.lit(1).alias("side"), "layer", "pos", "line"
    )
    return jb.render_files(jb.merge_config_sets(own.unionByName(inherited), ["doc", "job"]), ["doc", "job"])


def effective_config(
    layer_docs: DataFrame, dependencies: DataFrame, agent_root: str, skip_host: bool = False,
    texts: DataFrame | None = None,
) -> DataFrame:
    """(doc, job, task_id, target, ok, text), one row per task and file.

    ``layer_docs``: (doc, layer, value); ``dependencies``: (cluster, ordinal, dep_cluster)
    over document ids; ``texts``: (path, value) of the files that ``{file: path}`` entries name.
    ``effective_rejects`` has what is left out. Overlay, inheritance, rendering, placeholders and runtime variables
    run as joins over all documents at once.
    """
    merged, _ = merged_leaves(layer_docs)
    return _rendered(stage(merged, "merged"), dependencies, agent_root, skip_host, texts)


def effective_from_documents(
    documents: DataFrame, variables: Mapping[str, Column], agent_root: str, wanted: DataFrame | None = None,
    skip_host: bool = False, texts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """X8 from raw documents (path, value): the frame of ``effective_config``, and the rejects (doc, item, reason).

    X2, the base chain, the overlay and the dependencies that the documents themselves declare are
    composed. ``wanted`` (doc) must hold the dependencies too. As a document that can't be loaded
    can't be depended on, the documents above it are rejected with it.
    """
    layer_docs, unread = document_layers(documents, variables, wanted)
    merged, clashes = merged_leaves(layer_docs.select("doc", "layer", "value"))
    leaves = stage(merged, "merged")
    # Every document that merges has the row of its root.
    clusters = leaves.filter((F.col("path") == "") & (F.col("layer") == 0)).select("doc").distinct()
    dependencies = stage(declared_dependencies(leaves), "dependencies")
    stuck = stage(unloadable(clusters, dependencies), "stuck")
    loaded = leaves.join(stuck.select("doc").distinct(), "doc", "left_anti")
    rejects = unread.unionByName(clashes.select("doc", F.col("path").alias("item"), "reason")).unionByName(stuck)
    return _rendered(loaded, dependencies, agent_root, skip_host, texts), rejects


def _rendered(leaves: DataFrame, dependencies: DataFrame, agent_root: str, skip_host: bool, texts: DataFrame | None) -> DataFrame:
    tasks, _ = task_rows(leaves)
    files = stage(job_files(leaves, texts), "files")
    fleet = tasks.withColumnRenamed("doc", "cluster")
    rendered = files.join(tasks.select("doc", "job", "task_id"), ["doc", "job"]).withColumn(
        "cluster", F.col("doc")
    )
    names = cluster_fields(leaves).select("doc", "cluster_name")
    filled = tp.render_templates(
        rendered, ["doc", "job", "file", "task_id"], fleet, dependencies,
        jobs=declared_jobs(leaves), names=names.withColumnRenamed("doc", "cluster"), skip_host=skip_host,
    )
    root = F.lit(agent_root)

    def runtime(text: Column) -> Column:
        return tp.runtime_vars(text, root, F.col("task_id"))

    return filled.join(names, "doc", "left").select(
        "doc", "cluster_name", "job", "task_id", runtime(F.col("file")).alias("file"),
        (F.col("ok") & F.col("text").isNotNull()).alias("ok"), runtime(F.col("text")).alias("text"),
    )
