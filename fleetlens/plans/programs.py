"""P20 from documents: the command line of every task out of merged document leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import ordered, text as tf
from fleetlens.plans import config

# Where the parts of a command line stand. Class paths are one argument, main process and entry are scalars.
MAIN, OPTION, PROPERTY, PATHS, ENTRY, EXTRA = range(6)
SECTIONS = {"jvm_opts": OPTION, "jvm_properties": PROPERTY, "classpath": PATHS}


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def inherited_items(leaves: DataFrame) -> DataFrame:
    """U2 on rows: (doc, job, section, side, layer, pos, value) of the lists of every job, its own items
    (side 0) in order and after them once each item of its parent (side 1) that it lacks.

    Only one level is inherited. Items of the parent are combined to their first place before they meet
    the job's own, so no list is ever held as one.
    """
    jobs = config.job_leaves(leaves)
    items = jobs.filter(F.col("section").isin(*SECTIONS) & (F.col("kind") == "list") & F.col("pos").isNotNull()).select(
        "doc", "job", "section", "layer", "pos", "value")
    parents = jobs.filter((F.col("section") == "super_job") & (F.col("kind") == "scalar")).select("doc", "job", F.col("value").alias("parent"))
    first = items.groupBy("doc", F.col("job").alias("parent"), "section", "value").agg(F.min(F.struct("layer", "pos")).alias("at"))
    lacking = parents.join(first, ["doc", "parent"]).join(items.select("doc", "job", "section", "value"), ["doc", "job", "section", "value"], "left_anti")
    own = items.withColumn("side", F.lit(0))
    return own.unionByName(lacking.select("doc", "job", "section", F.lit(1).alias("side"), F.col("at.layer").alias("layer"), F.col("at.pos").alias("pos"), "value"))


def job_arguments(leaves: DataFrame) -> DataFrame:
    """(doc, job, args): the command line of every declared job as ``array<string>``, in the order main
    process, options, -D properties, -cp and the paths, main class, extra arguments."""
    items = inherited_items(leaves).withColumn("value", _trimmed(F.col("value"))).filter("value <> ''")
    rank = F.coalesce(*[F.when(F.col("section") == name, part) for name, part in SECTIONS.items()])
    at = F.struct(rank.alias("part"), "side", "layer", "pos")
    plain = items.filter(rank != PATHS).select(
        "doc", "job", at.alias("at"), F.when(rank == PROPERTY, F.concat(F.lit("-D"), "value")).otherwise(F.col("value")).alias("value"))

    def placed(part: int, pos: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("layer"), pos.cast("bigint").alias("pos"))

    paths = ordered.ordered_concat(
        items.filter(rank == PATHS), ["doc", "job"], F.struct("side", "layer", "pos"),
        F.struct("side", "layer", F.floor(F.col("pos") / ordered.CHUNK).alias("chunk")), F.col("value"), ":", "paths")
    class_path = paths.select("doc", "job", F.posexplode(F.array(F.lit("-cp"), "paths")).alias("pos", "value")).select(
        "doc", "job", placed(PATHS, F.col("pos")).alias("at"), "value")

    jobs = config.declared_jobs(leaves).withColumnRenamed("cluster", "doc")
    process = config.cluster_fields(leaves).filter(F.col("main_process").isNotNull()).select("doc", "main_process")
    started = jobs.join(process, "doc").select("doc", "job", placed(MAIN, F.lit(0)).alias("at"), F.col("main_process").alias("value"))

    entry = config.job_leaves(leaves).filter((F.col("section") == "main_entry") & (F.col("kind") == "scalar"))
    words = entry.withColumn("words", F.when(F.col("item") == "java_class", F.array(F.trim("value"))).when(
        F.col("item") == "extra_args", F.split("value", " ")))
    said = words.select("doc", "job", "item", F.posexplode("words").alias("pos", "value")).filter("value <> ''").select(
        "doc", "job", F.when(F.col("item") == "java_class", placed(ENTRY, F.col("pos"))).otherwise(placed(EXTRA, F.col("pos"))).alias("at"), "value")

    every = plain.unionByName(class_path).unionByName(started).unionByName(said)
    lines = every.groupBy("doc", "job").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("cells"))
    return lines.select("doc", "job", F.col("cells.value").alias("args"))


def task_commands(leaves: DataFrame) -> DataFrame:
    """P20: (doc, job, task_id, host, args) of every task of the merged documents."""
    tasks, _ = config.task_rows(leaves)
    return tasks.select("doc", "job", "task_id", "host").join(job_arguments(leaves), ["doc", "job"])
