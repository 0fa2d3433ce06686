"""F7 as a rule table: every failure of every document at once, out of its leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.operators.layers import REQUIRED_FIELDS
from fleetlens.sources.documents import flatten_documents

# What a document must look like, as (shape, allowed kinds, whether it must be there
# wherever its parent is a map). A star stands for the name of a job or of a configuration file.
# A list may also be a map that names a file to read its items from.
TEXT, MAP, LIST = ["scalar"], ["map"], ["list", "map"]
RULES: list[tuple[str, list[str], bool]] = [
    ("", MAP, False),
    ("/base", TEXT, False),
    ("/cluster", MAP, True),
    *[(f"/cluster/{field}", TEXT, True) for field in REQUIRED_FIELDS],
    ("/jobs", MAP, True),
    ("/jobs/*", MAP, False),
    ("/jobs/*/super_job", TEXT, False),
    ("/jobs/*/jvm_opts", LIST, False),
    ("/jobs/*/jvm_opts/file", TEXT, True),
    ("/jobs/*/jvm_properties", LIST, False),
    ("/jobs/*/jvm_properties/file", TEXT, True),
    ("/jobs/*/classpath", LIST, False),
    ("/jobs/*/classpath/file", TEXT, True),
    ("/jobs/*/hosts", LIST, False),
    ("/jobs/*/hosts/file", TEXT, True),
    ("/jobs/*/config", MAP, False),
    ("/jobs/*/config/*", LIST, False),
    ("/jobs/*/config/*/file", TEXT, True),
    ("/jobs/*/main_entry", MAP, False),
    ("/jobs/*/main_entry/java_class", TEXT, False),
    ("/jobs/*/main_entry/extra_args", TEXT, False),
]
# A job may not be null; what else is null counts as not there.
NEVER_NULL = ["", "/jobs/*"]


def rule_table(spark: SparkSession) -> DataFrame:
    """(shape, parent, name, allowed, required); fixed in size."""
    rows = [(shape, *shape.rpartition("/")[::2], allowed, required) for shape, allowed, required in RULES]
    return spark.createDataFrame(rows, "shape string, parent string, name string, allowed array<string>, required boolean")


def shape_of(path: Column) -> Column:
    """A leaf's path with stars for the names of jobs and of configuration files."""
    job = F.regexp_replace(path, "^/jobs/[^/]*", "/jobs/*")
    return F.regexp_replace(job, r"^/jobs/\*/config/[^/]*", "/jobs/*/config/*")


def document_nodes(leaves: DataFrame) -> DataFrame:
    """(doc, path, shape, kind, broken): one row for each place that a rule speaks of. ``broken`` tells
    of a list element that is neither a string nor an integer. Lists are combined before the shuffle."""
    shapes = [shape for shape, _, _ in RULES]
    known = leaves.withColumn("shape", shape_of(F.col("path"))).filter(F.col("shape").isin(shapes))
    element = F.col("pos").isNotNull()
    return known.groupBy("doc", "path", "shape").agg(
        F.min(F.when(element, "list").otherwise(F.col("kind"))).alias("kind"),
        F.max(element & (F.col("kind") == "error")).alias("broken"))


def validate_documents(docs: DataFrame, value: str = "value") -> DataFrame:
    """(doc, path, reason) of every rule that a merged document (doc, value) breaks.

    Wrong kinds come from a join of the leaves with the rules; what is missing from an anti-join of
    what the maps must hold with what is there. Below a place that is no map nothing is missed. A
    document without a row is valid.
    """
    rules = F.broadcast(rule_table(docs.sparkSession))
    nodes = document_nodes(flatten_documents(docs, value, typed=True))
    is_null = (F.col("kind") == "null") & ~F.col("shape").isin(NEVER_NULL)
    wrong = ~F.array_contains("allowed", F.col("kind")) & ~is_null
    expected = F.when(F.array_contains("allowed", F.lit("list")), "not a list").when(
        F.array_contains("allowed", F.lit("map")), "not a map").otherwise("not a string")
    reason = F.when(F.col("kind") == "error", "not JSON").when(wrong, expected).when(
        F.col("broken"), "an element is neither a string nor an integer")
    bad = nodes.join(rules.select("shape", "allowed"), "shape").select("doc", "path", reason.alias("reason")).filter("reason IS NOT NULL")

    maps = nodes.filter(F.col("kind") == "map").select("doc", "path", F.col("shape").alias("parent"))
    needed = maps.join(rules.filter("required").select("parent", "name"), "parent").select(
        "doc", F.concat_ws("/", "path", "name").alias("path"))
    there = nodes.filter(F.col("kind") != "null").select("doc", "path")
    missing = needed.join(there, ["doc", "path"], "left_anti").select("doc", "path", F.lit("missing").alias("reason"))
    return bad.unionByName(missing)
