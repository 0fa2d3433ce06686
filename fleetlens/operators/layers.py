"""Layered documents: overlay merge (X1), list unions (U1, U2), validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ordered_union(upper: Column, lower: Column) -> Column:
    """The upper list, then the lower items it lacks; repeats inside the lower list stay."""
    return F.concat(upper, F.filter(lower, lambda x: ~F.array_contains(upper, x)))


def inherit_union(child: Column, parent: Column) -> Column:
    """The child list, then each missing parent item once, in order."""
    return F.concat(child, F.array_except(parent, child))


# Codes in a BIGINT with the layer, so that the winner of a path is a plain hash aggregate.
_KIND_CODE = {"map": 0, "list": 1, "scalar": 2}


def _code(kind: Column) -> Column:
    out = None
    for name, code in _KIND_CODE.items():
        out = F.when(kind == name, code) if out is None else out.when(kind == name, code)
    return out


def overlay(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge the layers of each document; layer 0 is the nearest and wins.

    ``leaves`` has (doc, layer, path, kind, pos, value). Returns the merged rows, still with
    layer and pos (list order is layer, then pos), and the rejects (doc, path, reason).
    The nearest non-null layer fixes the kind of a path. A farther map or list of another
    kind rejects the document; a farther scalar under a map or list is ignored.

    Two aggregates, per path and per list item, are joined back to the rows. There is no
    window: a very long list or a path of very many layers is combined before the shuffle,
    and its join partition can be split.
    """
    kind = F.col("kind")
    paths = leaves.groupBy("doc", "path").agg(
        F.min(F.col("layer") * 4 + _code(kind)).alias("won"),
        F.max(kind == "map").alias("has_map"),
        F.max(kind == "list").alias("has_list"),
        F.max(kind == "error").alias("has_error"),
    )
    won_kind = F.col("won") % 4
    clash = (F.col("has_map") & (won_kind != 0)) | (F.col("has_list") & (won_kind != 1))
    rejects = paths.filter(F.col("has_error") | clash).select(
        "doc", "path", F.when(F.col("has_error"), "bad value").otherwise("kind conflict").alias("reason")
    )
    # An item belongs to the nearest layer that has it.
    items = leaves.filter((kind == "list") & F.col("pos").isNotNull())
    nearest = items.groupBy("doc", "path", "value").agg(F.min("layer").alias("item_layer"))
    judged = leaves.filter(kind.isin(list(_KIND_CODE))).join(
        paths.select("doc", "path", won_kind.alias("won_kind"), F.floor(F.col("won") / 4).alias("won_layer")),
        ["doc", "path"],
    ).join(nearest, ["doc", "path", "value"], "left")
    is_item = (kind == "list") & F.col("pos").isNotNull()
    kept = judged.filter(
        (_code(kind) == F.col("won_kind"))
        & F.when(is_item, F.col("layer") == F.col("item_layer")).otherwise(F.col("layer") == F.col("won_layer"))
    )
    bad = rejects.select("doc").distinct()
    return kept.select(*leaves.columns).join(bad, "doc", "left_anti"), rejects


# The fields every cluster document must have.
REQUIRED_FIELDS = ["project", "cluster_name", "main_process", "package_name", "package_md5sum"]


def validate_clusters(docs: DataFrame, value: str = "value") -> DataFrame:
    """adds ``reason``, NULL for a valid cluster document, else the first failed check.

    ``value`` is merged document JSON. Narrow: the document is parsed once per row.
    """
    v = F.try_parse_json(value)

    def at(path: str) -> Column:
        return F.try_variant_get(F.col("__v"), path, "variant")

    def kind(path: str) -> Column:
        return F.regexp_extract(F.schema_of_variant(at(path)), "^[A-Z]+", 0)

    def absent(path: str) -> Column:
        return at(path).isNull() | (kind(path) == "VOID")

    reason = F.when(F.col("__v").isNull(), "not JSON").when(
        ~absent("$.base") & (kind("$.base") != "STRING"), "base is not a string"
    ).when(absent("$.cluster"), "cluster section does not exist").when(
        kind("$.cluster") != "OBJECT", "cluster section is not a map"
    )
    for field in REQUIRED_FIELDS:
        path = f"$.cluster.{field}"
        reason = reason.when(absent(path), f"required key {field} does not exist").when(
            kind(path) != "STRING", f"{field} is not a string"
        )
    reason = reason.when(absent("$.jobs"), "jobs section does not exist").when(
        kind("$.jobs") != "OBJECT", "jobs section is not a map"
    )
    return docs.withColumn("__v", v).withColumn("reason", reason).drop("__v")
