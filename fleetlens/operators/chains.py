"""The chain of base documents above every document, as ordered layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.session import stage


def ancestor_layers(links: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc, base), one row per document, to (doc, layer, ancestor) and the documents (doc) that reach a cycle.

    Layer 0 is the document itself, layer 1 its base, and so on; a base that is no document ends
    its chain. ``wanted`` (doc) are the documents to list, all if not given; those that reach a cycle
    are never listed.

    Pointers are doubled: round k joins every document's ancestor 2^k steps up to that one's, so a
    chain of n documents takes log n rounds, and each round's table shrinks to the documents that
    far from their end. Among documents without a cycle some end lies in every round, so a round
    that loses no document has only those that run in circles. The layers are then spread from the
    longest jumps down, which makes each (doc, layer) once. The side that is looked up has one row
    per document, so a base that everything shares adds no rows, and its partition can be split.
    """
    known = links.select(F.col("doc").alias("base"))
    steps = stage(links.join(known, "base", "left_semi").select("doc", F.col("base").alias("up")), "jump")
    jumps, size, circling = [], steps.count(), None
    while size:
        jumps.append(steps)
        twice = steps.select("doc", F.col("up").alias("via")).join(steps.select(F.col("doc").alias("via"), "up"), "via")
        steps = stage(twice.select("doc", "up"), "jump")
        left = steps.count()
        if left == size:
            circling = steps.select("doc")
            break
        size = left
    circling = links.select("doc").filter(F.lit(False)) if circling is None else circling

    start = links.select("doc") if wanted is None else links.select("doc").join(wanted.select("doc").distinct(), "doc", "left_semi")
    rows = start.join(circling, "doc", "left_anti").select("doc", F.lit(0).cast("bigint").alias("layer"), F.col("doc").alias("ancestor"))
    for k in reversed(range(len(jumps))):
        farther = rows.join(jumps[k].select(F.col("doc").alias("ancestor"), "up"), "ancestor").select(
            "doc", (F.col("layer") + (1 << k)).alias("layer"), F.col("up").alias("ancestor"))
        rows = stage(rows.unionByName(farther), "layers")
    return rows, circling
