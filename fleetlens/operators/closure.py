"""Everything a document reaches through base files or dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.session import new_work_dir


def transitive_closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth) with the least depth, nearest first; stops by itself on cycles.

    Each round extends only the pairs found in the round before and keeps the new ones, so
    a cycle adds nothing. The rounds are written to the shared folder: the plan stays short
    and a lost executor does not replay them. The driver sees one flag per round. Base
    chains are a few steps long, and so is the loop.
    """
    spark = edges.sparkSession
    root = new_work_dir(spark, "closure")
    steps = edges.select("src", "dst").distinct()

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    steps = stored(steps, "edges")
    known = frontier = steps.withColumn("depth", F.lit(1))
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        longer = (
            frontier.select("src", F.col("dst").alias("via"))
            .join(steps.select(F.col("src").alias("via"), "dst"), "via")
            .select("src", "dst").distinct()
            .join(known, ["src", "dst"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = stored(longer, f"depth={depth}")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def cycle_edges(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Edges that lie on a cycle (the target reaches the source again): rejects of a base chain."""
    back = closure.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return edges.select("src", "dst").distinct().join(back, ["src", "dst"], "left_semi").select(
        "src", "dst", F.lit("cycle").alias("reason")
    )
