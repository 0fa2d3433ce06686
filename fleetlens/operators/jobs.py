"""Jobs: inheritance (J2, U2), config files (X3, U4, X4, X5), argument vectors (P20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import ordered, text as tf
from fleetlens.operators.layers import inherit_union

INHERITED = ["jvm_opts", "jvm_properties", "classpath"]


def inherit_jobs(jobs: DataFrame) -> DataFrame:
    """Each job with the lists of its parent in the same cluster united in, one level deep.

    ``jobs``: (cluster, job, super_job, jvm_opts, jvm_properties, classpath, ...). A parent that
    is not in the cluster changes nothing. A popular parent is a hot join key on the child
    side only, which adaptive execution can split.
    """
    parents = jobs.select(
        F.col("cluster").alias("p_cluster"), F.col("job").alias("p_job"),
        *[F.col(c).alias(f"p_{c}") for c in INHERITED],
    )
    joined = jobs.join(
        parents, (F.col("cluster") == F.col("p_cluster")) & (F.col("super_job") == F.col("p_job")), "left"
    )
    empty = F.array().cast("array<string>")

    def united(name: str) -> Column:
        own = F.coalesce(F.col(name), empty)
        parent = F.coalesce(F.col(f"p_{name}"), empty)
        return F.when(F.col("p_job").isNotNull(), inherit_union(own, parent)).otherwise(own)

    return joined.select(*[united(c).alias(c) if c in INHERITED else F.col(c) for c in jobs.columns])


# -- key/value files ------------------------------------------------------------------

def split_pairs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``k=v`` at the first ``=`` into columns key and value; (good rows, bad rows)."""
    at = F.instr("line", "=")
    pairs = lines.select(
        *lines.columns,
        F.expr("substring(line, 1, instr(line, '=') - 1)").alias("key"),
        F.expr("substring(line, instr(line, '=') + 1)").alias("value"),
    )
    return pairs.filter(at > 0), lines.filter(at == 0)


def collapse_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One value per key of a file, the last in (layer, pos) order."""
    return pairs.groupBy(*keys, "key").agg(F.max_by("value", F.struct("layer", "pos")).alias("value"))


def merge_pairs(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key by key union where the child's value wins. Both sides have one row per key;
    a union and one aggregate take the place of a full outer join."""
    ranked = child.select(*keys, "key", "value", F.lit(0).alias("rank")).unionByName(
        parent.select(*keys, "key", "value", F.lit(1).alias("rank"))
    )
    return ranked.groupBy(*keys, "key").agg(F.min_by("value", "rank").alias("value"))


def merge_config_sets(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U4: the files of a child job (side 0) and its parent (side 1) as one set of lines.

    ``lines``: (keys..., file, side, layer, pos, line). A file of one side stays as it is; a
    file of both sides is merged by its format: key by key for ini and xml, child lines then
    parent lines for plain. Output: (keys..., file, format, merged, side, layer, pos, line);
    a merged pair keeps the place of the line that won. A NULL line stands for an empty file.

    One aggregate merges all files: pairs to be merged meet under their key, any other line
    is its own group.
    """
    scope = [*keys, "file"]
    sides = lines.groupBy(*scope).agg((F.min("side") != F.max("side")).alias("shared"))
    line = F.col("line")
    tagged = lines.withColumn("format", tf.config_format(F.col("file"))).join(sides, scope)
    merged = F.col("shared") & F.col("format").isin("ini", "xml")
    pair = merged & (F.instr(line, "=") > 0)
    own_place = F.when(~F.coalesce(pair, F.lit(False)), F.struct("side", "layer", "pos"))
    # Inside one side the last line of a key wins, and the child side wins over the parent.
    strength = F.struct((-F.col("side")).alias("s"), F.col("layer"), F.col("pos"))
    place = F.struct("side", "layer", "pos", "line")
    grouped = tagged.groupBy(
        *scope, "format", merged.alias("merged"),
        F.when(pair, F.substring_index("line", "=", 1)).otherwise(line).alias("name"), own_place.alias("own"),
    ).agg(F.max_by(place, strength).alias("w"), F.count("*").cast("int").alias("n"))
    # Equal lines at one place are a repeated line, not one line.
    times = F.when(F.col("own").isNull(), 1).otherwise(F.col("n"))
    repeated = grouped.select(*scope, "format", "merged", F.explode(F.array_repeat("w", times)).alias("w"))
    return repeated.select(*scope, "format", "merged", "w.side", "w.layer", "w.pos", "w.line")


def _xml_property(key: Column, value: Column) -> Column:
    return F.concat(
        F.lit("  <property>\n    <name>"), key, F.lit("</name>\n    <value>"), value,
        F.lit("</value>\n  </property>"),
    )


def render_files(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One text per file out of (keys..., file, format, merged, side, layer, pos, line).

    ini and plain print their lines in order (merged ini in key order); xml collapses its
    pairs and prints them in key order. Texts are not escaped. A NULL line stands for an
    empty file. A file with a line without ``=`` where a pair is due has NULL text, and so has
    one whose suffix names no known format (its format is NULL).
    """
    scope = [*keys, "file", "format"]
    line, is_xml = F.col("line"), F.col("format") == "xml"
    keyed = is_xml | F.col("merged")
    name = F.substring_index("line", "=", 1)
    # Keyed lines sort by key; the others by place, with the text as a last resort.
    rank = F.struct(
        F.when(keyed, 0).otherwise(F.col("side")).cast("bigint").alias("side"),
        F.when(keyed, 0).otherwise(F.col("layer")).cast("bigint").alias("layer"),
        F.when(keyed, 0).otherwise(F.col("pos")).cast("bigint").alias("pos"),
        F.when(keyed, name).otherwise(line).alias("text"),
    )
    cells = lines.groupBy(*scope, keyed.alias("keyed"), rank.alias("rank")).agg(
        F.max_by("line", F.struct("side", "layer", "pos")).alias("line"),
        F.count("*").alias("n"),
        F.max(F.col("line").isNotNull() & (F.instr("line", "=") == 0)).alias("no_pair"),
    )
    value = F.expr("substring(line, instr(line, '=') + 1)")
    text = (
        F.when(is_xml, _xml_property(name, value)).when(F.col("keyed"), line)
        .otherwise(F.array_join(F.array_repeat(line, F.col("n").cast("int")), "\n"))
    )
    chunk = F.struct(
        F.col("rank.side"), F.col("rank.layer"),
        F.floor(F.col("rank.pos") / F.lit(ordered.CHUNK)).alias("c"),
        F.when(F.col("keyed"), F.substring("rank.text", 1, ordered.KEY_PREFIX)).alias("p"),
    )
    joined = ordered.ordered_concat(
        cells, scope, F.col("rank"), chunk, text, "\n", "body", F.col("keyed") & F.col("no_pair"), "broken"
    )
    body = F.col("body")
    wrapped = F.when(
        is_xml,
        F.concat(
            F.lit("<configuration>\n"), body, F.when(body != "", "\n").otherwise(""), F.lit("</configuration>")
        ),
    ).otherwise(body)
    known = F.col("format").isNotNull()
    return joined.select(*scope, F.when(known & ~F.col("broken"), wrapped).alias("text"))


# -- command line ---------------------------------------------------------------------

def _trimmed(items: Column) -> Column:
    stripped = F.transform(
        F.coalesce(items, F.array().cast("array<string>")),
        lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""),
    )
    return F.filter(stripped, lambda s: s != "")


def arg_vector(
    main_process: Column, jvm_opts: Column, jvm_properties: Column, classpath: Column,
    java_class: Column, extra_args: Column,
) -> Column:
    """P20: the command line of a task as ``array<string>``."""
    paths = _trimmed(classpath)
    none = F.array().cast("array<string>")
    class_name = F.trim(F.coalesce(java_class, F.lit("")))
    return F.concat(
        F.array(main_process),
        _trimmed(jvm_opts),
        F.transform(_trimmed(jvm_properties), lambda s: F.concat(F.lit("-D"), s)),
        F.when(F.size(paths) > 0, F.array(F.lit("-cp"), F.array_join(paths, ":"))).otherwise(none),
        F.when(class_name != "", F.array(class_name)).otherwise(none),
        F.filter(F.split(F.coalesce(extra_args, F.lit("")), " "), lambda s: s != ""),
    )
