"""Documents: package manifests (S5), the configuration corpus (S6), program
inventories (S7), dashboards (S8) and the flattening of untyped trees (S10)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions.text import json_pointer
from fleetlens.session import stage

MANIFEST_SCHEMA = (
    "map<string,struct<version:string,date:string,md5sum:string,size:bigint,link:string>>"
)

PROGRAM_STRUCT = (
    "struct<name:string,job:string,task_id:bigint,bin:string,args:array<string>,"
    "configs:map<string,string>,pkg_address:string,pkg_name:string,pkg_md5sum:string,"
    "pid:bigint,status:string,root_dir:string,hooks:map<string,string>>"
)
INVENTORY_SCHEMA = f"map<string,{PROGRAM_STRUCT}>"

TARGET_STRUCT = (
    "struct<refId:string,metric:string,aggregator:string,downsampleAggregator:string,"
    "downsampleInterval:string,downsampleFillPolicy:string,disableDownsampling:boolean,"
    "shouldComputeRate:boolean,isCounter:boolean,counterMax:string,counterResetValue:string,"
    "tags:map<string,string>>"
)
DASHBOARD_SCHEMA = (
    f"struct<uid:string,title:string,panels:array<struct<title:string,type:string,"
    f"targets:array<{TARGET_STRUCT}>>>,time:struct<from:string,to:string>>"
)


def _keep(df: DataFrame, *dropped: str) -> list[Column]:
    return [F.col(c) for c in df.columns if c not in dropped]


def manifest_rows(docs: DataFrame, value: str = "value") -> DataFrame:
    """Manifest JSON (name -> record) to one row per package."""
    return docs.select(
        *_keep(docs, value), F.explode(F.from_json(value, MANIFEST_SCHEMA)).alias("package_name", "r")
    ).select(*_keep(docs, value), "package_name", "r.*")


def yaml_to_json(texts: DataFrame, value: str = "value") -> DataFrame:
    """YAML text to JSON text in Arrow batches; ``error`` is set where a text does not parse.

    Spark has no YAML reader, so this is the one Python step on the configuration path.
    Output: the other columns, ``value`` as JSON text, ``error``.
    """
    others = [f.name for f in texts.schema.fields if f.name != value]
    schema = texts.select(*others, F.col(value).cast("string").alias(value)).schema.add("error", "string")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            rendered, errors = [], []
            for text in batch.column(value).to_pylist():
                try:
                    rendered.append(json.dumps(yaml.load(text, Loader=loader), default=str))
                    errors.append(None)
                except (yaml.YAMLError, AttributeError, TypeError, ValueError) as exc:
                    rendered.append(None)
                    errors.append(str(exc))
            columns = [batch.column(name) for name in others]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(rendered, pa.string()), pa.array(errors, pa.string())],
                names=[*others, value, "error"],
            )

    return texts.select(*others, F.col(value).cast("string").alias(value)).mapInArrow(convert, schema)


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file one directory below ``root`` (an absolute path or URI) as (path,
    project, file, value). The pattern also opens deeper folders; their files are left out."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*")
    bare_root = re.sub(r"^[A-Za-z0-9+.-]+:/*", "", root).strip("/")
    below = F.split(F.substring_index("path", bare_root + "/", -1), "/")
    return files.filter(F.size(below) == 2).select(
        "path",
        F.element_at(F.split("path", "/"), -2).alias("project"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.decode("content", "UTF-8").alias("value"),
    )


def read_corpus_lines(spark: SparkSession, root: str) -> DataFrame:
    """S6 for documents that stand one to a line: (path, project, file, value) of every line that isn't
    empty. Files are read as text, so one large file is read by many tasks, and none is held whole."""
    lines = spark.read.text(f"{root.rstrip('/')}/*/*").select(F.col("_metadata.file_path").alias("path"), "value")
    bare_root = re.sub(r"^[A-Za-z0-9+.-]+:/*", "", root).strip("/")
    below = F.split(F.substring_index("path", bare_root + "/", -1), "/")
    return lines.filter((F.size(below) == 2) & (F.col("value") != "")).select(
        "path", F.get(below, F.lit(0)).alias("project"), F.get(below, F.lit(1)).alias("file"), "value")


def list_folders(spark: SparkSession, root: str, depth: int = 2) -> DataFrame:
    """R2's listing: (path, is_dir, depth, files, bytes, last_modified) of every folder ``depth`` levels below
    ``root`` that holds a file at any depth.

    Spark lists the tree, in tasks where it is wide; only paths, sizes and times are read, no content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    bare_root = re.sub(r"^[A-Za-z0-9+.-]+:/*", "", root).strip("/")
    below = F.split(F.substring_index("path", bare_root + "/", -1), "/")
    folder = F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(F.slice(below, 1, depth), "/"))
    return files.filter(F.size(below) > depth).groupBy(folder.alias("path")).agg(
        F.lit(True).alias("is_dir"), F.lit(depth).alias("depth"), F.count("*").alias("files"), F.sum("length").alias("bytes"),
        F.max("modificationTime").alias("last_modified"))


def inventory_rows(docs: DataFrame, value: str = "value") -> DataFrame:
    """Inventory JSON (task label -> program) to one row per program."""
    return docs.select(
        *_keep(docs, value), F.explode(F.from_json(value, INVENTORY_SCHEMA)).alias("task_key", "p")
    ).select(*_keep(docs, value), "task_key", "p.*")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """S7 from files; a path that does not exist is an empty inventory."""
    try:
        docs = spark.read.text(path, wholetext=True)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        docs = spark.createDataFrame([], "value string")
    return inventory_rows(docs.select("value"))


def panel_rows(docs: DataFrame, value: str = "value") -> DataFrame:
    """Dashboard JSON to one row per panel target, in panel and target order."""
    parsed = docs.select(*_keep(docs, value), F.from_json(value, DASHBOARD_SCHEMA).alias("d"))
    panels = parsed.select(
        *_keep(docs, value),
        F.col("d.uid").alias("uid"),
        F.col("d.time.from").alias("time_from"),
        F.posexplode("d.panels").alias("panel_pos", "panel"),
    )
    return panels.select(
        *_keep(docs, value), "uid", "time_from", "panel_pos",
        F.col("panel.title").alias("title"),
        F.posexplode("panel.targets").alias("target_pos", "t"),
    ).select(*_keep(docs, value), "uid", "time_from", "panel_pos", "title", "target_pos", "t.*")


def read_dashboards(spark: SparkSession, path: str) -> DataFrame:
    return panel_rows(spark.read.text(path, wholetext=True).select("value"))


LEAF = "struct<path:string,kind:string,pos:bigint,value:string>"


LEVELS = 6  # levels opened in one row stream; deeper trees take another round


def flatten_documents(docs: DataFrame, value: str = "value", typed: bool = False) -> DataFrame:
    """JSON documents to rows (path, kind, pos, value).

    ``kind`` is map (one row for each interior map), list (one row for each element, or one
    with NULL pos when empty), scalar or null. Paths are JSON pointers. A list element that is
    neither a string nor an integer, and a text that is no JSON, give a row of kind ``error``.
    With ``typed`` only strings are of kind scalar; numbers and booleans are of kind other.

    Each level is an explode of the level above in the same row stream, so nothing is shuffled.
    After LEVELS levels the rows are written out, and the subtrees that are still closed are
    opened by another round, however deep a tree is.
    """
    keep = _keep(docs, value)
    closed = docs.select(*keep, F.lit("").alias("path"), F.try_parse_json(value).alias("v"))
    done = None
    while True:
        rows = stage(_open_levels(closed, keep, typed), "levels")
        leaves = rows.filter(F.col("rest").isNull()).select(*keep, "leaf.path", "leaf.kind", "leaf.pos", "leaf.value")
        done = leaves if done is None else done.unionByName(leaves)
        deeper = rows.filter(F.col("rest").isNotNull())
        if deeper.isEmpty():
            return done
        closed = deeper.select(*keep, "path", F.parse_json("rest").alias("v"))


def _open_levels(closed: DataFrame, keep: list[Column], typed: bool = False) -> DataFrame:
    """(keep..., path, leaf, rest): finished rows in ``leaf``, or the JSON text of a closed subtree."""
    # The kind of a variant is the leading word of its schema.
    def kind_of(v: Column) -> Column:
        return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)

    plain = F.when(F.col("k") == "STRING", "scalar").otherwise("other") if typed else F.lit("scalar")
    rows = closed.select(*keep, "path", "v", F.lit(None).cast(LEAF).alias("leaf"))
    for _ in range(LEVELS):
        is_open = F.col("leaf").isNull()
        rows = rows.withColumn("k", F.when(is_open, kind_of(F.col("v"))))
        members = F.transform(
            F.map_entries(F.col("v").cast("map<string,variant>")),
            lambda e: F.struct(
                json_pointer(F.col("path"), e["key"]).alias("path"),
                e["value"].alias("v"),
                F.lit(None).cast(LEAF).alias("leaf"),
            ),
        )

        def leaf(kind: Column, pos: Column, text: Column) -> Column:
            return F.struct(
                F.col("path").alias("path"),
                F.lit(None).cast("variant").alias("v"),
                F.struct(
                    F.col("path").alias("path"), kind.alias("kind"),
                    pos.cast("bigint").alias("pos"), text.alias("value"),
                ).alias("leaf"),
            )

        none_pos, none_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
        elements = F.transform(
            F.col("v").cast("array<variant>"),
            lambda item, i: leaf(
                F.when(kind_of(item).isin("STRING", "BIGINT"), "list").otherwise("error"),
                i, item.cast("string"),
            ),
        )
        opened = (
            F.when(~is_open, F.array(F.struct(F.col("path"), F.col("v"), F.col("leaf"))))
            .when(
                F.col("k") == "OBJECT",
                F.concat(F.array(leaf(F.lit("map"), none_pos, none_text)), members),
            )
            .when(
                F.col("k") == "ARRAY",
                F.when(
                    F.size(F.col("v").cast("array<variant>")) == 0,
                    F.array(leaf(F.lit("list"), none_pos, none_text)),
                ).otherwise(elements),
            )
            .when(F.col("v").isNull(), F.array(leaf(F.lit("error"), none_pos, F.lit("not JSON"))))
            .when(F.col("k") == "VOID", F.array(leaf(F.lit("null"), none_pos, none_text)))
            .otherwise(F.array(leaf(plain, none_pos, F.col("v").cast("string"))))
        )
        rows = rows.select(*keep, F.explode(opened).alias("n")).select(*keep, "n.path", "n.v", "n.leaf")
    return rows.select(*keep, "path", "leaf", F.when(F.col("leaf").isNull(), F.to_json("v")).alias("rest"))
