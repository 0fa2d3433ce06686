"""Monitoring payloads (S1-S4) and line files.

Every reader takes a DataFrame of landed texts, one payload per row in ``value`` plus any
context columns (cluster, job, host, port, ts ...), which are carried through. All of it
is narrow: one input row becomes zero or more output rows with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions.text import single_precision

JMX_SCHEMA = "beans array<map<string,string>>"

GAUGE_STRUCT = "struct<free:double,available:double,total:double,used:double,usedPercent:double>"
NODE_SCHEMA = (
    "CpuPercents double, "
    "Load struct<load1:double,load5:double,load15:double>, "
    f"memory {GAUGE_STRUCT}, "
    "Network array<struct<name:string,bytesRecv:double,bytesSent:double,packetsRecv:double,"
    "packetsSent:double,dropin:double,dropout:double,errin:double,errout:double>>, "
    "DiskUsage map<string,struct<free:double,total:double,used:double,usedPercent:double>>, "
    "JavaMetrics map<string,map<string,double>>"
)

# The 17 columns of the collector output, in position order.
GC_COLUMNS = [
    "survivor0.capacity",
    "survivor1.capacity",
    "survivor0.usage",
    "survivor1.usage",
    "eden.capacity",
    "eden.usage",
    "old.space.capacity",
    "old.space.usage",
    "metaspace.capacity",
    "metaspace.usage",
    "compressed.class.space.capacity",
    "compressed.class.space.usage",
    "young.gc.count",
    "young.gc.time",
    "full.gc.count",
    "full.gc.time",
    "total.gc.time",
]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload files, one per row, with the landing time as event time."""
    return (
        spark.read.text(path, wholetext=True)
        .select("value", "_metadata.file_path", F.col("_metadata.file_modification_time").alias("ts"))
    )


def _without(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(c) for c in df.columns if c not in names]


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """The same rows. Later filters read the values of ``names``; without it the optimiser puts
    their expressions into each filter, which it moves below shuffles, and computes them again."""
    cell = F.explode_outer(F.array(F.struct(*names))).alias("cell")
    return df.select(*_without(df, *names), cell).select(*[F.col(f"cell.{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def parse_jmx(payloads: DataFrame, value: str = "value") -> DataFrame:
    """S1, step 1: the payload text becomes ``beans array<map<string,string>>``.

    Nested values stay JSON text and JSON null becomes SQL NULL under a present key.
    """
    return payloads.select(
        *_without(payloads, value), F.from_json(value, JMX_SCHEMA)["beans"].alias("beans")
    )


def explode_beans(parsed: DataFrame) -> DataFrame:
    """S1, step 2: one row per bean with its name and key -> raw value map."""
    # Outer, so that the optimiser does not parse the payload a second time for an emptiness test.
    beans = parsed.select(*_without(parsed, "beans"), F.posexplode_outer("beans").alias("bean_pos", "props"))
    return beans.filter(F.col("bean_pos").isNotNull()).withColumn("bean_name", F.try_element_at("props", F.lit("name")))


def bean_entries(beans: DataFrame) -> DataFrame:
    """One row per key of each bean."""
    return beans.select(*_without(beans, "props"), F.explode("props").alias("key", "raw"))


def parse_node(payloads: DataFrame, value: str = "value") -> DataFrame:
    """Host snapshot JSON to typed columns; members that do not fit become NULL."""
    return payloads.select(
        *_without(payloads, value), F.from_json(value, NODE_SCHEMA).alias("node")
    )


def kv_lines(payloads: DataFrame, value: str = "value") -> DataFrame:
    """S3: ``key<TAB>value`` lines; a line needs exactly two parts. Reads whole replies."""
    lines = payloads.select(*_without(payloads, value), F.explode(F.split(value, "\n")).alias("line"))
    return (
        lines.withColumn("parts", F.split("line", "\t"))
        .filter(F.size("parts") == 2)
        .select(*_without(lines, "line"), F.get("parts", 0).alias("key"), F.get("parts", 1).alias("raw"))
    )


def parse_jstat(payloads: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``gc array<double>``, the 17 numbers of a three-line collector text; NULL marks
    a rejected record. Each step is its own column, so no text is split or cast twice."""
    keep = _without(payloads, value)
    lines = payloads.select(*keep, F.split(value, "\n").alias("lines"))
    words = lines.select(
        *keep, F.size("lines").alias("n_lines"),
        F.filter(F.split(F.get("lines", F.lit(1)), " +"), lambda w: w != "").alias("words"),
    )
    numbers = words.select(
        *keep,
        F.when(
            (F.col("n_lines") == 3) & (F.size("words") == len(GC_COLUMNS)),
            F.transform("words", single_precision),
        ).alias("numbers"),
    )
    whole = F.col("numbers").isNotNull() & ~F.array_contains(F.transform("numbers", F.isnull), True)
    return numbers.select(*keep, F.when(whole, F.col("numbers")).alias("gc"))


def split_rejects(
    df: DataFrame, bad: Column, payload_id: Column, path: str, raw: Column, reason: str
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, reject rows ``payload_id, path, raw, reason``)."""
    rejects = df.filter(bad).select(
        payload_id.cast("string").alias("payload_id"),
        F.lit(path).alias("path"),
        raw.cast("string").alias("raw"),
        F.lit(reason).alias("reason"),
    )
    return df.filter(~bad), rejects


def clean_lines(texts: DataFrame, value: str = "value") -> DataFrame:
    """Trimmed non-blank lines without ``#`` comments; ``pos`` is the line number."""
    lines = texts.select(
        *_without(texts, value), F.posexplode(F.split(value, "\n")).alias("pos", "line")
    ).withColumn("line", F.trim("line"))
    return lines.filter((F.length("line") > 0) & ~F.col("line").startswith("#"))
