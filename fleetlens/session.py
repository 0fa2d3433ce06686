"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# What right results need; all else is the caller's choice.
DEFAULTS = {"spark.sql.session.timeZone": "UTC"}

# Suggestions for whoever builds the session. Plans of many expressions are built several times
# faster without call-site capture; streaming state lives off the heap and is saved as changes; a
# small payload row still parses into many points, so small partitions are kept apart.
STATIC = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
}

_local_roots: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def work_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="fleetlens-")
    return _local_roots[app]


_run: ContextVar[str] = ContextVar("run", default="")


@contextmanager
def run_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """All folders that are made inside lie below one folder, which the caller may drop afterwards."""
    token = _run.set(f"{name}-{uuid.uuid4().hex}/")
    try:
        yield f"{work_root(spark)}/{_run.get()}".rstrip("/")
    finally:
        _run.reset(token)


def new_work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder path below the shared root; nothing is ever reused or deleted."""
    return f"{work_root(spark)}/{_run.get()}{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For results several later steps read: they scan columns instead of repeating the work,
    and a lost executor does not bring the work back.
    """
    path = new_work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
