"""What the operators of this package share: staging, word splitting, hashed row splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The white space that separates words, and the lower-casing of A-Z alone.
SPACE = " \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

ROWS_AT_ONCE = 1024

_own_roots: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="llm-")
    return _own_roots[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, so that a lost executor doesn't repeat the work."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an id's text modulo ``divisor``; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return (F.crc32(text) % divisor).cast("int")


def with_columns(df: DataFrame, added: T.StructType, fn: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Append columns computed from ROWS_AT_ONCE rows at a time. A column that has an added one's name is replaced."""
    names = {f.name.lower() for f in added.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType(kept + added.fields)
    keep = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + fn(batch), names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def unique_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case; bytes.split cuts at exactly the six characters of SPACE."""
    return text.translate(LOWER).split() if text else []


class WordHashes:
    """64-bit hashes of words, remembered up to a bound that only limits memory."""

    def __init__(self, bound: int = 100_000):
        self.bound, self.seen = bound, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        fresh = set(words).difference(seen)
        if len(seen) + len(fresh) > self.bound:
            seen.clear()
            fresh = set(words)
        seen.update((w, xxhash.xxh3_64_intdigest(w)) for w in fresh)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for every window of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(width):
        out = mix64(out + hashes[i : i + n] + np.uint64(i + 1)) if n > 0 else out
    return out
