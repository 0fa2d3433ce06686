"""Streams that know something of earlier batches (T5, T6), in Spark's own state.

Every stream takes a checkpoint folder and a trigger and resumes where it stopped. Rows later than
the watermark are dropped and counted in ``numRowsDroppedByWatermark``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.session import new_work_dir
from fleetlens.streaming.jobs import WATERMARK

CHUNK = "1 hour"
IDLE = 30 * 86400  # seconds of event time after which a silent series is forgotten
AVAILABLE = {"availableNow": True}

POINT = "struct<ts:timestamp,seq:bigint,value:double>"
CHUNKS = f"series_key string, chunk timestamp, points array<{POINT}>"
PAIRS = "series_key string, at bigint, value double, prev_at bigint, prev double"


def closed_chunks(points: DataFrame, order: str, chunk: str = CHUNK, watermark: str = WATERMARK) -> DataFrame:
    """Whole-second points of each series, one row per closed chunk of time, sorted.

    The state is keyed by series and chunk, so a busy series is many small states, and each is
    dropped when the watermark passes its end. The last point of a second by ``order`` stays.
    """
    cell = F.struct(F.date_trunc("second", "ts").alias("ts"), F.col(order).cast("bigint").alias("seq"), F.col("value").cast("double").alias("value"))
    grouped = points.withWatermark("ts", watermark).groupBy("series_key", F.window("ts", chunk).alias("w")).agg(
        F.array_sort(F.collect_list(cell)).alias("sorted"))
    # Each point next to the one after it; a point whose second goes on is replaced by that one.
    paired = F.transform("sorted", lambda p, i: F.struct(p.alias("p"), F.get(F.col("sorted"), i + 1)["ts"].alias("next")))
    kept = F.transform(F.filter(paired, lambda x: ~x["next"].eqNullSafe(x["p"]["ts"])), lambda x: x["p"])
    return grouped.select("series_key", F.col("w.start").alias("chunk"), kept.cast(f"array<{POINT}>").alias("points"))


def _last_of_series(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first point of each chunk next to the last one of the chunk before, which the state carries."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values("at")
    last = state.get if state.exists else None
    out = []
    for r in rows.itertuples(index=False):
        if last is not None:
            out.append((key[0], int(r.at), float(r.value), *last))
        last = (int(r.end_at), float(r.end_value))
    state.update(last)
    state.setTimeoutTimestamp(last[0] // 1000 + IDLE * 1000)
    yield pd.DataFrame(out, columns=["series_key", "at", "value", "prev_at", "prev"])


def chunk_rates(chunks: DataFrame, counter: bool = False, counter_max: float | None = None) -> DataFrame:
    """T5: (series_key, ts, rate) of a stream of closed chunks.

    Rates inside a chunk are plain expressions. Only its first and last point go through the
    state of the series, so a busy series costs one small row per chunk there.
    """
    points = F.col("points")
    # Chunks come in the order in which they closed; the watermark only lets silent series go.
    chunks = chunks.withWatermark("chunk", "1 day")
    inside = chunks.select("series_key", F.explode(F.transform(
        F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))),
        lambda p, i: F.struct(F.unix_micros(p["ts"]).alias("at"), p["value"].alias("value"),
                              F.unix_micros(F.get(points, i)["ts"]).alias("prev_at"), F.get(points, i)["value"].alias("prev")),
    )).alias("r")).select("series_key", "r.*")
    first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
    ends = chunks.select(
        "series_key", "chunk", F.unix_micros(first["ts"]).alias("at"), first["value"].alias("value"),
        F.unix_micros(last["ts"]).alias("end_at"), last["value"].alias("end_value"))
    between = ends.groupBy("series_key").applyInPandasWithState(
        _last_of_series, PAIRS, "at bigint, value double", "append", GroupStateTimeout.EventTimeTimeout)
    delta = F.col("value") - F.col("prev")
    if counter:
        wrapped = delta + F.lit(counter_max) if counter_max is not None else F.lit(None).cast("double")
        delta = F.when(delta < 0, wrapped).otherwise(delta)
    seconds = (F.col("at") - F.col("prev_at")) / F.lit(1e6)
    return inside.unionByName(between).select(
        "series_key", F.timestamp_micros("at").alias("ts"), F.try_divide(delta, seconds).alias("rate")).filter("rate IS NOT NULL")


def append_table(stream: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """An append stream into a Parquet table, exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option(
        "path", path).trigger(**trigger).start()


def stream_rate(
    points: DataFrame, order: str, counter: bool = False, counter_max: float | None = None,
    root: str | None = None, trigger: dict = AVAILABLE,
) -> DataFrame:
    """T5: W1/W2 on a stream of (series_key, ts, value, order), run over what is available.

    ``root`` holds both tables and checkpoints; called again with it, the streams go on. Two
    queries: the first closes chunks, the second rates them.
    """
    spark = points.sparkSession
    root = root or new_work_dir(spark, "rate")
    append_table(closed_chunks(points, order), f"{root}/chunks", f"{root}/checkpoint-chunks", trigger).awaitTermination()
    chunks = spark.readStream.schema(CHUNKS).parquet(f"{root}/chunks")
    rates = chunk_rates(chunks, counter, counter_max)
    append_table(rates, f"{root}/rates", f"{root}/checkpoint-rates", trigger).awaitTermination()
    return spark.read.schema(rates.schema).parquet(f"{root}/rates")


def latest_status(reports: DataFrame) -> DataFrame:
    """The last report of each key by ``seq``; one small state per key."""
    return reports.groupBy("key").agg(
        F.max("seq").alias("seq"), F.max_by("ts", "seq").alias("ts"), F.max_by("status", "seq").alias("status"))


def status_changes(reports: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Writes the keys that changed in each micro-batch; a repeated batch replaces its own folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return latest_status(reports).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(**trigger).start()


def current_status(changes: DataFrame, ttl_seconds: int, as_of: Column) -> DataFrame:
    """The state of every key: its last report, or Unknown once that is older than the ttl at ``as_of``."""
    latest = changes.groupBy("key").agg(F.max_by("ts", "seq").alias("ts"), F.max_by("status", "seq").alias("status"))
    stale = F.col("ts") < as_of - F.expr(f"INTERVAL '{int(ttl_seconds)}' SECOND")
    return latest.withColumn("status", F.when(stale, "Unknown").otherwise(F.col("status")))


def stream_status(reports: DataFrame, ttl_seconds: int, as_of: Column, root: str | None = None, trigger: dict = AVAILABLE) -> DataFrame:
    """T6 over what is available. ``reports``: (key, seq, ts, status); called again with ``root`` it goes on."""
    spark = reports.sparkSession
    root = root or new_work_dir(spark, "status")
    status_changes(reports.select("key", F.col("seq").cast("bigint").alias("seq"), "ts", "status"), f"{root}/changes", f"{root}/checkpoint", trigger).awaitTermination()
    changes = spark.read.schema("key string, seq bigint, ts timestamp, status string").parquet(f"{root}/changes")
    return current_status(changes, ttl_seconds, as_of)


TIMELINE = "key string, seq bigint, at bigint, status string"
# Keys are dealt into so many states: a call costs some ten milliseconds, whatever it has to do. A
# stream that goes on must keep the number it began with.
BUCKETS = 1024
HELD = pa.schema({"key": pa.string(), "seq": pa.int64(), "at": pa.int64()})


def _packed(held: dict[str, np.ndarray]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as out:
        out.write_batch(pa.record_batch([pa.array(held[f.name], f.type) for f in HELD], schema=HELD))
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes | None) -> dict[str, np.ndarray]:
    rows = pa.ipc.open_stream(held).read_all() if held else HELD.empty_table()
    return {f.name: rows[f.name].to_numpy() for f in HELD}


def _follow(held: dict[str, np.ndarray], new: pd.DataFrame, ttl: int, watermark: int) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    """The timeline rows that new reports and the watermark (in milliseconds) make of many keys at once, and
    the last reports that stay. ``held``: a row for each key; ``ttl`` and ``at`` in microseconds."""
    told = np.repeat([False, True], [len(held["key"]), len(new)])
    key = np.concatenate([held["key"], new["key"].to_numpy(object)])
    # A number that is missing fails here, as pandas doesn't cast it.
    seq, at = (np.concatenate([held[c], new[c].astype("int64").to_numpy()]) for c in ("seq", "at"))
    status = np.concatenate([np.full(len(held["key"]), None), new["status"].to_numpy(object)])
    code = pd.factorize(key, use_na_sentinel=False)[0]
    reported = np.bincount(code, told) > 0
    # What is held comes first in its key, then the reports; those of no greater seq than one before are none.
    order = np.lexsort((seq, told, code))
    same = code[order][1:] == code[order][:-1]
    start = np.maximum.accumulate(np.where(np.r_[True, ~same][: len(order)], np.arange(len(order)), 0))
    first, before = order[start], order[:-1]
    old = told[order] & ~told[first] & (seq[order] <= seq[first])
    old[1:] |= same & told[before] & (seq[order][1:] == seq[before])
    order = order[~old]
    code, told, key, seq, at, status = (x[order] for x in (code, told, key, seq, at, status))
    same = code[1:] == code[:-1]
    silent = np.flatnonzero(same & (at[1:] > at[:-1] + ttl))
    last = np.flatnonzero(np.r_[~same, True][: len(order)])
    # A timer fires when the watermark is beyond it; a key that reports is told at once where it has come to it.
    due = (at[last] + ttl) // 1000
    over = np.where(reported[code[last]], due <= watermark, due < watermark)
    reports, unknown, stays = np.flatnonzero(told), np.r_[silent, last[over]], last[~over]
    rows = np.r_[reports, unknown]
    rows = rows[turn := np.argsort(np.r_[2 * reports, 2 * unknown + 1])]
    gone = turn >= len(reports)
    out = pd.DataFrame({"key": key[rows], "seq": seq[rows], "at": at[rows] + ttl * gone, "status": np.where(gone, "Unknown", status[rows])})
    return out, {"key": key[stays], "seq": seq[stays], "at": at[stays]}


def status_timeline(reports: DataFrame, ttl_seconds: int, watermark: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """T6 with timers: (key, ts, seq, status) of every report, in the order of ``seq`` for each key, and Unknown
    at the instant at which a key's last report became older than the ttl: by a timer, or, if the next
    report comes in before the watermark has got there, with that one.

    A state holds the last reports of the keys of one of ``buckets`` and a timer for the first of them that
    falls silent; a key goes when it is told Unknown, so keys that fell silent cost nothing. A micro-batch
    writes the states of the buckets it touches anew, and a task holds one bucket's rows at a time.
    ``seq`` must not fall as ``ts`` rises. A report later than the watermark is dropped and counted;
    what else comes out doesn't depend on the micro-batches.
    """
    ttl = int(ttl_seconds) * 1_000_000

    def follow(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["key", "seq", "at", "status"]
        new = pd.DataFrame(columns=columns) if state.hasTimedOut else pd.concat([f[columns] for f in frames])
        out, held = _follow(_unpacked(state.get[0] if state.exists else None), new, ttl, state.getCurrentWatermarkMs())
        if len(held["key"]):
            state.update((_packed(held),))
            state.setTimeoutTimestamp(int((held["at"].min() + ttl) // 1000))
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    rows = reports.withWatermark("ts", watermark).select(
        "key", F.col("seq").cast("bigint").alias("seq"), "ts", F.unix_micros("ts").alias("at"), "status",
        F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"))
    changes = rows.groupBy("bucket").applyInPandasWithState(follow, TIMELINE, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return changes.select("key", F.timestamp_micros("at").alias("ts"), "seq", "status")


def stream_timeline(reports: DataFrame, ttl_seconds: int, root: str | None = None, trigger: dict = AVAILABLE) -> DataFrame:
    """``status_timeline`` over what is available; called again with ``root`` it goes on."""
    spark = reports.sparkSession
    root = root or new_work_dir(spark, "timeline")
    changes = status_timeline(reports, ttl_seconds)
    append_table(changes, f"{root}/changes", f"{root}/checkpoint", trigger).awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{root}/changes")
