"""Streams give what the batch operators give."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fleetlens.operators import series as sr
from fleetlens.session import new_work_dir, work_root
from fleetlens.streaming import jobs as sj, keyed

SCHEMA = "series_key string, sec bigint, value double, seq bigint"


def landing(spark, batches, label):
    """One file per batch, in order."""
    path = new_work_dir(spark, label)
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).select(
            "series_key", F.timestamp_seconds("sec").alias("ts"), "value", "seq"
        ).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def batches(seed=5, files=4, n=120):
    rng = random.Random(seed)
    # Not at the epoch itself: a watermark starts there, and what isn't after it counts as late.
    seconds = sorted(rng.sample(range(36000, 76000, 2), files * n))
    data = [("hot" if rng.random() < 0.34 else f"s{rng.randrange(5)}", s, round(rng.uniform(0, 9), 2), i) for i, s in enumerate(seconds)]
    return [data[i * n:(i + 1) * n] for i in range(files)]


def shaped(rates):
    return rates.select("series_key", F.unix_seconds("ts").alias("s"), F.round("rate", 9).alias("r"))


def closed_rates(table, **options):
    """Batch rates of the hours that the watermark has passed at the end."""
    limit = table.agg(F.max(F.unix_seconds("ts"))).head()[0] - 600
    rates = sr.rate(sr.latest_per_second(table, "seq"), **options)
    return rates.filter((F.floor(F.unix_seconds("ts") / 3600) + 1) * 3600 <= limit)


def test_rate_over_many_batches(spark, rows):
    path, table = landing(spark, batches(), "t-rate")
    stream = sj.read_landing(spark, path, table.schema, max_files=1)
    got = keyed.stream_rate(stream, "seq", counter=True, counter_max=10.0)
    assert rows(shaped(got)) == rows(shaped(closed_rates(table, counter=True, counter_max=10.0)))


def test_rate_resumes_and_drops_late_rows(spark, rows):
    parts = batches(11, files=3)
    path, _ = landing(spark, parts[:1], "t-resume")
    root = new_work_dir(spark, "t-resume-root")
    schema = spark.read.parquet(path).schema
    first = keyed.stream_rate(sj.read_landing(spark, path, schema, 1), "seq", root=root).count()

    def add(batch):
        spark.createDataFrame(batch, SCHEMA).select("series_key", F.timestamp_seconds("sec").alias("ts"), "value", "seq").coalesce(1).write.mode("append").parquet(path)

    late = ("hot", 36001, 99.0, 10**6)  # hours behind the watermark: it changes nothing
    add([*parts[1], late])
    add(parts[2])
    got = keyed.stream_rate(sj.read_landing(spark, path, schema, 1), "seq", root=root)
    want = closed_rates(spark.read.parquet(path).filter("seq < 1000000"))
    assert rows(shaped(got)) == rows(shaped(want))
    assert 0 < first < got.count()


def test_status_over_many_batches(spark, rows):
    path, table = landing(spark, batches(9, files=3, n=30), "t-status")
    stream = sj.read_landing(spark, path, table.schema, max_files=1).select(
        F.col("series_key").alias("key"), "seq", "ts", F.concat(F.lit("v"), F.col("value").cast("string")).alias("status")
    )
    as_of = F.timestamp_seconds(F.lit(76000))
    got = keyed.stream_status(stream, 10**6, as_of)
    want = table.groupBy("series_key").agg(F.max_by("value", "seq").alias("v"))
    assert rows(got, "key", "status") == rows(want.select("series_key", F.concat(F.lit("v"), F.col("v").cast("string"))))


def test_old_status_is_unknown(spark, rows):
    path, table = landing(spark, [[("a", 10, 1.0, 0), ("b", 100, 1.0, 1)]], "t-unknown")
    stream = sj.read_landing(spark, path, table.schema).select(
        F.col("series_key").alias("key"), "seq", "ts", F.lit("Running").alias("status")
    )
    assert rows(keyed.stream_status(stream, 50, F.timestamp_seconds(F.lit(120))), "key", "status") == [("a", "Unknown"), ("b", "Running")]


def test_downsample_emits_closed_buckets(spark, rows):
    path, table = landing(spark, batches(), "t-down")
    got = sj.run_available(sj.downsample(sj.read_landing(spark, path, table.schema, 1), "1 hour"), "t-down-out")
    limit = table.agg(F.max("ts") - F.expr("INTERVAL 10 MINUTES")).head()[0]
    want = sr.downsample(table, "1 hour").filter(F.col("bucket") + F.expr("INTERVAL 1 HOUR") <= F.lit(limit))
    shape = ["series_key", F.unix_seconds("bucket").alias("b"), F.round("value", 9).alias("v")]
    assert rows(got.select(*shape)) == rows(want.select(*shape))


def test_dedupe_and_late_rows(spark, rows):
    path, table = landing(spark, [
        [("a", 10, 1.0, 0), ("a", 10, 2.0, 1), ("a", 5000, 1.0, 2)], [("a", 5000, 3.0, 3), ("b", 5000, 1.0, 4)],
        [("a", 11, 9.0, 5)],
    ], "t-dedupe")
    got = sj.run_available(sj.dedupe(sj.read_landing(spark, path, table.schema, 1)), "t-dedupe-out")
    # The greatest seq wins; 5000 is still open when the input ends, and the last row is too late.
    assert rows(got.select("series_key", F.unix_seconds("ts").alias("s"), "value")) == [("a", 10, 2.0)]


def test_rollup_stream(spark, rows):
    data = [("r", 0, 1.0, 0), ("r", 0, 2.0, 1), ("r", 90000, 5.0, 2)]
    path, table = landing(spark, [data], "t-roll")
    regions = sj.read_landing(spark, path, table.schema).select(
        "ts", "value", F.lit("c").alias("cluster"), F.lit("j").alias("job"), F.lit("h").alias("host"), F.lit(1).alias("port"),
        F.lit("storeCount").alias("region_metric"), F.lit("n").alias("namespace"), F.concat(F.lit("t"), F.col("seq").cast("string")).alias("table"),
    )
    got = sj.run_available(sj.region_rollup(regions, "1 hour"), "t-roll-out")
    assert rows(got, "level", "namespace", "table", "value") == [
        ("namespace", "n", None, 3.0), ("server", None, None, 3.0), ("table", "n", "t0", 1.0), ("table", "n", "t1", 2.0),
    ]


def test_second_rollup_step_holds_table_sums_not_regions(spark):
    data = [("r", i % 60, 1.0, i) for i in range(400)]
    path, table = landing(spark, [data, [("r", 90000, 5.0, 999)]], "t-steps")
    regions = sj.read_landing(spark, path, table.schema, max_files=1).select(
        "ts", "value", F.lit("c").alias("cluster"), F.lit("j").alias("job"), F.lit("h").alias("host"), F.lit(1).alias("port"),
        F.lit("storeCount").alias("region_metric"), F.lit("n").alias("namespace"), F.concat(F.lit("t"), (F.col("seq") % 4).cast("string")).alias("table"),
    )
    query = (
        sj.region_rollup(regions, "1 hour").writeStream.outputMode("append").format("memory").queryName("t_steps")
        .option("checkpointLocation", f"{path}-steps").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    steps = [[o.numRowsUpdated for o in p.stateOperators] for p in query.recentProgress]
    assert {len(s) for s in steps} == {2}
    # Four tables of the closed hour: four table rows, one namespace and one server row reach the second state.
    # Five table sums of two hours in the first state; of the closed hour four table rows, one namespace
    # and one server row reach the second.
    assert [sum(s[i] for s in steps) for i in (0, 1)] == [6, 5]
    got = {(r.level, r.table, r.value, r.regions) for r in spark.table("t_steps").collect()}
    assert got == {("server", None, 400.0, 400), ("namespace", None, 400.0, 400), *[("table", f"t{i}", 100.0, 100) for i in range(4)]}


def test_work_root_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert work_root(spark) == configured.rstrip("/")


def test_silence_is_told_by_timers(spark, rows):
    parts = [[("a", 10, 1.0, 1), ("b", 20, 1.0, 2)], [("b", 4000, 2.0, 3)], [("a", 8000, 3.0, 4), ("b", 8000, 3.0, 5)], [("c", 50000, 1.0, 6)]]
    path, table = landing(spark, parts, "t-timers")

    def run(root):
        stream = sj.read_landing(spark, path, table.schema, max_files=1).select(
            F.col("series_key").alias("key"), "seq", "ts", F.concat(F.lit("v"), F.col("value").cast("int").cast("string")).alias("status"))
        return rows(keyed.stream_timeline(stream, 5000, root=root).select("key", F.unix_seconds("ts").alias("s"), "status"))

    root = f"{path}-timers"
    got = run(root)
    assert got == sorted([
        ("a", 10, "v1"), ("b", 20, "v1"), ("b", 4000, "v2"), ("a", 5010, "Unknown"), ("a", 8000, "v3"), ("b", 8000, "v3"),
        ("a", 13000, "Unknown"), ("b", 13000, "Unknown"), ("c", 50000, "v1")], key=lambda t: tuple((False, str(v)) for v in t))
    # Going on: an old report is dropped, a new one of a silent key brings it back.
    for late in (("b", 9000, 7.0, 8), ("b", 60000, 9.0, 9)):
        spark.createDataFrame([late], SCHEMA).select(
            "series_key", F.timestamp_seconds("sec").alias("ts"), "value", "seq").coalesce(1).write.mode("append").parquet(path)
    again = run(root)
    assert set(again) - set(got) == {("b", 60000, "v9"), ("c", 55000, "Unknown")}


def told(reports, ttl, limit):
    """What a timeline says of whole-second reports (key, second, seq, status), one key after the other."""
    out = []
    for key in {r[0] for r in reports}:
        mine, seen = sorted((r for r in reports if r[0] == key), key=lambda r: r[2]), set()
        mine = [r for r in mine if not (r[2] in seen or seen.add(r[2]))]
        for r, after in zip(mine, [*mine[1:], None]):
            out.append((key, r[1], r[3]))
            if r[1] + ttl < (after[1] if after else limit):
                out.append((key, r[1] + ttl, "Unknown"))
    return out


def test_a_state_follows_many_keys(spark, rows):
    rng = random.Random(3)
    seconds = sorted(rng.sample(range(36000, 76000), 600))
    data = [(rng.choice([None, *(f"k{i}" for i in range(40))]), s, 1.0 * (i % 2), i) for i, s in enumerate(seconds)]
    data += rng.sample(data, 50)  # reports that come twice
    data.sort(key=lambda r: r[3])
    path, table = landing(spark, [data[:250], data[250:400], data[400:]], "t-many")
    stream = sj.read_landing(spark, path, table.schema, max_files=1).select(
        F.col("series_key").alias("key"), "seq", "ts", F.when(F.col("value") > 0, "Running").otherwise("Stopped").alias("status"))
    want = told([(k, s, i, "Running" if v else "Stopped") for k, s, v, i in data], 5000, seconds[-1] - 600)
    for buckets in (1, 7):
        timeline = keyed.status_timeline(stream, 5000, buckets=buckets)
        keyed.append_table(timeline, f"{path}-{buckets}", f"{path}-{buckets}-check", keyed.AVAILABLE).awaitTermination()
        got = spark.read.schema(timeline.schema).parquet(f"{path}-{buckets}")
        assert rows(got.select("key", F.unix_seconds("ts").alias("s"), "status")) == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))
        state = spark.read.format("statestore").load(f"{path}-{buckets}-check")
        assert 0 < state.count() <= buckets


def test_a_bucket_keeps_order_and_timers():
    new = pd.DataFrame([("b", 2, 20_000, "x"), ("a", 1, 10_000, "y"), ("b", 2, 20_000, "x"), ("b", 9, 100_000, "z"), (None, 4, 40_000, None)], columns=["key", "seq", "at", "status"])
    out, held = keyed._follow(keyed._unpacked(None), new, 50_000, 0)
    assert [*out[out.key == "b"].itertuples(index=False, name=None)] == [("b", 2, 20_000, "x"), ("b", 2, 70_000, "Unknown"), ("b", 9, 100_000, "z")]
    assert len(out) == 5 and sorted(held["at"].tolist()) == [10_000, 40_000, 100_000]
    again = keyed._unpacked(keyed._packed(held))
    assert all(again[c].tolist() == held[c].tolist() for c in held)
    # Old seqs are no reports; silent keys go by the watermark, in milliseconds.
    out, held = keyed._follow({"key": np.array(["a", "b"], object), "seq": np.array([5, 6]), "at": np.array([10_000, 90_000])},
                              pd.DataFrame([("b", 6, 95_000, "no"), ("b", 7, 99_000, "yes")], columns=new.columns), 50_000, 61)
    assert [*out.itertuples(index=False, name=None)] == [("a", 5, 60_000, "Unknown"), ("b", 7, 99_000, "yes")]
    assert held["key"].tolist() == ["b"] and held["at"].tolist() == [99_000]
