from __future__ import annotations

import os
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetlens import store
from fleetlens.operators import series as sr
from fleetlens.plans import metrics as plans

POINT = "metric string, sec bigint, value double, tags map<string,string>, priority int"
DAY = 86400


def frame(spark, rows):
    return spark.createDataFrame(rows, POINT).select("metric", F.timestamp_seconds("sec").alias("ts"), "value", "tags", "priority")


def write(spark, rows, path, batch):
    store.append_points(frame(spark, rows), path, batch, priority=F.col("priority"))


def content(spark, path):
    joined = store.read_points(spark, path).join(store.read_series(spark, path), "series_id")
    return sorted(tuple(r) for r in joined.select("series_key", F.unix_seconds("ts"), "value", "priority", "batch").collect())


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_repeated_batch_changes_nothing_and_priority_wins(spark, tmp_path):
    path = str(tmp_path / "s")
    first = [("a.b.c", t * DAY, float(t), {"h": h}, 0) for t in range(4) for h in "xy"] + [("a.b.c", 0, 9.0, {"h": "x"}, 0), ("q", 5, 1.0, {}, 0)]
    write(spark, first, path, 1)
    once = content(spark, path)
    assert ("a.b.c{h=x}", 0, 9.0, 0, 1) in once and len(once) == 9
    write(spark, first, path, 1)
    assert content(spark, path) == once and store.read_series(spark, path).count() == 3
    before = files(f"{path}/points")
    write(spark, [("a.b.c", DAY, 50.0, {"h": "x"}, 1), ("a.b.c", DAY, -1.0, {"h": "y"}, -1), ("a.b.new", DAY, 3.0, {"h": "x"}, 0), ("a.b.c", DAY + 1, None, {}, 9)], path, 2)
    late = content(spark, path)
    assert ("a.b.c{h=x}", DAY, 50.0, 1, 2) in late and ("a.b.c{h=y}", DAY, 1.0, 0, 1) in late and len(late) == 10
    # Only the folder of that family and day was written.
    after = files(f"{path}/points")
    assert {os.path.dirname(p).split("/points/")[1] for p in before.keys() ^ after.keys()} == {"metric_family=a.b/date=1970-01-02"}
    write(spark, first, path, 1)
    assert content(spark, path) == late


def test_random_batches_against_brute_force(spark, tmp_path):
    rng, path, best = random.Random(3), str(tmp_path / "s"), {}
    batches = [[(f"m.{rng.randrange(3)}", rng.randrange(4) * DAY // 2, float(rng.randrange(9)), {"k": str(rng.randrange(2))}, rng.randrange(2))
                for _ in range(60)] for _ in range(3)]
    for number in (0, 2, 1, 0):
        for metric, sec, value, tags, priority in batches[number]:
            key = f"{metric}{{k={tags['k']}}}", sec
            best[key] = max(best.get(key, (-1, -1, -1.0)), (priority, number, value))
        write(spark, batches[number], path, number)
    assert content(spark, path) == sorted((k, s, v, p, b) for (k, s), (p, b, v) in best.items())


def test_compaction_keeps_the_points(spark, tmp_path):
    path = str(tmp_path / "s")
    write(spark, [("m.a", i, float(i), {}, 0) for i in range(40)] + [("m.b", 0, 1.0, {}, 0)], path, 1)
    crowded = f"{path}/points/metric_family=m.a/date=1970-01-01"
    store.read_points(spark, path).filter("metric_family = 'm.a'").drop("metric_family", "date").repartition(12).write.mode("overwrite").parquet(crowded)
    other = files(f"{path}/points/metric_family=m.b")
    kept = content(spark, path)
    assert len(files(crowded)) == 12
    store.compact(spark, path)
    assert content(spark, path) == kept and len(files(crowded)) <= 4 and files(f"{path}/points/metric_family=m.b") == other


def test_match_series_against_brute_force(spark):
    rng = random.Random(8)
    tags = [{k: rng.choice("12") for k in rng.sample(["a", "b", "c=", "d"], rng.randrange(4))} for _ in range(80)]
    rows = [(i, rng.choice("mn"), t, f"s{i}") for i, t in enumerate(tags)]
    asked = [(f"t{i}", rng.choice("mn"), {k: rng.choice("12") for k in rng.sample(["a", "b", "c=", "zz"], rng.randrange(3))}) for i in range(30)] * 2
    got = sr.match_series(
        spark.createDataFrame(rows, "series_id bigint, metric string, tags map<string,string>, series_key string"),
        spark.createDataFrame(asked, "uid string, metric string, tags map<string,string>"))
    want = sorted((u, i) for u, m, t in asked for i, metric, own, _ in rows if m == metric and t.items() <= own.items())
    assert sorted((r.uid, r.series_id) for r in got.collect()) == want


@pytest.fixture
def board(spark):
    fields = "uid string, panel_pos int, title string, target_pos int, metric string, aggregator string, rate boolean, raw boolean, tags map<string,string>, " \
        "time_from string, interval_seconds bigint, counter boolean, counter_max double, counter_reset double"
    base = lambda title, aggregator, rate=False, raw=False, interval=None, counter=False, top=None, reset=None, metric="m.a": (
        "u", 0, title, 0, metric, aggregator, rate, raw, {"h": "x"}, "now-2d", interval, counter, top, reset)
    return spark.createDataFrame([
        base("mean", "avg"), base("two hours", "sum", interval=7200), base("first", "first", raw=True), base("last", "last", raw=True),
        base("wrapped", "max", rate=True, counter=True, top=100.0), base("dropped", "max", rate=True, counter=True),
        base("reset", "max", rate=True, counter=True, top=1e9, reset=10.0), base("nothing", "avg", metric="m.z")], fields)


def test_a_store_and_loose_points_give_the_same_values(spark, tmp_path, board):
    rng, path = random.Random(6), str(tmp_path / "s")
    rows = [("m.a", 10 * DAY - rng.randrange(4 * DAY), float(rng.randrange(100)), {"h": rng.choice("xxy"), "k": rng.choice("123")}, 0) for _ in range(300)]
    rows = list({(m, s, tuple(t.items())): (m, s, v, t, p) for m, s, v, t, p in rows}.values())
    write(spark, rows, path, 1)
    as_of = F.timestamp_seconds(F.lit(10 * DAY))
    from fleetlens.operators import points as op

    loose = plans.evaluate_panels(op.with_series_key(frame(spark, rows)), board, as_of)
    stored = plans.evaluate_panels(store.read_points(spark, path), board, as_of, dictionary=store.read_series(spark, path))
    values = [sorted((r.title, r.ts, round(r.value, 9)) for r in df.collect()) for df in (loose, stored)]
    assert values[0] == values[1]
    # Brute force of the plain titles.
    buckets = defaultdict(lambda: defaultdict(list))
    for metric, sec, value, tags, _ in rows:
        if tags["h"] == "x" and sec > 8 * DAY:
            buckets["mean", sec // 3600 * 3600][tags["k"]].append(value)
            buckets["two hours", sec // 7200 * 7200][tags["k"]].append(value)
            buckets["first", sec][tags["k"]].append(value)
    mean = lambda v: sum(v) / len(v)
    pick = {"mean": lambda s: mean([mean(v) for v in s.values()]), "two hours": lambda s: sum(mean(v) for v in s.values()), "first": lambda s: s[min(s)][0]}
    want = sorted((title, sec, round(pick[title](s), 9)) for (title, sec), s in buckets.items() if sec > 8 * DAY)
    assert sorted((t, int(ts.timestamp()), v) for t, ts, v in values[0] if t in pick) == want
    assert {t for t, _, _ in values[0]} == {"mean", "two hours", "first", "last", "wrapped", "dropped", "reset"}
    assert all(v >= 0 for t, _, v in values[0] if t in ("wrapped", "dropped")) and all(v <= 10 for t, _, v in values[0] if t == "reset")


def scanned_files(df):
    """Files that the scans of the points read in a run of ``df``."""
    df.collect()
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(node.plan())
        elif name == "FileSourceScanExec" and "series_id" in node.toString() and "metric_family" in node.toString():
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found


def test_the_scan_opens_only_what_the_targets_ask_for(spark, tmp_path, board):
    path = str(tmp_path / "s")
    write(spark, [(f"m.{f}", d * DAY + 60, 1.0, {"h": "x"}, 0) for f in "abcd" for d in range(10)], path, 1)
    written = len(files(f"{path}/points"))
    as_of = F.timestamp_seconds(F.lit(10 * DAY))
    mine = board.filter("title = 'mean'")
    df = plans.evaluate_panels(store.read_points(spark, path), mine, as_of, dictionary=store.read_series(spark, path))
    found = scanned_files(df)
    assert written == 40 and found and max(found) <= 3, found
    assert df.count() == 1
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "tags" not in text
