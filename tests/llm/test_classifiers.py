from __future__ import annotations

import random

from pyspark.sql import functions as F

from fleetlens.llm import lang_id, rule_lists, zstd_quality
from tests.llm.helpers import docs, invented, words

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    from fleetlens.llm.queries import QUERIES

    scored = QUERIES["op3_zstd_quality"](spark, SF)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert scored.where("score < 0 OR score > 1 OR (predicted = 1) != (score >= 0.5)").isEmpty()
    rows = scored.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [1 - r.predicted for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) > 0.5


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (99, 0)], "doc_id long, quality int")
    df = docs(spark, [(1, "good text " * 30), (2, "### $$$ %%% " * 30), (3, None), (4, ""), (5, "x"), (5, "x"), (6, "long words " * 30000)])
    model = zstd_quality.fit(df, labels)
    got = zstd_quality.score(df.withColumn("raw_text", F.lit(1)), model)
    assert got.count() == 7 and got.where("score IS NULL OR isnan(score)").isEmpty()
    assert "raw_text" in got.columns
    for one_class, expected in ((labels.where("quality = 1"), 1), (labels.where("quality = 0"), 0), (labels.where("false"), 1)):
        alone = zstd_quality.score(df, zstd_quality.fit(df, one_class))
        assert {round(r.score) for r in alone.collect()} == {expected}
    assert zstd_quality.score(docs(spark, []), model).count() == 0


def test_language_on_held_out_rows(spark):
    from fleetlens.llm.queries import QUERIES

    found = QUERIES["op6_language_id"](spark, SF)
    rows = found.where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("lang IS NOT NULL").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["der", "die", "und", "nicht"], k=20)), "de") for i in range(40)]
    rows += [(100 + i, " ".join(rng.choices(["the", "and", "of", "that"], k=20)), "en") for i in range(40)]
    rows += [(200, None, "en"), (201, "123 !!", "de"), (202, "", None), (203, "the the of", None), (203, "the the of", None), (None, "und die " * 50000, None)]
    df = docs(spark, rows)
    model = lang_id.fit(df)
    assert model.languages == ("de", "en")
    got = {(r.doc_id, r.lang_pred): r.score for r in lang_id.predict(df.withColumn("score", F.lit("old")), model).collect()}
    assert got[(200, "und")] == got[(201, "und")] == got[(202, "und")] == 0
    assert (203, "en") in got and (None, "de") in got
    nothing = lang_id.fit(df.where("false"))
    assert {r.lang_pred for r in lang_id.predict(df, nothing).collect()} == {"und"}
    assert lang_id.predict(docs(spark, []), model).count() == 0


def plain_counts(text):
    found, lines, seen, dup = words(text, lower=False), (text or "").split("\n"), set(), 0
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_counts(spark):
    rng = random.Random(8)
    made = ["".join(rng.choice(["a", "b", " ", " ", "\n", "\t", "#", "é", "\x0b", "\xa0", "<"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    rows = list(enumerate([*made, None, "", " \n ", "a b c d e a b c d e", "x " * 400, "w w w w", "one line\none line\n one line"]))
    got = rule_lists.statistics(docs(spark, rows).withColumn("n_words", F.lit("old"))).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = plain_counts(r.text)
        assert tuple(r[c] for c in rule_lists.BASE) == expected
        assert r.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
    assert rule_lists.statistics(docs(spark, [])).count() == 0


def test_rules_are_learned_and_plain_rows_stay(spark):
    rng = random.Random(4)
    rows = [(i, invented(rng, 60), None) for i in range(120)]
    rows += [(1000 + i, " ".join(w + "###" for w in invented(rng, 60).split()), None) for i in range(60)]
    rows += [(2000 + i, invented(rng, 60).upper(), None) for i in range(60)]
    counted = rule_lists.statistics(docs(spark, rows)).withColumn("quality", (F.col("doc_id") < 1000).cast("int"))
    rules = rule_lists.learn(counted)
    assert rules and all(len(r) <= 3 for r in rules)
    verdict = {r.doc_id: r.v for r in counted.select("doc_id", rule_lists.verdict(rules).alias("v")).collect()}
    assert sum(v > 0 for i, v in verdict.items() if i >= 1000) > 100
    assert sum(v > 0 for i, v in verdict.items() if i < 1000) <= 2
    assert rule_lists.learn(counted.where("quality = 1")) == []
    assert rule_lists.learn(counted.where("false")) == []


def test_rule_query_runs_without_python(spark):
    counted = rule_lists.statistics(docs(spark, [(1, "a b")]))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_language_is_learned_and_the_sample_is_bounded(spark):
    rows = [(i, " ".join(chr(0x4E00 + 20 * i + k) for k in range(12)), f"l{i:03}") for i in range(230)]
    rows += [(1000 + i, " ".join(chr(0x3400 + 20 * k) for k in range(i % 7, 12)), "zz") for i in range(300)]
    df = docs(spark, rows + [(2000 + i, "12 34", "l005") for i in range(50)])
    model = lang_id.fit(df)
    assert model.languages == tuple(sorted({y for _, _, y in rows}))
    assert (abs(model.weights).max(1) > 0).all()
    got = lang_id.predict(df.where("doc_id < 1000"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 200


def test_quality_sample_is_bounded_where_an_id_repeats(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(zstd_quality, "dictionary", lambda blocks, real=zstd_quality.dictionary: taken.append(len(blocks)) or real(blocks))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    df = docs(spark, [(1, f"good text {i} " * 8) for i in range(300)] + [(2, f"### {i} $$$ " * 8) for i in range(300)])
    zstd_quality.fit(df, labels, rows=40)
    assert taken == [20, 20]
