from __future__ import annotations

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from fleetlens.llm import decontam
from tests.llm.helpers import docs, invented, words

ITEMS = "item_id long, text string"


def brute(document, item):
    """Whether some diagonal has a segment that counts as a leak, by trying all segments."""
    d, b = words(document), words(item)
    if len(b) < decontam.SHORTEST:
        return False
    for diagonal in range(-len(b) + 1, len(d)):
        same = [d[p + diagonal] == b[p] if 0 <= p + diagonal < len(d) else None for p in range(len(b))]
        for i in range(len(b)):
            for j in range(i + min(decontam.LEAST, len(b)), len(b) + 1):
                if None not in same[i:j] and 4 * sum(same[i:j]) >= 3 * (j - i):
                    return True
    return False


def tables(spark):
    rng = random.Random(6)
    items = [(i, invented(rng, rng.randrange(15, 40), 10**6)) for i in range(12)]
    rows = [(i, invented(rng, 120, 10**6)) for i in range(20)]
    for i, (_, text) in enumerate(items):
        cut = text.split()
        if i % 3 == 1:  # every sixth word replaced
            cut = ["zz" if k % 6 == 5 else w for k, w in enumerate(cut)]
        rows.append((100 + i, " ".join([*invented(rng, 30, 10**6).split(), *cut, *invented(rng, 30, 10**6).split()]).upper()))
    rows += [(200, items[0][1]), (200, items[0][1]), (201, None), (202, ""), (203, " ".join(items[1][1].split()[:9])), (None, items[2][1]),
             (204, invented(rng, 30000, 10**6) + " " + items[3][1])]
    items += [(50, None), (51, ""), (52, "two words"), (None, items[4][1]), (0, items[0][1])]
    return docs(spark, rows).withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, ITEMS), rows, items


def key(r):
    return tuple((v is not None, v or 0) for v in r)


def test_leaks_against_brute_force_and_both_ways_agree(spark, monkeypatch):
    df, benchmark, rows, items = tables(spark)
    sent = decontam.leaks(df, benchmark).collect()
    expected = sorted(((d, i) for d, t in rows for i, b in items if len(t or "") < 10**4 and brute(t, b)), key=key)
    assert sorted(((r.doc_id, r.item_id) for r in sent if r.doc_id != 204), key=key) == expected
    assert [(r.item_id, r.start_word) for r in sent if r.doc_id == 204] == [(3, 30000)]
    assert len(expected) >= 14
    monkeypatch.setattr(decontam, "SENT_WORDS", 0)
    joined = decontam.leaks(df, benchmark).collect()
    assert sorted(map(tuple, joined), key=key) == sorted(map(tuple, sent), key=key)


def test_without_leaks(spark, monkeypatch):
    df, benchmark, rows, _ = tables(spark)
    leaked = {r.doc_id for r in decontam.leaks(df, benchmark).collect()}
    for words_sent in (decontam.SENT_WORDS, 0):
        monkeypatch.setattr(decontam, "SENT_WORDS", words_sent)
        kept = decontam.without_leaks(df, benchmark)
        assert kept.columns == df.columns
        assert sorted(key((r.doc_id,)) for r in kept.collect()) == sorted(key((d,)) for d, _ in rows if d not in leaked)


def test_empty_tables(spark):
    df, benchmark, rows, _ = tables(spark)
    assert decontam.leaks(docs(spark, []), benchmark).count() == 0
    assert decontam.leaks(df, benchmark.where("false")).count() == 0
    assert decontam.without_leaks(df, benchmark.where("false")).count() == len(rows)


def seeded(pattern):
    """Whether words that differ from an item's where ``pattern`` is 0 share a seed with it on the diagonal."""
    return any(all(pattern[s + i] for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for s in range(len(pattern) - len(m) + 1))


def test_every_accepted_pattern_is_seeded(spark):
    for n in (*range(decontam.SHORTEST, 17), 20):
        for k in {n // 4} if n > 12 else range(n // 4 + 1):
            for gone in combinations(range(n), k):
                assert seeded([int(i not in gone) for i in range(n)]), (n, gone)
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randrange(17, 90)
        gone = set(rng.sample(range(n), rng.randrange(n // 4 + 1)))
        assert seeded([int(i not in gone) for i in range(n)]), gone
    rows = [(1, [f"a{i}" for i in range(60)], range(4, 60, 5)), (2, [f"b{i}" for i in range(15)], (4, 9)), (3, [f"c{i}" for i in range(15)], (12,))]
    documents = [(i, " ".join("zz" if k in gone else w for k, w in enumerate(item))) for i, item, gone in rows]
    benchmark = spark.createDataFrame([(i, " ".join(item)) for i, item, _ in rows], ITEMS)
    got = decontam.leaks(docs(spark, documents), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_longest_segment_against_all_segments():
    rng = random.Random(9)
    for _ in range(3000):
        n = rng.randrange(1, 40)
        same = [rng.random() < 0.75 for _ in range(n)]
        item = np.arange(1, n + 1, dtype=np.uint64)
        got = decontam.best_segment(item * np.array(same, np.uint64), item, 0)
        least = min(decontam.LEAST, n)
        good = [(j - i, -i) for i in range(n) for j in range(i + least, n + 1) if 4 * sum(same[i:j]) >= 3 * (j - i)]
        assert (got is None) == (not good)
        if good:
            length, i = max(good)
            a, size, equal = got
            assert -i <= a and a + size <= -i + length and size >= least and equal == sum(same[a : a + size]) == sum(same[-i : -i + length])
            assert size == least or (same[a] and same[a + size - 1])


def test_random_substitutions_on_both_paths(spark, monkeypatch):
    rng = random.Random(10)
    items = [(i, invented(rng, rng.choice([8, 11, 12, 15, 15, 20, 25, 40]), 10**6)) for i in range(60)]
    rows = []
    for d in range(240):
        item = items[d % 60][1].split()
        for k in rng.sample(range(len(item)), rng.randrange(6)):
            item[k] = "zz"
        rows.append((d, " ".join([*invented(rng, rng.randrange(20), 10**6).split(), *item, *invented(rng, rng.randrange(20), 10**6).split()])))
    want = sorted((d, d % 60) for d, t in rows if brute(t, items[d % 60][1]))
    assert 100 < len(want) < 240
    benchmark = spark.createDataFrame([(float(i), t) for i, t in items], "item_id double, text string").selectExpr("cast(item_id as decimal(9,1)) as item_id", "text")
    for words_sent in (decontam.SENT_WORDS, 0):
        monkeypatch.setattr(decontam, "SENT_WORDS", words_sent)
        assert sorted((r.doc_id, int(r.item_id)) for r in decontam.leaks(docs(spark, rows), benchmark).collect()) == want
