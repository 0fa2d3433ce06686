from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import gru_lm
from tests.llm.helpers import docs, remainder, words


def sample(seed=1, n=80):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        topic = rng.randrange(2)
        body = [f"t{topic}_{rng.randrange(8)}" if rng.random() < 0.9 else f"rare{rng.randrange(10**6)}," for _ in range(rng.randrange(1, 80))]
        rows.append((i, " ".join(body)))
    return [*rows, (900, None), (901, ""), (902, "É é ÉÉ."), (903, "x " * 4000), (904, "same same"), (904, "same same"), (None, "A a")]


def scored(spark, rows):
    df = docs(spark, rows).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0)
    return gru_lm.scores(df).collect()


@pytest.mark.parametrize("head", [gru_lm.HEAD, 12])
def test_counts_and_base_score(spark, monkeypatch, head):
    monkeypatch.setattr(gru_lm, "HEAD", head)  # 12: most words take the join
    monkeypatch.setattr(gru_lm, "WARM_TOKENS", 2000)
    rows = sample()
    tokens = [(i, [*words(t), "\n"]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if remainder(i, 10) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    expected = Counter()
    for i, ws in tokens:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        expected[(i, remainder(i, 10) == 0, len(ws), sum(w in counts for w in ws), total, round(base, 6))] += 1
    got = scored(spark, rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_the_network_learns_more_than_frequencies(spark):
    rows = [(i, t) for i, t in sample(seed=3, n=400) if i is not None and i < 900]
    got = [r for r in scored(spark, rows) if r.held_out]
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_empty_table_and_nothing_to_learn_from(spark):
    assert scored(spark, []) == []
    held = [(i, "a b") for i in range(200) if remainder(i, 10) == 0][:3]
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in scored(spark, held))


def net(seed=0, kind=np.float64):
    corpus = gru_lm.Corpus([b"\n", b"a", b"b"], np.array([5, 4, 3]), 12, 3, np.zeros(gru_lm.KINDS))
    out = gru_lm.Gru.start(corpus)
    return gru_lm.Gru(out.parameters.astype(kind) + np.random.default_rng(seed).standard_normal(len(out.parameters)) * 0.1)


def test_gradient_is_the_slope_of_the_loss():
    model, rng = net(), np.random.default_rng(1)
    documents = [rng.integers(0, gru_lm.VOCAB + gru_lm.KINDS, n).astype(np.int32) for n in (7, 5)]
    ids, _ = gru_lm.in_lanes(documents, 2)
    _, n, x, keep, y = next(gru_lm.windows(ids, 0, 16))
    h = rng.standard_normal((n, gru_lm.HIDDEN))
    grad, _, touched = model.gradient(x, keep.astype(float), y, h)

    def loss(parameters):
        other = gru_lm.Gru(parameters)
        states, _ = other.advance(x, keep.astype(float), h)
        real = np.flatnonzero(y.reshape(-1) >= 0)
        return -other.log_probability(states.astype(float).reshape(-1, gru_lm.HIDDEN)[real], y.reshape(-1)[real]).mean()

    for i in rng.choice(np.flatnonzero(grad.parameters), 12):
        up, down = model.parameters.copy(), model.parameters.copy()
        up[i] += 1e-3
        down[i] -= 1e-3
        assert (loss(up) - loss(down)) / 2e-3 == pytest.approx(grad.parameters[i], abs=2e-4)
    assert set(touched) == set(x.reshape(-1))


def test_probabilities_add_up_to_one():
    model = net()
    state = np.random.default_rng(2).standard_normal((1, gru_lm.HIDDEN))
    every = np.arange(gru_lm.VOCAB + gru_lm.KINDS)
    assert np.exp(model.log_probability(np.repeat(state, len(every), 0), every)).sum() == pytest.approx(1)


@pytest.mark.parametrize("lanes", [1, 3, 8])
def test_state_is_carried_over_windows_and_reset_between_documents(lanes):
    model, rng = net(kind=np.float32), np.random.default_rng(4)
    documents = [np.append(rng.integers(1, 40, n), 0).astype(np.int32) for n in (90, 3, 0, 41, 17, 8)]

    def plain(doc):
        h, total, before = np.zeros((1, gru_lm.HIDDEN), np.float32), 0.0, 0
        for token in doc:
            states, _ = model.advance(np.array([[before]]), np.ones((1, 1, 1), np.float32), h)
            h = states[-1]
            total += model.log_probability(h, np.array([token]))[0]
            before = token
        return total

    ids, whose = gru_lm.in_lanes(documents, lanes)
    sums, h = np.zeros(len(documents)), np.zeros((ids.shape[1], gru_lm.HIDDEN), np.float32)
    for rows, n, x, keep, y in gru_lm.windows(ids, 0, 10):
        states, _ = model.advance(x, keep, h[:n])
        h = states[-1]
        real = np.flatnonzero(y.reshape(-1) >= 0)
        sums += np.bincount(whose[rows, :n].reshape(-1)[real], model.log_probability(states.reshape(-1, gru_lm.HIDDEN)[real], y.reshape(-1)[real]), len(documents))
    assert sums == pytest.approx([plain(d) for d in documents], rel=1e-4)
