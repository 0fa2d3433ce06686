"""The two trained classifiers against plain Python, value by value and one text at a time."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import zstandard

from fleetlens.llm import lang_id, zstd_quality
from tests.llm.helpers import docs


def plain_grams(text):
    """bucket -> count of the 1- to 3-grams, with arithmetic modulo 2^32 on plain integers."""
    letters, last = [0], False
    for char in text.lower():
        if char.isalpha():
            letters.append(ord(char))
            last = True
        elif last:
            letters.append(0)
            last = False
    letters += [0]
    found = {}
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            mixed = 0
            for j in range(n):
                odd = int(lang_id.SPREAD[j])
                mixed = (mixed * 0x01000193 + letters[i + j] + 1) % 2**32 * odd % 2**32
                mixed ^= mixed >> 15
            bucket = mixed * odd % 2**32 >> 18
            found[bucket] = found.get(bucket, 0) + 1
    return found


def plain_ftrl(rows, classes, epochs=4, alpha=0.8, beta=1.0, l1=0.02, l2=0.05):
    """Sparse rows [(bucket -> value, class)]; the published per-coordinate rule, with dicts."""
    z, n = {}, {}

    def weight(c, i):
        zi = z.get((c, i), 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get((c, i), 0.0))) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for at in order.permutation(len(rows)):
            features, y = rows[at]
            features = {**features, "bias": 0.3}
            w = {(c, i): weight(c, i) for c in range(classes) for i in features}
            logits = [sum(w[c, i] * v for i, v in features.items()) for c in range(classes)]
            top = max(logits)
            share = [math.exp(x - top) for x in logits]
            total = sum(share)
            for c in range(classes):
                error = share[c] / total - (c == y)
                for i, v in features.items():
                    g, old = error * v, n.get((c, i), 0.0)
                    sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / alpha
                    z[c, i] = z.get((c, i), 0.0) + g - sigma * w[c, i]
                    n[c, i] = old + g * g
    return {key: w for key in z if (w := weight(*key))}


def test_grams_are_those_of_plain_counting():
    for text in ("Ein Haus, zwei Häuser!", "a", "ab  12 cd", "ΑΒΓ δε-ζ", "x" * 300):
        total = lang_id.counts(text)
        assert {int(i): int(total[i]) for i in np.flatnonzero(total)} == plain_grams(text)
    assert lang_id.counts("12 !") is None


def test_weights_are_those_of_plain_ftrl():
    rng = random.Random(4)
    rows = []
    for i in range(30):
        y = i % 3
        at = sorted({rng.randrange(40) + 20 * y for _ in range(8)})
        rows.append((np.array(at), np.array([rng.uniform(0.1, 1) for _ in at]), y))
    weights, bias = lang_id.ftrl(rows, 3)
    plain = plain_ftrl([(dict(zip(at.tolist(), value.tolist())), y) for at, value, y in rows], 3)
    expected, expected_bias = np.zeros_like(weights), np.zeros(3)
    for (c, i), w in plain.items():
        if i == "bias":
            expected_bias[c] = 0.3 * w
        else:
            expected[c, i] = w
    assert np.allclose(weights, expected, atol=1e-9) and np.allclose(bias, expected_bias, atol=1e-9)
    # The first penalty leaves most weights at zero exactly.
    assert set(zip(*np.nonzero(weights))) == {(c, i) for c, i in plain if i != "bias"}


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 200)
    logits = rng.normal(0, 1, (200, 3)) * 4
    logits[np.arange(200), y] += 3

    def loss(t):
        total = 0.0
        for row, label in zip(logits / t, y):
            top = row.max()
            logs = row - top - math.log(sum(math.exp(x - top) for x in row))
            total -= 0.99 * logs[label] + 0.01 * logs.mean()
        return total

    found = lang_id.temperature(logits, y)
    assert all(loss(found) <= loss(found * step) + 1e-6 for step in (0.5, 0.8, 0.95, 1.05, 1.25, 2))


def test_predictions_are_those_of_the_weights_written_out(spark):
    rng = random.Random(8)
    pool = {"de": ["der", "die", "und", "nicht", "schön"], "en": ["the", "and", "of", "that", "with"]}
    rows = [(i, " ".join(rng.choices(pool[lang], k=15)), lang) for i, lang in enumerate(["de", "en"] * 30)]
    df = docs(spark, rows)
    model = lang_id.fit(df)
    holding = {}
    for _, text, _ in rows:
        for bucket in plain_grams(text):
            holding[bucket] = holding.get(bucket, 0) + 1
    seen = [i for i in range(lang_id.BUCKETS) if i in holding]
    order = sorted(seen, key=lambda i: holding[i])
    # Rarer grams never weigh less.
    assert all(model.idf[a] >= model.idf[b] for a, b in zip(order, order[1:]))
    for row in lang_id.predict(df, model).collect():
        grams = plain_grams(row.text)
        values = {i: math.log1p(n) * model.idf[i] for i, n in grams.items()}
        length = math.sqrt(sum(v * v for v in values.values())) or 1.0
        logits = [(sum(model.weights[c, i] * v / length for i, v in values.items()) + model.bias[c]) / model.temperature
                  for c in range(len(model.languages))]
        share = [math.exp(x - max(logits)) for x in logits]
        best = max(range(len(share)), key=share.__getitem__)
        assert row.lang_pred == model.languages[best]
        assert row.score == pytest.approx(share[best] / sum(share), abs=1e-4)


def plain_difference(model, text):
    """Every block compressed by a compressor of its own."""
    raw = (text or "").encode()
    if not raw.strip():
        return 0.0
    sizes = []
    for content in (model.good, model.bad):
        size = 0
        for i in range(0, len(raw), 512):
            params = zstandard.ZstdCompressionParameters(**zstd_quality.SEARCH)
            packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=params)
            packed = packer.compress(raw[i : i + 512])
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            assert unpacker.decompress(packed, max_output_size=512) == raw[i : i + 512]
            size += len(packed)
        sizes.append(size)
    return (sizes[0] - sizes[1]) / (len(raw) + 64)


def test_quality_scores_are_those_of_plain_sizes(spark):
    rng = random.Random(6)
    good, bad = ["river", "house", "morning", "letter", "garden", "quiet"], ["click", "$$$", "###", "free", "win", "!!!"]
    rows = [(i, " ".join(rng.choices((bad, good)[i % 2], k=rng.randrange(5, 400)))) for i in range(80)]
    df = docs(spark, [*rows, (900, None), (901, " \n"), (902, "é" * 700)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = zstd_quality.fit(df, labels)
    for row in zstd_quality.score(df, model).collect():
        x = model.slope * plain_difference(model, row.text) + model.intercept
        assert row.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, x)))), abs=1e-9)


def test_logistic_curve_is_where_the_plain_gradient_ends():
    rng = random.Random(1)
    y = [i % 2 for i in range(60)]
    x = [rng.gauss(0.4 * label, 0.5) for label in y]
    slope, intercept = zstd_quality.logistic(np.array(x), np.array(y, float))
    scale = math.sqrt(sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x))
    a, b = 0.0, 0.0
    for _ in range(4000):
        errors = [1 / (1 + math.exp(-(a * v / scale + b))) - label for v, label in zip(x, y)]
        a -= 0.05 * (sum(e * v / scale for e, v in zip(errors, x)) + 0.01 * a)
        b -= 0.05 * (sum(errors) + 0.01 * b)
    assert slope == pytest.approx(a / scale, abs=1e-6) and intercept == pytest.approx(b, abs=1e-6)
