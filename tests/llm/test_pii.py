from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from fleetlens.llm import pii
from tests.llm.helpers import DOCS, docs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    ]
    listed = sorted((s, k, e) for k, spans in enumerate(found) for s, e in spans)
    return [len(f) for f in found], ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in listed)


PIECES = ["@", ".", "a", "b-c", "_", "%", "+", "1", "22", "255", "256", "4111111111111111", " ", "-", "(", ")", "é", "\n", "x@y.z", "1.2.3.4", "+1 (487) 555-7209", "00"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    found = pii.base_spans(text)
    counts, listed = brute(text)
    assert [len(f) for f in found] == counts
    assert pii.written([(s, k, e) for k, spans in enumerate(found) for s, e in spans]) == listed
    for kind, start, end in pii.candidates(text):
        assert 0 <= start < end <= len(text) and kind in range(4)


def card(rng):
    head = "4" + "".join(rng.choices("0123456789", k=14))
    return next(head + d for d in "0123456789" if luhn(head + d))


def corpus(rng, n):
    words = "the lake at hill stands near old town server card phone mail call order token".split()
    out = []
    for _ in range(n):
        said = [rng.choice(words) for _ in range(30)]
        kind = rng.randrange(6)
        quad = [str(rng.randrange(256)) for _ in range(4)]
        said.insert(rng.randrange(30), [
            rng.choice([f"{rng.choice(words)}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", f"{rng.choice(words)}.{rng.choice(words)}@example.com"]), ".".join(quad), card(rng),
            f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
            f"token a{rng.randrange(10**15, 10**16)}f {rng.randrange(300, 999)}.{'.'.join(quad[1:])}", str(rng.randrange(10**15, 10**16)),
        ][kind])
        out.append(" ".join(said) + ".")
    return out


def test_model_adds_what_it_should_and_leaves_the_rest(spark):
    rng = random.Random(12)
    texts = corpus(rng, 1500)
    model = pii.fit(docs(spark, list(enumerate(texts))))
    assert (model.thresholds < 1).all()
    two = f"{card(rng)} {card(rng)}"
    held = {
        "email": "please mail jo.smith at example dot com today", "ip": "the server 10[.]20[.]30[.]40 is down",
        "card": f"pay with card {two} now", "phone": f"call +1 (487) 555-7209 {rng.randrange(10**15, 10**16)} today",
    }
    clean = [" ".join(rng.choice("the lake at hill stands near old town com".split()) for _ in range(60)) for _ in range(200)]
    clean += ["version 300.1.2.900 of token 3f9a77120041b5", "at home dot", "it costs 12 345 or 1,234.56 at 10.30"]
    rows = [(i, t) for i, t in enumerate([*held.values(), *clean])]
    got = {r.doc_id: r for r in pii.redact(pii.detect(docs(spark, rows), model)).collect()}
    for i, kind in enumerate(held):
        assert f"[{kind.upper()}]" in got[i].redacted and brute(rows[i][1])[1] == got[i].base, (kind, got[i])
    assert got[2].redacted == "pay with card [CARD] [CARD] now" and got[0].redacted == "please mail [EMAIL] today"
    assert all(got[i].spans == "" and got[i].redacted == t for i, t in rows[4:])


def test_tables_against_the_patterns(spark):
    rng = random.Random(4)
    texts = [None, "", "a" * 2000, "1" * 2000, "1 " * 2000, "1.1.1.1." * 900, "+" + "1 " * 500, "@" * 500, "a@b." * 900, "x" * 2000 + "@b.c"]
    texts += corpus(rng, 100) + ["é 𝒳 a@b.cd 1.2.3.4 " * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q@w.er"), (3, "q@w.er"), (3, "q@w.er")]
    clash = docs(spark, rows).selectExpr("doc_id", "text", "1 as n_ip", "'s' as SPANS", "2 as kind")
    got = pii.detect(clash, pii.fit(clash)).collect()
    want = sorted(map(repr, ((i, *brute(t)) for i, t in rows)))
    assert sorted(map(repr, ((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base) for r in got))) == want
    assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in got)
    empty = spark.createDataFrame([], DOCS)
    assert pii.fit(empty) is pii.NOTHING and pii.detect(empty, pii.NOTHING).count() == 0


def test_long_texts_take_linear_time(spark):
    texts = ["a" * 2_000_000, "1" * 2_000_000, "1 " * 30_000, "1.1.1.1." * 9000, "+" + "1 " * 9000, "@" * 90_000, "a@b." * 30_000, "x" * 500_000 + "@b.c", " at a" * 50_000 + "1"]
    rows = docs(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in pii.detect(rows, pii.fit(rows)).collect()}
    assert got[7].n_email == 1 and got[3].n_ip == 9000


def test_trees_learn_a_threshold_and_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.6)).astype(float)
    trees = pii.Trees.fit(x[:1500], y[:1500])
    assert ((trees.margin(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.98
    p, right = np.array([0.9, 0.8, 0.7, 0.6]), np.array([1.0, 1.0, 0.0, 1.0])
    assert pii.least_threshold(p, right, 0.99) == 0.75 and pii.least_threshold(p, right, 0.7) == 0.5
    assert pii.least_threshold(p, np.zeros(4), 0.5) == 2.0


def test_fit_is_bounded_and_repeatable(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "learn", lambda kind, y, unseen, x, precision: seen.append((np.c_[kind, y], x)) or pii.NOTHING)
    texts = corpus(random.Random(1), 400)
    rows = docs(spark, list(enumerate(texts)) + [(1000 + i, texts[0]) for i in range(300)])
    for parts in (1, 7):
        pii.fit(rows.repartition(parts), rows=20)
    assert (seen[0][0] == seen[1][0]).all() and (seen[0][1] == seen[1][1]).all()
    assert np.unique(seen[0][0], axis=0, return_counts=True)[1].max() <= 20
