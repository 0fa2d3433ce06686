from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from fleetlens.llm import fim
from tests.llm.helpers import DOCS, docs


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=300), st.sampled_from([1, 8, 64, 5000]))
def test_index_is_exact_and_bounded(lengths, error):
    offsets = np.r_[0, np.cumsum(np.array(lengths, np.int64))].astype(np.int64)
    index = fim.RankIndex.fit(offsets, error)
    assert (index[np.arange(len(offsets))] == offsets).all()
    assert np.abs(index.residual.astype(int)).max() <= error + 1


def test_even_lines_need_one_segment():
    assert len(fim.RankIndex.fit(np.arange(0, 4_000_000, 40)).first) == 1


@given(st.lists(st.sampled_from(["<", "P>", "<S", ">", "\n", "é", "word ", "<P>"]), max_size=12).map("".join), st.lists(st.integers(0, 1 << 32), min_size=4, max_size=4))
def test_round_trip(text, draws):
    n, form, _, _, output = fim.cut(text, tuple(draws), 100, 50, 64)
    assert fim.rebuilt(output, form) == text and n == len(re.findall(r"[^\n]*\n|[^\n]+", text))


def test_table_against_brute_force(spark):
    rng = random.Random(11)
    texts = ["", None, "\n", "\n\n\n", "one line", "a\nb", "a <M> b\nc", "<\n<S\n<P", "x" * 300_000 + "\ny", "𝒳é\n" * 5000]
    texts += ["".join(rng.choice(["w\n", "long line here\n", "\r\n", "é", " "]) for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "a\nb\nc"), (None, None)]
    got = fim.restore(fim.transform(docs(spark, rows))).collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == \
        sorted(map(repr, ((i, *brute(i, t)) for i, t in rows)))
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_rate_empty_table_and_clashing_names(spark):
    rows = docs(spark, [(i, "a\nb\n") for i in range(400)])
    share = fim.transform(rows, rate=30).where("form = 'plain'").count() / 400
    assert 0.6 < share < 0.8
    clash = rows.selectExpr("doc_id", "text", "1 as n", "'x' as FORM", "2 as output", "3 as draws")
    out = fim.transform(clash)
    assert out.columns == ["doc_id", "text", "draws", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.where("form = 'plain'").count() == 0 and out.select("draws").distinct().collect()[0][0] == 3
    assert fim.transform(spark.createDataFrame([], DOCS)).count() == 0


def test_query_against_sql(spark, tmp_path):
    import duckdb

    from fleetlens.llm.queries import ORACLES, QUERIES

    rows = [(0, None), (1, ""), (2, "\n"), (3, "a\r\n\x0bb"), (4, "x <P>\ny"), (None, "é\nb")] + [(i, "line\n" * (i % 9) + "é") for i in range(5, 60)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_fim"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op11_fim']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
