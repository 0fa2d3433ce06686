from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm import bpe, token_histogram
from tests.llm.helpers import docs

CHARACTERS = ["a", "B", " ", "\n", "\t", "　", "é", "1", "٣", "中", "<|endoftext|>", "'s", "'", "\x1c", "\x85", "😀", "the", "aaaa", "%%%", "\xa0", "\r"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(CHARACTERS) for _ in range(rng.randrange(40))) for _ in range(300)]
    return [*made, "", " ", "a" * 3000, "x" + " " * 50, "word " * 4000, None]


def test_ids_and_texts_equal_the_library(spark, library):
    rows = list(enumerate(texts()))
    back = bpe.decode(bpe.encode(docs(spark, rows))).orderBy("doc_id").collect()
    assert [r.doc_id for r in back] == list(range(len(rows)))
    for (_, text), r in zip(rows, back):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_clashing_columns_and_empty_table(spark):
    df = docs(spark, [(1, "a b"), (1, "a b")]).withColumn("IDS", F.lit("old"))
    got = bpe.encode(df)
    assert sum(c.lower() == "ids" for c in got.columns) == 1
    assert got.count() == 2
    assert bpe.decode(bpe.encode(docs(spark, []))).count() == 0
    assert bpe.decode(docs(spark, [(1, None)]).withColumn("ids", F.lit(None).cast("binary"))).first().decoded == ""


def test_pieces_are_relearned_when_the_memory_is_full(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    known = bpe.Vocabulary(bpe.default_vocabulary())
    for text in ("one two three four five six seven", "eight nine ten one two"):
        assert np.frombuffer(known.encode_many([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_length_histogram_against_plain_counts(spark, library):
    rows = list(enumerate([*texts(), *texts()[:50]]))
    lengths = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    histogram = token_histogram.length_histogram(docs(spark, rows)).cache()
    assert {r.length: r.n_docs for r in histogram.collect()} == {n: lengths.count(n) for n in set(lengths)}
    for r in token_histogram.limit_report(histogram).collect():
        limit = r.context_limit
        assert r.n_docs == lengths.count(limit)
        assert (r.n_longer, r.tokens_longer) == (sum(n > limit for n in lengths), sum(n for n in lengths if n > limit))
        assert (r.docs_total, r.tokens_total) == (len(lengths), sum(lengths))
        assert r.tokens_kept == sum(min(n, limit) for n in lengths)
        assert r.quantile == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    for r in token_histogram.at_limits(histogram, [0, 7, 10**6]).collect():
        assert r.tokens_kept == sum(min(n, r.context_limit) for n in lengths)
    for r in token_histogram.quantiles(histogram, [0.1, 0.5, 1.0]).collect():
        assert r.length == next(n for n in lengths if sum(m <= n for m in lengths) >= r.share * len(lengths))


def test_histogram_of_nothing(spark):
    histogram = token_histogram.length_histogram(docs(spark, []))
    assert token_histogram.limit_report(histogram).count() == 0
    assert token_histogram.at_limits(histogram, [5]).first().tokens_kept == 0
