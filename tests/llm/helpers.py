"""Brute-force counterparts and small tables that the tests share."""

from __future__ import annotations

import random
import re
import zlib

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=True):
    text = text or ""
    return re.findall("[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def remainder(key, divisor):
    return zlib.crc32(("" if key is None else str(key)).encode()) % divisor


def invented(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join("w" + str(rng.randrange(pool)) for _ in range(n))


def docs(spark, rows):
    """A documents table from (doc_id, text) or (doc_id, text, lang)."""
    full = [(*r, *[None] * (3 - len(r)), "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)
