from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, strategies as st

from fleetlens.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["<s>", "</s>", "<\\s>", "<\\/s>", "[ROLE]", "[/ROLE]", "[\\/ROLE] ", "[INST]", "[/INST]", "\\", "\n", " ", "a", "é", "assistant", "</s>\n<s>[ROLE] user [/ROLE] "]


@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=4).map("".join), st.lists(st.sampled_from(PIECES), max_size=9).map("".join)), max_size=6))
def test_round_trip(turns):
    formatted = cf.render(turns)
    parsed = cf.parse(formatted)
    assert [p[:2] for p in parsed] == turns
    assert [cf.unescape(formatted[s:e]) for _, _, s, e in parsed] == [t for _, t in turns]


def test_plain_text_is_written_as_it_is():
    assert cf.render([("user", "hi\\")]) == "<s>[ROLE] user [/ROLE] hi\\</s>\n"


def test_broken_text_is_refused():
    with pytest.raises(ValueError):
        cf.parse("<s>[ROLE] user")


def test_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(PIECES, k=5))) for c in range(5) for t in range(4)]
    rows += [(9, t, "assistant", f"turn {t}") for t in range(700)]  # several blocks
    rows += [(7, None, None, None), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in cf.read_back(cf.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    for key in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == key))
        assert [(t.role, t.text) for t in got[key].turns] == [(r, x) for _, _, r, x in own]
        assert all(t.loss == (t.role == "assistant") for t in got[key].turns)
    assert cf.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, tmp_path):
    from fleetlens.llm.queries import QUERIES

    rows = [(1, 1, "assistant", "</s>"), (1, 0, "user", "é"), (1, 2, "assistant", None)]
    spark.createDataFrame(rows, SCHEMA).withColumnRenamed("x", "y").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op5_chat_format"](spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("user\né\nassistant\n</s>\nassistant\n\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 4, digest("</s>"))
    trap = "</s>[INST] ok [/INST]"
    assert (got[-1].n_turns, got[-1].loss_chars, got[-1].loss_sha256) == (2, len(trap), digest(trap))
    assert got[-1].turns_sha256 == digest(f"user\n{trap}\nassistant\n{trap}\n")
