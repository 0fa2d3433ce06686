r"""Chat formatting with a grammar round trip.

A turn is written as ``<s>[ROLE] role [/ROLE] text</s>`` and a line break; a conversation is its
turns in order. ``parse`` is a deterministic parser of that grammar.

Control strings inside a role or text are escaped by one backslash after their first character
(``</s>`` becomes ``<\/s>``); one that already has backslashes there gets one more, so taking one
away always restores the source. The formatter first writes a block of turns as it is, parses it
back and compares; the turns that don't come back identical, or all that hold a control string if
the number of turns differs, are escaped, until the block is identical.

Turns are rendered per block of a conversation, so that a very long conversation is spread over
tasks; only its finished text, which is the output row, is put together in one place.

Defined results: a null text or role is empty; a null conv_id is a conversation of its own; a null
turn sorts first; rows that tie on the turn are ordered by role and text, and repeated rows stay;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fleetlens.llm.common import with_columns

# The control strings of the template.
CONTROLS = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]"]
CONFLICT = re.compile(r"([<\[])(\\*)(/?(?:s>|ROLE\]|INST\]))")
ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|ROLE\]|INST\]))")
TURN = re.compile(r"<s>\[ROLE\] (.*?) \[/ROLE\] (.*?)</s>\n", re.DOTALL)
LOSS_ROLE = "assistant"
BLOCK = 256  # turn numbers that are rendered together


def escape(text: str) -> str:
    return CONFLICT.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the text's characters start and end in it."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def render(turns: list[tuple[str, str]]) -> str:
    """The formatted turns, escaped as far as the round trip needs it."""
    escaped = [False] * len(turns)
    while True:
        formatted = "".join(
            f"<s>[ROLE] {escape(r) if e else r} [/ROLE] {escape(t) if e else t}</s>\n" for (r, t), e in zip(turns, escaped)
        )
        try:
            back = [x[:2] for x in parse(formatted)]
        except ValueError:
            back = []
        if back == turns:
            return formatted
        if len(back) == len(turns):
            wrong = [a != b for a, b in zip(back, turns)]
        else:
            wrong = [bool(CONFLICT.search(r) or CONFLICT.search(t)) for r, t in turns]
        if not any(w and not e for w, e in zip(wrong, escaped)):
            # What differs is escaped already: a neighbour's control string reaches into it.
            wrong = [True] * len(turns)
        if all(escaped):
            raise ValueError("the turns can't be written")
        escaped = [e or w for e, w in zip(escaped, wrong)]


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted): one row per conversation."""
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn) / BLOCK), F.lit(-(1 << 62))).alias("block"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
        ).alias("row"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def run(batch: pa.RecordBatch) -> list:
        return [pa.array([render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(2).to_pylist()], pa.string())]

    rendered = with_columns(blocks, T.StructType([T.StructField("part", T.StringType())]), run)
    parts = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
    return parts.select("conv_id", F.array_join(F.col("parts.part"), "").alias("formatted"))


TURNS = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("loss", T.BooleanType()),
]))


def read_back(df: DataFrame, formatted: str = "formatted", into: str = "turns") -> DataFrame:
    """Adds ``into``: the parsed turns, with the span of each text in the formatted string.

    ``loss`` marks the spans that the training loss covers (the assistant's texts).
    """
    at = df.columns.index(formatted)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())]))

    def run(batch: pa.RecordBatch) -> list:
        return [pa.array([
            [{"role": r, "text": t, "start": s, "end": e, "loss": r == LOSS_ROLE} for r, t, s, e in parse(x or "")]
            for x in batch.column(at).to_pylist()
        ], kind)]

    return with_columns(df, T.StructType([T.StructField(into, TURNS)]), run)
