"""Conversation structure repair by iterative-deepening A*.

A repaired conversation has the role initials ``(s?(ua)+)?``. Edits are D (delete a row, 3, demanded
for blank rows and duplicates), I (insert a user or assistant row without text, 2), K (keep, 0) and
R (change a row's role to user or assistant, 2); a truncated row that stays adds 1. The initials
leave one role open for an insertion or a new role at each place, so a string of edit letters says
everything.

``search`` goes depth first through the edits in ASCII order, under a cost bound that is raised to
the least cost that exceeded it, so the first accepting path is the cheapest, and of the cheapest the
ASCII-least. The estimate of what is left adds 3 for each row that must go and 1 for each truncated
one. A table keeps for every state (rows read, last initial) that failed what it needs at least.

Long conversations are cut into pieces of at most PIECE rows in order. A piece is searched once for
each last initial before and after it; costs add up along the pieces, and as no edit string of a
piece is a prefix of another, the ASCII-least whole is made of the choice at each piece. So only two
streams of a few numbers a piece pass over a long conversation, and one of its rows for the digest,
each in constant memory: a SHA-256 can't be taken in parts.

Rows of one turn are taken in the order of role and then of the text's SHA-256.

Defined results: a null role or text is one space; a null turn sorts first and doesn't count in
``gaps``; a null conv_id is one conversation, and stays null; a repeated row is a duplicate like any
other; an empty role can't be kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.llm.common import stage

# White space, ends of sentences, what an edit costs, and the grammar.
BLANK = r"\A[\x20\x09-\x0D]*\z"
TRUNCATED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
DELETE, INSERT, REROLE, CUT_SHORT = 3, 2, 2, 1
# States by the last initial: none, s, u, a. What may follow is s or u, u, a, u.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (NONE, ASSISTANT)
# What closes a conversation after its last row: the cost, and the edits.
CLOSE = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))

PIECE = 32  # rows; a power of two
AT_ONCE = 256  # rows that are Python objects at a time
FAR = 1 << 40


def faults(role: Column, text: Column) -> Column:
    """One letter a row: '-' blank; else the role's initial (x if none of sua), upper case if truncated."""
    initial = F.substring(role, 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(text.rlike(BLANK), "-").when(text.rlike(TRUNCATED), F.upper(known)).otherwise(known)


def search(rows: str, start: int, goal: int | None, failed: dict[int, int] | None = None) -> tuple[int, str]:
    """Cheapest edits, ASCII-least among these, and their cost, over the letters of ``faults`` ('=' is a duplicate).

    From state ``start`` to state ``goal`` with no insertion after the last row, or, if ``goal`` is
    None, to an accepting state. What failed on the way to one goal holds for every start: ``failed``
    is the table that such searches share.
    """
    n = len(rows)
    if goal == NONE or goal == SYSTEM:
        found = deleting(rows, start, goal)
        return found if found is not None else (FAR, "")
    estimate = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        estimate[i] = estimate[i + 1] + (DELETE if rows[i] in "-=" else CUT_SHORT if rows[i].isupper() else 0)
    failed = {} if failed is None else failed
    path: list[str] = []

    def walk(i: int, state: int, allowance: int) -> int:
        """0 if an accepting path within the allowance was found, else how much more the cheapest attempt needs."""
        if allowance < estimate[i]:
            return estimate[i] - allowance
        if i == n and (state == goal if goal is not None else state in ENDS):
            return 0
        key = 4 * i + state
        needed = failed.get(key, 0)
        if needed > allowance:
            return needed - allowance
        lacking = FAR
        for letter, after, cost, step in edits(i, state):
            path.append(letter)
            missing = walk(i + step, after, allowance - cost)
            if not missing:
                return 0
            lacking = min(lacking, missing)
            path.pop()
        failed[key] = allowance + lacking
        return lacking

    def edits(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """In ASCII order: letter, state after it, cost, rows read."""
        following = NEXT[state]
        if i == n:
            return [("I", following, INSERT, 0)] if goal is None else []
        found = [("D", state, DELETE, 1), ("I", following, INSERT, 0)]
        letter = rows[i]
        if letter not in "-=":
            short = CUT_SHORT if letter.isupper() else 0
            own = "xsua".index(letter.lower())
            if own == following or (own == SYSTEM and state == NONE):
                found.append(("K", own, short, 1))
            found.append(("R", following, REROLE + short, 1))
        return found

    bound = estimate[0]
    while True:
        lacking = walk(0, start, bound)
        if not lacking:
            return bound, "".join(path)
        bound += lacking


def deleting(rows: str, start: int, goal: int) -> tuple[int, str] | None:
    """The edits to an initial that only deletions around at most one kept system row reach."""
    if start == goal:
        return DELETE * len(rows), "D" * len(rows)
    if start != NONE or goal != SYSTEM:
        return None
    kept = [(r == "S", -i) for i, r in enumerate(rows) if r in "sS"]
    if not kept:
        return None
    # Of equal costs the one that deletes longest is ASCII-least.
    short, at = min(kept)
    return DELETE * (len(rows) - 1) + short * CUT_SHORT, "D" * -at + "K" + "D" * (len(rows) + at - 1)


@lru_cache(maxsize=1 << 14)
def whole(rows: str) -> tuple[int, str]:
    return search(rows, NONE, None)


@lru_cache(maxsize=1 << 12)
def between(rows: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Costs and edits of a piece from each state (in order) to each state."""
    failed: list[dict[int, int]] = [{} for _ in range(4)]
    cells = [search(rows, start, goal, failed[goal]) for start in range(4) for goal in range(4)]
    return tuple(c for c, _ in cells), tuple(e for _, e in cells)


def best_next(costs: list[int], edits: list[str], left: list[int]) -> list[int]:
    """For each state before a piece the state after it, given the least costs of all that follows."""
    return [min(range(4), key=lambda goal: (costs[4 * start + goal] + left[goal], edits[4 * start + goal])) for start in range(4)]


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the hash of each row's conv_id and turn says."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    draw = F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    once = F.array(F.lit(0))
    return df.where(draw != 0).select(
        "conv_id", "turn",
        F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(once)).alias("copy"),
    ).drop("copy")


ORDER = ["conv_id", "turn", "role", "digest"]


def in_pieces(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, turn, role, digest, letters): at most PIECE rows in order each, keyed by the first of them."""
    slim = rows.select(
        "conv_id", "turn", "role", "digest",
        faults(F.col("role"), F.col("text")).alias("letter"), F.monotonically_increasing_id().alias("spread"))
    # Equal rows are told apart by where they were read, so that many of them are spread over tasks.
    sorted_rows = slim.repartitionByRange(*ORDER, "spread").sortWithinPartitions(*ORDER, "spread").drop("spread")
    placed = stage(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "turns")
    again = placed.where("letter <> '-'").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    again = again.where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    letters = placed.join(again, same, "left").withColumn(
        "letter", F.when((F.col("letter") != "-") & (F.col("place") > F.col("first")), "=").otherwise(F.col("letter")))
    cut = letters.groupBy("conv_id", F.shiftright("place", PIECE.bit_length() - 1).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("place", "letter"))).alias("rows"),
        F.min(F.struct("place", "turn", "role", "digest")).alias("at"))
    return cut.select(
        "conv_id", "piece", "at.turn", "at.role", "at.digest", F.array_join(F.col("rows.letter"), "").alias("letters"))


def mapped(df: DataFrame, schema: str, fn: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """The rows of every partition, in order, through a generator over tuples."""
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), arrow.types)], names=arrow.names)

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                yield from zip(*(c.to_pylist() for c in batch.slice(start, AT_ONCE).columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in fn(tuples(batches)):
            out.append(row)
            if len(out) == AT_ONCE:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    return df.mapInArrow(run, fields)


def same(a: object, b: object) -> bool:
    return a is b or a == b


def plans(pieces: DataFrame) -> DataFrame:
    """(conv_id, piece, turn, role, digest, letters, edits): the edits of every piece in the cheapest whole."""
    key = pieces.schema["conv_id"].dataType.simpleString()
    several = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    split = pieces.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "piece", "letters")
    alone = pieces.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_anti").select("conv_id", "piece", "letters")

    def by_itself(rows):
        for conv, piece, letters in rows:
            yield conv, piece, whole(letters)[1]

    def searched(rows):
        for conv, piece, letters in rows:
            yield (conv, piece, *map(list, between(letters)))

    def backwards(rows):
        now, left = object(), []
        for conv, piece, costs, edits in rows:
            if not same(conv, now):
                now, left = conv, [c for c, _ in CLOSE]
            after = best_next(costs, edits, left)
            left = [costs[4 * q + g] + left[g] for q, g in enumerate(after)]
            yield conv, piece, after, [edits[4 * q + g] for q, g in enumerate(after)]

    def forwards(rows):
        now, state, held = object(), NONE, None
        for conv, piece, after, edits in rows:
            if not same(conv, now):
                if held:
                    yield (*held[:2], held[2] + CLOSE[state][1])
                now, state = conv, NONE
            elif held:
                yield held
            held, state = (conv, piece, edits[state]), after[state]
        if held:
            yield (*held[:2], held[2] + CLOSE[state][1])

    back = mapped(split, f"conv_id {key}, piece long, costs array<long>, edits array<string>", searched)
    back = back.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece"))
    back = mapped(back, f"conv_id {key}, piece long, after array<int>, edits array<string>", backwards)
    # The rows of a conversation are together already; only their order turns.
    ahead = mapped(back.sortWithinPartitions("conv_id", "piece"), f"conv_id {key}, piece long, edits string", forwards)
    found = mapped(alone, f"conv_id {key}, piece long, edits string", by_itself).unionByName(ahead)
    found = found.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), "edits")
    return pieces.join(found, (F.col("piece") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c"))).drop("c", "p")


class Repair:
    """One conversation's report, row by row; it holds no rows, only the edits."""

    def __init__(self) -> None:
        self.digest, self.first = hashlib.sha256(), True
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.low = self.high = None
        self.distinct = 0
        self.audit: list[str] = []
        self.waiting: deque[tuple[str, str]] = deque()
        self.letters, self.edits, self.at, self.edit_at = "", "", 0, 0
        self.state, self.last = NONE, None

    def piece(self, letters: str, edits: str) -> None:
        """Pieces come in order, each before its first row, some earlier where rows are equal."""
        self.waiting.append((letters, edits))
        self.audit.append(edits)

    def write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def insert(self) -> None:
        while self.edit_at < len(self.edits) and self.edits[self.edit_at] == "I":
            self.state = NEXT[self.state]
            self.write(ROLES[self.state], "")
            self.cost += INSERT
            self.edit_at += 1

    def row(self, turn: int | None, role: str, text: str) -> None:
        if self.at == len(self.letters):
            (self.letters, self.edits), self.at, self.edit_at = self.waiting.popleft(), 0, 0
        self.insert()
        letter, edit = self.letters[self.at], self.edits[self.edit_at]
        self.at, self.edit_at = self.at + 1, self.edit_at + 1
        short = letter.isupper()
        self.blank += letter == "-"
        self.duplicate += letter == "="
        self.truncated += short
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += CUT_SHORT * short + (REROLE if edit == "R" else 0)
        self.state = NEXT[self.state] if edit == "R" else "xsua".index(role[0])
        self.write(ROLES[self.state] if edit == "R" else role, text)

    def end(self) -> None:
        self.insert()

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Rewriting(Repair):
    """A conversation's repaired rows, taken away as they come."""

    def __init__(self) -> None:
        super().__init__()
        self.written: list[tuple[int, str, str]] = []
        self.place = 0

    def write(self, role: str, text: str) -> None:
        self.written.append((self.place, role, text))
        self.place += 1

    def drain(self) -> list[tuple[int, str, str]]:
        out, self.written = self.written, []
        return out


def turns_of(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return df.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), said.alias("text"),
        F.unhex(F.sha2(said, 256)).alias("digest"))


def streamed(rows: DataFrame) -> DataFrame:
    """All rows in order, each piece's edits before its first row, conversation by conversation."""
    pieces = plans(stage(in_pieces(rows), "pieces")).withColumn("text", F.lit(None).cast("string"))
    blank = [F.lit(None).cast(k).alias(c) for c, k in (("piece", "long"), ("letters", "string"), ("edits", "string"))]
    both = rows.select(*ORDER, "text", *blank).unionByName(pieces)
    return both.repartition("conv_id").sortWithinPartitions(*ORDER, F.asc_nulls_last("piece")).select(
        "conv_id", "turn", "role", "letters", "edits", "text")


def conversations_of(rows: Iterator[tuple], kind: type[Repair]) -> Iterator[tuple[object, Repair, bool]]:
    """The conversation after each of the rows of ``streamed``, and whether it is at its end."""
    now, held = object(), None
    for conv, turn, role, letters, edits, text in rows:
        if not same(conv, now):
            if held:
                held.end()
                yield now, held, True
            now, held = conv, kind()
        if letters is not None:
            held.piece(letters, edits)
        else:
            held.row(turn, role, text)
            yield now, held, False
    if held:
        held.end()
        yield now, held, True


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``gaps`` are the turn numbers missing between the least and the greatest, ``illegal`` the adjacent
    rows whose initials aren't su, ua or au; the digest is that of ``role:text`` lines.
    """
    rows = turns_of(df, conv, turn, role, text)

    def report(source):
        for key, held, ended in conversations_of(source, Repair):
            if ended:
                yield (key, *held.report())

    return mapped(streamed(rows), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {REPORT}", report)


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, role, text): the rows of every repaired conversation, ``place`` from 0."""
    rows = turns_of(df, conv, turn, role, text)

    def rewrite(source):
        for key, held, _ in conversations_of(source, Rewriting):
            for row in held.drain():
                yield (key, *row)

    return mapped(streamed(rows), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, role string, text string", rewrite)
