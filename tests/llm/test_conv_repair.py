from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from fleetlens.llm import conv_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Brute force: (cost, edits) by taking states off a queue in the order of cost, then of the edits."""
    import heapq

    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, path, i, last = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return cost, path
        if (i, last) in done:
            continue
        done.add((i, last))
        heapq.heappush(queue, (cost + 2, path + "I", i, NEXT[last]))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(queue, (cost + 3, path + "D", i + 1, last))
            if fault in ("", "truncated"):
                extra = 1 if fault else 0
                if role[:1] == NEXT[last] or (role[:1] == "s" and last == ""):
                    heapq.heappush(queue, (cost + extra, path + "K", i + 1, role[0]))
                heapq.heappush(queue, (cost + 2 + extra, path + "R", i + 1, NEXT[last]))


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """The report over (turn, role, text) in order."""
    found = faults([r[1:] for r in rows])
    cost, audit = cheapest([(r[1], f) for r, f in zip(rows, found)])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    out, at, last = [], 0, ""
    for edit in audit:
        if edit == "I":
            last = NEXT[last]
            out.append(f"{FULL[last]}:")
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "D":
            continue
        role = FULL[NEXT[last]] if edit == "R" else role
        last = role[0]
        out.append(f"{role}:{text}")
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if x is None else str(x) for x in (conv, turn)]
        draw = zlib.crc32(":".join(said).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        row = (conv, turn, "user" if draw == 4 else role, text)
        out += [row] * (2 if draw == 3 else 1)
    return out


def reports(rows, of):
    want = {}
    for key in {r[0] for r in of}:
        own = [r[1:] for r in rows if r[0] == key]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        want[key] = brute(own)
    return want


def role_and_fault(letter):
    return "xsua"["xsua".find(letter.lower())] if letter not in "-=" else "u", {"-": "blank", "=": "duplicate"}.get(letter, "truncated" if letter.isupper() else "")


@settings(max_examples=300, deadline=None)
@given(st.text("suaSUAx-=", max_size=14))
def test_search_is_the_cheapest_and_ascii_least(rows):
    assert cr.search(rows, cr.NONE, None) == cheapest([role_and_fault(x) for x in rows])


@settings(max_examples=100, deadline=None)
@given(st.text("suaSUAx-=", min_size=1, max_size=24), st.integers(1, 7))
def test_pieces_make_the_whole(rows, size):
    parts = [cr.between(rows[i : i + size]) for i in range(0, len(rows), size)]
    left, chosen = [c for c, _ in cr.CLOSE], []
    for costs, edits in reversed(parts):
        after = cr.best_next(costs, edits, left)
        left = [costs[4 * q + g] + left[g] for q, g in enumerate(after)]
        chosen.insert(0, after)
    state, audit = cr.NONE, ""
    for (_, edits), after in zip(parts, chosen):
        audit, state = audit + edits[4 * state + after[state]], after[state]
    assert (left[cr.NONE], audit + cr.CLOSE[state][1]) == cr.search(rows, cr.NONE, None)


def test_examples():
    assert cr.search("", 0, None) == (0, "")
    assert cr.search("sua", 0, None) == (0, "KKK")
    assert cr.search("ua-=", 0, None) == (6, "KKDD")
    assert cr.search("uu", 0, None) == (2, "KR")
    assert cr.search("s", 0, None) == (3, "D")
    assert cr.search("u", 0, None) == (2, "KI")


@pytest.mark.parametrize("piece", [32, 4])
def test_tables_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    rng = random.Random(piece)
    said = ["Yes.", "No!", "cut", " \n", "", "Why? ", "é. ", "\u0085", None, "what then."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(said)) for c in range(40) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, ["user", "assistant"][t % 2], f"turn {t}.") for c in (100, 101) for t in range(70)]
    rows += [(200, t, "user", "same.") for t in range(300)] + [(201, 1, "user", "equal.")] * 200
    rows += [(None, t, "user", f"x{t}.") for t in (3, None, 1, 9)] + [(300, None, "user", "a."), (300, None, "assistant", "b.")]
    rows += [(1, 0, "user", "again.")] * 3
    given_rows = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair(cr.damaged(given_rows)).collect()}
    after = damage(rows)
    assert got == reports(after, after)


def test_repaired_rows_follow_the_grammar(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b!", "", "c"])) for c in range(30) for t in range(9)]
    got = {}
    for r in cr.repaired(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    report = {r.conv_id: r.repaired_sha256 for r in cr.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    for key, said in report.items():
        own = sorted(got.get(key, []))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest() == said


def test_query_with_lost_conversations_and_clashing_names(spark, tmp_path):
    from fleetlens.llm.queries import QUERIES

    lost = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(c, 0, "user", "only.") for c in lost] + [(1000, t, ["user", "assistant"][t % 2], f"t{t}.") for t in range(9)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as piece", "'x' as digest", "2 as edits", "3 as cost")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == reports(damage(rows), rows)
    assert got[lost[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cr.repair(table).count() == len(lost) + 1
    assert cr.repair(spark.createDataFrame([], SCHEMA)).count() == 0
