from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import near_dedup
from tests.llm.helpers import docs, invented, words


def shingles(text):
    found = words(text)
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4)) or frozenset([tuple(found)])


def brute(rows):
    """doc_id -> smallest id reachable over links, ids being unique."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def edited(rng, text, changes):
    out = text.split()
    for _ in range(changes):
        out[rng.randrange(len(out))] = "new" + str(rng.randrange(10**6))
    return " ".join(out)


def table(seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(25):
        base = invented(rng, rng.randrange(6, 150), 5000)
        for _ in range(rng.randrange(1, 8)):
            rows.append((at, edited(rng, base, rng.randrange(0, 6))))
            at += 1
    rows += [(at + i, t) for i, t in enumerate([None, "", " \n", "a", "A", "a b", "a b c", "A  b\tc", "x " * 3000, "x " * 2000])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)  # keys of several blocks
    rows = table(seed)
    expected = brute(rows)
    got = near_dedup.near_duplicates(docs(spark, rows).withColumn("node", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}


def test_chain_of_links_is_one_group(spark):
    text = [f"t{i}" for i in range(100)]
    rows = []
    for k in range(6):  # neighbours are similar, the ends are not
        rows.append((k, " ".join(text)))
        text = text[12:] + [f"u{k}_{i}" for i in range(12)]
    assert brute(rows) == {k: 0 for k in range(6)}
    assert {r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()} == {0}


def test_null_and_repeated_ids_and_nothing(spark):
    same = invented(random.Random(1), 50)
    rows = [(None, same), (5, same), (3, same), (7, "other words here"), (7, "quite different text of seven"), (8, None), (8, None)]
    got = near_dedup.near_duplicates(docs(spark, rows))
    assert got.count() == len(rows)
    assert {r.component_id for r in got.where("n_shingles = 46").collect()} == {3}
    kept = near_dedup.keep_one(docs(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (False, 3, same), (False, 7, "other words here"), (False, 7, "quite different text of seven"), (False, 8, "")]
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert near_dedup.keep_one(docs(spark, [])).count() == 0


def test_pigeonhole_keys_meet(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 16, near_dedup.SYMBOLS, dtype=np.uint16)
    rows = [(b"base", one.tobytes())]
    for i in range(40):
        other = one.copy()
        other[rng.choice(near_dedup.SYMBOLS, near_dedup.MOST_DIFFERENT, replace=False)] ^= 1
        rows.append((f"n{i}".encode(), other.tobytes()))
    keys = near_dedup.keys_of(spark.createDataFrame(rows, "node binary, sig binary")).collect()
    base = {r.key for r in keys if bytes(r.node) == b"base"}
    assert len(base) == near_dedup.CHUNKS * 4
    for node, _ in rows[1:]:
        assert base & {r.key for r in keys if bytes(r.node) == node}


def test_borderline_pair_beyond_the_pigeonhole_is_linked(spark):
    import numpy as np

    one = [f"s2562w{i}" for i in range(39)]
    rows = [(0, " ".join(one)), (1, " ".join([*one[:19], "new", *one[20:]]))]  # 30 of 40 shingles: exactly 0.75
    sigs = [near_dedup.signature(near_dedup.shingles(t.encode())) for _, t in rows]
    assert sum(a != b for a, b in zip(*(np.frombuffer(s, "<u2") for s in sigs))) == near_dedup.MOST_DIFFERENT + 1
    assert brute(rows) == {0: 0, 1: 0}
    assert {r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()} == {0}
    assert near_dedup.forest([near_dedup.BOTH, near_dedup.RIGHT], [b"a", b"b"], sigs) == [(b"a", b"b")]


@pytest.mark.parametrize("role", ["both", "split"])
def test_forest_connects_what_is_near(role):
    import numpy as np

    rng = np.random.default_rng(5)
    sigs = []
    for _ in range(6):  # chains of signatures, neighbours 20 symbols apart
        sig = rng.integers(0, 1 << 16, near_dedup.SYMBOLS, dtype=np.uint16)
        for _ in range(5):
            sigs.append(sig.tobytes())
            sig = sig.copy()
            sig[rng.choice(near_dedup.SYMBOLS, 20, replace=False)] ^= 7
    nodes = [f"{i:02d}".encode() for i in range(len(sigs))]
    outside = [i % 5 in (1, 3) for i in range(len(sigs))]
    if role == "both":
        roles = [near_dedup.BOTH if o else near_dedup.RIGHT for o in outside]
    else:
        roles = [near_dedup.RIGHT] * len(sigs) + [near_dedup.LEFT] * sum(outside)
        nodes += [n for n, o in zip(nodes, outside) if o]
        sigs += [s for s, o in zip(sigs, outside) if o]
    found = near_dedup.forest(roles, nodes, sigs)
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    assert len({find(n) for n in nodes}) == 6


def test_many_texts_under_one_null_id(spark):
    rng = random.Random(9)
    rows = [(None, invented(rng, 30, 10**6)) for _ in range(1500)]
    rows += [(None, edited(rng, t, 1)) for _, t in rows[:1500]]
    table = docs(spark, rows)
    signed = near_dedup.signed(table, "text", "doc_id")
    classes = signed.select("node", "doc_id", "text_key").distinct()
    assert near_dedup.set_table(table, classes, "text", "doc_id").count() == 3000
    own = near_dedup.keyed_texts(table, "text", "doc_id").alias("r")
    joined = own.join(classes.alias("c"), F.expr("r.doc_id <=> c.doc_id AND r.text_key = c.text_key"))
    assert joined.count() == 3000  # a text meets its own class alone
    half = [(shingles(a), shingles(b)) for (_, a), (_, b) in zip(rows[:1500], rows[1500:])]
    linked = sum(100 * len(a & b) >= 75 * len(a | b) for a, b in half)
    assert 0 < linked < 1500
    assert near_dedup.keep_one(table).count() == 3000 - linked


@pytest.mark.parametrize("bound", ["members", "bytes"])
def test_cells_hold_every_pair_across_components_in_bounded_blocks(spark, monkeypatch, bound):
    monkeypatch.setattr(near_dedup, "BLOCK", 8 if bound == "members" else 10**6)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 8 * 16 if bound == "bytes" else 1 << 30)
    rows = [("g", f"n{i:03d}".encode(), b"big" if i % 8 else f"c{i % 3}".encode(), b"x" * 16) for i in range(200)]
    rows += [("h", b"a", b"c1", b"y" * 16), ("h", b"b", b"c2", b"y" * 16)]
    members = spark.createDataFrame(rows, "grp string, node binary, component binary, set binary")
    placed = near_dedup.dealt(members, "grp", F.octet_length("set"), ["node", "component"]).collect()
    cells = {}
    for r in placed:
        cells.setdefault((r.grp, r.x, r.y), []).append(r)
    met = {
        (g, *sorted((bytes(a.node), bytes(b.node)))) for (g, _, _), held in cells.items()
        for a in held for b in held if a.role != near_dedup.RIGHT and b.role != near_dedup.LEFT and a.component != b.component}
    of = {}
    for g, node, component, _ in rows:
        of.setdefault(g, []).append((node, component))
    assert met == {(g, *sorted((a, b))) for g, held in of.items() for a, p in held for b, q in held if p != q}
    assert max(map(len, cells.values())) < 40
    # 200 members: the 25 outsiders make 4 left blocks, all make 25 right ones
    assert len(placed) == 200 * 4 + 25 * 25 + 2


def test_a_large_star_is_one_component(spark):
    edges = [(b"hub", f"n{i:04d}".encode()) for i in range(3000)] + [(b"n0007", b"aaa"), (b"x", b"y"), (b"z", b"y")]
    got = near_dedup.components(spark.createDataFrame(edges, "a binary, b binary"), "star").collect()
    assert len(got) == 3002 + 3
    assert {bytes(r.component) for r in got} == {b"aaa", b"x"}


@pytest.mark.parametrize("seed, nodes, edges", [(1, 60, 40), (2, 200, 230), (3, 12, 60)])
def test_components_of_random_graphs(spark, seed, nodes, edges):
    rng = random.Random(seed)
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    root = list(range(nodes))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    touched = {x for pair in pairs if pair[0] != pair[1] for x in pair}
    name = lambda i: i.to_bytes(2, "big")
    table = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "a binary, b binary")
    got = near_dedup.components(table, "graph").collect()
    assert len(got) == len(touched)
    assert {bytes(r.node): bytes(r.component) for r in got} == {name(i): name(find(i)) for i in touched}


def test_components_of_a_long_path_and_of_nothing(spark):
    name = lambda i: i.to_bytes(2, "big")
    order = list(range(70))
    random.Random(9).shuffle(order)
    path = spark.createDataFrame([(name(a), name(b)) for a, b in zip(order, order[1:])], "a binary, b binary")
    assert {bytes(r.component) for r in near_dedup.components(path, "path").collect()} == {name(0)}
    assert near_dedup.components(path.limit(0), "none").isEmpty()
