"""MinHash near-duplicates through a multi-index Hamming join.

A text's set is its distinct 5-word shingles (all its words as one if there are fewer). Two texts
are linked if their sets have a Jaccard similarity of 0.75 or more; the groups are the connected
components of the links.

1. Texts with equal sets become one class, known by a 128-bit digest of the set.
2. A class gets a signature of SYMBOLS minimum hashes of 16 bits. Signatures are split into CHUNKS
   chunks, and for every chunk each way of leaving out ERRORS of its symbols is a key: by pigeonhole
   any two signatures that differ in at most MOST_DIFFERENT symbols share a key, and most of those
   that differ in more do too. (A pair at exactly 0.75 differs in 10 symbols on average; it is missed
   if every chunk has two differing symbols, about 1.5 times in a million.) Pairs that share a key are
   left out before the full sets only if they differ in more than FARTHEST symbols (a pair at exactly
   0.75 does so about once in a billion).
3. Each class that shares a key is compared with the smallest class of that key only, on the
   signature and then on the full sets, and first components are formed. This unites a group of
   any size with as many pairs as it has members.
4. Keys that still span several components connect the classes within the signature distance to
   neighbourhoods (again with as many rows as members). Each neighbourhood of several components
   gets its full sets together, in blocks of BLOCK classes and BLOCK_BYTES, and every pair across
   components is compared on them. In both steps only classes outside a group's commonest component
   are held against all others. No link between different texts is lost, and no pair is written out
   that doesn't unite two components.

The full sets are only made for classes that share a key. Everything is written to the shared
folder between the steps; nothing but row counts comes to the driver.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; a
component's id is the smallest id of its texts, a null id never counts as smallest; repeated ids
with differing texts are rows of their own; an empty table gives no rows. The result has one row per
input row, and no other columns than those named.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.common import WordHashes, mix64, stage, unique_name, window_hashes, words_of

WIDTH = 5
PERCENT = 75
SYMBOLS = 40
CHUNKS = 10
ERRORS = 1
MOST_DIFFERENT = CHUNKS * (ERRORS + 1) - 1
FARTHEST = 28
BLOCK = 2048
BLOCK_BYTES = 16 << 20
# One odd multiplier and one offset for each minimum hash, from a fixed seed.
_DRAWN = np.random.default_rng(20240607).integers(1, 1 << 63, (2, SYMBOLS), dtype=np.uint64)
MULTIPLIERS, OFFSETS = _DRAWN[0] | np.uint64(1), _DRAWN[1]

_hashes = WordHashes()


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(_hashes(words), WIDTH))


def digest(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def signature(found: np.ndarray) -> bytes | None:
    """The low 16 bits of SYMBOLS minimum hashes."""
    if not len(found):
        return None
    out = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    mixed = mix64(found)
    for start in range(0, len(mixed), 2048):
        x = (mixed[None, start : start + 2048] + OFFSETS[:, None]) * MULTIPLIERS[:, None]
        x ^= x >> np.uint64(31)
        np.minimum(out, x.min(1), out=out)
    # The minimum's high bits are small for every large set: mix before taking 16 bits.
    return (mix64(out) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def signed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, sig) of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) for s in sets], pa.binary()), pa.array([signature(s) for s in sets], pa.binary()),
            ], names=["doc_id", "text_key", "n_shingles", "node", "sig"])

    return keyed_texts(docs, text, key).mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, node binary, sig binary")


def keyed_texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, text_key, text): a hash of the text tells apart the texts of a repeated or null id."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def keys_of(classes: DataFrame) -> DataFrame:
    """(key, node): CHUNKS x (ways to leave out ERRORS symbols) keys of every class."""
    size = SYMBOLS // CHUNKS
    cells = []
    for chunk in range(CHUNKS):
        for kept in combinations(range(size), size - ERRORS):
            parts = [F.substring("sig", 2 * (chunk * size + i) + 1, 2) for i in kept]
            number = F.lit(chunk * 256 + sum(1 << i for i in kept))
            cells.append(F.xxhash64(F.concat(*parts), number))
    return classes.select("node", F.explode(F.array(*cells)).alias("key"))


def different(a: str, b: str) -> str:
    """SQL for the number of differing symbols of two signatures."""
    return " + ".join(f"int(substring({a}, {2 * i + 1}, 2) != substring({b}, {2 * i + 1}, 2))" for i in range(SYMBOLS))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def are_stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v), u > v, leads straight to its component's least node: no node has two
    smaller neighbours, and none has both a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    degrees = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return degrees.where("below > 1 OR (below = 1 AND above = 1)").isEmpty()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches: the smallest node reachable.

    Alternating large-star and small-star rounds, each one written out, until only stars are left.
    Both keep what is connected, so the stars are the components. In the first step an edge learns the
    least neighbour of its smaller end, for which smaller neighbours are enough; these are combined
    before the shuffle. A hub has as many edges as its component has nodes, and the join by the smaller
    end is left to Spark, which splits a skewed key by size.
    """
    current = stage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    while not are_stars(current):
        below = current.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = current.join(below, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        current = stage(small.distinct(), label)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


LEFT, RIGHT, BOTH = 0, 1, 2


def dealt(members: DataFrame, group: str, weight: Column, columns: list[str]) -> DataFrame:
    """The members (node, component, ...) of each group in cells (group, x, y), with the role of each.

    Only pairs of different components matter, and each has a side outside the group's commonest
    component. So those outside go into blocks x (LEFT), all members into blocks y (RIGHT), and each
    left block meets each right block in a cell; a group of one cell has its outsiders once (BOTH).
    Blocks hold about BLOCK members and BLOCK_BYTES of ``weight``. Rows come sorted by cell. Copies grow
    with members + outsiders * blocks: in proportion as long as the outsiders of a group fit one block.
    """
    shares = members.groupBy(group, "component").agg(F.count("*").alias("n"), F.sum(weight).alias("bytes"))
    sizes = shares.groupBy(group).agg(
        F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"),
        F.max_by("bytes", F.struct("n", "component")).alias("most_bytes"))

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))

    sizes = sizes.select(
        group, F.col("most.component").alias("most"), blocks(F.col("all"), F.col("all_bytes")).alias("rights"),
        blocks(F.col("all") - F.col("most.n"), F.col("all_bytes") - F.col("most_bytes")).alias("lefts"))
    known = members.join(sizes, group).withColumn("outside", F.col("component") != F.col("most"))
    left = F.pmod(F.xxhash64("node", F.lit(1)), F.col("lefts"))
    right = F.pmod(F.xxhash64("node"), F.col("rights"))

    def cell(x: Column, y: Column, role: Column | int) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), F.lit(role).alias("role"))

    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    single = F.array(cell(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.when(F.col("outside"), BOTH).otherwise(RIGHT)))
    as_right = F.transform(upto("lefts"), lambda x: cell(x, right, RIGHT))
    as_left = F.when(F.col("outside"), F.transform(upto("rights"), lambda y: cell(left, y, LEFT)))
    cells = F.when((F.col("lefts") == 1) & (F.col("rights") == 1), single).otherwise(
        F.concat(as_right, F.coalesce(as_left, F.array().cast("array<struct<x:bigint,y:bigint,role:int>>"))))
    placed = known.select(group, *columns, F.explode(cells).alias("cell")).select(group, "cell.x", "cell.y", "cell.role", *columns)
    return placed.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The columns after the first ``keys`` of each run of equal keys."""
    at, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != at:
                if held:
                    yield [list(c) for c in zip(*held)]
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield [list(c) for c in zip(*held)]


def pair_rows(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])


def forest(roles: list[int], nodes: list[bytes], sigs: list[bytes]) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the pairs of a left and a right member within the signature distance."""
    sig, role = np.frombuffer(b"".join(sigs), "<u2").reshape(-1, SYMBOLS), np.array(roles)
    left, right = np.flatnonzero(role != RIGHT), np.flatnonzero(role != LEFT)
    found = []
    while len(left) and len(right):
        queue, left = [int(left[0])], left[1:]
        if role[queue[0]] == BOTH:
            right = right[right != queue[0]]
        while queue:
            i = queue.pop()
            near = np.zeros(0, int)
            if role[i] != RIGHT:
                near = right[(sig[right] != sig[i]).sum(1) <= FARTHEST]
            if role[i] != LEFT:
                near = np.union1d(near, left[(sig[left] != sig[i]).sum(1) <= FARTHEST])
            found += [(nodes[i], nodes[j]) for j in near.tolist()]
            queue += near.tolist()
            left, right = left[~np.isin(left, near)], right[~np.isin(right, near)]
    return found


def neighbourhoods(members: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all classes of different components which lie within the signature
    distance and share a key; ``members`` has (key, node, component, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in runs(batches, 3):
            yield pair_rows(forest(*columns))

    cells = dealt(members, "key", F.lit(0), ["node", "sig"])
    return cells.mapInArrow(run, "a binary, b binary").where("a != b").distinct()


def exact_links(roles: list[int], nodes: list[bytes], components: list[bytes], raw: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Links of left members to right ones of other components on the full sets, as many as it takes
    to unite what is linked."""
    names: dict[bytes, int] = {}
    component, role = np.array([names.setdefault(c, len(names)) for c in components]), np.array(roles)
    if len(names) < 2:
        return []
    sets = [np.frombuffer(r, np.uint64) for r in raw]
    sizes = np.array([len(x) for x in sets])
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    holders = owner[np.argsort(token, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(token, minlength=len(values)))]
    start = np.r_[0, np.cumsum(sizes)]
    found = []
    for i in np.flatnonzero(role != RIGHT).tolist():
        mine = token[start[i] : start[i + 1]]
        lengths = first[mine + 1] - first[mine]
        places = np.repeat(first[mine] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        common = np.bincount(holders[places], minlength=len(sets))
        linked_to = (100 * common >= PERCENT * (sizes + sizes[i] - common)) & (component != component[i]) & (role != LEFT)
        for j in np.flatnonzero(linked_to).tolist():
            if component[j] != component[i]:
                found.append((nodes[i], nodes[j]))
                component[component == component[j]] = component[i]
    return found


def across(members: DataFrame) -> DataFrame:
    """Links (a, b) between different components of a neighbourhood; ``members`` has
    (neighbourhood, node, component, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in runs(batches, 3):
            found = exact_links(*columns)
            if found:
                yield pair_rows(found)

    cells = dealt(members, "neighbourhood", F.octet_length("set"), ["node", "component", "set"])
    return cells.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    rows = stage(signed(docs, text, key), "signed")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")).alias("source"), F.first("sig").alias("sig"))
    classes = stage(classes.select("node", F.col("source.doc_id").alias("least"), "source.text_key", "sig"), "classes")
    keys = keys_of(classes)
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("members")).where("members > 1")
    members = stage(keys.join(shared, "key").select("key", "node", "first"), "members")

    touched = members.select("node").distinct()
    sources = classes.join(touched, "node", "left_semi").select("node", F.col("least").alias("doc_id"), "text_key")
    sets = stage(set_table(docs, sources, text, key), "sets")

    sig = classes.select("node", "sig")
    pairs = members.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    near = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").where(F.expr(f"{different('sig_a', 'sig_b')} <= {FARTHEST}"))
    links = stage(linked(near.select("a", "b"), sets), "links")
    first = components(links, "first")

    known = members.select("key", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    open_keys = known.join(mixed, "key", "left_semi").join(sig, "node").select("key", "node", "component", "sig")
    around = components(stage(neighbourhoods(open_keys), "near"), "around").withColumnRenamed("component", "neighbourhood")
    within = around.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = within.groupBy("neighbourhood").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("neighbourhood")
    open_sets = within.join(several, "neighbourhood", "left_semi").join(sets, "node")
    more = stage(across(open_sets.select("neighbourhood", "node", "component", "set")), "more")
    # What the first components say is enough of their links: without further ones they are stars already.
    stars = first.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(stars.unionAll(more), "final")

    named = classes.join(final, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(smallest, "component").select("node", "component_id")
    alone = rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = rows.where("node IS NOT NULL").join(of_class, "node").select("doc_id", "n_shingles", "component_id").unionAll(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, of each group of near-duplicates only the one of the smallest id.

    Rows of one id are told apart by a hash of all columns (rows that are equal throughout are one),
    and a null id counts as greater than all others.
    """
    name = unique_name(docs, "row_key")
    own = F.struct(F.col(key).isNull().alias("absent"), F.col(key).alias("id"), F.xxhash64(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = docs.withColumn(name, own)
    kept = near_duplicates(rows, text, name).where("kept").select(F.col("doc_id").alias("kept_key")).distinct()
    # Both steps deal rows by the whole key: the duplicates of a row are dropped without another shuffle.
    kept = stage(kept, "kept")
    return rows.join(kept, F.equal_null(rows[name], kept["kept_key"]), "left_semi").dropDuplicates([name]).drop(name)


def set_table(docs: DataFrame, sources: DataFrame, text: str, key: str) -> DataFrame:
    """(node, set): the full sets of the given classes, made again from one text of each."""
    rows = keyed_texts(docs, text, key)
    same = F.equal_null(rows["doc_id"], sources["doc_id"]) & (rows["text_key"] == sources["text_key"])
    texts = rows.join(sources, same).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            whose = [digest(s) == n for s, n in zip(sets, batch.column(0).to_pylist())]  # two texts may have one hash
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"]).filter(pa.array(whose, pa.bool_()))

    return texts.mapInArrow(run, "node binary, set binary").dropDuplicates(["node"])
