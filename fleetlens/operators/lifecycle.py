"""Replay of task actions into task states.

Every action is a map on three states, and such maps compose. So a long history is cut into
chunks, each chunk is folded to its map, the maps give every chunk its entry state, and then
all chunks replay at the same time. No task ever sees the whole history of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ABSENT, RUN, STOP = 0, 1, 2
STATE_NAMES = ["absent", "Running", "Stopped"]
CHUNK = 1024
LEVELS = 3

# Action -> next state from (absent, Running, Stopped); None is a refused
# action, which leaves the state. The second row is for a process that fails to start.
TRANSITIONS = {
    "bootstrap": ((RUN, None, None), (STOP, None, None)),
    "start": ((None, None, RUN), (None, None, STOP)),
    "stop": ((None, STOP, None), (None, STOP, None)),
    "restart": ((None, RUN, RUN), (None, STOP, STOP)),
    "rolling_update": ((None, RUN, RUN), (None, STOP, STOP)),
    "cleanup": ((None, None, ABSENT), (None, None, ABSENT)),
}


def _rows() -> list[tuple]:
    return [row for pair in TRANSITIONS.values() for row in pair]


def _next_states() -> Column:
    return F.array(*[
        F.array(*[F.lit(state if nxt is None else nxt) for state, nxt in enumerate(row)]) for row in _rows()
    ])


def _refusals() -> Column:
    return F.array(*[F.array(*[F.lit(nxt is None) for nxt in row]) for row in _rows()])


def _row_number(action: Column, ok: Column) -> Column:
    """Row of the transition table; NULL for an unknown action."""
    code = F.lit(None).cast("int")
    for i, name in enumerate(TRANSITIONS):
        code = F.when(action == name, 2 * i).otherwise(code)
    return code + F.when(ok, 0).otherwise(1)


def _step(row: Column, state: Column) -> Column:
    return F.coalesce(F.get(F.get(_next_states(), row), state), state)


def _identity() -> Column:
    return F.array(F.lit(ABSENT), F.lit(RUN), F.lit(STOP))


def _last(states: Column) -> Column:
    return F.get(states, F.size(states) - 1)


def _up(column: str, chunk: int) -> Column:
    return F.floor(F.col(column) / F.lit(chunk))


def _pack_maps(maps: DataFrame, keys: Sequence[str], parent: Column) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("c", "map")))
    return maps.withColumn("up", parent).groupBy(*keys, "up").agg(items.alias("items"))


def _compose_up(maps: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    """(keys, c, map) -> (keys, c // chunk, map), the maps of a chunk applied in order."""
    composed = F.aggregate(
        "items", _identity(), lambda acc, i: F.transform(acc, lambda s: F.get(i["map"], s))
    )
    return _pack_maps(maps, keys, _up("c", chunk)).select(*keys, F.col("up").alias("c"), composed.alias("map"))


def _entries(maps: DataFrame, above: DataFrame | None, keys: Sequence[str], chunk: int) -> DataFrame:
    """Entry state of every (keys, c). ``above`` has those of the next level; the top level
    starts absent."""
    if above is None:
        packed = _pack_maps(maps, keys, F.lit(0)).withColumn("entry", F.lit(ABSENT))
    else:
        packed = _pack_maps(maps, keys, _up("c", chunk)).join(
            above.withColumnRenamed("c", "up"), [*keys, "up"]
        )
    walk = F.aggregate(
        "items", F.array("entry"),
        lambda acc, i: F.concat(acc, F.array(F.get(i["map"], _last(acc)))),
    )
    out = F.transform(
        "items", lambda i, k: F.struct(i["c"].alias("c"), F.get(F.col("states"), k).alias("entry"))
    )
    return (
        packed.withColumn("states", walk)
        .select(*keys, F.explode(out).alias("o")).select(*keys, "o.c", "o.entry")
    )


def _chunk_events(actions: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    return actions.select(
        *keys, F.floor(F.col("seq") / F.lit(chunk)).alias("c"),
        F.struct(
            F.col("seq").cast("bigint").alias("seq"), F.col("action").alias("action"),
            _row_number(F.col("action"), F.coalesce("ok", F.lit(True))).alias("row"),
        ).alias("e"),
    ).groupBy(*keys, "c").agg(F.array_sort(F.collect_list("e")).alias("events"))


def _event_map() -> Column:
    """The map of a chunk of events: its end state for each of the three entry states."""
    return F.transform(
        _identity(), lambda s: F.aggregate("events", s, lambda acc, e: _step(e["row"], acc))
    )


def replay(
    actions: DataFrame,
    keys: Sequence[str] = ("cluster", "job", "task_id"),
    chunk: int = CHUNK,
    levels: int = LEVELS,
) -> DataFrame:
    """(keys, seq, action, ok) -> (keys, seq, action, state, refused), state after the action.

    ``seq`` is an integer, unique per row: a chunk holds at most ``chunk`` rows of a task and
    a chunk of chunks at most ``chunk`` maps, whatever the share of one task is.
    """
    keys = list(keys)
    packed = _chunk_events(actions, keys, chunk)
    maps = [packed.select(*keys, "c", _event_map().alias("map"))]
    for _ in range(levels - 1):
        maps.append(_compose_up(maps[-1], keys, chunk))
    entry = None
    for level in reversed(maps):
        entry = _entries(level, entry, keys, chunk)

    walk = F.aggregate(
        "events", F.array("entry"),
        lambda acc, e: F.concat(acc, F.array(_step(e["row"], _last(acc)))),
    )
    names = F.array(*[F.lit(n) for n in STATE_NAMES])
    rows = F.transform(
        "events",
        lambda e, i: F.struct(
            e["seq"].alias("seq"), e["action"].alias("action"),
            F.get(names, F.get(F.col("states"), i + 1)).alias("state"),
            F.coalesce(
                F.get(F.get(_refusals(), e["row"]), F.get(F.col("states"), i)), F.lit(True)
            ).alias("refused"),
        ),
    )
    return (
        packed.join(entry, [*keys, "c"]).withColumn("states", walk)
        .select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    )


def final_states(
    actions: DataFrame,
    keys: Sequence[str] = ("cluster", "job", "task_id"),
    chunk: int = CHUNK,
    levels: int = LEVELS,
) -> DataFrame:
    """(keys, state) after the last action of each task: folds only, no replay of the rows."""
    keys = list(keys)
    level = _chunk_events(actions, keys, chunk).select(*keys, "c", _event_map().alias("map"))
    for _ in range(levels - 1):
        level = _compose_up(level, keys, chunk)
    whole = _compose_up(level, keys, 1 << 62)
    names = F.array(*[F.lit(n) for n in STATE_NAMES])
    return whole.select(*keys, F.get(names, F.get("map", F.lit(ABSENT))).alias("state"))
