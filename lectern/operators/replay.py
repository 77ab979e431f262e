"""Replaying an event log into fragment states, and finding illegal events.

An event is a map of the states onto themselves, written as an array, and maps compose. So a
log needs no single walk: rows are numbered per fragment and dealt into blocks, a block's maps
compose into one, blocks of blocks likewise, until a fragment is one map; then every block
learns its first state from the maps before it, and its rows follow. All of it is array
functions on blocks of bounded size, whatever the length of a fragment's log, and fragments
of one block, which is what most have, need nothing beyond the numbering's shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.hot_groups import numbered, small
from lectern.session import reliable_checkpoint

#: Rows of a block, and blocks of a block of blocks.
BLOCK = 256

# Fixed values of the data contract. A state is a status, with the code of a warning, and
# for a fragment that waits for a retry with the state it came from.
RETRYABLE = ("warning:transcript_mismatch", "warning:audio_warning")
EDITED, REWRITTEN, RESTORED = "warning:text_edited", "warning:text_rewritten", "warning:text_restored"
WARNINGS = (*RETRYABLE, EDITED, REWRITTEN, RESTORED)
FAULTY = (*WARNINGS, "failed")
INITIAL = "pending"
WAITING = {f"pending<{state}": state for state in FAULTY}
STATES = (INITIAL, "generating", "ready", *FAULTY, *WAITING)
#: action -> {from state: to state}. A finished generation with a code, and a rewrite
#: that leaves the text as it was, are actions of their own. Only generated audio can be
#: approved, which edits remove.
TRANSITIONS = {
    "start": dict.fromkeys((INITIAL, *WAITING), "generating"),
    "complete": {"generating": "ready"},
    "complete_with_warning": {"generating": "warning:transcript_mismatch"},
    "complete_with_audio_warning": {"generating": "warning:audio_warning"},
    "fail": {"generating": "failed"},
    "auto_retry": {state: f"pending<{state}" for state in RETRYABLE},
    "manual_retry": {state: f"pending<{state}" for state in FAULTY},
    "cancel_retry": WAITING,
    "manual_edit": dict.fromkeys(FAULTY, EDITED),
    "ai_rewrite": dict.fromkeys(WARNINGS, REWRITTEN),
    "ai_rewrite_same": {state: state for state in WARNINGS},
    "restore": {**{state: state for state in (INITIAL, *WAITING)},
                **dict.fromkeys(("ready", *FAULTY), RESTORED)},
    "approve": dict.fromkeys(RETRYABLE, "ready"),
}


def status_of(state: Column) -> Column:
    return F.regexp_extract(state, "^[a-z]+", 0)


def code_of(state: Column) -> Column:
    """The code of a warning, or the empty string."""
    return F.regexp_extract(state, "^warning:(.*)$", 1)


def transition_table(spark: SparkSession) -> DataFrame:
    rows = [(action, old, new) for action, moves in TRANSITIONS.items()
            for old, new in moves.items()]
    return spark.createDataFrame(rows, "action string, from_state string, to_state string")


def _array(values: list) -> Column:
    return F.array(*[_array(v) if isinstance(v, list) else F.lit(v) for v in values])


def _moves() -> tuple[Column, Column]:
    """Per action, from 1, and state, from 0: the state after it, and whether it is allowed.

    The first row is that of unknown actions, which are never allowed.
    """
    number = {state: k for k, state in enumerate(STATES)}
    after, legal = [list(range(len(STATES)))], [[False] * len(STATES)]
    for moves in TRANSITIONS.values():
        after.append([number[moves.get(state, state)] for state in STATES])
        legal.append([state in moves for state in STATES])
    return _array(after), _array(legal)


def _action_number(action: Column) -> Column:
    names = _array(list(TRANSITIONS))
    return F.coalesce(F.array_position(names, action), F.lit(0)).cast("int") + 1


def _identity() -> Column:
    return _array(list(range(len(STATES))))


def _composed(maps: Column) -> Column:
    """The map that the given ones, in turn, come to."""
    return F.aggregate(maps, _identity(), lambda done, step: F.transform(
        done, lambda state: F.element_at(step, state + 1)))


def _path(maps: Column, start: Column) -> Column:
    """The states before each map and after the last one."""
    return F.aggregate(maps, F.array(start), lambda path, step: F.concat(
        path, F.array(F.element_at(step, F.element_at(path, -1) + 1))))


def _starts(maps: DataFrame, key: str, longest: int, block: int) -> DataFrame:
    """The state before each of the maps (key, _n, _map), of which a key has ``longest`` at most."""
    grouped = maps.groupBy(key, F.expr(f"_n div {block}").alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("_n", "_map"))).alias("_rows"))
    steps = F.transform("_rows", lambda row: row["_map"])
    if longest <= block:
        grouped = grouped.withColumn("_start", F.lit(0))
    else:
        grouped = reliable_checkpoint(grouped)
        above = _starts(
            grouped.select(key, F.col("_block").alias("_n"), _composed(steps).alias("_map")),
            key, -(-longest // block), block)
        grouped = grouped.join(above.withColumnRenamed("_n", "_block"), [key, "_block"])
    return grouped.select(key, F.explode(F.arrays_zip(
        F.transform("_rows", lambda row: row["_n"]).alias("n"),
        F.slice(_path(steps, F.col("_start")), 1, F.size("_rows")).alias("state"))).alias("x")
    ).select(key, F.col("x.n").alias("_n"), F.col("x.state").alias("_start"))


def replay(
    events: DataFrame, key: str, order: list[str], at_most: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Every event with the state before and after it and whether it was allowed.

    Events that are not allowed in the current state leave it unchanged. ``at_most`` bounds
    the number of rows, where that is known.
    """
    names = events.columns
    after, legal = _moves()
    rest = [name for name in names if name != key]
    rows = numbered(events, [key], order, "_n", at_most).select(
        key, F.expr(f"(_n - 1) div {block}").alias("_block"),
        F.struct("_n", _action_number(F.col("action")).alias("_move"), *rest).alias("_row"))
    blocks = rows.groupBy(key, "_block").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    longest = at_most
    if at_most is None or at_most > block:
        longest = events.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    steps = F.transform("_rows", lambda row: F.element_at(after, row["_move"]))
    if longest <= block:
        blocks = blocks.withColumn("_start", F.lit(0))
    else:
        maps = reliable_checkpoint(blocks.select(
            key, F.col("_block").alias("_n"), _composed(steps).alias("_map")))
        starts = _starts(maps, key, -(-longest // block), block).where("_start > 0").select(
            F.col(key), F.col("_n").alias("_block"), "_start")
        blocks = blocks.join(small(starts, maps.count()), [key, "_block"], "left").withColumn(
            "_start", F.coalesce("_start", F.lit(0)))
    states = _array(list(STATES))
    walked = blocks.withColumn("_path", _path(steps, F.col("_start"))).select(
        key, F.explode(F.zip_with(
            "_rows", F.arrays_zip(F.slice("_path", 1, F.size("_rows")).alias("a"),
                                  F.slice("_path", 2, F.size("_rows")).alias("b")),
            lambda row, moved: F.struct(row.alias("row"), moved.alias("moved")))).alias("x"))
    walked = walked.select(key, "x.row.*", F.col("x.moved.a").alias("_a"),
                           F.col("x.moved.b").alias("_b"))
    return walked.select(
        *names, F.element_at(states, F.col("_a") + 1).alias("from_state"),
        F.element_at(states, F.col("_b") + 1).alias("to_state"),
        F.element_at(F.element_at(legal, F.col("_move")), F.col("_a") + 1).alias("legal"),
    ).withColumns({"from_status": status_of(F.col("from_state")),
                   "to_status": status_of(F.col("to_state"))})


def current_states(replayed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last state per fragment with its counts, combined before the shuffle."""
    allowed = F.col("legal")
    return replayed.groupBy(key).agg(
        F.max_by("to_state", F.struct(*order)).alias("_state"),
        F.count_if(allowed & (F.col("action") == "start")).alias("attempt"),
        F.count_if(allowed).alias("applied"),
        F.count_if(~allowed).alias("rejected"),
    ).select(key, status_of(F.col("_state")).alias("status"), "attempt",
             code_of(F.col("_state")).alias("warning_code"), "applied", "rejected")


def illegal_events(replayed: DataFrame, table: DataFrame) -> DataFrame:
    """Events whose (state, action) is missing from the fixed transition table."""
    return replayed.join(
        F.broadcast(table.select("action", "from_state")), ["action", "from_state"],
        "left_anti")
