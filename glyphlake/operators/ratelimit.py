"""Fixed-window rate limiting of an event table.

A window of a key opens at its first event and at the first event later than ``window`` after the
last opening. Within a window the first ``limit`` events pass. Which events open windows depends
on all earlier ones of the key, so there are two exact ways to find them:

* keys with few events are folded in one pass over their sorted times;
* busy keys are cut into slices as long as a window. A slice holds at most one opening, so it acts
  as a function from the opening in the slice before to its own. Functions of neighbouring slices
  are composed pairwise with equi-joins, halving their number every round, and the openings are
  then read back down the same tree. No task ever holds a whole key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.operators.joins import lookup_join
from glyphlake.session import cut_lineage

FOLD_ROWS = 20_000
NONE = -1


def _folded_openings(events: DataFrame, window_us: int) -> DataFrame:
    """``key, opened`` by a fold over each key's distinct times; for keys of bounded size."""
    fold = F.aggregate(
        F.array_sort(F.collect_set("at")),
        F.struct(F.array().cast("array<bigint>").alias("all"), F.lit(None).cast("bigint").alias("last")),
        lambda state, at: F.when(
            state["last"].isNull() | (state["last"] + window_us < at),
            F.struct(F.concat(state["all"], F.array(at)).alias("all"), at.alias("last")),
        ).otherwise(state),
    )
    return events.groupBy("key").agg(fold["all"].alias("all")).select("key", F.explode("all").alias("opened"))


def _first_after(entries: DataFrame, times: DataFrame, window_us: int) -> DataFrame:
    """Slice functions: ``key, slice, enter, leave``.

    ``enter`` is the offset of the opening in the slice before, ``leave`` the first larger offset
    of this slice, or none. Offsets of both are ordered inside fine pieces of the slice; an entry
    with nothing larger in its own piece takes the first offset of the next filled piece.
    """
    piece = max(1, window_us // 256)
    both = entries.select("key", "slice", F.col("enter").alias("x"), F.lit(0).alias("is_time")).unionByName(
        times.select("key", "slice", F.col("offset").alias("x"), F.lit(1).alias("is_time"))
    ).withColumn("piece", F.floor(F.col("x") / piece))
    later = Window.partitionBy("key", "slice", "piece").orderBy(F.desc("x"), F.asc("is_time"))
    # Rows of equal offset: the entry sorts first, so it sees only strictly larger times.
    nearest = F.min(F.when(F.col("is_time") == 1, F.col("x"))).over(
        later.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    pieces = both.groupBy("key", "slice", "piece").agg(F.min(F.when(F.col("is_time") == 1, F.col("x"))).alias("first"))
    after = Window.partitionBy("key", "slice").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    beyond = pieces.withColumn("beyond", F.min("first").over(after)).select("key", "slice", "piece", "beyond")
    return (
        both.withColumn("near", nearest)
        .where(F.col("is_time") == 0)
        .join(beyond, ["key", "slice", "piece"])
        .select(
            "key", "slice", F.col("x").alias("enter"),
            F.coalesce("near", "beyond", F.lit(NONE).cast("bigint")).alias("leave"),
        )
    )


def _composed_openings(events: DataFrame, window_us: int) -> DataFrame:
    """``key, opened`` for keys of any size by composing slice functions pairwise."""
    times = cut_lineage(
        events.select(
            "key",
            F.floor(F.col("at") / window_us).alias("slice"),
            F.pmod("at", F.lit(window_us)).alias("offset"),
        ).distinct()
    )
    span = times.agg(F.min("slice").alias("low"), F.max("slice").alias("high")).first()
    if span["low"] is None:
        return events.select("key", F.col("at").alias("opened")).limit(0)
    times = times.withColumn("slice", F.col("slice") - span["low"])
    levels = max(1, math.ceil(math.log2(span["high"] - span["low"] + 1)))
    slices = times.select("key", "slice").distinct()
    # What may enter a slice: nothing, or an opening anywhere in the slice before. A slice whose
    # predecessor is empty is entered with nothing, whatever came before.
    entries = slices.withColumn("enter", F.lit(NONE).cast("bigint")).unionByName(
        times.select("key", (F.col("slice") + 1).alias("slice"), F.col("offset").alias("enter")).join(
            slices, ["key", "slice"], "left_semi"
        )
    )
    tree = [cut_lineage(_first_after(entries, times, window_us))]
    for _ in range(levels):
        tree.append(cut_lineage(_pair_up(tree[-1])))
    # Down again: the entry of the whole is "nothing"; each half gets its own.
    entered = tree[-1].select("key", "slice").distinct().withColumn("enter", F.lit(NONE).cast("bigint"))
    for functions in reversed(tree[:-1]):
        entered = cut_lineage(_split(entered, functions))
    found = _leave(entered, tree[0]).where(F.col("leave") != NONE)
    return found.select("key", ((F.col("slice") + span["low"]) * window_us + F.col("leave")).alias("opened"))


def _leave(entered: DataFrame, functions: DataFrame) -> DataFrame:
    """``entered`` (key, slice, enter, ...) with the ``leave`` of each entry.

    A slice or block nothing can enter from the slice before knows only the entry "nothing", so
    that entry is the fallback; a slice without events leaves nothing.
    """
    plain = functions.where(F.col("enter") == NONE).select("key", "slice", F.col("leave").alias("__plain"))
    return (
        entered.join(functions, ["key", "slice", "enter"], "left")
        .join(plain, ["key", "slice"], "left")
        .withColumn("leave", F.coalesce("leave", "__plain", F.lit(NONE).cast("bigint")))
        .drop("__plain")
    )


def _pair_up(functions: DataFrame) -> DataFrame:
    """Compose the functions of slices 2n and 2n + 1 into that of block n."""
    half = F.pmod("slice", F.lit(2))
    left = functions.where(half == 0).select(
        "key", (F.col("slice") + 1).alias("slice"), F.col("enter").alias("first"), F.col("leave").alias("enter")
    )
    both = _leave(left, functions.where(half == 1)).select("key", "slice", F.col("first").alias("enter"), "leave")
    # Without events in the left half the block is entered with nothing, whatever came before.
    alone = functions.where((half == 1) & (F.col("enter") == NONE)).join(
        left.select("key", "slice").distinct(), ["key", "slice"], "left_anti"
    )
    return both.unionByName(alone.select(*both.columns)).withColumn("slice", F.floor(F.col("slice") / 2))


def _split(entered: DataFrame, functions: DataFrame) -> DataFrame:
    """From the entry of each block to the entries of its halves that have events."""
    halves = functions.select("key", "slice").distinct().withColumn("block", F.floor(F.col("slice") / 2))
    half = F.pmod("slice", F.lit(2))
    left = (
        halves.where(half == 0)
        .join(entered.withColumnRenamed("slice", "block"), ["key", "block"])
        .select("key", "slice", "enter")
    )
    passed = _leave(left, functions).select("key", (F.col("slice") + 1).alias("slice"), F.col("leave").alias("enter"))
    right = (
        halves.where(half == 1)
        .join(passed, ["key", "slice"], "left")
        .select("key", "slice", F.coalesce("enter", F.lit(NONE).cast("bigint")).alias("enter"))
    )
    return left.unionByName(right)


def window_openings(events: DataFrame, window_us: int, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """``key, opened`` of every window of a table ``key, at`` (BIGINT microseconds)."""
    narrow = events.select("key", "at")
    busy = cut_lineage(
        narrow.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > fold_rows).select("key")
    )
    if busy.isEmpty():
        return _folded_openings(narrow, window_us)
    rest = lookup_join(narrow, busy, "key", "left_anti", spread="at")
    large = lookup_join(narrow, busy, "key", "left_semi", spread="at")
    return _folded_openings(rest, window_us).unionByName(_composed_openings(large, window_us))


def _in_windows(events: DataFrame, openings: DataFrame, window_us: int) -> DataFrame:
    """Each event with the opening of its window: the last one at or before it.

    Windows are longer than a slice, so the opening lies in the event's slice or the one before.
    """
    cut = events.withColumn("__slice", F.floor(F.col("at") / window_us))
    opened = openings.withColumn("__slice", F.floor(F.col("opened") / window_us))
    own = opened.withColumnRenamed("opened", "__own")
    before = opened.select("key", (F.col("__slice") + 1).alias("__slice"), F.col("opened").alias("__before"))
    known = own.join(before, ["key", "__slice"], "full_outer")
    return (
        lookup_join(cut, known, ["key", "__slice"], spread="event_id")
        .withColumn("opened", F.when(F.col("__own") <= F.col("at"), F.col("__own")).otherwise(F.col("__before")))
        .drop("__slice", "__own", "__before")
    )


def rate_limit(
    events: DataFrame,
    limit: int | str,
    window_us: int,
    key: str = "key",
    at: str = "at",
    tie: str = "event_id",
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Adds ``allowed, remaining, reset`` to every event of ``key, at, tie``.

    ``limit`` is a number or the name of a column that is the same for all events of a key. Events
    without a key share one; an event without a time belongs to no window and passes. ``tie`` tells events of one key and
    time apart; where it may not, number them as ``multi_limit`` does. Only the
    events that pass are ranked (the rank is cut at ``limit`` before the shuffle); all later
    events of a window compare with its last passing one.
    """
    if isinstance(limit, int) and limit < 1:
        raise ValueError("a limit lets at least one event pass")
    most = F.lit(limit) if isinstance(limit, int) else F.col(limit)
    named = events.withColumnsRenamed({key: "key", at: "at", tie: "event_id"})
    # In a struct a missing key is a key like any other.
    timed = named.where(F.col("at").isNotNull()).withColumn("key", F.struct("key"))
    openings = cut_lineage(window_openings(timed, window_us, fold_rows))
    placed = _in_windows(timed, openings, window_us)
    order = Window.partitionBy("key", "opened").orderBy("at", "event_id")
    ranked = placed.withColumn("rank", F.row_number().over(order))
    # Written once: these rows are part of the result and their last ones are the bar for the rest.
    passed = cut_lineage(ranked.where(F.col("rank") <= most))
    last = passed.where(F.col("rank") == most).select("key", "opened", F.struct("at", "event_id").alias("__last"))
    denied = (
        lookup_join(placed, last, ["key", "opened"], spread="event_id")
        .where(F.struct("at", "event_id") > F.col("__last"))
        .drop("__last")
        .withColumn("rank", most.cast("int"))
        .withColumn("allowed", F.lit(False))
    )
    judged = (
        passed.withColumn("allowed", F.lit(True))
        .unionByName(denied)
        .withColumn("remaining", (most - F.col("rank")).cast("int"))
        .withColumn("reset", F.col("opened") + window_us)
        .withColumn("key", F.col("key.key"))
    )
    free = named.where(F.col("at").isNull()).withColumns(
        {"allowed": F.lit(True), "remaining": F.lit(None).cast("int"), "reset": F.lit(None).cast("bigint")}
    )
    return (
        judged.select(*free.columns)
        .unionByName(free)
        .withColumnsRenamed({"key": key, "at": at, "event_id": tie})
        .select(*events.columns, "allowed", "remaining", "reset")
    )


# The limits of the interface, per route group.
LIMITS = [
    ("default", 60, 60_000_000),
    ("default", 1000, 3_600_000_000),
    ("search", 30, 60_000_000),
    ("search", 500, 3_600_000_000),
    ("admin", 10, 60_000_000),
    ("render", 10, 60_000_000),
]
EXPIRY_US = 300_000_000


def multi_limit(
    events: DataFrame,
    limits: list[tuple[str, int, int]] = LIMITS,
    group_col: str = "limit_group",
    key: str = "key",
    at: str = "at",
    tie: str = "event_id",
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """``tie, allowed, limits_hit``: an event passes when every limit of its group allows it.

    All limits of one window length are judged in one pass, each event once per limit of its group.
    Events of a group without limits, or without a group, pass. Events are numbered first, so each has a row of its own
    whether its ``tie`` is null or repeated; equal ones are judged in any order.
    """
    events = cut_lineage(events.select(group_col, key, at, F.struct(F.col(tie).alias("id"), F.monotonically_increasing_id().alias("n")).alias("__event")))
    judged = events.select("__event", F.lit(True).alias("allowed"))
    for window_us in sorted({w for _, _, w in limits}):
        rows = [(g, n) for g, n, w in limits if w == window_us]
        mine = F.array_compact(F.array(*[F.when(F.col(group_col) == g, F.struct(F.lit(g).alias("g"), F.lit(n).alias("n"))) for g, n in rows]))
        each = events.select(F.explode(mine).alias("__limit"), F.col(key).alias("__key"), at, "__event")
        each = each.select(F.struct("__limit", "__key").alias("key"), at, "__event", F.col("__limit.n").alias("__most"))
        one = rate_limit(each, "__most", window_us, "key", at, "__event", fold_rows)
        judged = judged.unionByName(one.select("__event", "allowed"))
    found = judged.groupBy("__event").agg(F.bool_and("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("limits_hit"))
    return found.select(F.col("__event.id").alias(tie), "allowed", "limits_hit")


def expire_state(state: DataFrame, now_us: int) -> DataFrame:
    """Rate-limit entries ``key, count, reset`` still needed at ``now_us``."""
    return state.where(F.col("reset") >= now_us)


def state_at_end(events: DataFrame, limit: int, window_us: int, key: str = "key", at: str = "at", tie: str = "event_id") -> DataFrame:
    """``key, count, reset`` after the last event of every key, as a stream would hold it."""
    judged = rate_limit(events, limit, window_us, key, at, tie)
    per_window = judged.groupBy(key, "reset").agg(F.count_if("allowed").alias("count"))
    return per_window.groupBy(key).agg(F.max_by("count", "reset").alias("count"), F.max("reset").alias("reset"))
