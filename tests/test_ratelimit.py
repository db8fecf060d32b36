import random

import pytest
from pyspark.sql import functions as F

from glyphlake.operators.ratelimit import expire_state, multi_limit, rate_limit, state_at_end, window_openings
from glyphlake.operators.timeline import debounce, with_next_time


def judge(rows, limit, window):
    state, out = {}, set()
    for key, at, ident in sorted(rows, key=lambda r: (r[1], r[2])):
        count, reset = state.get(key, (0, None))
        if reset is None or reset < at:
            count, reset = 0, at + window
        passes = count < limit
        count += passes
        state[key] = (count, reset)
        out.add((key, at, ident, passes, limit - count if passes else 0, reset))
    return out, state


def events(seed, n, span, hot=0.4):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else f"k{rng.randrange(9)}", rng.randrange(span), i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, at bigint, event_id bigint").repartition(6)


def result(df):
    return {tuple(r) for r in df.select("key", "at", "event_id", "allowed", "remaining", "reset").collect()}


@pytest.mark.parametrize(
    "seed, n, span, window, fold_rows",
    [
        (1, 300, 5_000, 100, 20_000), (1, 300, 5_000, 100, 30), (2, 200, 400, 60, 0), (3, 150, 100_000, 300, 20_000),
        (3, 150, 100_000, 300, 0), (4, 60, 50, 1000, 0),
    ],
)
def test_limiter_equals_plain_loop(spark, seed, n, span, window, fold_rows):
    rows = events(seed, n, span)
    expected, _ = judge(rows, 3, window)
    assert result(rate_limit(frame(spark, rows), 3, window, fold_rows=fold_rows)) == expected


@pytest.mark.parametrize("fold_rows", [20_000, 0])
def test_window_edges(spark, fold_rows):
    # The event exactly at the reset still belongs to the window; one later opens the next.
    rows = [("a", 100, 1), ("a", 100, 2), ("a", 200, 3), ("a", 201, 4), ("a", 302, 5), ("b", 0, 6)]
    expected, _ = judge(rows, 2, 100)
    assert result(rate_limit(frame(spark, rows), 2, 100, fold_rows=fold_rows)) == expected
    opened = {tuple(r) for r in window_openings(frame(spark, rows).select("key", "at"), 100, fold_rows).collect()}
    assert opened == {("a", 100), ("a", 201), ("a", 302), ("b", 0)}


def test_negative_times_and_empty_table(spark):
    with pytest.raises(ValueError):
        rate_limit(frame(spark, [("a", 1, 1)]), 0, 10)
    rows = [(k, at - 3000, i) for k, at, i in events(5, 80, 6000)]
    expected, _ = judge(rows, 2, 500)
    assert result(rate_limit(frame(spark, rows), 2, 500, fold_rows=0)) == expected
    assert rate_limit(frame(spark, rows).where("false"), 2, 500, fold_rows=0).collect() == []


def test_multi_limit_needs_every_limit(spark):
    rows = events(6, 200, 5000)
    limits = [("default", 3, 100), ("default", 10, 1000), ("search", 1, 500)]
    grouped = frame(spark, rows).withColumn("limit_group", F.when(F.col("event_id") % 3 == 0, "search").otherwise("default"))
    passes = {}
    for group, limit, window in limits:
        mine = [r for r in rows if (r[2] % 3 == 0) == (group == "search")]
        for r in judge(mine, limit, window)[0]:
            passes.setdefault(r[2], []).append(r[3])
    found = {r.event_id: (r.allowed, r.limits_hit) for r in multi_limit(grouped, limits).collect()}
    assert found == {i: (all(p), p.count(False)) for i, p in passes.items()}


def test_no_event_is_lost(spark):
    rows = [(None, 10, 1), (None, 20, 2), ("a", 10, 3), ("a", None, 4)]
    found = result(rate_limit(frame(spark, rows), 1, 100))
    assert found == {(None, 10, 1, True, 0, 110), (None, 20, 2, False, 0, 110), ("a", 10, 3, True, 0, 110), ("a", None, 4, True, None, None)}
    grouped = frame(spark, rows).withColumn("limit_group", F.when(F.col("event_id") < 3, "listed").when(F.col("event_id") == 3, "other"))
    judged = {r.event_id: (r.allowed, r.limits_hit) for r in multi_limit(grouped, [("listed", 1, 100)]).collect()}
    assert judged == {1: (True, 0), 2: (False, 1), 3: (True, 0), 4: (True, 0)}
    quiet = {r.event_id for r in debounce(frame(spark, rows), "key", "at", 50, "event_id").collect()}
    assert quiet == {2, 3, 4}


def test_state_and_expiry(spark):
    rows = events(7, 200, 5000)
    _, state = judge(rows, 3, 400)
    kept = state_at_end(frame(spark, rows), 3, 400)
    assert {r.key: (r["count"], r.reset) for r in kept.collect()} == state
    assert {r.key for r in expire_state(kept, 5100).collect()} == {k for k, (_, reset) in state.items() if reset >= 5100}


@pytest.mark.parametrize("slice_us", [10, 1000, 10_000_000])
def test_next_time_and_debounce(spark, slice_us):
    rows = events(8, 150, 3000)
    by_key = {}
    for key, at, ident in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key.setdefault(key, []).append((at, ident))
    following = {i: (seq[n + 1][0] if n + 1 < len(seq) else None) for seq in by_key.values() for n, (_, i) in enumerate(seq)}
    found = {r.event_id: r.next_at for r in with_next_time(frame(spark, rows), "key", "at", slice_us, "event_id").collect()}
    assert found == following
    quiet = {i for _, at, i in rows if following[i] is None or following[i] - at >= 50}
    assert {r.event_id for r in debounce(frame(spark, rows), "key", "at", 50, "event_id", slice_us).collect()} == quiet


def test_multi_limit_keeps_repeated_and_null_ids_apart(spark):
    rows = [("search", "a", 5, 1), ("search", "a", 5, 1), ("search", "a", 6, None), ("search", "b", 7, 1), ("search", "b", 7, None), (None, "c", 1, None)]
    events = spark.createDataFrame(rows, "limit_group string, key string, at long, event_id long")
    found = multi_limit(events, [("search", 2, 1000)]).collect()
    assert len(found) == 6
    assert sorted((str(r.event_id), r.allowed, r.limits_hit) for r in found) == [
        ("1", True, 0), ("1", True, 0), ("1", True, 0), ("None", False, 1), ("None", True, 0), ("None", True, 0)
    ]
    assert sum(not r.allowed for r in multi_limit(events, [("search", 1, 1000)]).collect()) == 3
