import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.operators.ratelimit import rate_limit
from glyphlake.operators.runs import span_metrics
from glyphlake.streaming.indexing import compact, merged_index, micro_batch_index, read_compacted, read_status, read_updates
from glyphlake.streaming.limits import ENTRY_EVENTS, _FixedWindow, rate_limit_stream
from glyphlake.streaming.windows import debounce_stream, span_metrics_stream
from glyphlake.workloads.base import requests_by_user, table


def drain(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def event_files(spark, sf, path):
    """The events as several files in time order, one per trigger."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for start, stop in (("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2024-03-01")):
        rows.where(f"ts >= '{start}' AND ts < '{stop}'").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1)  # triggers take files in the order of their modification times
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), rows


def far_event(rows, path):
    """A last far event moves the watermark past everything else."""
    late = rows.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(1_900_000_000))).withColumn("event_id", F.lit(-1).cast("bigint"))
    late.withColumn("user_id", F.lit(-1).cast("bigint")).withColumn("event_type", F.lit("end")).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def tiny_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 2)
    yield
    spark.conf.set(name, before)


def test_limiter_stream_orders_events_of_a_trigger(spark, tmp_path, tiny_batches):
    path = str(tmp_path / "in")
    rows = [("a", at, n) for n, at in enumerate((50, 40, 30, 20, 10))] + [(None, 15, 9), (None, 5, 8)]
    frame = spark.createDataFrame([(k, at * 1_000_000, n) for k, at, n in rows], "key string, at long, event_id long")
    frame.coalesce(1).write.parquet(path)
    time.sleep(1)
    spark.createDataFrame([("end", 10**12, -1)], frame.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = drain(spark, rate_limit_stream(stream, 1, 100_000_000), "ordered")
    batch = rate_limit(frame, 1, 100_000_000)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in batch.select(*found.columns).collect()}


def test_limiter_stream_equals_batch(spark, sf, tmp_path, tiny_batches):
    stream, rows = event_files(spark, sf, str(tmp_path / "events"))
    far_event(rows, str(tmp_path / "events"))
    named = stream.select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"), "event_id")
    day = 86_400_000_000
    found = drain(spark, rate_limit_stream(named, 2, day), "limited")
    batch = rate_limit(requests_by_user(spark, sf).drop("event_type"), 2, day)
    columns = ["event_id", "allowed", "remaining", "reset"]
    mine = {tuple(r) for r in found.select(*columns).collect()}
    assert mine == {tuple(r) for r in batch.select(*columns).collect()}
    assert len({r[0] for r in mine}) == 1000 and any(not r[1] for r in mine)


def test_window_streams_equal_batch(spark, sf, tmp_path):
    stream, rows = event_files(spark, sf, str(tmp_path / "events"))
    far_event(rows, str(tmp_path / "events"))
    bursts = drain(spark, debounce_stream(stream.select("user_id", "ts", "event_id", "value"), "user_id", gap="1 hour"), "bursts")
    from glyphlake.operators.timeline import debounce

    batch = debounce(requests_by_user(spark, sf), "key", "at", 3_600_000_000, "event_id")
    assert {r.event_id for r in bursts.where("user_id >= 0").collect()} == {r.event_id for r in batch.collect()}
    spans = lambda df: df.select("ts", F.col("event_type").alias("route"), F.col("value").alias("duration_ms"), (F.col("value") > 20).alias("failed"))
    metrics = drain(spark, span_metrics_stream(spans(stream), "6 hours"), "metrics").where("route <> 'end'")
    exact = span_metrics(spans(rows), "6 hours")
    key = lambda r: (r.window_start, r.route, r.requests, round(r.error_rate, 9))
    assert {key(r) for r in metrics.collect()} == {key(r) for r in exact.collect()}
    pairs = metrics.select("window_start", "route", F.col("p50").alias("a")).join(exact, ["window_start", "route"])
    assert pairs.count() > 0 and pairs.where("requests % 2 = 1 AND abs(a - p50) > 0.001").count() == 0


def items(spark, path, rows):
    spark.createDataFrame(rows, "doc_id string, seq int, description string").coalesce(1).write.mode("append").json(path)


def encode(batch):
    return batch.withColumn("length", F.length("description")).withColumn("error", F.when(F.col("description").isNull(), "no text"))


def test_micro_batches_and_replay(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    assert read_updates(spark, log) is None
    items(spark, source, [("a", 1, "one"), ("b", 2, None)])
    items(spark, source, [("a", 3, "three"), ("c", 4, "four")])

    def run():
        stream = spark.readStream.schema("doc_id string, seq int, description string").option("maxFilesPerTrigger", 1).json(source)
        query = micro_batch_index(stream, encode, log, state, pause=None)
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    status = read_status(spark, log).first()
    assert (status.batches, status.total, status.success, status.failed) == (2, 4, 3, 1)
    run()  # nothing new: nothing changes
    assert read_status(spark, log).first() == status
    # A batch that is replayed after a crash replaces its own rows.
    before = sorted(map(tuple, read_updates(spark, log).collect()))
    replayed = spark.read.parquet(f"{log}/updates/batch_id=0").collect()
    spark.createDataFrame(replayed, "doc_id string, seq int, description string, length int").write.mode("overwrite").parquet(f"{log}/updates/batch_id=0")
    assert sorted(map(tuple, read_updates(spark, log).collect())) == before
    index = spark.createDataFrame([("a", "keep")], "doc_id string, tag string")
    found = {r.doc_id: r for r in merged_index(index, read_updates(spark, log), "seq").collect()}
    assert set(found) == {"a", "c"} and found["a"].tag == "keep" and found["a"].length == 5 and found["a"].description == "three"
    assert merged_index(index, None, "seq") is index
    # Merging takes each batch once, however often it runs.
    root = str(tmp_path / "index")
    texts = spark.createDataFrame([("a", 0, "zero")], "doc_id string, pos bigint, description string")
    assert compact(spark, root, str(tmp_path / "none"), "seq", index, texts) == 0
    assert [compact(spark, root, log, "seq", index, texts) for _ in range(2)] == [1, 1]
    items(spark, source, [("a", 5, "five")])
    run()
    assert [compact(spark, root, log, "seq", index, texts) for _ in range(2)] == [2, 2]
    documents, texts = read_compacted(spark, root)
    assert sorted(map(tuple, texts.select("doc_id", "pos", "description").collect())) == [
        ("a", 0, "zero"), ("a", 1, "one"), ("a", 2, "three"), ("a", 3, "five"), ("c", 0, "four")
    ]
    assert {r.doc_id: (r.tag, r.length) for r in documents.collect()} == {"a": ("keep", 4), "c": (None, 4)}


def test_many_events_of_one_key_in_one_trigger(spark, tmp_path):
    """A hundred thousand events of one key, all waiting at once, judged as in a batch and within seconds."""
    minute = 60_000_000
    frame = spark.range(100_000).select(F.lit("hot").alias("key"), (F.xxhash64("id") % 2_000_000_000 + 4_000_000_000).alias("at"), F.col("id").alias("event_id"))
    frame.write.parquet(f"{tmp_path}/a")
    late = frame.limit(1).withColumn("at", F.lit(10**15)).withColumn("event_id", F.lit(-1).cast("bigint")).withColumn("key", F.lit("end"))
    late.write.parquet(f"{tmp_path}/b")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/[ab]")
    started = time.time()
    found = drain(spark, rate_limit_stream(stream, 30, minute), "hot_key")
    spent = time.time() - started
    columns = ["event_id", "allowed", "remaining", "reset"]
    want = {tuple(r) for r in rate_limit(frame, 30, minute).select(*columns).collect()}
    assert {tuple(r) for r in found.where("key = 'hot'").select(*columns).collect()} == want
    assert spent < 60


class _States:
    """State variables of one key in memory; counts the calls to them."""

    def __init__(self, window_us: int):
        self.calls, self.timers, self.passed = 0, set(), 0
        event = T.StructType([T.StructField("at", T.LongType()), T.StructField("event_id", T.LongType())])
        self.job = _FixedWindow(2, window_us, event, 0)
        self.job.init(self)

    def getValueState(self, name, schema):
        return _Value(self)

    def getMapState(self, name, key, value):
        return _Value(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def take(self, rows):
        list(self.job.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["at", "event_id"])]), self))

    def getCurrentWatermarkInMs(self):
        return self.passed

    def getExpiryTimeInMs(self):
        return self.expired

    def pass_to(self, ms):
        """The rows handed out when the watermark comes to ``ms``."""
        self.passed, out = ms, []
        while due := [t for t in self.timers if t <= ms]:
            self.expired = min(due)
            self.timers.remove(self.expired)
            for frame in self.job.handleExpiredTimer(("a",), self, self):
                out += frame.drop(columns="key").itertuples(index=False, name=None)
        return out


class _Value:
    def __init__(self, states):
        self.states, self.held, self.value = states, {}, None

    def _called(self, result=None):
        self.states.calls += 1
        return result

    def get(self):
        return self._called(self.value)

    def update(self, value):
        self.value = self._called(value)

    def clear(self):
        self.value = self._called()

    def keys(self):
        return self._called(list(self.held))

    def getValue(self, name):
        return self._called(self.held[name])

    def updateValue(self, name, value):
        assert name not in self.held
        self.held[self._called(name)] = value

    def removeKey(self, name):
        del self.held[self._called(name)]


def plain_limit(rows, limit, window_us):
    out, count, reset = [], 0, -1
    for at, ident in sorted(rows):
        if reset < at:
            count, reset = 0, at + window_us
        count += count < limit or 0
        out.append((at, ident, reset))
    return out


def test_a_key_with_few_events_takes_few_calls_to_the_state_store():
    """Sixty events of sixty buckets, taken in one trigger: one entry."""
    hour = 3_600_000_000
    states = _States(24 * hour)
    rows = [(n * 12 * hour, n) for n in range(60)]
    states.take(rows[::-1])
    assert [r[:2] for r in states.pass_to(10**12)] == rows and states.calls < 20


def test_entries_of_many_buckets_are_judged_bucket_by_bucket():
    """Triggers of many entries in any order, a watermark that stops within them: every event once, in order, none early."""
    second = 1_000_000
    rng = random.Random(3)
    states, sent, found = _States(8 * second), [], []
    low = 0
    for trigger in range(6):
        rows = [(rng.randrange(low * second, (low + 400) * second), trigger * 10_000 + n) for n in range(2 * ENTRY_EVENTS + 300)]
        rows += [((low + 70) * second + n % 7, trigger * 10_000 + 9_000 - n) for n in range(ENTRY_EVENTS // 2)]
        states.take(rows)
        sent += rows
        for step in range(5):
            low += rng.randrange(1, 60)
            part = states.pass_to(low * 1000)
            assert all(at < low * second for at, *_ in part)
            found += part
            low_us = low * second
            assert len(found) == sum(at < low_us for at, _ in sent)
        low += 1
    found += states.pass_to(10**9)
    assert [(r[0], r[1], r[4]) for r in found] == plain_limit(sent, 2, 8 * second)
