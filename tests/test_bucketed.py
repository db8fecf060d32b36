"""The commit log, the bucketed index and concurrent writers."""

import pytest
from pyspark.sql import functions as F

from glyphlake.sources.bucketed import BucketedIndex
from glyphlake.sources.commits import CommitLog
from glyphlake.streaming import indexing


def buckets_in(df):
    return {f.split("__bucket=")[1].split("/")[0] for f in df.inputFiles()}


@pytest.fixture()
def store(spark, tmp_path):
    docs = spark.range(2000).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.col("id").alias("n"), F.lit("old").alias("tag"))
    return BucketedIndex.create(docs, f"{tmp_path}/index", 32)


def test_one_of_two_commits_wins(spark, tmp_path):
    log, other = CommitLog(spark, f"{tmp_path}/log"), CommitLog(spark, f"{tmp_path}/log")
    assert log.latest() == (0, {})
    assert log.commit(1, {"who": "a"}) and not other.commit(1, {"who": "b"})
    assert other.latest() == (1, {"who": "a"})
    assert other.commit(2, {"who": "ü"}) and log.latest() == (2, {"who": "ü"}) and log.read(1) == {"who": "a"}
    import os

    assert [n for n in os.listdir(f"{tmp_path}/log") if not n.endswith((".json", ".crc"))] == []


def test_point_reads_open_only_their_buckets(spark, store):
    ids = spark.createDataFrame([("d1",), ("d1500",), ("none",), (None,)], "doc_id string")
    found = store.get(ids)
    assert {(r.doc_id, r.n) for r in found.collect()} == {("d1", 1), ("d1500", 1500)}
    assert len(buckets_in(found)) <= 3 < len(buckets_in(store.read()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    assert {(r.doc_id, r.found) for r in store.exists(ids).collect()} == {("d1", True), ("d1500", True), ("none", False), (None, False)}
    many = spark.range(0, 2000).select(F.concat(F.lit("d"), "id").alias("doc_id"))
    assert store.get(many).count() == 2000 and store.get(ids.limit(0)).count() == 0


def test_an_update_rewrites_only_its_buckets(spark, store):
    before = set(store.read().inputFiles())
    changes = spark.createDataFrame([("d7", "new", 1), ("d7", None, 2), ("x", "made", 1), ("d9", "late", 5), ("d9", "early", 3)], "doc_id string, tag string, at int")
    assert store.upsert(changes, order_by="at") == 2
    after = set(store.read().inputFiles())
    touched = {f.split("__bucket=")[1].split("/")[0] for f in after - before}
    assert len(touched) <= 3 and len(before & after) >= 29
    rows = {r.doc_id: (r.n, r.tag) for r in store.read().collect()}
    assert len(rows) == 2001
    assert (rows["d7"], rows["x"], rows["d9"], rows["d8"]) == ((7, "new"), (None, "made"), (9, "late"), (8, "old"))
    assert {r.tag for r in store.read(1).collect()} == {"old"}
    assert store.upsert(changes.limit(0).drop("at")) == 2
    with pytest.raises(ValueError, match="no column"):
        store.upsert(spark.createDataFrame([("d7", 1)], "doc_id string, other int"))
    with pytest.raises(ValueError, match="exists"):
        BucketedIndex.create(store.read(), store.root, 32)


@pytest.mark.parametrize("theirs", ["d7", "d8"])
def test_concurrent_updates_lose_nothing(spark, store, monkeypatch, theirs):
    """Another writer commits between the merge and the commit of an update, to the same document or to another."""
    change = spark.createDataFrame([("d7", "mine")], "doc_id string, tag string")
    first, merges = BucketedIndex._merged, []

    def interrupted(self, state, changes, touched):
        written = first(self, state, changes, touched)
        merges.append(touched)
        if len(merges) == 1:
            monkeypatch.setattr(BucketedIndex, "_merged", first)
            other = spark.createDataFrame([(theirs, 70)], "doc_id string, n bigint")
            BucketedIndex(spark, store.root).upsert(other)
        return written

    monkeypatch.setattr(BucketedIndex, "_merged", interrupted)
    assert store.upsert(change) == 3
    rows = {r.doc_id: (r.n, r.tag) for r in store.read().collect()}
    assert rows["d7"] == (70 if theirs == "d7" else 7, "mine") and rows[theirs][0] == 70 and len(rows) == 2000


def test_of_two_compactions_one_wins(spark, tmp_path, monkeypatch):
    root, log = f"{tmp_path}/state", f"{tmp_path}/log"
    none = spark.createDataFrame([], "doc_id string, description string, seq int")
    start = (none.select("doc_id"), none.select("doc_id", F.lit(0).cast("bigint").alias("pos"), "description"))
    for batch, rows in enumerate(([("a", "one", 1)], [("a", "two", 2), ("b", "three", 3)])):
        spark.createDataFrame(rows, none.schema).write.parquet(f"{log}/updates/batch_id={batch}")
    merge, runs = indexing.upsert_descriptions, []

    def interrupted(*args):
        runs.append(1)
        if len(runs) == 1:  # the other run goes through while this one merges
            assert indexing.compact(spark, root, log, "seq", *start) == 1
        return merge(*args)

    monkeypatch.setattr(indexing, "upsert_descriptions", interrupted)
    assert indexing.compact(spark, root, log, "seq", *start) == 1
    assert indexing.compacted(spark, root) == (1, 1)
    _, texts = indexing.read_compacted(spark, root)
    assert sorted(map(tuple, texts.select("doc_id", "pos", "description").collect())) == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three")]
