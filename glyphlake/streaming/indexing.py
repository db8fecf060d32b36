"""Indexing a stream of items in micro-batches.

A batch is appended as its own partition of an update log, keyed by the batch number: a batch that
is replayed after a failure replaces its own rows and nothing else. Readers merge the log over the
last written index state; ``compact`` merges what is new into the next version and marks how far it got.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from glyphlake.operators.runs import batch_status
from glyphlake.operators.upsert import upsert, upsert_descriptions
from glyphlake.sources.commits import CommitLog

# Pause between batches, per kind of item.
PAUSES = {"text": "100 milliseconds", "svg": "100 milliseconds", "image": "200 milliseconds"}


def micro_batch_index(
    items: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    log_path: str,
    checkpoint_path: str,
    pause: str | None = PAUSES["text"],
) -> StreamingQuery:
    """Start indexing a stream of ``doc_id, ...`` items.

    ``encode`` turns a batch into partial documents with an ``error`` column (null when good).
    Batches are bounded at the source, for files with ``maxFilesPerTrigger``. ``pause`` is the
    shortest time between batches; None handles what is there and stops.
    """

    def index_batch(batch: DataFrame, batch_id: int) -> None:
        encoded = encode(batch).persist()
        good = encoded.where(F.col("error").isNull()).drop("error")
        good.write.mode("overwrite").parquet(f"{log_path}/updates/batch_id={batch_id}")
        status = encoded.select(F.col("doc_id").alias("icon_name"), "error")
        batch_status(status).write.mode("overwrite").parquet(f"{log_path}/status/batch_id={batch_id}")
        status.where(F.col("error").isNotNull()).write.mode("overwrite").parquet(f"{log_path}/errors/batch_id={batch_id}")
        encoded.unpersist()

    writer = items.writeStream.foreachBatch(index_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if pause is None else writer.trigger(processingTime=pause)
    return writer.start()


def read_updates(spark: SparkSession, log_path: str) -> DataFrame | None:
    """All logged partial documents with their ``batch_id``; None before the first batch."""
    try:
        return spark.read.option("mergeSchema", True).parquet(f"{log_path}/updates")
    except AnalysisException:
        return None


def read_status(spark: SparkSession, log_path: str) -> DataFrame:
    """Counters of the whole stream so far."""
    batches = spark.read.parquet(f"{log_path}/status")
    return batches.agg(
        F.count("*").alias("batches"),
        F.sum("total").alias("total"),
        F.sum("success").alias("success"),
        F.sum("failed").alias("failed"),
    )


def merged_index(index: DataFrame, updates: DataFrame | None, arrival: str) -> DataFrame:
    """The index with the log applied in (batch, arrival) order."""
    return index if updates is None else upsert(index, updates, order_by=["batch_id", arrival])


def compacted(spark: SparkSession, root: str) -> tuple[int, int]:
    """The last version below ``root`` and the last batch merged into it; (0, -1) before the first."""
    version, state = CommitLog(spark, f"{root}/log").latest()
    return version, state.get("batch", -1)


def read_compacted(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Documents and texts of the last version."""
    place = CommitLog(spark, f"{root}/log").latest()[1]["place"]
    return tuple(spark.read.parquet(f"{root}/{place}/{part}") for part in ("documents", "texts"))


def compact(spark: SparkSession, root: str, log_path: str, arrival: str, documents: DataFrame, texts: DataFrame) -> int:
    """Merge the logged batches that are not merged yet into the next version; returns its number.

    ``documents`` and ``texts`` are the state before the first version. Each run writes to a folder of its own and then commits:
    of two runs at a time one wins, and the other merges what is still new then, if anything. A run that failed before its
    commit changes nothing, nor does one without new batches. So every update is applied once.
    """
    log = CommitLog(spark, f"{root}/log")
    updates = read_updates(spark, log_path)
    while True:
        version, state = log.latest()
        fresh = None if updates is None else updates.where(F.col("batch_id") > state.get("batch", -1))
        last = None if fresh is None else fresh.agg(F.max("batch_id")).first()[0]
        if last is None:
            return version
        old = read_compacted(spark, root) if version else (documents, texts)
        place = f"state/{uuid.uuid4().hex}"
        # Batches logged while this run goes on are left for the next.
        for part, rows in zip(("documents", "texts"), upsert_descriptions(*old, fresh.where(F.col("batch_id") <= last), ["batch_id", arrival])):
            rows.write.parquet(f"{root}/{place}/{part}")
        if log.commit(version + 1, {"batch": int(last), "place": place}):
            return version + 1
