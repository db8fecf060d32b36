"""Finding the next event of a key without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_next_time(events: DataFrame, key: str, at: str, slice_us: int, tie: str | None = None) -> DataFrame:
    """Adds ``next_at``: the time of the key's following event, null for its last one.

    ``at`` is a BIGINT time in microseconds, ``tie`` orders events of equal time. Time is cut in
    slices; inside a (key, slice) a window finds the next event, and the last event of a slice
    takes the first time of the key's next filled slice from the small table of slice starts.
    Events without a key share one; an event without a time has no next one.
    """
    cut = events.withColumn("__slice", F.floor(F.col(at) / slice_us))
    order = [at] if tie is None else [at, tie]
    inside = Window.partitionBy(key, "__slice").orderBy(*order)
    slices = Window.partitionBy(key).orderBy("__slice")
    starts = (
        cut.groupBy(key, "__slice")
        .agg(F.min(at).alias("__first"))
        .select(F.col(key).alias("__key"), F.col("__slice").alias("__at_slice"), F.lead("__first").over(slices).alias("__after"))
    )
    return (
        cut.withColumn("__inside", F.when(F.col(at).isNotNull(), F.lead(at).over(inside)))
        .join(starts, F.col(key).eqNullSafe(F.col("__key")) & F.col("__slice").eqNullSafe(F.col("__at_slice")))
        .withColumn("next_at", F.when(F.col(at).isNotNull(), F.coalesce("__inside", "__after")))
        .drop("__slice", "__inside", "__after", "__key", "__at_slice")
    )


def debounce(
    events: DataFrame, key: str, at: str, gap_us: int, tie: str | None = None, slice_us: int | None = None
) -> DataFrame:
    """The last event of each burst: no other event of its key follows within ``gap_us``.

    Slices are short, 64 gaps by default, so that a busy key spreads over many tasks.
    """
    found = with_next_time(events, key, at, slice_us or gap_us * 64, tie)
    quiet = F.col("next_at").isNull() | (F.col("next_at") - F.col(at) >= gap_us)
    return found.where(quiet).drop("next_at")
