"""Event-time streams: bursts and latency metrics. Rows later than the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounce_stream(
    events: DataFrame, key: str, ts: str = "ts", gap: str = "500 milliseconds", delay: str = "10 seconds",
    tie: str = "event_id",
) -> DataFrame:
    """The last event of each burst, emitted once the watermark has passed its end."""
    last = F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(ts, tie))
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.col(key), F.session_window(ts, gap))
        .agg(last.alias("event"))
        .select(key, "event.*")
    )


def span_metrics_stream(
    spans: DataFrame,
    window: str = "1 minute",
    delay: str = "1 minute",
    ts: str = "ts",
    by: str = "route",
    latency_col: str = "duration_ms",
    error_col: str = "failed",
    accuracy: int = 10_000,
) -> DataFrame:
    """Requests, error rate and approximate p50, p95, p99 latency per closed window and route.

    The percentiles are mergeable sketches, so the state of a busy route stays small.
    """
    p = F.percentile_approx(latency_col, [0.5, 0.95, 0.99], accuracy)
    return (
        spans.withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("w"), by)
        .agg(F.count("*").alias("requests"), F.count_if(error_col).alias("errors"), p.alias("p"))
        .select(
            F.col("w.start").alias("window_start"),
            by,
            "requests",
            (F.col("errors") / F.col("requests")).alias("error_rate"),
            F.col("p")[0].alias("p50"),
            F.col("p")[1].alias("p95"),
            F.col("p")[2].alias("p99"),
        )
    )
