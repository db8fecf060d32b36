"""Results of indexing runs: per icon, per batch and per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.vectors import present
from glyphlake.session import cut_lineage

# The error texts and token type of an indexing run.
RENDER_ICON_IMAGE = "Failed to render icon image - renderer service is required"
EMBED_ICON_IMAGE = "Failed to generate icon image embedding"
EMBED_ICON_SVG = "Failed to generate icon SVG embedding"
RENDER_TOKEN_IMAGE = "Failed to render token image"
EMBED_TOKEN_IMAGE = "Failed to generate token image embedding"
RENDER_TOKEN_SVG = "Failed to render token SVG"
EMBED_TOKEN_SVG = "Failed to generate token SVG embedding"
INDEX_FAILED = "Failed to index embeddings"
TOKEN_TYPE = "string"


def _one_of(source: str, vector: str, no_source: str, no_vector: str) -> Column:
    """The error of a rendered payload: nothing rendered, or rendered but not encoded."""
    return F.when(~_has(source), F.lit(no_source)).when(~_has_vector(vector), F.lit(no_vector))


def _has(name: str) -> Column:
    return F.col(name).isNotNull() & (F.length(name) > 0)


def _has_vector(name: str) -> Column:
    return F.coalesce(present(name), F.lit(False))


def process_icons(icons: DataFrame, skip_tokens: bool = False, index_ok: str | None = None) -> DataFrame:
    """Outcome per icon of one run over rows with the payloads and the four vectors.

    Needs ``icon_name, filename, icon_image, token_image, token_svg_content`` and the visual
    fields. ``index_ok`` names a boolean column telling whether the write worked; without it the
    run is dry and an icon counts as indexed when it has an icon vector.
    """
    errors = [
        _one_of("icon_image", "icon_image_embedding", RENDER_ICON_IMAGE, EMBED_ICON_IMAGE),
        F.when(~_has_vector("icon_svg_embedding"), F.lit(EMBED_ICON_SVG)),
    ]
    if not skip_tokens:
        errors += [
            _one_of("token_image", "token_image_embedding", RENDER_TOKEN_IMAGE, EMBED_TOKEN_IMAGE),
            _one_of("token_svg_content", "token_svg_embedding", RENDER_TOKEN_SVG, EMBED_TOKEN_SVG),
        ]
    if index_ok is not None:
        written = F.coalesce(F.col(index_ok), F.lit(False))
        errors.append(F.when(~written, F.lit(INDEX_FAILED)))
        indexed = written
    else:
        indexed = _has_vector("icon_image_embedding") | _has_vector("icon_svg_embedding")
    return (
        icons.withColumn("errors", F.array_compact(F.array(*errors)))
        .withColumn("indexed", indexed)
        .withColumn("success", F.size("errors") == 0)
        .withColumn("token_type", F.lit(None if skip_tokens else TOKEN_TYPE).cast("string"))
        .select("icon_name", "filename", "success", "indexed", "token_type", "errors")
    )


def run_summary(results: DataFrame) -> DataFrame:
    """One row ``total, successful, indexed, failed, ok``."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if("indexed").alias("indexed"),
    ).select(
        "*",
        (F.col("total") - F.col("successful")).alias("failed"),
        (F.col("total") == F.col("successful")).alias("ok"),
    )


def failed_icons(results: DataFrame) -> DataFrame:
    return results.where(~F.col("success")).select("icon_name", F.concat_ws(", ", "errors").alias("errors"))


def batch_status(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``total, success, failed`` of items ``icon_name, error``, an item without error is a success."""
    return items.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("error").isNull()).alias("success"),
        F.count("error").alias("failed"),
    )


def batch_errors(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The error list of a batch, one row per failed item."""
    return items.where(F.col("error").isNotNull()).select(*(by or []), "icon_name", "error")


def list_indexed(index: DataFrame, key: str = "doc_id", cap: int | None = None) -> DataFrame:
    """Values of ``key`` with their document counts, most frequent first; with ``cap`` only so many."""
    counts = index.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), key)
    return counts if cap is None else counts.limit(cap)


# The percentiles told.
PERCENTILES = (0.5, 0.95, 0.99)
#: Distinct latencies of a route in a window that one task reads at once.
BUFFERED = 100_000


def span_metrics(
    spans: DataFrame,
    window: str = "1 minute",
    ts_col: str = "ts",
    by: str = "route",
    latency_col: str = "duration_ms",
    error_col: str = "failed",
    buffered: int = BUFFERED,
) -> DataFrame:
    """Requests, error rate and p50, p95, p99 latency per window and route; the percentiles are exact.

    Rows of one route are first counted per distinct latency. A route of up to ``buffered`` distinct latencies in a window
    has them read by one task; the ranks of busier ones are found by counts of sorted ranges.
    """
    histogram = spans.groupBy(F.window(ts_col, window).alias("w"), by, F.col(latency_col).alias("latency")).agg(
        F.count("*").alias("n"), F.count_if(error_col).alias("errors")
    )
    histogram = cut_lineage(histogram)
    busy = cut_lineage(histogram.groupBy("w", by).agg(F.count("*").alias("k")).where(F.col("k") > buffered).select("w", by))
    p = F.percentile("latency", F.array(*map(F.lit, PERCENTILES)), F.col("n"))
    sums = [F.sum("n").alias("requests"), F.sum("errors").alias("errors")]
    if busy.isEmpty():
        found = histogram.groupBy("w", by).agg(*sums, p.alias("p"))
    else:
        # A missing route is a route like any other.
        same = F.col("w").eqNullSafe(F.col("__w")) & F.col(by).eqNullSafe(F.col("__by"))
        named = busy.select(F.col("w").alias("__w"), F.col(by).alias("__by"))
        marked = histogram.join(named, same, "left").withColumn("__busy", F.col("__w").isNotNull()).drop("__w", "__by")
        usual = marked.where(~F.col("__busy")).groupBy("w", by).agg(*sums, p.alias("p"))
        large = marked.where("__busy").drop("__busy")
        counts = large.groupBy("w", by).agg(*sums)
        at = _ranked_percentiles(large.where(F.col("latency").isNotNull()), ["w", by])
        at = at.select(F.col("w").alias("__w"), F.col(by).alias("__by"), "p")
        found = usual.unionByName(counts.join(at, same, "left").drop("__w", "__by"))
    return found.select(
        F.col("w.start").alias("window_start"),
        by,
        "requests",
        (F.col("errors") / F.col("requests")).alias("error_rate"),
        F.col("p")[0].alias("p50"),
        F.col("p")[1].alias("p95"),
        F.col("p")[2].alias("p99"),
    )


def _ranked_percentiles(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, p``: the percentiles of rows ``keys, latency, n`` by their ranks, whatever a group's size.

    The rows are sorted in ranges over the cluster. A group's counts in each range tell which range holds a rank; inside a range
    running sums tell the row. Only rows that hold an asked rank are gathered.
    """
    ordered = histogram.orderBy(*keys, "latency").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))
    ordered = cut_lineage(ordered.select(F.struct(*keys).alias("group"), "part", F.col("latency").cast("double").alias("latency"), "n"))
    ahead = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ordered.groupBy("group", "part").agg(F.sum("n").alias("n"))
    ranges = ranges.select(
        "group", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy("group")).alias("all")
    )
    inside = Window.partitionBy("group", "part").orderBy("latency").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    met = placed.join(ranges, ["group", "part"]).withColumn("first", F.col("ahead") + F.col("before"))
    values = []
    for share in PERCENTILES:
        rank = (F.col("all") - 1) * share
        low, high = F.floor(rank), F.ceil(rank)

        def at(place):
            return F.max(F.when((F.col("first") <= place) & (place < F.col("first") + F.col("n")), F.col("latency")))

        part = F.max(rank - low)
        values.append(at(low) * (1 - part) + at(high) * part)
    found = met.groupBy("group").agg(F.array(*values).alias("p"))
    return found.select(*[F.col(f"group.{k}").alias(k) for k in keys], "p")
