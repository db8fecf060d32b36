"""Requests: batches of items to index and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.schema import ICON_TYPES, REQUEST_TYPES

ITEMS_SCHEMA = "items array<struct<iconName: string, description: string>>"
NAMES_SCHEMA = "iconNames array<string>"


def read_items(requests: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """Text batches: ``icon_name, description, pos`` per item; a request without items is rejected
    as one row with an ``error``."""
    parsed = requests.select(*(keep or []), F.from_json(json_col, ITEMS_SCHEMA)["items"].alias("items"))
    return _exploded(parsed, "items", keep or []).select(
        *(keep or []), "pos", F.col("item.iconName").alias("icon_name"), F.col("item.description").alias("description"), "error"
    )


def read_icon_names(requests: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """Image and SVG batches: ``icon_name, pos`` per name, rejected like text batches."""
    parsed = requests.select(*(keep or []), F.from_json(json_col, NAMES_SCHEMA)["iconNames"].alias("items"))
    return _exploded(parsed, "iconNames", keep or []).select(*(keep or []), "pos", F.col("item").alias("icon_name"), "error")


def _exploded(parsed: DataFrame, name: str, keep: list[str]) -> DataFrame:
    empty = F.coalesce(F.size("items"), F.lit(0)) == 0
    return parsed.select(
        *keep,
        F.when(empty, F.lit(f"Missing or empty '{name}' array")).alias("error"),
        F.posexplode_outer("items").alias("pos", "item"),
    )


def read_request_file(spark: SparkSession, path: str) -> DataFrame:
    """One text batch per JSON file; a file without items raises ``ValueError``."""
    items = read_items(spark.read.text(path, wholetext=True), "value")
    if not items.where(F.col("error").isNotNull()).isEmpty():
        raise ValueError("Missing or empty 'items' array")
    return items.drop("error")


def validate_requests(queries: DataFrame) -> DataFrame:
    """Adds ``reason`` (null when the request is good) and ``valid``."""
    blank_svg = (F.col("type") == "svg") & (F.trim(F.col("query")) == "")
    known = F.coalesce(F.col("type").isin(REQUEST_TYPES), F.lit(False))
    reason = (
        F.when(~known, F.lit("unknown type"))
        .when(F.col("query").isNull(), F.lit("missing query"))
        .when(F.col("icon_type").isNotNull() & ~F.col("icon_type").isin(ICON_TYPES), F.lit("unknown icon_type"))
        .when(blank_svg, F.lit("SVG content cannot be empty"))
    )
    return queries.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
