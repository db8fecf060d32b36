"""Fusion of candidate lists, page cuts and the shape of a result row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.vectors import rounded
from glyphlake.operators.knn import SCORE_DECIMALS
from glyphlake.schema import PAGE_SIZE


def fuse(*candidates: DataFrame) -> DataFrame:
    """Sum the scores of candidate lists per (query, document); a list without it adds nothing."""
    parts = [c.select("query_id", "doc_id", "score") for c in candidates]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def rank_page(scored: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """The best ``size`` rows per query with their rank, ties broken on the document id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (
        scored.withColumn("score", rounded("score", SCORE_DECIMALS))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= size)
    )


def top_results(ranked: DataFrame, max_results: int = 10) -> DataFrame:
    return ranked.where(F.col("rank") <= max_results)


def page(ranked: DataFrame, index: int, size: int = PAGE_SIZE) -> DataFrame:
    """Rows of one display page, pages counted from 0."""
    return ranked.where(F.col("rank").between(index * size + 1, (index + 1) * size))


def total_hits(scored: DataFrame) -> DataFrame:
    """Matches per query, whatever page is shown later."""
    return scored.groupBy("query_id").agg(F.count("*").alias("total"))


def shown_name(icon_name: Column | str = "icon_name", doc_id: Column | str = "doc_id") -> Column:
    """The name of a hit; a missing or empty name falls back to the document id."""
    name = F.col(icon_name) if isinstance(icon_name, str) else icon_name
    ident = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.nullif(name, F.lit("")), ident.cast("string"))


def format_result(hits: DataFrame) -> DataFrame:
    """Name fallback and score default of a result row; other columns stay as they are."""
    return hits.withColumn("icon_name", shown_name()).withColumn("score", F.coalesce("score", F.lit(0.0)))
