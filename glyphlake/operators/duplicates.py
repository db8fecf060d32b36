"""Exact copies of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.joins import lookup_join
from glyphlake.session import cut_lineage


def copy_groups(df: DataFrame, field: str, id_col: str = "doc_id") -> DataFrame:
    """Distinct vectors: ``field, group_id`` (the smallest id) and ``copies``; absent ones are left out.

    Counts and minima are combined before the shuffle, so copies of one vector do not pile up.
    """
    return (
        df.where(F.size(field) > 0)
        .groupBy(field)
        .agg(F.min(id_col).alias("group_id"), F.count("*").alias("copies"))
    )


def exact_duplicates(df: DataFrame, field: str, id_col: str = "doc_id") -> DataFrame:
    """``group_id, copies, doc_id``: one row per member of every group of two or more.

    Members stay rows: a group may hold a large share of the table.
    """
    rows = df.where(F.size(field) > 0).select(
        F.col(id_col).alias("doc_id"), field, F.xxhash64(field).alias("__a"), F.xxhash64(F.lit(1), field).alias("__b")
    )
    # Digests are counted first; whole vectors are shuffled and compared only where a digest comes twice.
    twice = cut_lineage(rows.groupBy("__a", "__b").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("__a", "__b"))
    rows = cut_lineage(lookup_join(rows, twice, ["__a", "__b"], "left_semi", spread="doc_id").select("doc_id", field))
    groups = cut_lineage(copy_groups(rows, field, "doc_id").where(F.col("copies") > 1))
    return lookup_join(rows, groups, field, spread="doc_id").select("group_id", "copies", "doc_id")
