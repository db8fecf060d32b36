"""Reconciling files with the name map, and choosing what still has to be indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.text import doc_id
from glyphlake.functions.vectors import present
from glyphlake.operators.joins import lookup_join
from glyphlake.schema import VISUAL_FIELDS

ICON_FIELDS = [name for name in VISUAL_FIELDS if name.startswith("icon_")]
TOKEN_FIELDS = [name for name in VISUAL_FIELDS if name.startswith("token_")]

# Which release tags count and how their numbers are read.
MAJOR_TAG = "v%.0.0"
TAG_NUMBERS = r"^v(\d+)\.(\d+)\.(\d+)"


def reverse_map(name_map: DataFrame) -> DataFrame:
    """``filename, icon_name``; of several aliases of a file the last in map order wins."""
    return name_map.groupBy("filename").agg(F.max_by("icon_name", "ord").alias("icon_name"))


def match_files(files: DataFrame, reversed_map: DataFrame, spread: str = "path") -> DataFrame:
    """Files whose stem is a mapped file name, with the icon name."""
    return lookup_join(files, reversed_map.select("filename", "icon_name"), "filename", spread=spread)


def unmatched_files(files: DataFrame, reversed_map: DataFrame, spread: str = "path") -> DataFrame:
    return lookup_join(files, reversed_map.select("filename"), "filename", "left_anti", spread=spread)


def missing_files(name_map: DataFrame, files: DataFrame) -> DataFrame:
    """Map entries, every alias of them, for which no file exists."""
    return lookup_join(name_map, files.select("filename").distinct(), "filename", "left_anti")


def limit_after_match(matched: DataFrame, n: int | None, order_by: str = "path") -> DataFrame:
    """The first ``n`` matched files in path order; none or a value below 1 keeps all."""
    return matched if n is None or n <= 0 else matched.orderBy(order_by).limit(n)


def incomplete_icons(matched: DataFrame, index: DataFrame, release_tag: str, skip_tokens: bool = False) -> DataFrame:
    """Matched icons whose document is missing, lacks a required vector or has another release."""
    required = ICON_FIELDS + ([] if skip_tokens else TOKEN_FIELDS)
    complete = F.col("release_tag") == release_tag
    for name in required:
        complete = complete & F.col(name).isNotNull()
    wanted = matched.select("icon_name").distinct().withColumn("doc_id", doc_id("icon_name", F.lit(release_tag)))
    # Vectors are only tested for presence, so the complete side shrinks to ids before the join.
    done = index.where(complete).select("doc_id")
    return wanted.join(done, "doc_id", "left_anti")


def check_complete(matched: DataFrame, index: DataFrame, release_tag: str, skip_tokens: bool = False) -> bool:
    return incomplete_icons(matched, index, release_tag, skip_tokens).isEmpty()


def tag_version(tag: Column | str) -> Column:
    """Numbers of a release tag for sorting; an unreadable tag sorts as zeros."""
    text = F.col(tag) if isinstance(tag, str) else tag
    return F.struct(
        *[
            F.coalesce(F.regexp_extract(text, TAG_NUMBERS, i).try_cast("bigint"), F.lit(0).cast("bigint")).alias(part)
            for i, part in ((1, "major"), (2, "minor"), (3, "patch"))
        ]
    )


def latest_release(tags: DataFrame, tag_col: str = "tag") -> DataFrame:
    """One row with the highest major release tag, null when there is none."""
    trimmed = F.trim(F.col(tag_col))
    rank = F.struct(tag_version(trimmed).alias("version"), trimmed.alias("tag"))
    return (
        tags.where(trimmed.like(MAJOR_TAG)).agg(F.max_by(trimmed, rank).alias("latest_release"))
    )


def to_process(
    matched: DataFrame, index: DataFrame, release_tag: str, bookmark: str | None, skip_tokens: bool = False,
    force: bool = False,
) -> DataFrame:
    """Matched files that need work: all on force, else those with no complete document.

    A bookmark other than ``release_tag`` means a new release, so everything is processed.
    """
    if force or bookmark != release_tag:
        return matched
    todo = incomplete_icons(matched, index, release_tag, skip_tokens).select("icon_name")
    return matched.join(todo, "icon_name", "left_semi")


def embedding_presence(index: DataFrame, fields: list[str]) -> DataFrame:
    """Per document: has_<field> flags and vector lengths."""
    columns = []
    for name in fields:
        columns.append(F.coalesce(present(name), F.lit(False)).alias(f"has_{name}"))
        columns.append(F.when(F.col(name).isNotNull(), F.size(name)).alias(f"dims_{name}"))
    return index.select("doc_id", *columns)
