"""Partial-document merges. Parquet has no MERGE, so every merge yields the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.session import cut_lineage

# Fixed value: how many of a document's texts are shown with it.
SHOWN_TEXTS = 3


def given(name: str, kind: T.DataType) -> Column:
    """The value of a field if it was given: an empty vector or map counts as not given."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(name) > 0, F.col(name))
    return F.col(name)


def latest_fields(
    updates: DataFrame, order_by: str | list[str], id_col: str | list[str] = "doc_id"
) -> DataFrame:
    """One row per document: for each field the value given last in ``order_by``."""
    keys = [order_by] if isinstance(order_by, str) else order_by
    ids = [id_col] if isinstance(id_col, str) else id_col
    order = F.struct(*keys)
    fields = [f for f in updates.schema.fields if f.name not in (*ids, *keys)]
    if not fields:
        return updates.select(*ids).distinct()
    return updates.groupBy(*ids).agg(
        *[
            F.max_by(given(f.name, f.dataType), F.when(given(f.name, f.dataType).isNotNull(), order)).alias(f.name)
            for f in fields
        ]
    )


def upsert(
    index: DataFrame,
    updates: DataFrame,
    order_by: str | list[str] | None = None,
    id_col: str | list[str] = "doc_id",
) -> DataFrame:
    """Fields given overwrite, fields absent keep, new ids insert.

    ``updates`` holds one row per document, or several with ``order_by`` telling which is last.
    Columns of either side are kept.
    """
    ids = [id_col] if isinstance(id_col, str) else id_col
    changes = updates if order_by is None else latest_fields(updates, order_by, ids)
    old_names = [c for c in index.columns if c not in ids]
    new_fields = {f.name: f.dataType for f in changes.schema.fields if f.name not in ids}
    old = index.select(*ids, *[F.col(c).alias(f"old_{c}") for c in old_names])
    new = changes.select(*ids, *[given(c, kind).alias(f"new_{c}") for c, kind in new_fields.items()])
    merged = []
    for name in [*old_names, *[c for c in new_fields if c not in old_names]]:
        sides = [F.col(f"new_{name}")] if name in new_fields else []
        sides += [F.col(f"old_{name}")] if name in old_names else []
        merged.append(F.coalesce(*sides).alias(name))
    return old.join(new, ids, "full_outer").select(*ids, *merged)


def append_positions(
    existing_counts: DataFrame,
    updates: DataFrame,
    order_by: str | list[str],
    id_col: str = "doc_id",
    pieces: int | None = None,
) -> DataFrame:
    """Updates with ``pos``, the place of each in its document's growing list (0-based).

    Numbering is done in two steps so that a document holding much of the batch is not one task:
    the batch is cut into ranges of arrival order, rows are numbered inside (document, range),
    and the counts of the earlier ranges and of the existing list are added. ``pieces`` is the
    number of ranges, by default one per shuffle partition.
    """
    if pieces is None:
        pieces = int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [order_by] if isinstance(order_by, str) else order_by
    # The cut points come from sampling, so the cut rows are written before they are read twice.
    cut = cut_lineage(
        updates.repartitionByRange(pieces, *keys).withColumn("__range", F.spark_partition_id())
    )
    inside = Window.partitionBy(id_col, "__range").orderBy(*keys)
    before = Window.partitionBy(id_col).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        cut.groupBy(id_col, "__range")
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    # Old counts meet the few counts of ranges, not the rows: a hot document is split by its ranges.
    start = existing_counts.select(id_col, F.col("n").alias("__old"))
    counts = counts.join(start, id_col, "left").withColumn("__before", F.col("__before") + F.coalesce("__old", F.lit(0)))
    return (
        cut.withColumn("__at", F.row_number().over(inside) - 1)
        .join(counts.drop("__old"), [id_col, "__range"])
        .withColumn("pos", F.col("__before") + F.col("__at"))
        .drop("__range", "__at", "__before")
    )


def split_descriptions(index: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """An index with lists of descriptions as documents without them and a table ``id, pos, description``."""
    texts = index.select(id_col, F.posexplode("descriptions").alias("pos", "description"))
    return index.drop("descriptions"), texts.withColumn("pos", F.col("pos").cast("bigint"))


def upsert_descriptions(
    documents: DataFrame,
    texts: DataFrame,
    updates: DataFrame,
    order_by: str | list[str],
    id_col: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Merge rows ``doc_id, description, <fields>``; returns the new documents and the new texts.

    Texts are a table of their own, ``doc_id, pos, description``: one row a text, new ones after the
    old in arrival order, duplicates kept. A document stays one row with the last value given of
    every other field, however many texts it has.
    """
    keys = [order_by] if isinstance(order_by, str) else order_by
    counts = texts.groupBy(id_col).agg((F.max("pos") + 1).alias("n"))
    # The text itself is the last sort key, which fixes the order of equal arrival keys.
    placed = append_positions(counts, updates.select(id_col, *keys, "description"), [*keys, "description"], id_col)
    grown = texts.unionByName(placed.select(id_col, "pos", "description"))
    return upsert(documents, latest_fields(updates.drop("description"), keys, id_col), id_col=id_col), grown


def with_descriptions(documents: DataFrame, texts: DataFrame, shown: int = SHOWN_TEXTS, id_col: str = "doc_id") -> DataFrame:
    """Documents with their first ``shown`` texts and the number of all."""
    first = F.collect_list(F.when(F.col("pos") < shown, F.struct("pos", "description")))
    counts = texts.groupBy(id_col).agg(
        F.count("*").alias("n_descriptions"), F.transform(F.array_sort(first), lambda t: t["description"]).alias("descriptions")
    )
    empty = F.array().cast("array<string>")
    return documents.join(counts, id_col, "left").withColumns(
        {"n_descriptions": F.coalesce("n_descriptions", F.lit(0)), "descriptions": F.coalesce("descriptions", empty)}
    )
