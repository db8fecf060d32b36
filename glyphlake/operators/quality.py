"""Checks of schema, coverage and dimensions, and the combined vector diagnosis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions.vectors import present
from glyphlake.operators.duplicates import copy_groups
from glyphlake.operators.pairs import group_pair_counts, similarity_distribution
from glyphlake.schema import SAMPLED_PAIRS, SIMILAR_THRESHOLD, SPARSE_FIELD
from glyphlake.session import cut_lineage


def validate_schema(
    df: DataFrame,
    expected: dict[str, T.DataType],
    expected_dims: dict[str, int] | None = None,
    searchable: set[str] | None = None,
    sparse_field: str = SPARSE_FIELD,
) -> DataFrame:
    """``field, check, status, details`` rows; statuses are PASS, FAIL and WARN.

    Types come from the schema, vector lengths from one aggregate over the data. ``searchable``
    lists the vector fields used for search, others get a warning.
    """
    wanted_dims = expected_dims or {}
    have = {f.name: f.dataType for f in df.schema.fields}
    measured = [name for name in wanted_dims if isinstance(have.get(name), T.ArrayType)]
    sizes = df.agg(
        F.count("*").alias("n"),
        *[F.min(F.size(name)).alias(f"min_{i}") for i, name in enumerate(measured)],
        *[F.max(F.size(name)).alias(f"max_{i}") for i, name in enumerate(measured)],
    ).first()
    report = []
    for name, kind in expected.items():
        if name not in have:
            report.append((name, "exists", "FAIL", "Field not found"))
            continue
        same = have[name] == kind
        text = f"Type: {kind.simpleString()}" if same else (
            f"Expected {kind.simpleString()}, got {have[name].simpleString()}"
        )
        report.append((name, "type", "PASS" if same else "FAIL", text))
        if name in measured:
            at = measured.index(name)
            low, high, dims = sizes[f"min_{at}"], sizes[f"max_{at}"], wanted_dims[name]
            fits = low is None or (low == dims and high == dims)
            found = f"{dims} dimensions" if fits else f"Expected {dims} dimensions, got {low} to {high}"
            report.append((name, "dimensions", "PASS" if fits else "FAIL", found))
            if searchable is not None and name not in searchable:
                report.append((name, "searchable", "WARN", "Field is not searched"))
    if sparse_field not in have:
        report.append((sparse_field, "sparse", "WARN", "Sparse field not found"))
    elif not isinstance(have[sparse_field], T.MapType):
        report.append((sparse_field, "sparse", "WARN", f"Expected a map, got {have[sparse_field].simpleString()}"))
    else:
        report.append((sparse_field, "sparse", "PASS", "Sparse field found"))
    return df.sparkSession.createDataFrame(report, "field string, check string, status string, details string")


def coverage(df: DataFrame, fields: list[str], by: str = "release_tag") -> DataFrame:
    """Documents per release and how many of them hold each embedding."""
    return df.groupBy(by).agg(
        F.count("*").alias("docs"),
        *[F.count_if(present(name)).alias(f"with_{name}") for name in fields],
    )


def check_dims(df: DataFrame, expected: dict[str, int], id_col: str = "doc_id") -> DataFrame:
    """``doc_id, field, dims, expected`` of every vector with another length than declared."""
    found = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.size(name).alias("dims"), F.lit(dims).alias("expected"))
            for name, dims in expected.items()
            if name in df.columns
        ]
    )
    return (
        df.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("v"))
        .select("doc_id", "v.*")
        .where(F.col("dims").isNotNull() & (F.col("dims") != F.col("expected")))
    )


def diagnose(
    df: DataFrame,
    field: str,
    threshold: float = SIMILAR_THRESHOLD,
    sampled: int = SAMPLED_PAIRS,
    id_col: str = "doc_id",
) -> DataFrame:
    """``metric, value`` rows: documents, copies, similar pairs and the similarity distribution."""
    vectors = df.select(F.col(id_col).alias("doc_id"), field)
    docs = vectors.agg(
        F.count("*").cast("double").alias("documents"), F.count(field).cast("double").alias("with_vector")
    )
    # Vectors are grouped once, for copies and similar pairs.
    groups = cut_lineage(copy_groups(vectors, field))
    copies = groups.where(F.col("copies") > 1).agg(
        F.count("*").cast("double").alias("duplicate_groups"),
        F.coalesce(F.sum("copies"), F.lit(0)).cast("double").alias("duplicated_documents"),
    )
    pairs = group_pair_counts(groups, field, threshold).select(F.col("pairs").cast("double").alias("similar_pairs"))
    spread = similarity_distribution(vectors, field, sampled)
    parts = []
    for part in (docs, copies, pairs, spread):
        columns = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in part.columns]
        parts.append(part.select(F.explode(F.array(*columns)).alias("m")).select("m.metric", "m.value"))
    return reduce(DataFrame.unionByName, parts)
