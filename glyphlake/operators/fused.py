"""Dense, sparse and visual search of a batch of requests in one scan of the index.

The requests are broadcast. A task reads its documents once: it keeps the best dense rows of every text request together with
their token scores, the best token matches, the match counts, and the best rows of every visual field that a request searches.
Few rows leave a task. One shuffle by request then ranks, fuses and pages all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions.vectors import rounded, score_of
from glyphlake.operators.joins import BROADCAST_ROWS
from glyphlake.operators.knn import (
    MAX_BROADCAST_CELLS, MAX_BROADCAST_QUERIES, SCORE_DECIMALS, _Field, _ids, _matrix, _QueryBlock,
)
from glyphlake.operators.sparse import SparseBlock

# Parts of a scan's rows; visual fields are counted on from the last.
DENSE, SPARSE, TOTAL, VISUAL = 0, 1, 2, 3


class FusedBlock:
    """The requests of a task."""

    def __init__(self, text: _QueryBlock, sparse: SparseBlock, visual: _QueryBlock | None, text_field: str, sparse_field: str, fields: list[str], k: int):
        self.text, self.sparse, self.visual, self.k = text, sparse, visual, k
        self.text_field, self.sparse_field, self.fields = text_field, sparse_field, fields
        place = {q: i for i, q in enumerate(sparse.query_id.tolist())}
        self.code = np.array([place.get(q, -1) for q in text.query_id.tolist()], dtype=np.int64)

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.sparse.begin()
        dense = {name: _Field(m, g, self.k) for name, (_, m, g) in self.text.parts.items()}
        seen = {name: _Field(m, None, self.k) for name, (_, m, _) in (self.visual.parts if self.visual else {}).items()}
        grouped = self.sparse.groups is not None or any(s.groups is not None for s in dense.values())
        for batch in batches:
            if not batch.num_rows:
                continue
            ident = _ids(batch.column("doc_id"))
            groups = batch.column("__group").to_numpy(zero_copy_only=False).astype(object) if grouped else None
            tiles = self.sparse.add(ident, batch.column(self.sparse_field), groups)
            for name, state in dense.items():
                rows = _rows_of(batch.column(name), self.text.dims)
                if len(rows):
                    code, at = self.code, self.text.parts[name][0]
                    state.add(
                        _matrix(batch.column(name).take(pa.array(rows))),
                        ident[rows],
                        None if groups is None else groups[rows],
                        lambda query, row: self.sparse.pair_scores(tiles, code[at[query]], rows[row]),
                    )
            for name, state in seen.items():
                rows = _rows_of(batch.column(name), self.visual.dims)
                if len(rows):
                    state.add(_matrix(batch.column(name).take(pa.array(rows))), ident[rows], None)
        kind = None
        for name, state in dense.items():
            if state.ident is not None and len(state.row):
                kind = pa.array(state.ident).type
                yield _told(self.text.query_id[self.text.parts[name][0][state.row]], DENSE, state.ident, state.score, state.extra)
        best, some = self.sparse.best, np.flatnonzero(self.sparse.matches)
        if best.ident is not None and len(best.row):
            kind = pa.array(best.ident).type
            yield _told(self.sparse.query_id[best.row], SPARSE, best.ident, best.score)
        if len(some):
            counts = self.sparse.matches[some].astype(np.float64)
            yield _told(self.sparse.query_id[some], TOTAL, pa.nulls(len(some), kind), counts)
        for name, state in seen.items():
            if state.ident is not None and len(state.row):
                at = self.visual.parts[name][0][state.row]
                times = np.array([self.visual.times[i].get(name, 0) for i in at.tolist()], np.float64)
                yield _told(self.visual.query_id[at], VISUAL + self.fields.index(name), state.ident, state.score, times)


def _rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """The rows whose vector has the length asked for."""
    return np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))


def _told(query_id, part: int, ident, score: np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(score)
    missing = pa.nulls(n, pa.float64()) if other is None else pa.array(other, pa.float64(), mask=np.isnan(other))
    columns = [pa.array(query_id), pa.array([part] * n, pa.int32()), ident if isinstance(ident, pa.Array) else pa.array(ident)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64()), missing], names=["query_id", "part", "doc_id", "score", "other"])


def _vectors(queries: DataFrame, bound: int, *more) -> pd.DataFrame | None:
    """The requests with a vector as a pandas frame, or None if they are beyond the bounds of a broadcast."""
    asked = queries.where(F.col("vector").isNotNull())
    head = asked.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *more).limit(bound + 1).toPandas()
    longest = head["vector"].map(len).max() if len(head) else 0
    return None if len(head) > bound or len(head) * longest > MAX_BROADCAST_CELLS else head


def fused_scan(
    index: DataFrame,
    queries: DataFrame,
    query_postings: DataFrame,
    text_field: str,
    sparse_field: str,
    k: int,
    size: int,
    group_col: str | None = None,
    visual: DataFrame | None = None,
    visual_fields: list[str] | None = None,
    max_queries: int = MAX_BROADCAST_QUERIES,
    max_query_rows: int = BROADCAST_ROWS,
) -> DataFrame | None:
    """``query_id, part, doc_id, score, other`` of all tasks, or None if the requests are too many for a broadcast.

    ``visual`` holds ``query_id, vector, fields``; a field named twice counts twice.
    """
    group = [F.col(group_col).alias("__group")] if group_col else []
    text = _vectors(queries, max_queries, *group)
    tokens = query_postings.select("query_id", "token", "weight", *group).limit(max_query_rows + 1).toPandas()
    pictures = None if visual is None else _vectors(visual, max_queries, F.col("fields").alias("__fields"))
    if text is None or (visual is not None and pictures is None) or len(tokens) > max_query_rows or tokens["query_id"].nunique() > max_queries:
        return None
    fields = list(visual_fields or []) if pictures is not None and len(pictures) else []
    seen = None
    if fields:
        seen = _QueryBlock(pictures, fields)
        usual = pictures[pictures["vector"].map(len) == seen.dims]
        seen.times = [pd.Series(list(names)).value_counts().to_dict() for names in usual["__fields"]]
    block = FusedBlock(_QueryBlock(text, [text_field]), SparseBlock(tokens, size), seen, text_field, sparse_field, fields, k)
    rows = index.select("doc_id", text_field, sparse_field, *fields, *group)
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("part", T.IntegerType()),
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("other", T.DoubleType()),
        ]
    )
    shared = index.sparkSession.sparkContext.broadcast(block)
    return rows.mapInArrow(lambda batches: shared.value.scan(batches), schema)


def fused_page(found: DataFrame, k: int, size: int) -> DataFrame:
    """``query_id, doc_id, score, rank, total`` from the rows of a scan: a single shuffle, by request.

    Dense hits have their own token score added, visual hits the sum over their fields; token matches that are no dense hit
    keep their score. The total counts all token matches, and the dense hits among which no token is shared.
    """
    inside = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "doc_id")
    limit = F.when(F.col("part") == SPARSE, size).otherwise(k)
    best = found.repartition("query_id").withColumn("__at", F.row_number().over(inside))
    best = best.where((F.col("part") == TOTAL) | (F.col("__at") <= limit))

    def of(part, value):
        return F.when(F.col("part") == part, value)

    fused = best.groupBy("query_id", "doc_id").agg(
        F.coalesce(
            F.max(of(DENSE, score_of("score") + F.coalesce("other", F.lit(0.0)))),
            F.max(of(SPARSE, F.col("score"))),
            F.sum(F.when(F.col("part") >= VISUAL, score_of("score") * F.col("other"))),
        ).alias("score"),
        F.coalesce(F.sum(of(TOTAL, F.col("score"))), F.lit(0.0)).alias("__matches"),
        F.coalesce(F.max(F.when((F.col("part") >= VISUAL) | ((F.col("part") == DENSE) & F.col("other").isNull()), 1)), F.lit(0)).alias("__more"),
    )
    everything = Window.partitionBy("query_id")
    total = F.sum(F.col("__matches") + F.col("__more")).over(everything).cast("bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("doc_id").isNull(), F.desc("score"), "doc_id")
    ranked = fused.withColumn("score", rounded("score", SCORE_DECIMALS)).withColumn("total", total).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("doc_id").isNotNull() & (F.col("rank") <= size)).select("query_id", "doc_id", "score", "rank", "total")
