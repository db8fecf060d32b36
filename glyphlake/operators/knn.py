"""Exact cosine top-k for a table of queries against an index of any size.

Each task multiplies its Arrow batches with the query matrix and keeps only the best k rows per
query and field, so no candidate pair leaves the task; one ranked window merges the survivors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions.vectors import score_of
from glyphlake.operators.joins import lookup_join
from glyphlake.schema import KNN_K, NUM_CANDIDATES

MAX_BROADCAST_QUERIES = 8192
MAX_BROADCAST_CELLS = 8_000_000
INDEX_CHUNK_ROWS = 65_536
CELLS_PER_TILE = 4_000_000
# Scores are compared after rounding, so ranks do not depend on the order of summation.
SCORE_DECIMALS = 9


def check_k(k: int, num_candidates: int) -> None:
    if not 1 <= k <= num_candidates:
        raise ValueError("need 1 <= k <= num_candidates")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column without nulls as unit vectors; a zero vector stays zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of one field differ in length, see quality.check_dims")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(values.reshape(len(column), -1))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _keep_best(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int, *more: np.ndarray):
    """The k best entries per query row, score descending and id ascending; ``more`` goes along."""
    order = np.lexsort((ident, -score, row))
    row, score, ident, *more = (values[order] for values in (row, score, ident, *more))
    first = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1] if len(row) else np.array([], int)
    lengths = np.diff(np.r_[first, len(row)])
    rank = np.arange(len(row)) - np.repeat(first, lengths)
    keep = rank < k
    return row[keep], score[keep], ident[keep], *(values[keep] for values in more)


class BestRows:
    """Running best k rows per query over all batches of a task."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.floor = np.full(queries, -np.inf)
        self.row = np.array([], dtype=np.int64)
        self.score = np.array([], dtype=np.float64)
        self.ident: np.ndarray | None = None
        self.extra: np.ndarray | None = None

    def cut(self, scores: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a (query, row) block of scores that can still be among the best."""
        floor = self.floor[start : start + len(scores)]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        return np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))

    def offer(
        self, rows: list[np.ndarray], scores: list[np.ndarray], idents: list[np.ndarray], extras: list[np.ndarray] | None = None
    ) -> None:
        """Take in entries; ``extras``, where given, holds a number that is kept with each."""
        old = [] if self.ident is None else [self.ident]
        carried = [] if extras is None else [np.concatenate([*([] if self.extra is None else [self.extra]), *extras])]
        self.row, self.score, self.ident, *kept = _keep_best(
            np.concatenate([self.row, *rows]),
            np.concatenate([self.score, *scores]),
            np.concatenate([*old, *idents]),
            self.k,
            *carried,
        )
        self.extra = kept[0] if kept else None
        count = np.bincount(self.row, minlength=self.queries)
        full = np.flatnonzero(count >= self.k)
        self.floor[full] = self.score[np.cumsum(count)[full] - 1]


class _Field(BestRows):
    """The best rows of one vector field."""

    def __init__(self, queries: np.ndarray, groups: np.ndarray | None, k: int):
        super().__init__(len(queries), k)
        self.matrix, self.groups = queries, groups

    def add(self, vectors: np.ndarray, ident: np.ndarray, groups: np.ndarray | None, extra=None) -> None:
        """Meet a batch of vectors; ``extra(rows of queries, rows of vectors)`` gives a number for each kept pair."""
        tile = max(1, CELLS_PER_TILE // max(1, len(vectors)))
        rows, scores, idents, extras = [], [], [], []
        for start in range(0, self.queries, tile):
            part = np.round(self.matrix[start : start + tile] @ vectors.T, SCORE_DECIMALS)
            if self.groups is not None:
                part = np.where(same_group(self.groups[start : start + tile], groups), part, -np.inf)
            hit_row, hit_col = self.cut(part, start)
            rows.append(hit_row + start)
            scores.append(part[hit_row, hit_col])
            idents.append(ident[hit_col])
            if extra is not None:
                extras.append(extra(hit_row + start, hit_col))
        self.offer(rows, scores, idents, None if extra is None else extras)


def same_group(wanted: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """(query, row) mask of rows a query may see; a query without a group sees all."""
    # Compared as numbers: a cell of the mask costs an integer comparison, whatever the groups are.
    codes = pd.factorize(np.concatenate([wanted, groups]))[0]
    asked, held = codes[: len(wanted)], codes[len(wanted) :]
    return (asked < 0)[:, None] | (asked[:, None] == held[None, :])


def _ids(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


class _QueryBlock:
    """The query side of a task: per field the unit matrix and where its rows come from."""

    def __init__(self, frame: pd.DataFrame, fields: list[str]):
        # Vectors meet only others of their length: that of most queries. Odd ones, on either side, have no hits.
        lengths = frame["vector"].map(lambda v: 0 if v is None else len(v))
        self.dims = int(lengths[lengths > 0].mode().min()) if (lengths > 0).any() else 0
        frame = frame[(lengths == self.dims) & (lengths > 0)].reset_index(drop=True)
        self.query_id = frame["query_id"].to_numpy()
        matrix = _unit(np.array(frame["vector"].tolist(), dtype=np.float64).reshape(len(frame), self.dims))
        groups = frame["__group"].to_numpy(dtype=object) if "__group" in frame else None
        wanted = frame["__fields"].tolist() if "__fields" in frame else None
        self.parts = {}
        for name in fields:
            at = np.arange(len(frame))
            if wanted is not None:
                at = np.array([i for i, names in enumerate(wanted) if name in names], dtype=int)
            if len(at):
                self.parts[name] = (at, matrix[at], None if groups is None else groups[at])

    def scan(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        best = {name: _Field(m, g, k) for name, (_, m, g) in self.parts.items()}
        for batch in batches:
            table = pa.table(batch) if isinstance(batch, pa.RecordBatch) else batch
            for name, state in best.items():
                part = table.filter(pa.compute.equal(pa.compute.list_value_length(table.column(name)), self.dims))
                if part.num_rows == 0:
                    continue
                groups = None
                if state.groups is not None:
                    groups = part.column("__group").to_numpy(zero_copy_only=False).astype(object)
                state.add(_matrix(part.column(name)), _ids(part.column("doc_id")), groups)
        for name, state in best.items():
            if state.ident is None or not len(state.row):
                continue
            at = self.parts[name][0][state.row]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.query_id[at]),
                    pa.array([name] * len(at), pa.string()),
                    pa.array(state.ident),
                    pa.array(state.score, pa.float64()),
                ],
                names=["query_id", "field", "doc_id", "cos"],
            )


def field_top_k(
    index: DataFrame,
    queries: DataFrame,
    fields: list[str],
    k: int = KNN_K,
    query_fields: str | None = None,
    group_col: str | None = None,
    max_queries: int = MAX_BROADCAST_QUERIES,
    index_chunk_rows: int = INDEX_CHUNK_ROWS,
) -> DataFrame:
    """Top k per (query, field): ``query_id, field, doc_id, cos, rank``.

    ``index`` needs ``doc_id`` and ``fields``; ``queries`` needs ``query_id, vector``.
    ``query_fields`` names an array column that limits the fields of a query, ``group_col`` a
    column of both sides that must be equal before k is taken (null in a query: no limit).
    """
    q_cols = [F.col("query_id"), F.col("vector").cast("array<double>").alias("vector")]
    i_cols = [F.col("doc_id"), *[F.col(f) for f in fields]]
    if query_fields:
        q_cols.append(F.col(query_fields).alias("__fields"))
    if group_col:
        q_cols.append(F.col(group_col).alias("__group"))
        i_cols.append(F.col(group_col).alias("__group"))
    asked = queries.where(F.col("vector").isNotNull()).select(*q_cols)
    rows = index.select(*i_cols).where(" OR ".join(f"`{f}` IS NOT NULL" for f in fields))
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("field", T.StringType()),
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("cos", T.DoubleType()),
        ]
    )
    head = asked.limit(max_queries + 1).toPandas()
    size = len(head) * (len(head["vector"].iloc[0]) if len(head) else 0)
    if len(head) == 0:
        found = index.sparkSession.createDataFrame([], schema)
    elif len(head) <= max_queries and size <= MAX_BROADCAST_CELLS:
        block = index.sparkSession.sparkContext.broadcast(_QueryBlock(head, fields))
        found = rows.mapInArrow(lambda batches: block.value.scan(batches, k), schema)
    else:
        found = _blocked(rows, asked, fields, k, schema, max_queries, index_chunk_rows)
    order = Window.partitionBy("query_id", "field").orderBy(F.desc("cos"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocked(rows, asked, fields, k, schema, max_queries, index_chunk_rows) -> DataFrame:
    """Too many queries to broadcast: bounded (index chunk, query chunk) blocks on the cluster."""
    per_block = max(1, max_queries // 2)
    q_chunks = -(-asked.count() // per_block)
    i_chunks = max(1, -(-rows.count() // index_chunk_rows))
    left = rows.withColumn("__i", F.pmod(F.xxhash64("doc_id"), F.lit(i_chunks))).withColumn(
        "__q", F.explode(F.sequence(F.lit(0), F.lit(q_chunks - 1)))
    )
    right = asked.withColumn("__q", F.pmod(F.xxhash64("query_id"), F.lit(q_chunks)).cast("int")).withColumn(
        "__i", F.explode(F.sequence(F.lit(0), F.lit(i_chunks - 1)).cast("array<bigint>"))
    )

    def block(index_part: pa.Table, query_part: pa.Table) -> pa.Table:
        found = []
        if index_part.num_rows and query_part.num_rows:
            found = list(_QueryBlock(query_part.to_pandas(), fields).scan(iter([index_part]), k))
        if found:
            return pa.Table.from_batches(found)
        types = {"query_id": query_part, "doc_id": index_part}
        return pa.table(
            {
                "query_id": pa.array([], types["query_id"].schema.field("query_id").type),
                "field": pa.array([], pa.string()),
                "doc_id": pa.array([], types["doc_id"].schema.field("doc_id").type),
                "cos": pa.array([], pa.float64()),
            }
        )

    return left.groupBy("__i", "__q").cogroup(right.groupBy("__i", "__q")).applyInArrow(block, schema)


def knn(
    index: DataFrame,
    queries: DataFrame,
    field: str,
    k: int = KNN_K,
    num_candidates: int = NUM_CANDIDATES,
    where: Column | None = None,
    group_col: str | None = None,
    **limits: int,
) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the k nearest documents on one field.

    The search is exact, so ``num_candidates`` is only checked. ``where`` and ``group_col`` are
    applied before k is taken; a plain ``where`` reaches the parquet scan.
    """
    check_k(k, num_candidates)
    source = index if where is None else index.where(where)
    found = field_top_k(source, queries, [field], k, group_col=group_col, **limits)
    return found.select("query_id", "doc_id", score_of("cos").alias("score"), "rank")


def knn_filtered(index: DataFrame, queries: DataFrame, field: str, icon_type: str | None, **options) -> DataFrame:
    """kNN among documents of one type only; no type means no filter."""
    where = None if icon_type is None else F.col("icon_type") == icon_type
    return knn(index, queries, field, where=where, **options)


def knn_multi_field(
    index: DataFrame,
    queries: DataFrame,
    fields: list[str],
    k: int = KNN_K,
    query_fields: str | None = None,
    **limits: int,
) -> DataFrame:
    """One k per (query, field) in a single scan, fused by summing: ``query_id, doc_id, score``.

    With ``query_fields`` every query searches its own list; a field named twice counts twice.
    """
    found = field_top_k(index, queries, list(dict.fromkeys(fields)), k, query_fields, **limits)
    weight = F.lit(1)
    if query_fields:
        asked = queries.select("query_id", F.explode(query_fields).alias("field"))
        times = asked.groupBy("query_id", "field").agg(F.count("*").alias("times"))
        found = found.join(times, ["query_id", "field"])
        weight = F.col("times")
    else:
        weight = sum((F.when(F.col("field") == f, F.lit(1)).otherwise(F.lit(0)) for f in fields), F.lit(0))
    return found.groupBy("query_id", "doc_id").agg(F.sum(score_of("cos") * weight).alias("score"))


def search_by_example(index: DataFrame, examples: DataFrame, field: str, k: int = KNN_K, **options) -> DataFrame:
    """kNN with the vectors of the documents named in ``examples(doc_id)`` as queries."""
    asked = lookup_join(index.select("doc_id", F.col(field).alias("vector")), examples.select("doc_id").distinct(), "doc_id")
    return knn(index, asked.withColumnRenamed("doc_id", "query_id"), field, k, **options)


def recall_at_k(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    seen = approximate.select("query_id", "doc_id", F.lit(1).alias("seen"))
    return (
        exact.join(seen, ["query_id", "doc_id"], "left")
        .groupBy("query_id")
        .agg((F.count("seen") / F.count("*")).alias("recall"))
    )
