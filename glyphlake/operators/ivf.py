"""Approximate cosine top-k with an inverted file: vectors stored by the cell of their nearest centroid.

``build_ivf`` fits centroids with Lloyd's rounds on Spark over a bounded sample, assigns every vector and writes the vectors
partitioned by cell, full cells in several files. ``ann_candidates`` ranks the cells of each query, reads only the partitions
that some query asks for, and inside a task multiplies the rows of a cell with the queries that ask for this cell alone. Cells
number about the square root of the vectors, so the work of a query grows with that root, not with the table. Each cell keeps
its radius, the largest angle between its centroid and one of its vectors: with ``exact`` a query goes on to every cell that the
radius lets hold a row as near as its last hit, which gives the hits of exact search.

Every vector of the usual length is stored; null vectors and odd lengths have no hits, as in exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions.vectors import score_of
from glyphlake.operators.knn import (
    MAX_BROADCAST_CELLS, MAX_BROADCAST_QUERIES, SCORE_DECIMALS, BestRows, _ids, _matrix, _unit, check_k,
)
from glyphlake.schema import KNN_K, NUM_CANDIDATES
from glyphlake.session import cut_lineage, work_folder

#: Bounds of the centroid table, in cells and in numbers: it is broadcast and read by the driver.
MAX_CELLS = 1 << 14
MAX_CENTROID_NUMBERS = 4_000_000
#: Rows of the fitting sample for each cell; the sample grows with the cells, thus with the root of the vectors.
SAMPLE_PER_CELL = 64
ROUNDS = 6
#: Parts that the sums of a round are added up in.
SUM_PARTS = 16
ROWS_PER_FILE = 1 << 17
#: Slack of a cell's bound, for the rounding of scores and of angles near zero.
BOUND_SLACK = 1e-7
#: A query looks into so many cells at least, and so many rows for every candidate asked for.
MIN_PROBES = 6
ROWS_PER_CANDIDATE = 16
SEED = 5


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid of each vector, in tiles of bounded size."""
    tile = max(1, MAX_CENTROID_NUMBERS // max(1, len(centroids)))
    parts = [np.argmax(vectors[i : i + tile] @ centroids.T, axis=1) for i in range(0, len(vectors), tile)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def fit_centroids(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of at most ``cells`` groups of the vectors ``(doc_id, vector)`` of one length.

    Each round, tasks add up the vectors of each cell and parts of the cells are added up on the cluster: the driver gets
    one row a cell. A cell that no vector of the sample is nearest to keeps its centroid.
    """
    context = vectors.sparkSession.sparkContext
    order = F.xxhash64(F.lit(SEED), "doc_id")
    first = vectors.orderBy(order, "doc_id").limit(cells).select("vector").toArrow()
    centroids = _matrix(first.column("vector")) if first.num_rows else np.zeros((0, 0))
    for _ in range(rounds if len(centroids) else 0):
        shared = context.broadcast(centroids)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shared.value.shape)
            seen = np.zeros(len(sums), bool)
            for batch in batches:
                rows = _matrix(batch.column(0))
                near = _nearest(rows, shared.value)
                np.add.at(sums, near, rows)
                seen[near] = True
            held = np.flatnonzero(seen)
            yield pa.record_batch({"part": held % SUM_PARTS, "cell": held, "total": pa.array(list(sums[held]), pa.list_(pa.float64()))})

        def united(table: pa.Table) -> pa.Table:
            cell, place = np.unique(table.column("cell").to_numpy(), return_inverse=True)
            rows = table.column("total").combine_chunks().flatten().to_numpy().reshape(len(place), -1)
            total = np.zeros((len(cell), rows.shape[1]))
            np.add.at(total, place, rows)
            return pa.table({"cell": cell, "total": pa.array(list(total), pa.list_(pa.float64()))})

        parts = vectors.select("vector").mapInArrow(add, "part bigint, cell bigint, total array<double>")
        sums = parts.groupBy("part").applyInArrow(united, "cell bigint, total array<double>").toArrow()
        centroids = centroids.copy()
        if sums.num_rows:
            total = np.array(sums.column("total").to_pylist())
            some = np.linalg.norm(total, axis=1) > 0
            centroids[sums.column("cell").to_numpy()[some]] = _unit(total[some])
    return centroids


def assigned(rows: DataFrame, field: str, centroids: np.ndarray) -> DataFrame:
    """``rows`` with the ``cell`` of each vector and its ``__angle`` to the centroid; angles that are no number count as the widest."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("struct<cell: int, angle: double>")
    def place(vectors: pa.Array) -> pa.Array:
        matrix = _matrix(vectors)
        near = _nearest(matrix, shared.value)
        cos = np.einsum("ij,ij->i", matrix, shared.value[near]) if len(near) else np.zeros(0)
        angle = np.nan_to_num(np.arccos(np.clip(cos, -1, 1)), nan=np.pi)
        return pa.StructArray.from_arrays([pa.array(near, pa.int32()), pa.array(angle, pa.float64())], names=["cell", "angle"])

    placed = rows.withColumn("__place", place.asNondeterministic()(field))
    return placed.select(*[F.col(c) for c in rows.columns], F.col("__place.cell").alias("cell"), F.col("__place.angle").alias("__angle"))


def build_ivf(index: DataFrame, field: str, path: str, cells: int | None = None) -> IvfIndex:
    """Write the inverted file of ``field`` below ``path``; all columns of ``index`` are kept.

    ``index`` needs ``doc_id`` and must not have a column ``cell``. The number of cells is the root of the number of vectors
    unless given. Identical vectors share a cell; however many rows a cell has, its files are written by several tasks.
    """
    spark = index.sparkSession
    lengths = index.where(F.size(field) > 0).groupBy(F.size(field).alias("dims")).count().collect()
    usual = min(lengths, key=lambda r: (-r["count"], r["dims"]), default=None)
    dims, number = (usual["dims"], usual["count"]) if usual else (0, 0)
    rows = index.where(F.size(field) == dims) if number else index.limit(0)
    bound = max(1, min(MAX_CELLS, MAX_CENTROID_NUMBERS // max(1, dims)))
    cells = max(1, min(cells or math.ceil(math.sqrt(number)), bound))
    share = SAMPLE_PER_CELL * cells / max(1, number)
    vectors = rows.select("doc_id", F.col(field).alias("vector"))
    if share < 1:
        vectors = vectors.where(F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    centroids = fit_centroids(cut_lineage(vectors), cells)
    staged = f"{work_folder(spark)}/assigned"
    assigned(rows, field, centroids).write.parquet(staged)
    placed = spark.read.parquet(staged)
    # One row a cell, at most MAX_CELLS.
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("__angle").alias("radius"))
    told = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    kept = told.join(counts, "cell", "left").select("cell", "centroid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius"))
    kept.write.mode("overwrite").parquet(f"{path}/cells")
    parts = counts.select(F.col("cell").alias("__cell"), F.ceil(F.col("n") / ROWS_PER_FILE).alias("__files"))
    spread = placed.join(F.broadcast(parts), F.col("cell") == F.col("__cell"))
    spread = spread.withColumn("__file", F.pmod(F.xxhash64("doc_id"), F.col("__files"))).repartition("cell", "__file")
    spread.drop("__cell", "__files", "__file", "__angle").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    return IvfIndex(spark, path, field)


class IvfIndex:
    """An inverted file read back: the centroids in memory, the vectors as a table whose files are listed once."""

    def __init__(self, spark: SparkSession, path: str, field: str):
        self.field = field
        told = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        self.centroids = np.array([r["centroid"] for r in told]) if told else np.zeros((0, 0))
        self.sizes = np.array([r["n"] for r in told], np.int64)
        self.radii = np.array([r["radius"] for r in told], np.float64)
        number = int(self.sizes.sum())
        self.rows = spark.read.parquet(f"{path}/rows") if number else None

    def probes(self, matrix: np.ndarray, least_rows: int, least_cells: int) -> list[np.ndarray]:
        """The cells each query looks into: the nearest ones, as many as hold ``least_rows`` and ``least_cells`` at least."""
        near = np.argsort(-(matrix @ self.centroids.T), axis=1, kind="stable")
        held = np.cumsum(self.sizes[near], axis=1)
        needed = np.maximum((held < least_rows).sum(axis=1) + 1, least_cells)
        return [cells[:n] for cells, n in zip(near, needed)]

    def reaching(self, matrix: np.ndarray, floor: np.ndarray, seen: list[np.ndarray]) -> list[np.ndarray]:
        """The cells not ``seen`` that can hold a row of a cosine of at least ``floor``, for each query."""
        angles = np.arccos(np.clip(matrix @ self.centroids.T, -1, 1))
        most = np.cos(np.maximum(0, angles - self.radii)) + BOUND_SLACK
        can = (most >= floor[:, None]) & (self.sizes > 0)
        for held, cells in zip(can, seen):
            held[cells] = False
        return [np.flatnonzero(held) for held in can]


class _Probes:
    """The query side of a task: unit vectors, and which queries ask for a cell."""

    def __init__(self, query_id: np.ndarray, matrix: np.ndarray, cells: list[np.ndarray]):
        self.query_id, self.matrix = query_id, matrix
        self.asking: dict[int, list[int]] = {}
        for i, asked in enumerate(cells):
            for cell in asked.tolist():
                self.asking.setdefault(cell, []).append(i)

    def scan(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        best = BestRows(len(self.query_id), k)
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            vectors, ident = _matrix(batch.column(1)), _ids(batch.column(0))
            found: tuple[list, list, list] = ([], [], [])
            for cell in np.unique(cells).tolist():
                at, asking = np.flatnonzero(cells == cell), np.array(self.asking[cell])
                scores = np.round(self.matrix[asking] @ vectors[at].T, SCORE_DECIMALS)
                floor = best.floor[asking]
                if scores.shape[1] > k:
                    floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
                hit_query, hit_row = np.nonzero(scores >= floor[:, None])
                for out, values in zip(found, (asking[hit_query], scores[hit_query, hit_row], ident[at[hit_row]])):
                    out.append(values)
            if found[0]:
                best.offer(*found)
        if best.ident is not None and len(best.row):
            columns = [pa.array(self.query_id[best.row]), pa.array(best.ident), pa.array(best.score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "doc_id", "cos"])


def ann_candidates(
    ivf: IvfIndex,
    queries: DataFrame,
    k: int = KNN_K,
    num_candidates: int = NUM_CANDIDATES,
    where: Column | None = None,
    least_cells: int = MIN_PROBES,
    max_queries: int = MAX_BROADCAST_QUERIES,
    exact: bool = False,
) -> DataFrame:
    """Approximate kNN, ``query_id, doc_id, score, rank``: exact cosine over the cells nearest to each query.

    With ``exact`` every query goes on to all cells that can still hold one of its k nearest, so the hits are those of ``knn``.
    More candidates make a query look into more cells; with as many as there are vectors the search is exact.
    ``recall_at_k`` against ``knn`` tells the quality. Queries come in blocks that fit a broadcast, one scan each.
    """
    check_k(k, num_candidates)
    spark = queries.sparkSession
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    dims = ivf.centroids.shape[1]
    asked = asked.where(F.size("vector") == dims)
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("doc_id", ivf.rows.schema["doc_id"].dataType if ivf.rows is not None else T.LongType()),
            T.StructField("cos", T.DoubleType()),
        ]
    )
    per_block = max(1, min(max_queries, MAX_BROADCAST_CELLS // max(1, dims)))
    head = asked.limit(per_block + 1).toArrow()
    if ivf.rows is None or head.num_rows == 0:
        found = spark.createDataFrame([], schema)
    elif head.num_rows <= per_block:
        found = _searched(ivf, head, k, num_candidates, where, least_cells, schema, exact)
    else:
        blocks = -(-asked.count() // max(1, per_block // 2))
        # Hashed blocks of about half the bound; each one's hits are written before the next is read.
        cut = cut_lineage(asked.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
        place = work_folder(spark)
        for block in range(blocks):
            part = cut.where(F.col("__block") == block).drop("__block").toArrow()
            if part.num_rows:
                hits = _searched(ivf, part, k, num_candidates, where, least_cells, schema, exact)
                _ranked(hits, k).write.parquet(f"{place}/block={block}")
        return spark.read.parquet(place).drop("block")
    return _ranked(found, k)


def _searched(ivf, head: pa.Table, k, num_candidates, where, least_cells, schema, exact) -> DataFrame:
    matrix = _matrix(head.column("vector"))
    query_id = _ids(head.column("query_id").combine_chunks())
    cells = ivf.probes(matrix, max(k, ROWS_PER_CANDIDATE * num_candidates), least_cells)
    found = _scanned(ivf, query_id, matrix, cells, k, where, schema)
    if not exact:
        return found
    best = cut_lineage(_best(found, k))
    # One row a query of the block: its last hit, if it has k.
    last = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("cos").alias("floor")).where(F.col("n") == k).toArrow()
    floors = dict(zip(_ids(last.column("query_id").combine_chunks()).tolist(), last.column("floor").to_pylist()))
    floor = np.array([floors.get(q, -np.inf) for q in query_id.tolist()])
    others = ivf.reaching(matrix, floor, cells)
    if not any(len(c) for c in others):
        return best.drop("rank")
    return best.drop("rank").unionByName(_scanned(ivf, query_id, matrix, others, k, where, schema))


def _scanned(ivf, query_id: np.ndarray, matrix: np.ndarray, cells: list[np.ndarray], k, where, schema) -> DataFrame:
    probes = _Probes(query_id, matrix, cells)
    shared = ivf.rows.sparkSession.sparkContext.broadcast(probes)
    # Named cells are a filter on the partition column: other cells' files are not read.
    near = ivf.rows.where(F.col("cell").isin(sorted(probes.asking)))
    near = near if where is None else near.where(where)
    return near.select("doc_id", ivf.field, "cell").mapInArrow(lambda batches: shared.value.scan(batches, k), schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return _best(found, k).select("query_id", "doc_id", score_of("cos").alias("score"), "rank")
