"""Approximate nearest neighbours: robust-pruned directed graphs, one a shard, searched by beams.

Equal vectors are one node with its smallest ids. Nodes are dealt to shards by a hash; shards grow with the root of the
table up to ``MOST``, so that a search of a larger table follows longer paths in fewer graphs. Every shard builds its graph in a
task of its own: greedy searches from the node nearest to the mean propose neighbours, and a proposal stays only if no kept
neighbour is nearer to it by the factor ``ALPHA``, which keeps diverse edges. Graphs are written once. Queries are a table too:
each meets every shard of its dimension in tasks of one shard and about ``SLICE`` queries, which hold the graph and read the
queries batch by batch; nothing of either reaches the driver. A task hands out its best hits, one window merges them. Every
vector is indexed; distances are exact, in double precision, only the choice of candidates is approximate.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components take no part, nor do rows
without an id; vectors meet only others of their dimension; repeated rows count once; ties go to the smaller id; fewer
candidates than asked for give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import stored

LEAST = 4096  # vectors of a shard
GROWTH = 32  # times the root of the vectors
MOST = 65536
NUMBERS = 1 << 22  # components of a shard
DEGREE = 24
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
EXPANDED = 4  # nodes of a beam followed at once
BATCH = 256  # searches in step
SLICE = 1 << 15  # queries of a search task
SEED = 7

INDEX = "shard int, dims int, vectors binary, edges binary, entry int, ids array<array<bigint>>"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def beam_search(data: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and squared distances of the ``beam`` nearest nodes met by every query, nearest first.

    Unused places hold -1 at an infinite distance; ``edges`` uses -1 likewise.
    """
    n, count = len(data), len(queries)
    rows = np.arange(count)[:, None]
    seen = np.zeros((count, n + 1), bool)
    seen[:, [entry, n]] = True
    nodes = np.full((count, beam), -1)
    far = np.full((count, beam), np.inf)
    done = np.ones((count, beam), bool)
    nodes[:, 0], far[:, 0], done[:, 0] = entry, distances(queries, data[entry]), False
    while not done.all():
        # The nearest nodes not followed yet; a place beyond them points at -1.
        open_far = np.where(done, np.inf, far)
        pick = np.argsort(open_far, axis=1)[:, :EXPANDED]
        good = np.isfinite(open_far[rows, pick])
        done[rows, pick] = True
        near = np.where(good[:, :, None], edges[nodes[rows, pick]], -1).reshape(count, -1)
        near = np.where(near < 0, n, near)
        near = np.where(seen[rows, near], n, near)
        # The same node can come from several of the followed ones.
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[rows, near] = True
        fresh = near < n
        d = np.full(near.shape, np.inf)
        which, _ = np.nonzero(fresh)
        d[fresh] = distances(queries[which], data[near[fresh]])
        nodes = np.concatenate([nodes, np.where(fresh, near, -1)], axis=1)
        far = np.concatenate([far, d], axis=1)
        done = np.concatenate([done, ~fresh], axis=1)
        best = np.argsort(far, axis=1, kind="stable")[:, :beam]
        nodes, far, done = nodes[rows, best], far[rows, best], done[rows, best]
    return nodes, far


def pruned(data: np.ndarray, points: np.ndarray, nodes: np.ndarray, alpha: float) -> np.ndarray:
    """Up to ``DEGREE`` diverse neighbours of every point out of its candidates (-1: none)."""
    rows = np.arange(len(points))
    nodes = np.sort(np.where(nodes == points[:, None], -1, nodes), axis=1)
    nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
    far = np.where(nodes >= 0, distances(data[points][:, None], data[nodes]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    nodes, far = nodes[rows[:, None], order], far[rows[:, None], order]
    around = data[nodes]
    squares = np.einsum("...i,...i->...", around, around)
    kept = np.full((len(points), DEGREE), -1)
    left = far.copy()
    for k in range(DEGREE):
        pick = np.argmin(left, axis=1)
        alive = np.isfinite(left[rows, pick])
        if not alive.any():
            break
        chosen = nodes[rows, pick]
        kept[alive, k] = chosen[alive]
        dots = (around @ around[rows, pick][:, :, None])[:, :, 0]
        between = squares + squares[rows, pick][:, None] - 2 * dots
        left[alive[:, None] & (alpha * alpha * between <= far)] = np.inf
        left[rows, pick] = np.inf
    return kept


def build(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Edges ``(n, DEGREE)`` of the graph over distinct vectors, and the node where searches start."""
    n = len(data)
    entry = int(np.argmin(distances(data, data.mean(axis=0))))
    if n <= DEGREE + 1:
        every = np.tile(np.arange(n), (n, 1))
        edges = np.full((n, DEGREE), -1)
        edges[:, : n - 1] = every[~np.eye(n, dtype=bool)].reshape(n, n - 1)
        return edges, entry
    rng = np.random.default_rng(SEED)
    edges = (np.arange(n)[:, None] + rng.integers(1, n, (n, DEGREE))) % n
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            points = order[at : at + BATCH]
            met, _ = beam_search(data, edges, entry, data[points], BUILD_BEAM)
            edges[points] = pruned(data, points, np.concatenate([met, edges[points]], axis=1), alpha)
            _add_backward(data, edges, points, alpha)
    return edges, entry


def _add_backward(data: np.ndarray, edges: np.ndarray, points: np.ndarray, alpha: float) -> None:
    """Edges back to ``points`` from their new neighbours, which are pruned where they have too many."""
    target, source = edges[points].reshape(-1), np.repeat(points, DEGREE)
    new = (target >= 0) & (edges[target] != source[:, None]).all(axis=1)
    if not new.any():
        return
    target, source = target[new], source[new]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    places, first, count = np.unique(target, return_index=True, return_counts=True)
    most = int(count.max())
    incoming = np.full((len(places), most), -1)
    row = np.repeat(np.arange(len(places)), count)
    incoming[row, np.arange(len(target)) - np.repeat(first, count)] = source
    for at in range(0, len(places), BATCH):
        part = places[at : at + BATCH]
        edges[part] = pruned(data, part, np.concatenate([edges[part], incoming[at : at + BATCH]], axis=1), alpha)


def _graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row of the shard that is all of a task's input."""
    rows = list(batches)
    if not sum(b.num_rows for b in rows):
        return
    table = pa.Table.from_batches(rows).sort_by([("first", "ascending")])
    dims = table.column("dims")[0].as_py()
    data = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims)
    edges, entry = build(data)
    yield pa.record_batch(
        {
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
            "dims": pa.array([dims], pa.int32()),
            "vectors": pa.array([data.tobytes()]),
            "edges": pa.array([edges.astype(np.int32).tobytes()]),
            "entry": pa.array([entry], pa.int32()),
            "ids": pa.ListArray.from_arrays([0, len(table)], table.column("ids").combine_chunks()),
        }
    )


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, vector, dims)`` of the rows that take part, in double precision."""
    values = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), values.alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(F.coalesce(sound, F.lit(False))).withColumn("dims", F.size("vector"))


def build_index(df: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row a shard: vectors, graph and ids; answers searches for up to ``k`` neighbours."""
    rows = stored(usable(df, vec_id, vector).distinct())
    # Of equal vectors only the k + 1 smallest ids can be among k hits; counted before rows are shuffled.
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = stored(
        rows.withColumn("rank", rank)
        .where(F.col("rank") <= k + 1)
        .groupBy("vector", "dims")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("first", F.col("ids")[0])
    )
    counts = {r["dims"]: shards_of(r["count"], r["dims"]) for r in nodes.groupBy("dims").count().collect()}
    before = dict(zip(counts, accumulate(counts.values(), initial=0)))
    number = _by_dims(before) + F.pmod(F.xxhash64("vector"), _by_dims(counts)).cast("int")
    dealt = nodes.withColumn("shard", number).repartitionById(max(1, sum(counts.values())), F.col("shard"))
    return stored(dealt.mapInArrow(_graph, INDEX))


def shards_of(count: int, dims: int) -> int:
    """How many shards ``count`` vectors make."""
    most = max(64, min(MOST, NUMBERS // dims))
    return ceil(count / min(most, max(LEAST, GROWTH * isqrt(count))))


def _by_dims(values: dict[int, int]) -> Column:
    """The value of a row's dimension, null if there is none."""
    pairs = [F.array(*map(F.lit, part)).cast("array<int>") for part in (values.keys(), values.values())]
    return F.element_at(F.map_from_arrays(*pairs), F.col("dims"))


def _hits(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Best hits in one shard: its row comes first, then the queries."""
    shard = None
    for batch in batches:
        if shard is None and batch.num_rows:
            shard = batch.slice(0, 1).to_pylist()[0]
            batch = batch.slice(1)
            data = np.frombuffer(shard["vectors"]).reshape(-1, shard["dims"])
            edges = np.frombuffer(shard["edges"], np.int32).reshape(-1, DEGREE).astype(np.int64)
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            queries = part.column("vector").flatten().to_numpy().reshape(-1, shard["dims"])
            nodes, far = beam_search(data, edges, shard["entry"], queries, max(SEARCH_BEAM, k + 1))
            out: list[tuple[int, int, float]] = []
            for query, met, d in zip(part.column("query_id").to_pylist(), nodes[:, : 2 * k + 1].tolist(), np.sqrt(far[:, : 2 * k + 1]).tolist()):
                found = [(x, i) for node, x in zip(met, d) if node >= 0 for i in shard["ids"][node] if i != query]
                out += [(query, i, x) for x, i in sorted(found)[:k]]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.record_batch(
                {"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())}
            )


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for every usable row of ``queries``, its own id left out."""
    asked = stored(usable(queries, vec_id, vector).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "query_id"))
    shards = index.groupBy("dims").agg(F.min("shard").alias("low"), F.max("shard").alias("high")).collect()
    low, high = ({r["dims"]: r[side] for r in shards} for side in ("low", "high"))
    slices = max(1, ceil(asked.count() / SLICE))
    # A task is one shard and one slice of the queries; its first row is the shard's.
    graphs = index.withColumn("task", F.explode(F.sequence(F.col("shard") * slices, F.col("shard") * slices + (slices - 1))))
    met = asked.withColumn("shard", F.explode(F.sequence(_by_dims(low), _by_dims(high))))
    met = met.withColumn("task", F.col("shard") * slices + F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")).drop("dims", "shard")
    tasks = slices * (1 + max(high.values(), default=0))
    rows = graphs.unionByName(met, allowMissingColumns=True).repartitionById(tasks, F.col("task"))
    rows = rows.sortWithinPartitions(F.col("query_id").asc_nulls_first())
    hits = rows.mapInArrow(lambda batches: _hits(batches, k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
