"""Similar pairs, sampled pairs and comparisons of named pairs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions.vectors import (
    array_equal, cosine, dims, head, l2_norm, max_abs_diff, mean_abs_diff,
)
from glyphlake.operators.duplicates import copy_groups
from glyphlake.operators.joins import lookup_join
from glyphlake.operators.knn import SCORE_DECIMALS, _ids, _matrix
from glyphlake.schema import SAMPLED_PAIRS, SIMILAR_SHOWN, SIMILAR_THRESHOLD
from glyphlake.session import cut_lineage

CHUNK_ROWS = 4096
CELLS_PER_TILE = 1_000_000
#: Bounds of the pivots, which are broadcast, and of the sample they are fitted to, which the driver reads.
MAX_PIVOTS = 1024
SAMPLE_ROWS = 16_384
SAMPLE_PER_PIVOT = 32
ROUNDS = 6
FEISTEL_ROUNDS = 4
# Above this distance a vector reaches most cells, and cells prune nothing.
USEFUL_DISTANCE = 0.5
SLACK = 1e-6
#: Numbers of a sketch; shorter vectors than twice that are met whole. Rows of a block of sketches, and what sketches may be off by.
SKETCH_DIMS = 64
SKETCH_CHUNK_ROWS = 16_384
SKETCH_SLACK = 1e-5


def _sample(vectors: DataFrame, field: str, n: int) -> np.ndarray:
    """Unit vectors of a bounded sample that ``n`` pivots are fitted to."""
    sample = vectors.orderBy(F.xxhash64("group_id")).limit(min(SAMPLE_ROWS, SAMPLE_PER_PIVOT * n)).select(field).toArrow()
    return _matrix(sample.column(field)) if sample.num_rows else np.zeros((0, 1))


def _pivots(rows: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors in the middle of groups of the sample; any pivots give exact results, good ones smaller cells."""
    pivots = rows[: min(n, len(rows))]
    for _ in range(ROUNDS if len(rows) else 0):
        near = np.argmax(rows @ pivots.T, axis=1)
        total = np.zeros_like(pivots)
        np.add.at(total, near, rows)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        pivots = np.where(length > 0, np.divide(total, length, out=np.zeros_like(total), where=length > 0), pivots)
    return pivots


def _basis(rows: np.ndarray) -> np.ndarray:
    """The ``SKETCH_DIMS`` main directions of the sample, orthonormal in columns; any such directions give exact results."""
    return np.linalg.eigh(rows.T @ rows)[1][:, -SKETCH_DIMS:]


def _sketches(unit: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Vectors along the basis, then the length of what is left: a product of two is never below the cosine of their vectors."""
    inside = unit @ basis
    return np.column_stack([inside, np.linalg.norm(unit - inside @ basis.T, axis=1)]).astype(np.float32)


def _cells(vectors: DataFrame, field: str, radius: float, pivots: np.ndarray, basis: np.ndarray | None = None) -> DataFrame:
    """Rows in the cell of their nearest pivot and in every lower cell within reach.

    The plane between two pivots parts their cells. A vector within ``radius`` of one in another cell is no further than
    that from the plane, so of two close vectors the one in the higher cell always visits the cell of the other. With ``basis``
    a row holds the sketch of its vector in place of the vector.
    """
    kept = [T.StructField(f.name, T.ArrayType(T.FloatType())) if basis is not None and f.name == field else f for f in vectors.schema.fields]
    schema = T.StructType([*kept, T.StructField("cell", T.LongType()), T.StructField("home", T.BooleanType())])
    names, shared = vectors.columns, vectors.sparkSession.sparkContext.broadcast((pivots, basis))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, basis = shared.value
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))
        tile = max(1, CELLS_PER_TILE // len(pivots))
        for whole in batches:
            for start in range(0, whole.num_rows, tile):
                batch = whole.slice(start, tile)
                unit = _matrix(batch.column(names.index(field)))
                near = unit @ pivots.T
                home = near.argmax(axis=1)
                reach = near.max(axis=1, keepdims=True) - near <= (radius + SLACK) * apart[home] + SLACK
                rows, cells = np.nonzero(reach & (np.arange(len(pivots)) <= home[:, None]))
                if basis is not None:
                    sketch = pa.array(list(_sketches(unit, basis)), pa.list_(pa.float32()))
                    batch = batch.set_column(names.index(field), field, sketch)
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cells.astype(np.int64)), pa.array(cells == home[rows])], names=[*names, "cell", "home"]
                )

    return vectors.mapInArrow(place, schema)


def similar_pairs(
    df: DataFrame,
    field: str,
    threshold: float = SIMILAR_THRESHOLD,
    id_col: str = "doc_id",
    chunk_rows: int = CHUNK_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """All pairs of distinct vectors with cosine above ``threshold``, exactly.

    ``doc_a, doc_b, copies_a, copies_b, similarity`` with the smallest id standing for all copies
    of a vector and ``doc_a < doc_b``; a vector with copies also has a row with itself. Copies are folded first, so a vector
    held by many documents costs one row. Vectors are then placed in the cells of ``pivots`` fitted vectors (about the
    root of their number); a vector also visits the cells that its neighbourhood reaches into. Each cell is cut into blocks of
    at most ``chunk_rows`` rows, and a block hands out nothing but its matches.
    """
    groups = cut_lineage(copy_groups(df, field, id_col))
    found = _match_cells(_placed(groups, field, threshold, pivots), field, threshold, chunk_rows)
    # Copies are similar as well: a row that pairs their vector with itself.
    own = _copies(groups, field, threshold).select(
        F.col("group_id").alias("doc_a"), F.col("group_id").alias("doc_b"), F.col("copies").alias("copies_a"),
        F.col("copies").alias("copies_b"), "similarity",
    )
    return found.unionByName(own)


def _placed(groups: DataFrame, field: str, threshold: float, pivots: int | None) -> DataFrame:
    """Distinct vectors in the cells they take part in."""
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    if threshold >= 0 and radius < USEFUL_DISTANCE and pivots != 0:
        number = min(MAX_PIVOTS, pivots or max(1, math.ceil(math.sqrt(groups.count()))))
        sample = _sample(groups, field, number)
        fitted = _pivots(sample, number)
        if len(fitted) and fitted.shape[1] >= 2 * SKETCH_DIMS:
            near = _with_neighbours(_cells(groups.select("group_id", field), field, radius, fitted, _basis(sample)), field, threshold)
            return cut_lineage(groups.join(near, "group_id").select(*groups.columns, "cell", "home"))
        if len(fitted):
            return _cells(groups, field, radius, fitted)
    return groups.withColumn("cell", F.lit(0).cast("bigint")).withColumn("home", F.lit(True))


def _with_neighbours(sketched: DataFrame, field: str, threshold: float) -> DataFrame:
    """``group_id, cell, home`` of the rows with another in their cell that their sketches let be above the threshold.

    Sketches are a sixth of a vector of 384 numbers: the others never meet whole.
    """
    ids = sketched.schema["group_id"].dataType
    schema = T.StructType([T.StructField("group_id", ids), T.StructField("cell", T.LongType()), T.StructField("home", T.BooleanType())])

    def numbers(table: pa.Table) -> np.ndarray:
        return table.column(field).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def block(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        hit, met = np.zeros(ours.num_rows, bool), np.zeros(theirs.num_rows, bool)
        if ours.num_rows and theirs.num_rows:
            v, w = numbers(ours), numbers(theirs)
            place = np.unique(np.concatenate([_ids(ours.column("group_id")), _ids(theirs.column("group_id"))]), return_inverse=True)[1]
            a, b = place[: len(v)], place[len(v) :]
            step = max(1, CELLS_PER_TILE // len(w))
            for start in range(0, len(v), step):
                near = (v[start : start + step] @ w.T > threshold - SKETCH_SLACK) & (a[start : start + step, None] != b[None, :])
                hit[start : start + step] = near.any(axis=1)
                met |= near.any(axis=0)
        mine, other = ours.filter(pa.array(hit)), theirs.filter(pa.array(met))
        home = pa.concat_arrays([pa.array([True] * mine.num_rows, pa.bool_()), pa.array(other.column("home").to_pylist(), pa.bool_())])
        both = [pa.chunked_array([*mine.column(c).chunks, *other.column(c).chunks], mine.column(c).type) for c in ("group_id", "cell")]
        return pa.table({"group_id": both[0], "cell": both[1], "home": home})

    found = _dealt(sketched, SKETCH_CHUNK_ROWS, ["group_id", field]).applyInArrow(block, schema)
    return cut_lineage(found.distinct())


def _dealt(placed: DataFrame, chunk_rows: int, columns: list[str]):
    """The rows at home in a cell and all of its rows, cogrouped in blocks of at most about ``chunk_rows`` of each."""
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count_if("home") / chunk_rows).cast("int").alias("home_chunks"),
        F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"),
    )
    rows = lookup_join(placed, cut_lineage(sizes.where("home_chunks > 0")), "cell", spread="group_id")
    part = F.xxhash64("group_id")
    left = rows.where("home").select(
        "cell", F.pmod(part, "home_chunks").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1).cast("array<bigint>")).alias("j"),
        *columns,
    )
    # Aliased anew, for both sides of the cogroup come from the same rows.
    right = rows.select(
        F.col("cell").alias("cell"),
        F.explode(F.sequence(F.lit(0), F.col("home_chunks") - 1).cast("array<bigint>")).alias("i"),
        F.pmod(part, "chunks").alias("j"),
        *[F.col(c).alias(c) for c in (*columns, "home")],
    )
    keys = ["cell", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


class _Block:
    """Two chunks of one cell and the pairs between them above the threshold."""

    def __init__(self, ours: pa.Table, theirs: pa.Table, field: str, threshold: float):
        self.threshold = threshold
        self.v, self.w = _matrix(ours.column(field)), _matrix(theirs.column(field))
        self.a, self.b = _ids(ours.column("group_id")), _ids(theirs.column("group_id"))
        self.ca, self.cb = ours.column("copies").to_numpy(), theirs.column("copies").to_numpy()
        place = np.unique(np.concatenate([self.a, self.b]), return_inverse=True)[1]
        self.ra, self.rb = place[: len(self.a)], place[len(self.a) :]
        self.at_home = theirs.column("home").to_numpy()

    def tiles(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, similarities, mask of matches) over a few of our rows at a time."""
        step = max(1, CELLS_PER_TILE // len(self.w))
        for start in range(0, len(self.v), step):
            cos = np.round(self.v[start : start + step] @ self.w.T, SCORE_DECIMALS)
            # Two rows at home meet twice, once from either side: the ordered meeting counts.
            ordered = ~self.at_home[None, :] | (self.ra[start : start + step, None] < self.rb[None, :])
            yield start, cos, (cos > self.threshold) & ordered

    def pairs(self, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        """doc_a, doc_b, copies_a, copies_b with the smaller id first."""
        swap = self.ra[i] > self.rb[j]
        a, b, ca, cb = self.a[i], self.b[j], self.ca[i], self.cb[j]
        return [np.where(swap, b, a), np.where(swap, a, b), np.where(swap, cb, ca), np.where(swap, ca, cb)]

    def all_pairs(self) -> list[np.ndarray]:
        found = []
        for start, cos, match in self.tiles():
            i, j = np.nonzero(match)
            found.append([*self.pairs(i + start, j), cos[i, j]])
        return [np.concatenate(column) for column in zip(*found, strict=True)]

    def summary(self, top: int) -> tuple[int, list[np.ndarray]]:
        """Number of document pairs and the ``top`` most similar pairs of vectors."""
        count, kept = 0, None
        for start, cos, match in self.tiles():
            count += int(self.ca[start : start + len(cos)] @ match @ self.cb)
            level = cos[match]
            if len(level) > top:
                match &= cos >= np.partition(level, len(level) - top)[len(level) - top]
            i, j = np.nonzero(match)
            part = [*self.pairs(i + start, j), cos[i, j]]
            kept = part if kept is None else [np.concatenate(c) for c in zip(kept, part, strict=True)]
            order = np.lexsort((kept[1], kept[0], -kept[4]))[:top]
            kept = [c[order] for c in kept]
        return count, kept


def _match_cells(
    placed: DataFrame, field: str, threshold: float, chunk_rows: int, top: int | None = None
) -> DataFrame:
    """All pairs, or with ``top`` only the best pairs of each block and a row without ids that
    holds the number of its document pairs in ``copies_a``."""
    id_type = placed.schema["group_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_a", id_type),
            T.StructField("doc_b", id_type),
            T.StructField("copies_a", T.LongType()),
            T.StructField("copies_b", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    names = schema.fieldNames()

    def block(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        ids = ours.column("group_id").type
        types = [ids, ids, pa.int64(), pa.int64(), pa.float64()]
        columns, count = [[] for _ in types], 0
        if ours.num_rows and theirs.num_rows:
            both = _Block(ours, theirs, field, threshold)
            if top is None:
                columns = both.all_pairs()
            else:
                count, columns = both.summary(top)
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        if count:
            extra = [None, None, count, None, None]
            arrays = [pa.concat_arrays([x, pa.array([e], t)]) for x, e, t in zip(arrays, extra, types, strict=True)]
        return pa.table(dict(zip(names, arrays, strict=True)))

    return _dealt(placed, chunk_rows, ["group_id", "copies", field]).applyInArrow(block, schema)


def similar_pairs_summary(
    groups: DataFrame, field: str, threshold: float, top: int, chunk_rows: int = CHUNK_ROWS, pivots: int | None = None
) -> DataFrame:
    """The pairs among ``groups``, a result of ``copy_groups``, without listing them: per block its best ``top`` and, in rows
    without ids, the number of document pairs as ``copies_a``. Written once, for it is small and read twice."""
    return cut_lineage(_match_cells(_placed(groups, field, threshold, pivots), field, threshold, chunk_rows, top))


def _copies(groups: DataFrame, field: str, threshold: float) -> DataFrame:
    """Vectors held by several documents; they are similar to themselves if 1 passes the threshold."""
    self_similarity = F.when(l2_norm(field) == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return groups.where(F.col("copies") > 1).select("group_id", "copies", self_similarity.alias("similarity")).where(
        F.col("similarity") > threshold
    )


def similar_pair_counts(
    df: DataFrame, field: str, threshold: float = SIMILAR_THRESHOLD, id_col: str = "doc_id", **options: int
) -> DataFrame:
    """One row ``pairs``: document pairs above the threshold, copies counted without listing them."""
    return group_pair_counts(cut_lineage(copy_groups(df, field, id_col)), field, threshold, **options)


def group_pair_counts(groups: DataFrame, field: str, threshold: float = SIMILAR_THRESHOLD, **options: int) -> DataFrame:
    """The same from a written result of ``copy_groups``."""
    counted = similar_pairs_summary(groups, field, threshold, 1, **options)
    across = counted.where(F.col("doc_a").isNull()).select(F.col("copies_a").alias("n"))
    within = _copies(groups, field, threshold).select((F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint").alias("n"))
    return across.unionByName(within).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


def top_similar_pairs(
    df: DataFrame,
    field: str,
    threshold: float = SIMILAR_THRESHOLD,
    n: int = SIMILAR_SHOWN,
    id_col: str = "doc_id",
    **options: int,
) -> DataFrame:
    """The ``n`` most similar document pairs, ``doc_a, doc_b, similarity``, ties on the ids.

    Among pairs of one similarity only the n + 1 smallest ids of a vector's copies can be shown,
    so no group of copies is ever listed whole.
    """
    order = [F.desc("similarity"), "doc_a", "doc_b"]
    groups = cut_lineage(copy_groups(df, field, id_col))
    best = similar_pairs_summary(groups, field, threshold, n, **options)
    across = best.where(F.col("doc_a").isNotNull()).orderBy(*order).limit(n)
    within = _copies(groups, field, threshold).orderBy(F.desc("similarity"), "group_id").limit(n)
    chosen = cut_lineage(
        across.select("doc_a", "doc_b", "similarity").unionByName(
            within.select(F.col("group_id").alias("doc_a"), F.col("group_id").alias("doc_b"), "similarity")
        )
    )
    # At most 3n representatives: their vectors find their copies, of which n + 1 each are kept.
    named = chosen.select(F.explode(F.array("doc_a", "doc_b")).alias("group_id")).distinct()
    rows = df.select(F.col(id_col).alias("doc_id"), field).where(F.col(field).isNotNull())
    vectors = rows.withColumnRenamed("doc_id", "group_id").join(F.broadcast(named), "group_id")
    smallest = Window.partitionBy("group_id").orderBy("doc_id")
    members = (
        rows.join(F.broadcast(cut_lineage(vectors)), field)
        .select("group_id", "doc_id")
        .withColumn("__r", F.row_number().over(smallest))
        .where(F.col("__r") <= n + 1)
        .drop("__r")
    )
    a = members.select(F.col("group_id").alias("doc_a"), F.col("doc_id").alias("x"))
    b = members.select(F.col("group_id").alias("doc_b"), F.col("doc_id").alias("y"))
    return (
        chosen.join(a, "doc_a")
        .join(b, "doc_b")
        .where((F.col("doc_a") != F.col("doc_b")) | (F.col("x") < F.col("y")))
        .select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "similarity")
        .orderBy(*order)
        .limit(n)
    )


def pair_places(number: int, documents: int, seed: str) -> tuple[int, int]:
    """The places ``a < b`` of sampled pair ``number`` among ``documents``; different numbers give different pairs.

    A keyed Feistel network permutes the numbers of all N(N-1)/2 pairs: it permutes a power of four that is less than four times
    as large, and is walked on until the result is the number of a pair.
    """
    total = documents * (documents - 1) // 2
    half = max(1, -(-total.bit_length() // 2))
    mask = (1 << half) - 1
    low, high = number & mask, number >> half
    while True:
        for turn in range(FEISTEL_ROUNDS):
            mixed = int(hashlib.md5(f"{seed}|{turn}|{low}".encode()).hexdigest()[:15], 16) & mask
            low, high = high ^ mixed, low
        pair = high << half | low
        if pair < total:
            b = (1 + math.isqrt(1 + 8 * pair)) // 2
            return pair - b * (b - 1) // 2, b


def sample_pairs(ids: DataFrame, n: int = SAMPLED_PAIRS, seed: str = "0", id_col: str = "doc_id") -> DataFrame:
    """``min(n, N(N-1)/2)`` distinct pairs of different documents, each pair as likely as any other: ``doc_a, doc_b``.

    Documents are numbered in the order of their ids, by the range of the sorted table they fall into and their place
    there; the sampled pairs are numbers below N(N-1)/2 under a keyed permutation. Only ids are sorted, and only the rows of
    the sampled places leave the ranges.
    """
    ordered = ids.select(F.col(id_col).alias("doc_id")).orderBy("doc_id").withColumn("__at", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)
    # One row a range: as many as the sort has tasks.
    parts = sorted((r["part"], r["n"]) for r in ordered.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in parts)])
    documents, ranges = int(starts[-1]), np.array([p for p, _ in parts], np.int64)
    wanted = min(n, documents * (documents - 1) // 2)

    @F.arrow_udf("array<bigint>")
    def named(numbers: pa.Array) -> pa.Array:
        places = np.array([pair_places(p, documents, seed) for p in numbers.to_pylist()], np.int64).reshape(-1, 2)
        part = np.searchsorted(starts, places, side="right") - 1
        return pa.array(list((ranges[part] << 33) + places - starts[part]), pa.list_(pa.int64()))

    slots = ids.sparkSession.range(wanted).select(named("id").alias("at"))
    slots = cut_lineage(slots.select(F.col("at")[0].alias("at_a"), F.col("at")[1].alias("at_b")))
    met = slots
    for side in ("a", "b"):
        asked = met.select(F.col(f"at_{side}").alias("__at")).distinct()
        held = lookup_join(ordered, asked, "__at", "left_semi").select(F.col("__at").alias(f"at_{side}"), F.col("doc_id").alias(f"doc_{side}"))
        met = met.join(held, f"at_{side}")
    return met.select("doc_a", "doc_b")


def similarity_distribution(
    df: DataFrame, field: str, n: int = SAMPLED_PAIRS, seed: str = "0", id_col: str = "doc_id"
) -> DataFrame:
    """Minimum, maximum, mean, median, p95 and p99 of the cosine over sampled pairs."""
    vectors = df.where(F.size(field) > 0)
    pairs = sample_pairs(vectors, n, seed, id_col)
    compared = compare_pairs(vectors, pairs, field, id_col)
    p = F.percentile("similarity", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return compared.agg(
        F.count("*").alias("sampled"),
        F.min("similarity").alias("min_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.avg("similarity").alias("mean_similarity"),
        p[0].alias("median_similarity"),
        p[1].alias("p95_similarity"),
        p[2].alias("p99_similarity"),
    )


def compare_pairs(index: DataFrame, pairs: DataFrame, field: str, id_col: str = "doc_id") -> DataFrame:
    """Cosine, equality and differences of the named pairs; a pair missing a vector gives no row.

    A document of very many pairs is met by salted joins where the vectors are too many to broadcast.
    """
    named = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias(id_col)).distinct()
    # Read once for either side of the pairs.
    rows = cut_lineage(lookup_join(index.select(id_col, field).where(F.col(field).isNotNull()), named, id_col, "left_semi"))
    left = rows.select(F.col(id_col).alias("doc_a"), F.col(field).alias("__a"))
    right = rows.select(F.col(id_col).alias("doc_b"), F.col(field).alias("__b"))
    half = lookup_join(pairs.select("doc_a", "doc_b"), left, "doc_a", spread="doc_b")
    both = lookup_join(half, right, "doc_b", spread="doc_a")
    return both.select(
        "doc_a",
        "doc_b",
        F.round(cosine("__a", "__b"), SCORE_DECIMALS).alias("similarity"),
        array_equal("__a", "__b").alias("identical"),
        max_abs_diff("__a", "__b").alias("max_abs_diff"),
        mean_abs_diff("__a", "__b").alias("mean_abs_diff"),
    )


def lookup_specific(index: DataFrame, ids: DataFrame, field: str, id_col: str = "doc_id") -> DataFrame:
    """Per asked id: found, no_vector or missing, with dimension, first values and length."""
    rows = lookup_join(index.select(id_col, field), ids.select(id_col).distinct(), id_col)
    found = rows.select(id_col, F.lit(True).alias("__found"), field)
    state = (
        F.when(F.col("__found").isNull(), F.lit("missing"))
        .when(F.col(field).isNull(), F.lit("no_vector"))
        .otherwise(F.lit("found"))
    )
    return ids.select(id_col).join(found, id_col, "left").select(
        id_col,
        state.alias("state"),
        dims(field).alias("dims"),
        head(field).alias("first_values"),
        l2_norm(field).alias("norm"),
    )
