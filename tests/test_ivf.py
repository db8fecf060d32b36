"""The inverted file: what it finds, what it reads, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.operators.ivf import IvfIndex, ann_candidates, build_ivf
from glyphlake.operators.knn import knn, recall_at_k
from glyphlake.workloads import CHECKS, QUERIES

DIMS = 24


def clustered(n, clusters=60, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, DIMS))
    return (centers[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, DIMS))).astype(np.float32)


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, v.tolist(), "even" if i % 2 == 0 else "odd") for i, v in enumerate(clustered(20_000))]
    return spark.createDataFrame(rows, "doc_id long, vector array<float>, icon_type string").repartition(8).cache()


@pytest.fixture(scope="module")
def ivf(spark, index, tmp_path_factory):
    return build_ivf(index, "vector", str(tmp_path_factory.mktemp("ivf")))


@pytest.fixture(scope="module")
def queries(index):
    return index.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector").cache()


def test_every_vector_is_stored_in_the_cell_of_its_nearest_centroid(index, ivf):
    assert ivf.rows.count() == index.count() == ivf.sizes.sum()
    rows = ivf.rows.where("doc_id % 50 = 0").collect()
    unit = ivf.centroids / np.linalg.norm(ivf.centroids, axis=1, keepdims=True)
    for r in rows:
        scores = unit @ np.array(r.vector)
        assert scores[r.cell] >= scores.max() - 1e-6


def test_recall_and_what_is_read(index, ivf, queries):
    found = ann_candidates(ivf, queries, 10, 50)
    recall = recall_at_k(knn(index, queries, "vector", 10), found).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    one = queries.orderBy("query_id").limit(1)
    plan = ann_candidates(ivf, one, 10, 50)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "cell" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "icon_type" not in text.split("ReadSchema: ")[1].split("\n")[0]
    # Cells hold about 142 rows; 800 are looked at.
    cells = ivf.probes(np.array(one.first()["vector"])[None, :], 800, 1)[0]
    assert ivf.sizes[cells].sum() < 0.1 * ivf.sizes.sum()
    assert {r.cell for r in ivf.rows.join(plan, "doc_id").select("cell").distinct().collect()} <= set(cells.tolist())


def test_scores_are_exact_and_filters_hold(index, ivf, queries):
    few = queries.limit(5)
    hits = ann_candidates(ivf, few, 5, 50, where=F.col("icon_type") == "odd").collect()
    vectors = {r.doc_id: np.array(r.vector) for r in index.collect()}
    assert len(hits) == 25 and all(r.doc_id % 2 for r in hits)
    for r in hits:
        a, b = vectors[r.query_id], vectors[r.doc_id]
        assert r.score == pytest.approx((1 + a @ b / np.linalg.norm(a) / np.linalg.norm(b)) / 2, abs=1e-6)


def test_as_many_candidates_as_vectors_are_exact_in_blocks_too(index, ivf, queries):
    some = queries.limit(30)
    exact = {tuple(r) for r in knn(index, some, "vector", 5, 20_000).collect()}
    assert {tuple(r) for r in ann_candidates(ivf, some, 5, 20_000).collect()} == exact
    assert {tuple(r) for r in ann_candidates(ivf, some, 5, 20_000, max_queries=8).collect()} == exact


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0]), *[(i, [0.5, 0.5]) for i in range(10, 60)]]
    odd = spark.createDataFrame(rows, "doc_id long, vector array<float>")
    ivf = build_ivf(odd, "vector", f"{tmp_path}/odd")
    assert {r.doc_id for r in ivf.rows.collect()} == {1, 2, *range(10, 60)}
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [1.0, 0.0])], "query_id long, vector array<float>")
    found = {(r.query_id, r["rank"]): r.doc_id for r in ann_candidates(ivf, asked, 3).collect()}
    assert found == {(1, 1): 10, (1, 2): 11, (1, 3): 12, (4, 1): 1, (4, 2): 10, (4, 3): 11}


def test_an_empty_table_and_a_reopened_index(spark, index, ivf, queries, tmp_path):
    empty = build_ivf(index.limit(0), "vector", f"{tmp_path}/none")
    assert ann_candidates(empty, queries).count() == 0
    path = f"{tmp_path}/kept"
    build_ivf(index.where("doc_id < 500"), "vector", path, cells=4)
    again = IvfIndex(spark, path, "vector")
    assert len(again.sizes) == 4 and again.rows.count() == 500
    assert ann_candidates(again, queries.limit(0)).count() == 0


def test_exact_hits_beyond_the_probed_cells(index, ivf):
    """Means of the table lie far from all centroids, so their neighbours are spread over many cells."""
    means = [(i, [float(x) for x in index.where(f"doc_id % 5 = {i}").agg(*[F.avg(F.col("vector")[d]) for d in range(DIMS)]).first()]) for i in range(5)]
    asked = index.sparkSession.createDataFrame([*means, (5, [0.0] * DIMS)], "query_id long, vector array<double>")
    exact = {tuple(r) for r in knn(index, asked, "vector", 10).collect()}
    assert {tuple(r) for r in ann_candidates(ivf, asked, 10, 10).collect()} != exact
    assert {tuple(r) for r in ann_candidates(ivf, asked, 10, 10, exact=True).collect()} == exact
    assert {tuple(r) for r in ann_candidates(ivf, asked, 10, 10, max_queries=4, exact=True).collect()} == exact
    odd = F.col("icon_type") == "odd"
    assert {tuple(r) for r in ann_candidates(ivf, asked, 10, 10, where=odd, exact=True).collect()} == {tuple(r) for r in knn(index, asked, "vector", 10, where=odd).collect()}


def test_exact_search_leaves_out_cells_that_are_too_far(index, ivf, queries):
    matrix = np.array([r["vector"] for r in queries.limit(20).collect()], float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    cells = ivf.reaching(matrix, np.full(20, 0.999), [np.array([], int)] * 20)
    assert sum(len(c) for c in cells) < 20 * len(ivf.sizes)


def test_the_recall_query_tells_a_share_of_exact_hits(spark, sf):
    found = QUERIES["ann_recall"](spark, sf)
    assert found.columns == ["query_id", "recall"] and {r.recall for r in found.collect()} == {1.0}
    assert "embeddings" in CHECKS["ann_recall"] and "row_number" in CHECKS["ann_recall"]
