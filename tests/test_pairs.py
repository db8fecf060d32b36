import numpy as np
import pytest
from conftest import vectors
from pyspark.sql import functions as F

from glyphlake.operators.duplicates import copy_groups, exact_duplicates
from glyphlake.operators.knn import _unit
from glyphlake.operators.pairs import (
    SKETCH_SLACK, _basis, _placed, _sketches, compare_pairs, lookup_specific, pair_places, sample_pairs, similar_pair_counts, similar_pairs, similarity_distribution,
    top_similar_pairs,
)
from glyphlake.session import cut_lineage


def rows(n=90, dims=6):
    """A third copies of one vector, a cloud of near copies, a scaled copy, a zero and a null."""
    base = vectors(n, dims, 11)
    noise = vectors(n, dims, 12) * 0.02
    out = []
    for i in range(n):
        v = base[0] if i % 3 == 0 else base[1] + noise[i] if i % 3 == 1 else base[i]
        out.append((f"d{i:03d}", [float(x) for x in v]))
    out += [("scaled", [float(x) * 2 for x in base[0]]), ("zero", [0.0] * dims), ("none", None)]
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "doc_id string, v array<float>").repartition(4).cache()


def cos(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(a @ b / norm), 9) if norm else 0.0


def brute(threshold):
    data = [(i, tuple(v)) for i, v in rows() if v is not None]
    return {(a, b): s for n, (a, x) in enumerate(data) for b, y in data[n + 1 :] for s in [cos(x, y)] if s > threshold}


def sorted_pairs(pairs):
    return {tuple(sorted(p)): s for p, s in pairs.items()}


@pytest.mark.parametrize("threshold", [0.99, 0.95, 0.3])
@pytest.mark.parametrize("options", [{}, {"pivots": 0, "chunk_rows": 5}, {"pivots": 7, "chunk_rows": 4}, {"pivots": 60}])
def test_pairs_of_distinct_vectors(df, threshold, options):
    first = {}
    for ident, v in rows():
        if v is not None:
            first.setdefault(tuple(v), []).append(ident)
    heads = {min(ids): len(ids) for ids in first.values()}
    expected = {p: s for p, s in sorted_pairs(brute(threshold)).items() if p[0] in heads and p[1] in heads}
    expected |= {(i, i): 1.0 for i, n in heads.items() if n > 1}
    found = similar_pairs(df, "v", threshold, **options).collect()
    assert len(found) == len(expected)
    for r in found:
        assert expected[r.doc_a, r.doc_b] == pytest.approx(r.similarity, abs=2e-9)
        assert (r.copies_a, r.copies_b) == (heads[r.doc_a], heads[r.doc_b])


@pytest.mark.parametrize("threshold", [0.99, -0.5])
def test_counts_and_top(df, threshold):
    expected = sorted_pairs(brute(threshold))
    assert similar_pair_counts(df, "v", threshold).first()["pairs"] == len(expected)
    top = top_similar_pairs(df, "v", threshold, n=25).collect()
    best = sorted((-s, a, b) for (a, b), s in expected.items())[:25]
    assert [(r.doc_a, r.doc_b) for r in top] == [(a, b) for _, a, b in best]


def test_exact_duplicates_lists_every_member(df):
    found = exact_duplicates(df, "v").collect()
    assert len(found) == 30 and {r.group_id for r in found} == {"d000"} and {r.copies for r in found} == {30}
    assert sorted(r.doc_id for r in found) == [f"d{i:03d}" for i in range(0, 90, 3)]
    assert exact_duplicates(df.limit(1), "v").count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_sampled_pairs_are_distinct_and_ordered(spark, n):
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    for wanted in (3, 20, 100):
        pairs = [tuple(r) for r in sample_pairs(ids, wanted).collect()]
        assert len(pairs) == min(wanted, n * (n - 1) // 2)
        assert len(set(pairs)) == len(pairs) and all(a != b for a, b in pairs)
        assert pairs and set(pairs) != {tuple(r) for r in sample_pairs(ids, wanted, "other").collect()} or n < 40


def test_distribution_matches_numpy(df):
    full = df.where(F.col("v").isNotNull())
    pairs = sample_pairs(full, 50).collect()
    known = dict(rows())
    values = [cos(known[r.doc_a], known[r.doc_b]) for r in pairs]
    found = similarity_distribution(df, "v", 50).first()
    assert found.sampled == 50
    assert found.median_similarity == pytest.approx(np.median(values), abs=1e-7)
    assert found.p95_similarity == pytest.approx(np.percentile(values, 95), abs=1e-7)
    assert found.p99_similarity == pytest.approx(np.percentile(values, 99), abs=1e-7)
    assert (found.min_similarity, found.max_similarity) == pytest.approx((min(values), max(values)), abs=1e-7)


def test_compare_and_lookup(spark, df):
    pairs = spark.createDataFrame([("d000", "d003"), ("d000", "scaled"), ("d000", "none"), ("zero", "d000")], "doc_a string, doc_b string")
    found = {(r.doc_a, r.doc_b): r for r in compare_pairs(df, pairs, "v").collect()}
    assert set(found) == {("d000", "d003"), ("d000", "scaled"), ("zero", "d000")}
    assert found["d000", "d003"].identical and found["d000", "d003"].max_abs_diff == 0
    assert not found["d000", "scaled"].identical and found["d000", "scaled"].similarity == pytest.approx(1)
    assert found["zero", "d000"].similarity == 0.0
    ids = spark.createDataFrame([("d000",), ("none",), ("absent",)], "doc_id string")
    states = {r.doc_id: r for r in lookup_specific(df, ids, "v").collect()}
    assert (states["d000"].state, states["none"].state, states["absent"].state) == ("found", "no_vector", "missing")
    assert states["d000"].dims == 6 and len(states["d000"].first_values) == 5 and states["none"].dims is None


def test_any_number_of_pivots_finds_the_same_pairs(spark):
    base = vectors(30, 12, 5)
    near = [(f"n{i:03d}", [float(x) for x in base[i % 30] + vectors(240, 12, 6)[i] * 1e-4]) for i in range(240)]
    df = spark.createDataFrame(near, "doc_id string, v array<float>")
    found = {n: sorted((r.doc_a, r.doc_b) for r in similar_pairs(df, "v", 0.999999, pivots=n).collect()) for n in (2, 8)}
    assert found[2] == found[8] and len(found[8]) == len(set(found[8])) > 100


def test_sampled_pairs_use_many_documents_evenly(spark):
    ids = spark.range(5000).select(F.col("id").alias("doc_id")).repartition(7)
    pairs = sample_pairs(ids, 100).collect()
    assert len({x for r in pairs for x in r}) >= 190
    few = spark.range(12).select(F.col("id").alias("doc_id"))
    assert {tuple(sorted(r)) for r in sample_pairs(few, 1000).collect()} == {(a, b) for b in range(12) for a in range(b)}
    # Every pair of 40 documents about as often as any other, over many seeds.
    seen = np.zeros(780)
    for seed in range(400):
        for number in range(20):
            a, b = pair_places(number, 40, str(seed))
            seen[b * (b - 1) // 2 + a] += 1
    expected = 400 * 20 / 780
    assert ((seen - expected) ** 2 / expected).sum() < 780 + 5 * np.sqrt(2 * 780)
    # The permutation holds beyond 64 bits.
    places = {pair_places(p, 1 << 40, "x") for p in range(200)}
    assert len(places) == 200 and all(0 <= a < b < 1 << 40 for a, b in places)


def test_visits_grow_with_the_vectors_on_clusters(spark):
    """384 numbers a vector, clusters of eight: a vector visits few cells however many there are."""
    rng = np.random.default_rng(4)
    shares = []
    for clusters in (100, 400):
        centers = rng.normal(size=(clusters, 384))
        data = np.repeat(centers, 8, axis=0) + 0.02 * rng.normal(size=(8 * clusters, 384))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "doc_id long, v array<float>")
        placed = _placed(cut_lineage(copy_groups(df, "v")), "v", 0.99, None)
        shares.append(placed.count() / len(data))
        if clusters == 100:
            found = similar_pairs(df, "v", 0.99).count()
            unit = data.astype(np.float32).astype(float)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            assert found == np.count_nonzero(np.triu(np.round(unit @ unit.T, 9) > 0.99, 1)) == 2800
    assert shares[1] < 1.5 * shares[0] and shares[1] < 3


def test_only_vectors_with_a_near_one_meet_whole(spark):
    """Sketches never tell less than the cosine, and leave out vectors that are alone."""
    rng = np.random.default_rng(8)
    data = rng.normal(size=(600, 384))
    data[1], data[3], data[5] = data[0] + 0.01 * rng.normal(size=384), 2 * data[2], 0
    unit = _unit(data)
    told = _sketches(unit, _basis(unit[100:300]))
    assert (told @ told.T >= unit @ unit.T - SKETCH_SLACK).all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "doc_id long, v array<double>")
    placed = _placed(cut_lineage(copy_groups(df, "v")), "v", 0.99, None)
    assert {r.group_id for r in placed.select("group_id").collect()} == {0, 1, 2, 3}
    assert sorted((r.doc_a, r.doc_b) for r in similar_pairs(df, "v", 0.99).collect()) == [(0, 1), (2, 3)]
