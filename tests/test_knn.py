import numpy as np
import pytest
from conftest import vectors
from pyspark.sql import functions as F

from glyphlake.operators.knn import (
    check_k, field_top_k, knn, knn_filtered, knn_multi_field, recall_at_k, search_by_example,
)
from glyphlake.operators.ranking import format_result, fuse, page, rank_page, top_results

SCHEMA = "doc_id string, icon_type string, a array<float>, b array<float>"


def index_rows(n=60, dims=8):
    a, b = vectors(n, dims, 1), vectors(n, dims, 2)
    rows = []
    for i in range(n):
        first = a[0] if i % 3 == 0 else a[i]  # a third of the table are copies of one vector
        second = None if i % 4 == 0 else b[i].tolist()
        rows.append((f"d{i:03d}", "icon" if i % 2 else None, first.tolist(), second))
    rows.append(("zero", "icon", [0.0] * dims, None))
    return rows


def brute(rows, queries, column, k, kind=None):
    found = {}
    for qid, vector in queries:
        scored = []
        for row in rows:
            v = row[column]
            if v is None or (kind and row[1] != kind):
                continue
            v, q = np.array(v, float), np.array(vector, float)
            norm = np.linalg.norm(v) * np.linalg.norm(q)
            scored.append((-round(float(v @ q / norm) if norm else 0.0, 9), row[0]))
        found[qid] = [(doc, rank + 1) for rank, (_, doc) in enumerate(sorted(scored)[:k])]
    return found


def by_query(df):
    found = {}
    for row in df.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["doc_id"], row["rank"]))
    return found


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(index_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(f"q{i}", v.tolist()) for i, v in enumerate(vectors(9, 8, 3))]
    return spark.createDataFrame(rows, "query_id string, vector array<float>")


def asked(queries):
    return [(r["query_id"], r["vector"]) for r in queries.collect()]


@pytest.mark.parametrize("limits", [{}, {"max_queries": 4, "index_chunk_rows": 7}])
def test_knn_equals_brute_force(index, queries, limits):
    for column, place in (("a", 2), ("b", 3)):
        assert by_query(knn(index, queries, column, k=7, **limits)) == brute(index_rows(), asked(queries), place, 7)


def test_k_larger_than_index_gives_every_row_with_a_vector(index, queries):
    assert knn(index, queries, "b", k=100).groupBy("query_id").count().select("count").distinct().collect() == [(45,)]


def test_filter_applies_before_k(index, queries):
    expected = brute(index_rows(), asked(queries), 2, 5, "icon")
    assert by_query(knn_filtered(index, queries, "a", "icon", k=5)) == expected
    assert by_query(knn_filtered(index, queries, "a", None, k=5)) == brute(index_rows(), asked(queries), 2, 5)
    typed = queries.withColumn("icon_type", F.when(F.col("query_id") == "q1", "icon"))
    mixed = by_query(knn(index, typed, "a", k=5, group_col="icon_type"))
    assert mixed["q1"] == expected["q1"]
    assert mixed["q2"] == brute(index_rows(), asked(queries), 2, 5)["q2"]


def test_no_queries_and_no_rows(spark, index, queries):
    assert knn(index, queries.where("false"), "a").collect() == []
    assert knn(index.where("false"), queries, "a").collect() == []


def test_vector_lengths(spark):
    query = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    rows = [("a", [1.0, 0.0]), ("empty", []), ("none", None)]
    assert [r.doc_id for r in knn(spark.createDataFrame(rows, "doc_id string, v array<float>"), query, "v").collect()] == ["a"]
    # Rows and queries of another length have no hits; the others are not disturbed.
    odd = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0, 3.0]), ("c", [0.5, 0.5])], "doc_id string, v array<float>").coalesce(1)
    asked = [("q", [1.0, 0.0]), ("r", [0.0, 1.0]), ("short", [1.0]), ("empty", []), ("none", None)]
    found = knn(odd, spark.createDataFrame(asked, query.schema), "v").collect()
    assert sorted((r.query_id, r.doc_id) for r in found) == [("q", "c"), ("r", "c")]


def test_candidate_bounds():
    check_k(10, 100)
    for k, n in ((0, 100), (101, 100)):
        with pytest.raises(ValueError):
            check_k(k, n)


def test_repeated_field_counts_twice(index, queries):
    once = {(r.query_id, r.doc_id): r.score for r in knn_multi_field(index, queries, ["a"], k=4).collect()}
    twice = {(r.query_id, r.doc_id): r.score for r in knn_multi_field(index, queries, ["a", "a"], k=4).collect()}
    assert twice == pytest.approx({key: 2 * score for key, score in once.items()})


def test_fields_of_each_query(spark, index, queries):
    listed = queries.withColumn("fields", F.when(F.col("query_id") == "q0", F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"))))
    found = knn_multi_field(index, listed, ["a", "b"], k=3, query_fields="fields")
    per_query = {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()}
    assert per_query["q0"] == 3 and 3 < per_query["q1"] <= 6


def test_example_finds_itself_first(index):
    examples = index.where("doc_id IN ('d001', 'd007')").select("doc_id")
    best = search_by_example(index, examples, "a", k=1).collect()
    assert sorted((r.query_id, r.doc_id) for r in best) == [("d001", "d001"), ("d007", "d007")]
    assert all(abs(r.score - 1) < 1e-9 for r in best)


def test_fuse_rank_page_and_format(spark):
    left = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.5)], "query_id string, doc_id string, score double")
    right = spark.createDataFrame([("q", "b", 0.5), ("q", "c", 0.9)], "query_id string, doc_id string, score double")
    ranked = rank_page(fuse(left, right), 50)
    assert [(r.doc_id, r.score, r["rank"]) for r in ranked.orderBy("rank").collect()] == [("a", 1.0, 1), ("b", 1.0, 2), ("c", 0.9, 3)]
    assert [r.doc_id for r in top_results(ranked, 1).collect()] == ["a"]
    assert [r.doc_id for r in page(ranked, 1, 2).collect()] == ["c"]
    hits = spark.createDataFrame([("x_v1", "x", None), ("y_v1", "", 2.0), ("z_v1", None, 0.5)], "doc_id string, icon_name string, score double")
    assert [(r.icon_name, r.score) for r in format_result(hits).orderBy("doc_id").collect()] == [("x", 0.0), ("y_v1", 2.0), ("z_v1", 0.5)]


def test_only_searched_columns_are_read_and_filters_are_pushed(spark, sf):
    from glyphlake.workloads.base import table

    base = table(spark, sf, "embeddings")
    index = base.selectExpr("vec_id AS doc_id", "embedding AS vector", "label")
    asked = base.selectExpr("vec_id AS query_id", "embedding AS vector")
    plan = knn(index, asked, "vector", where=F.col("label") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)" in plan.replace("IsNotNull(embedding), ", "")
    assert "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    narrow = field_top_k(index, asked, ["vector"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in narrow
