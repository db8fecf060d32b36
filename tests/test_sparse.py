import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.operators.encoders import embed_sparse, embed_text, text_postings, token_slot
from glyphlake.operators.sparse import postings, sparse_page, sparse_search
from glyphlake.plans.search import hybrid_search

WORDS = ["the", "user", "arrow", "left", "right", "folder", "open", "closed"]


def corpus(n=80, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(rng.choice(WORDS[1:], size=rng.integers(0, 5)))
        text = " ".join(["the"] * int(i % 3 == 0) + words)  # a third of the documents hold "the"
        rows.append((i, text, "icon" if i % 2 else "token"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(corpus(), "doc_id bigint, text string, icon_type string").repartition(4)
    return embed_sparse(embed_text(frame, "text", dims=32), "text").cache()


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(0, "The arrow", None), (1, "folder open folder", "icon"), (2, "nothing here", None), (3, "the", "token")]
    return embed_text(spark.createDataFrame(rows, "query_id bigint, text string, icon_type string"), "text", "vector", 32)


def weights(text):
    words = text.lower().split()
    return {w: math.log1p(words.count(w)) for w in words}


def brute_sparse(queries):
    scores = {}
    for q in queries.collect():
        for doc, text, kind in corpus():
            mine, theirs = weights(q.text), weights(text)
            if mine.keys() & theirs.keys() and q.icon_type in (None, kind):
                scores[q.query_id, doc] = round(sum(mine[w] * theirs[w] for w in mine.keys() & theirs.keys()), 9)
    return scores


def asked(queries):
    return text_postings(queries, "text", "query_id").join(queries.select("query_id", "icon_type"), "query_id")


def test_sparse_map_and_postings(spark):
    df = spark.createDataFrame([(1, "Open, open folder"), (2, ""), (3, None), (4, "...")], "doc_id int, text string")
    made = {r.doc_id: r.s for r in embed_sparse(df, "text", "s").collect()}
    assert made[1] == pytest.approx({"open": math.log(3), "folder": math.log(2)})
    assert made[2] is None and made[3] is None and made[4] is None
    again = embed_sparse(df, "text", "s")
    assert postings(again, "s").count() == text_postings(df, "text").count() == 2


def test_dense_text_vectors(spark):
    df = spark.createDataFrame([(1, "Open folder open"), (2, ""), (3, None)], "doc_id int, text string")
    made = {r.doc_id: r.v for r in embed_text(df, "text", "v", 16).collect()}
    expected = np.zeros(16)
    for token in ("open", "folder", "open"):
        slot, sign = token_slot(token, 16)
        expected[slot] += sign
    assert made[1] == pytest.approx(expected / np.linalg.norm(expected), abs=1e-6)
    assert made[2] == [0.0] * 16 and made[3] is None


@pytest.mark.parametrize("limits", [{}, {"max_query_rows": 2}, {"max_queries": 1}])
def test_sparse_page_equals_brute_force(docs, queries, limits):
    scores = brute_sparse(queries)
    found = sparse_page(docs, asked(queries), "text_embedding_sparse", 5, "icon_type", **limits).collect()
    for q in {q for q, _ in scores}:
        best = sorted((-s, d) for (qq, d), s in scores.items() if qq == q)
        mine = sorted(r for r in found if r.query_id == q)
        assert {r.total for r in mine} == {len(best)}
        ranked = sorted(mine, key=lambda r: r["rank"])
        assert [r.doc_id for r in ranked] == [d for _, d in best[:5]]
        assert [r.score for r in ranked] == pytest.approx([-s for s, _ in best[:5]], abs=1e-8)
    assert {r.query_id for r in found} == {q for q, _ in scores}


@pytest.mark.parametrize("block_rows, tile_rows", [(16, 2048), (3, 50), (1, 1)])
def test_bounds_leave_out_most_cells_and_no_match(monkeypatch, block_rows, tile_rows):
    """Zipf tokens over documents of uneven length, negative weights included."""
    import pandas as pd
    import pyarrow as pa

    from glyphlake.operators import sparse

    monkeypatch.setattr(sparse, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(sparse, "TILE_ROWS", tile_rows)
    rng = np.random.default_rng(2)
    share = 1 / np.arange(1, 301)
    share /= share.sum()

    def entries(n):
        tokens = np.unique(rng.choice(300, n, p=share))
        return [(f"t{t}", float(w)) for t, w in zip(tokens, rng.lognormal(0, 1, len(tokens)) * (1 - 2 * (tokens % 50 == 7)))]

    docs = [entries(int(n)) for n in rng.lognormal(2, 1, 1500)]
    asked = [(q, t, w) for q in range(40) for t, w in entries(6)]
    block = sparse.SparseBlock(pd.DataFrame(asked, columns=["query_id", "token", "weight"]), 5)
    block.begin()
    ident, half = np.arange(1500), 700
    for low, high in ((0, half), (half, 1500)):
        column = pa.array(docs[low:high], pa.map_(pa.string(), pa.float64()))
        tiles = block.add(ident[low:high], column, None)
    got = {}
    for row, doc, score in zip(block.best.row, block.best.ident, block.best.score):
        got.setdefault(int(block.query_id[row]), []).append((-score, int(doc)))
    for q in range(40):
        mine = {t: w for query, t, w in asked if query == q}
        every = {d: sum(mine[t] * w for t, w in e if t in mine) for d, e in enumerate(docs) if any(t in mine for t, _ in e)}
        at = block.query_id.tolist().index(q)
        assert block.matches[at] == len(every)
        want = sorted((-round(s, 9), d) for d, s in every.items())[:5]
        assert [d for _, d in got[q]] == [d for _, d in want]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want], abs=1e-8)
        pairs = block.pair_scores(tiles, np.full(800, at), np.arange(800))
        assert {half + i for i in np.flatnonzero(~np.isnan(pairs))} == {d for d in every if d >= half}
        assert all(pairs[d - half] == pytest.approx(s, abs=1e-8) for d, s in every.items() if d >= half)
    if tile_rows > 50:
        assert block.scored < 0.25 * 40 * 1500


@pytest.mark.parametrize("rows", [100_000, 3])
def test_sparse_join_equals_brute_force(docs, queries, rows):
    terms = docs.select("doc_id", "icon_type", F.explode("text_embedding_sparse").alias("token", "weight"))
    found = sparse_search(terms, asked(queries), "icon_type", max_query_rows=rows)
    assert {(r.query_id, r.doc_id): r.score for r in found.collect()} == pytest.approx(brute_sparse(queries), abs=1e-8)


# The second bound is below the number of requests, so they are answered branch by branch.
@pytest.mark.parametrize("size, bounds", [(3, {}), (50, {}), (3, {"max_queries": 2})])
def test_hybrid_equals_full_fusion(docs, queries, size, bounds):
    from glyphlake.operators.knn import knn

    fused = brute_sparse(queries)
    for r in knn(docs, queries, "text_embedding", 4, group_col="icon_type").collect():
        fused[r.query_id, r.doc_id] = fused.get((r.query_id, r.doc_id), 0.0) + r.score
    found = hybrid_search(docs, queries, asked(queries), k=4, size=size, group_col="icon_type", **bounds).collect()
    for q in {q for q, _ in fused}:
        best = sorted((-round(s, 9), d) for (qq, d), s in fused.items() if qq == q)
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert {r.total for r in mine} == {len(best)}
        assert [r.score for r in mine] == pytest.approx([-s for s, _ in best[:size]], abs=1e-7)
        assert {r.doc_id for r in mine} == {d for _, d in best[:size]}


def test_hybrid_reads_the_index_once(spark, docs, queries, tmp_path):
    docs.drop("text").write.parquet(f"{tmp_path}/index")
    found = hybrid_search(spark.read.parquet(f"{tmp_path}/index"), queries, asked(queries), k=4, group_col="icon_type")
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
