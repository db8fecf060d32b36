"""Encoding, sparse and hybrid search over the documents, with the benchmark texts as queries."""

from pyspark.sql import functions as F

from glyphlake.operators.encoders import embed_sparse, embed_text, text_postings
from glyphlake.operators.knn import knn
from glyphlake.operators.ranking import rank_page, total_hits
from glyphlake.operators.sparse import sparse_page, sparse_search
from glyphlake.plans.search import choose_branch, hybrid_search
from glyphlake.session import work_folder
from glyphlake.workloads.base import (
    SQL_DOC_VECTORS, SQL_QUERY_VECTORS, documents, sql_cos, sql_tokens, table, text_index, text_queries,
)
from glyphlake.workloads.dense import shown
from glyphlake.workloads.registry import register

SQL_POSTINGS = f"""{sql_tokens('documents', 'doc_id', 'dt')},
{sql_tokens('benchmark', 'item_id', 'qt')},
dp AS (SELECT id AS doc_id, token, ln(1 + count(*)) AS weight FROM dt GROUP BY ALL),
qp AS (SELECT id AS query_id, token, ln(1 + count(*)) AS weight FROM qt GROUP BY ALL),
sparse AS (
  SELECT query_id, doc_id, round(sum(dp.weight * qp.weight), 9) AS score FROM dp JOIN qp USING (token) GROUP BY ALL)"""


@register(
    "embed_text",
    f"""WITH {SQL_DOC_VECTORS}
SELECT id AS doc_id, len(v) AS dims, round(list_sum(v::DOUBLE[]), 6) AS total,
       round(list_sum(list_transform(v::DOUBLE[], lambda x, i: x * i)), 5) AS moment FROM dv""",
)
def embedded(spark, sf):
    vector = F.col("text_embedding").cast("array<double>")
    moment = F.aggregate(F.transform(vector, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return text_index(spark, sf).select(
        "doc_id",
        F.size("text_embedding").cast("bigint").alias("dims"),
        F.round(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
        F.round(moment, 5).alias("moment"),
    )


@register(
    "embed_sparse",
    f"""WITH {SQL_POSTINGS}
SELECT d.doc_id, count(p.token) AS tokens, round(coalesce(sum(p.weight), 0), 6) AS weight
FROM documents d LEFT JOIN dp p USING (doc_id) GROUP BY d.doc_id""",
)
def sparse_maps(spark, sf):
    made = embed_sparse(documents(spark, sf), "text")
    weights = F.map_values("text_embedding_sparse")
    return made.select(
        "doc_id",
        F.coalesce(F.size("text_embedding_sparse"), F.lit(0)).cast("bigint").alias("tokens"),
        F.round(F.coalesce(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)), 6).alias("weight"),
    )


@register("text_postings", f"WITH {SQL_POSTINGS} SELECT doc_id, token, round(weight, 6) AS weight FROM dp")
def token_weights(spark, sf):
    return text_postings(documents(spark, sf), "text").withColumn("weight", F.round("weight", 6))


def document_postings(spark, sf):
    return text_postings(documents(spark, sf), "text")


def query_postings(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return text_postings(asked, "text", "query_id")


def sql_page(source, size=50):
    return f"""SELECT query_id, doc_id, round(round(score, 9), 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {source})
WHERE rank <= {size}"""


SQL_TOTAL = "JOIN (SELECT query_id, count(*) AS total FROM sparse GROUP BY query_id) USING (query_id)"


@register("sparse_search", f"WITH {SQL_POSTINGS} SELECT * FROM ({sql_page('sparse')}) {SQL_TOTAL}")
def best_matches(spark, sf):
    index = embed_sparse(documents(spark, sf), "text", "sparse").drop("text")
    return shown(sparse_page(index, query_postings(spark, sf), "sparse"))


@register("sparse_scores", f"WITH {SQL_POSTINGS} SELECT query_id, doc_id, round(score, 6) AS score FROM sparse")
def all_matches(spark, sf):
    return shown(sparse_search(document_postings(spark, sf), query_postings(spark, sf)))


@register("total_hits", f"WITH {SQL_POSTINGS} SELECT query_id, count(*) AS total FROM sparse GROUP BY query_id")
def hits(spark, sf):
    return total_hits(sparse_search(document_postings(spark, sf), query_postings(spark, sf)))


SQL_TEXT_KNN = f"""dense AS (
  SELECT query_id, doc_id, (1 + cos) / 2 AS score FROM (
    SELECT q.id AS query_id, d.id AS doc_id, {sql_cos('d.v', 'q.v')} AS cos FROM dv d CROSS JOIN qv q)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) <= 10)"""


@register("text_knn", f"WITH {SQL_DOC_VECTORS}, {SQL_QUERY_VECTORS}, {SQL_TEXT_KNN} {sql_page('dense')}")
def text_knn(spark, sf):
    found = knn(text_index(spark, sf), text_queries(spark, sf), "text_embedding")
    return shown(rank_page(found.drop("rank")))


@register(
    "hybrid_search",
    f"""WITH {SQL_DOC_VECTORS}, {SQL_QUERY_VECTORS}, {SQL_TEXT_KNN}, {SQL_POSTINGS},
fused AS (SELECT query_id, doc_id, sum(score) AS score
          FROM (SELECT query_id, doc_id, score FROM dense UNION ALL SELECT query_id, doc_id, score FROM sparse) GROUP BY ALL)
SELECT * FROM ({sql_page('fused')}) JOIN (SELECT query_id, count(*) AS total FROM fused GROUP BY query_id) USING (query_id)""",
)
def hybrid(spark, sf):
    # Encoded and stored once, as an index would be, then searched by both halves.
    place = work_folder(spark)
    embed_sparse(embed_text(documents(spark, sf), "text"), "text").drop("text").write.parquet(place)
    index = spark.read.parquet(place)
    return shown(hybrid_search(index, text_queries(spark, sf), query_postings(spark, sf)))


@register(
    "choose_branch",
    """WITH t AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'text' WHEN role = 'assistant' THEN 'svg' ELSE 'image' END AS type,
         len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS tokens FROM conversations)
SELECT conv_id, turn, CASE WHEN type = 'text' AND tokens > 0 THEN 'hybrid' WHEN type IN ('image', 'svg') THEN 'visual' ELSE 'dense' END AS branch FROM t""",
)
def branches(spark, sf):
    from glyphlake.functions.text import tokens

    kind = F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "svg").otherwise("image")
    asked = table(spark, sf, "conversations").withColumn("type", kind)
    asked = asked.withColumn("sparse_size", F.size(F.array_distinct(tokens("text"))))
    return asked.select("conv_id", "turn", choose_branch().alias("branch"))
