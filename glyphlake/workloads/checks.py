"""Copies, similar pairs, samples and data quality."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.operators.catalog import embedding_presence
from glyphlake.operators.duplicates import copy_groups, exact_duplicates
from glyphlake.operators.pairs import (
    compare_pairs, lookup_specific, sample_pairs, similar_pair_counts, similar_pairs, similarity_distribution,
    top_similar_pairs,
)
from glyphlake.operators.quality import check_dims, coverage, diagnose, validate_schema
from glyphlake.workloads.base import SQL_DOC_VECTORS, sql_cos, table, text_index, vector_index
from glyphlake.workloads.dense import SQL_VISUAL, visual_index
from glyphlake.workloads.registry import register

SQL_COPIES = "cp AS (SELECT v, min(id) AS rep, count(*) AS copies FROM dv GROUP BY v)"
SQL_PAIRS = f"""{SQL_COPIES},
sp AS (SELECT a.rep AS doc_a, b.rep AS doc_b, a.copies AS copies_a, b.copies AS copies_b, {sql_cos('a.v', 'b.v')} AS similarity
       FROM cp a JOIN cp b ON a.rep < b.rep WHERE {sql_cos('a.v', 'b.v')} > 0.99)"""


@register(
    "exact_duplicates",
    f"WITH {SQL_DOC_VECTORS}, {SQL_COPIES} SELECT rep AS group_id, copies, id AS doc_id FROM dv JOIN cp USING (v) WHERE copies > 1",
)
def duplicates(spark, sf):
    return exact_duplicates(text_index(spark, sf), "text_embedding")


@register(
    "duplicate_groups",
    f"WITH {SQL_DOC_VECTORS}, {SQL_COPIES} SELECT rep AS group_id, copies FROM cp WHERE copies > 1",
)
def groups(spark, sf):
    return copy_groups(text_index(spark, sf), "text_embedding").where("copies > 1").select("group_id", "copies")


@register(
    "similar_pairs",
    f"WITH {SQL_DOC_VECTORS}, {SQL_PAIRS} SELECT doc_a, doc_b, copies_a, copies_b, round(similarity, 6) AS similarity FROM sp "
    "UNION ALL SELECT rep, rep, copies, copies, 1.0 FROM cp WHERE copies > 1 AND list_sum(list_transform(v, lambda x: abs(x))) > 0",
)
def near(spark, sf):
    return similar_pairs(text_index(spark, sf), "text_embedding").withColumn("similarity", F.round("similarity", 6))


@register(
    "similar_pair_counts",
    f"""WITH {SQL_DOC_VECTORS}, {SQL_PAIRS}
SELECT ((SELECT coalesce(sum(copies_a * copies_b), 0) FROM sp) + (
  SELECT coalesce(sum(copies * (copies - 1) // 2), 0) FROM cp WHERE list_sum(list_transform(v, lambda x: abs(x))) > 0))::BIGINT AS pairs""",
)
def near_count(spark, sf):
    return similar_pair_counts(text_index(spark, sf), "text_embedding")


@register(
    "top_similar_pairs",
    f"""WITH {SQL_DOC_VECTORS}, pairs AS (
  SELECT a.id AS doc_a, b.id AS doc_b, {sql_cos('a.v', 'b.v')} AS similarity FROM dv a JOIN dv b ON a.id < b.id)
SELECT doc_a, doc_b, round(similarity, 6) AS similarity FROM pairs WHERE similarity > 0.99
ORDER BY pairs.similarity DESC, doc_a, doc_b LIMIT 20""",
)
def nearest(spark, sf):
    return top_similar_pairs(text_index(spark, sf), "text_embedding").withColumn("similarity", F.round("similarity", 6))


# A network of four rounds on numbers of 2 * h bits, walked on until the number is that of a pair.
SQL_SAMPLE = f"""RECURSIVE placed AS (
  SELECT vec_id AS doc_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS at FROM embeddings),
size AS (
  SELECT total, ceil(length(ltrim(total::BIT::VARCHAR, '0')) / 2)::INT AS h, (1::BIGINT << ceil(length(ltrim(total::BIT::VARCHAR, '0')) / 2)::INT) - 1 AS mask
  FROM (SELECT count(*) * (count(*) - 1) // 2 AS total FROM embeddings)),
walk(p, turn, low, high) AS (
  SELECT p, 0, p & mask, p >> h FROM size, unnest(range(least(100, total))) AS r(p)
  UNION ALL
  SELECT p, turn + 1, CASE WHEN turn = 4 THEN low ELSE xor(high, ('0x' || substr(md5('0|' || turn || '|' || low), 1, 15))::BIGINT & mask) END,
         CASE WHEN turn = 4 THEN high ELSE low END
  FROM (SELECT p, CASE WHEN turn = 4 THEN 0 ELSE turn END AS turn, low, high FROM walk, size WHERE turn < 4 OR (high << h) + low >= total), size),
numbered AS (SELECT (high << h) + low AS x FROM walk, size WHERE turn = 4 AND (high << h) + low < total),
slots AS (SELECT x - b * (b - 1) // 2 AS at_a, b AS at_b FROM (SELECT x, floor((1 + sqrt(1 + 8 * x)) / 2)::BIGINT AS b FROM numbered)),
sampled AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, {sql_cos('a.embedding', 'b.embedding')} AS similarity
  FROM slots JOIN placed a ON a.at = at_a JOIN placed b ON b.at = at_b)"""


@register("sample_pairs", f"WITH {SQL_SAMPLE} SELECT doc_a, doc_b FROM sampled")
def sampled(spark, sf):
    return sample_pairs(vector_index(spark, sf))


SQL_SPREAD = """count(*) AS sampled, min(similarity) AS min_similarity, max(similarity) AS max_similarity,
  avg(similarity) AS mean_similarity, quantile_cont(similarity, 0.5) AS median_similarity,
  quantile_cont(similarity, 0.95) AS p95_similarity, quantile_cont(similarity, 0.99) AS p99_similarity"""


@register(
    "similarity_distribution",
    f"""WITH {SQL_SAMPLE} SELECT sampled, round(min_similarity, 6) AS min_similarity, round(max_similarity, 6) AS max_similarity,
  round(mean_similarity, 6) AS mean_similarity, round(median_similarity, 6) AS median_similarity,
  round(p95_similarity, 6) AS p95_similarity, round(p99_similarity, 6) AS p99_similarity
FROM (SELECT {SQL_SPREAD} FROM sampled)""",
)
def spread(spark, sf):
    found = similarity_distribution(vector_index(spark, sf), "vector")
    return found.select("sampled", *[F.round(c, 6).alias(c) for c in found.columns if c != "sampled"])


@register(
    "diagnose",
    f"""WITH {SQL_SAMPLE}, cp AS (SELECT embedding, count(*) AS copies FROM embeddings GROUP BY embedding HAVING count(*) > 1),
wide AS (
  SELECT (SELECT count(*) FROM embeddings)::DOUBLE AS documents, (SELECT count(embedding) FROM embeddings)::DOUBLE AS with_vector,
         (SELECT count(*) FROM cp)::DOUBLE AS duplicate_groups, (SELECT coalesce(sum(copies), 0) FROM cp)::DOUBLE AS duplicated_documents,
         (SELECT count(*) FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
          WHERE {sql_cos('a.embedding', 'b.embedding')} > 0.99)::DOUBLE AS similar_pairs,
         s.sampled::DOUBLE AS sampled, s.* EXCLUDE (sampled)
  FROM (SELECT {SQL_SPREAD} FROM sampled) s)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT wide ON * INTO NAME metric VALUE value)""",
)
def diagnosis(spark, sf):
    return diagnose(vector_index(spark, sf), "vector").withColumn("value", F.round("value", 6))


@register(
    "compare_pairs",
    f"""WITH p AS (SELECT vec_id AS doc_b, min(vec_id) OVER (PARTITION BY label) AS doc_a FROM embeddings)
SELECT doc_a, doc_b, round({sql_cos('a.embedding', 'b.embedding')}, 6) AS similarity,
       a.embedding = b.embedding AS identical,
       round(list_max(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: abs(x[1] - x[2]))), 6) AS max_abs_diff,
       round(list_avg(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: abs(x[1] - x[2]))), 6) AS mean_abs_diff
FROM p JOIN embeddings a ON a.vec_id = doc_a JOIN embeddings b ON b.vec_id = doc_b""",
)
def compared(spark, sf):
    index = vector_index(spark, sf)
    first = index.groupBy("label").agg(F.min("doc_id").alias("doc_a"))
    pairs = index.select("label", F.col("doc_id").alias("doc_b")).join(first, "label")
    found = compare_pairs(index, pairs, "vector")
    return found.select("doc_a", "doc_b", "identical", *[F.round(c, 6).alias(c) for c in ("similarity", "max_abs_diff", "mean_abs_diff")])


@register(
    "lookup_specific",
    f"""WITH {SQL_VISUAL} SELECT d.doc_id,
  CASE WHEN v.doc_id IS NULL THEN 'missing' WHEN token_svg_embedding IS NULL THEN 'no_vector' ELSE 'found' END AS state,
  len(token_svg_embedding)::INTEGER AS dims, round(list_sum(token_svg_embedding[1:5]::DOUBLE[]), 6) AS first_values,
  round(sqrt(list_dot_product(token_svg_embedding::DOUBLE[], token_svg_embedding::DOUBLE[])), 6) AS norm
FROM documents d LEFT JOIN vis v USING (doc_id)""",
)
def looked_up(spark, sf):
    found = lookup_specific(visual_index(spark, sf), table(spark, sf, "documents"), "token_svg_embedding")
    head = F.aggregate(F.col("first_values").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return found.select("doc_id", "state", "dims", F.round(head, 6).alias("first_values"), F.round("norm", 6).alias("norm"))


FIELDS = ["icon_image_embedding", "icon_svg_embedding", "token_image_embedding", "token_svg_embedding"]


@register(
    "embedding_presence",
    f"WITH {SQL_VISUAL} SELECT doc_id, "
    + ", ".join(f"coalesce(len({f}) > 0, FALSE) AS has_{f}, len({f})::INTEGER AS dims_{f}" for f in FIELDS)
    + " FROM vis",
)
def presence(spark, sf):
    return embedding_presence(visual_index(spark, sf), FIELDS)


@register(
    "coverage",
    f"WITH {SQL_VISUAL} SELECT icon_type, count(*) AS docs, "
    + ", ".join(f"count({f}) AS with_{f}" for f in FIELDS)
    + " FROM vis GROUP BY icon_type",
)
def covered(spark, sf):
    return coverage(visual_index(spark, sf), FIELDS, by="icon_type")


@register(
    "check_dims",
    f"""WITH {SQL_VISUAL}, long AS (
  UNPIVOT (SELECT doc_id, icon_image_embedding, token_svg_embedding FROM vis) ON icon_image_embedding, token_svg_embedding INTO NAME field VALUE v)
SELECT doc_id, field, len(v)::INTEGER AS dims, CASE field WHEN 'icon_image_embedding' THEN 16 ELSE 512 END AS expected
FROM long WHERE len(v) <> CASE field WHEN 'icon_image_embedding' THEN 16 ELSE 512 END""",
)
def dimensions(spark, sf):
    return check_dims(visual_index(spark, sf), {"icon_image_embedding": 16, "token_svg_embedding": 512})


@register(
    "validate_schema",
    f"""WITH {SQL_VISUAL}, m AS (SELECT min(len(icon_image_embedding)) AS a, max(len(icon_image_embedding)) AS b,
  min(len(icon_svg_embedding)) AS c, max(len(icon_svg_embedding)) AS d FROM vis)
SELECT 'doc_id' AS field, 'type' AS "check", 'FAIL' AS status, 'Expected string, got bigint' AS details
UNION ALL SELECT 'icon_type', 'type', 'PASS', 'Type: string'
UNION ALL SELECT 'icon_image_embedding', 'type', 'PASS', 'Type: array<float>'
UNION ALL SELECT 'icon_image_embedding', 'dimensions', CASE WHEN a = 512 AND b = 512 THEN 'PASS' ELSE 'FAIL' END,
  CASE WHEN a = 512 AND b = 512 THEN '512 dimensions' ELSE 'Expected 512 dimensions, got ' || a || ' to ' || b END FROM m
UNION ALL SELECT 'icon_svg_embedding', 'type', 'PASS', 'Type: array<float>'
UNION ALL SELECT 'icon_svg_embedding', 'dimensions', CASE WHEN c = 16 AND d = 16 THEN 'PASS' ELSE 'FAIL' END,
  CASE WHEN c = 16 AND d = 16 THEN '16 dimensions' ELSE 'Expected 16 dimensions, got ' || c || ' to ' || d END FROM m
UNION ALL SELECT 'icon_svg_embedding', 'searchable', 'WARN', 'Field is not searched'
UNION ALL SELECT 'image_embedding', 'exists', 'FAIL', 'Field not found'
UNION ALL SELECT 'text_embedding_sparse', 'sparse', 'WARN', 'Sparse field not found'""",
)
def schema_report(spark, sf):
    vector = T.ArrayType(T.FloatType())
    expected = {
        "doc_id": T.StringType(), "icon_type": T.StringType(), "icon_image_embedding": vector,
        "icon_svg_embedding": vector, "image_embedding": vector,
    }
    return validate_schema(
        visual_index(spark, sf), expected, {"icon_image_embedding": 512, "icon_svg_embedding": 16, "image_embedding": 16},
        searchable={"icon_image_embedding"},
    )
