"""Whole jobs: answering a mixed table of requests, encoding a corpus, indexing a release."""

import numpy as np
from pyspark.sql import functions as F

from glyphlake.operators.encoders import embed_image, embed_sparse, embed_text, encode_column, encode_corpus
from glyphlake.functions.images import image_stats, normalize_images
from glyphlake.plans.indexing import index_release
from glyphlake.plans.search import search, search_report
from glyphlake.schema import DOC_SCHEMA, VISUAL_FIELDS
from glyphlake.session import cut_lineage, work_folder
from glyphlake.sources.corpus import read_images
from glyphlake.workloads.base import (
    SQL_CENTROIDS, SQL_DOC_VECTORS, SQL_QUERY_VECTORS, documents, label_centroids, named_files, spread_out, sql_cos, table, text_queries, write_files,
)
from glyphlake.workloads.dense import SQL_VISUAL, shown, visual_index
from glyphlake.workloads.markup import SQL_GRIDS, SQL_SVGS, grids, svgs
from glyphlake.workloads.registry import register
from glyphlake.workloads.text import SQL_POSTINGS, query_postings


def search_index(spark, sf):
    """Documents with text vectors; those that also have an embedding carry the visual fields.

    Stored once, as an index is, and then searched.
    """
    docs = embed_text(documents(spark, sf), "text", "text_embedding")
    kind = F.when(F.col("lang") == "en", "icon").when(F.col("lang") == "de", "token")
    named = embed_sparse(docs, "text").select(
        "doc_id",
        F.when(F.col("source") != "src1", F.col("source")).alias("icon_name"),
        F.lit("v1.0.0").alias("release_tag"),
        kind.alias("icon_type"),
        F.array("lang", "source").alias("descriptions"),
        "text_embedding",
        "text_embedding_sparse",
    )
    place = work_folder(spark)
    named.join(visual_index(spark, sf).drop("icon_type", "label"), "doc_id", "left").write.parquet(place)
    return spread_out(spark.read.parquet(place))


def search_requests(spark, sf):
    """Benchmark texts and label centroids (as images), each asking for a type or for none."""
    wanted = F.when(F.col("query_id") % 3 == 1, "icon").when(F.col("query_id") % 3 == 2, "token")
    vector = F.col("vector").cast("array<double>")
    none = F.lit(None).cast("array<string>").alias("fields")
    texts = text_queries(spark, sf).select(
        F.concat(F.lit("t"), "query_id").alias("query_id"), F.lit("text").alias("type"), F.col("text").alias("query"),
        wanted.alias("icon_type"), none, vector.alias("vector"),
    )
    images = label_centroids(spark, sf).select(
        F.concat(F.lit("i"), "query_id").alias("query_id"), F.lit("image").alias("type"), F.lit(None).cast("string").alias("query"),
        wanted.alias("icon_type"), none, F.slice(vector, 1, 16).alias("vector"),
    )
    return texts.unionByName(images)


def found(spark, sf):
    sparse = query_postings(spark, sf).withColumn("query_id", F.concat(F.lit("t"), "query_id"))
    return search(search_index(spark, sf), search_requests(spark, sf), sparse)


SQL_WANTED = "CASE {0} % 3 WHEN 1 THEN 'icon' WHEN 2 THEN 'token' END"
SQL_SEARCH = f"""{SQL_DOC_VECTORS}, {SQL_QUERY_VECTORS}, {SQL_POSTINGS}, {SQL_VISUAL}, {SQL_CENTROIDS},
docs AS (SELECT doc_id, source, lang, CASE lang WHEN 'en' THEN 'icon' WHEN 'de' THEN 'token' END AS icon_type FROM documents),
tq AS (SELECT id AS query_id, v, {SQL_WANTED.format('id')} AS wanted FROM qv),
td AS (
  SELECT query_id, doc_id, (1 + cos) / 2 AS score FROM (
    SELECT tq.query_id, dv.id AS doc_id, {sql_cos('dv.v', 'tq.v')} AS cos
    FROM dv JOIN docs ON docs.doc_id = dv.id CROSS JOIN tq WHERE wanted IS NULL OR wanted = icon_type)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) <= 10),
ts AS (SELECT s.* FROM sparse s JOIN docs USING (doc_id) JOIN tq USING (query_id) WHERE wanted IS NULL OR wanted = icon_type),
iq AS (SELECT query_id, qv[1:16] AS qv, unnest(CASE {SQL_WANTED.format('query_id')}
    WHEN 'icon' THEN ['icon_image_embedding', 'icon_svg_embedding'] WHEN 'token' THEN ['token_image_embedding', 'token_svg_embedding']
    ELSE ['icon_image_embedding', 'icon_svg_embedding', 'token_image_embedding', 'token_svg_embedding'] END) AS field FROM q),
long AS (UNPIVOT (SELECT doc_id, icon_image_embedding, icon_svg_embedding, token_image_embedding, token_svg_embedding FROM vis SEMI JOIN documents USING (doc_id))
         ON icon_image_embedding, icon_svg_embedding, token_image_embedding, token_svg_embedding INTO NAME field VALUE vector),
ic AS (
  SELECT query_id, field, doc_id, {sql_cos('vector', 'qv')} AS cos FROM iq JOIN long USING (field)
  QUALIFY row_number() OVER (PARTITION BY query_id, field ORDER BY cos DESC, doc_id) <= 10),
al AS (
  SELECT 't' || query_id AS query_id, doc_id, score FROM td UNION ALL SELECT 't' || query_id, doc_id, score FROM ts
  UNION ALL SELECT 'i' || query_id, doc_id, (1 + cos) / 2 FROM ic),
sc AS (SELECT query_id, doc_id, round(sum(score), 9) AS score FROM al GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM sc),
res AS (SELECT query_id, rank, doc_id, CASE WHEN source <> 'src1' THEN source ELSE doc_id::VARCHAR END AS icon_name, score,
          lang, source, icon_type, total FROM rk JOIN docs USING (doc_id) WHERE rank <= 50)"""


@register(
    "search",
    f"""WITH {SQL_SEARCH} SELECT query_id, rank, doc_id, icon_name, round(score, 6) AS score, lang || ',' || source AS descriptions,
  'v1.0.0' AS release_tag, icon_type, total FROM res""",
)
def searched(spark, sf):
    return shown(found(spark, sf)).withColumn("descriptions", F.array_join("descriptions", ","))


@register(
    "search_report",
    f"""WITH {SQL_SEARCH}, blocks AS (SELECT query_id, rank, total, rank || '. ' || icon_name || ' (score: ' || printf('%.4f', score) || ')'
    || CASE WHEN icon_type IS NOT NULL THEN chr(10) || '   Type: ' || icon_type ELSE '' END || chr(10) || '   Release: v1.0.0'
    || chr(10) || '   Descriptions: ' || lang || ', ' || source || chr(10) AS block FROM res WHERE rank <= 10)
SELECT query_id, 'Found ' || max(total) || ' total matches, showing top ' || count(*) || ':' || chr(10) || chr(10)
  || string_agg(block, chr(10) ORDER BY rank) AS report FROM blocks GROUP BY query_id""",
)
def reported(spark, sf):
    return search_report(found(spark, sf), search_requests(spark, sf))


@register(
    "encode_corpus",
    f"""WITH {SQL_VISUAL} SELECT doc_id, label, """
    + ", ".join(f"round(list_sum({f}::DOUBLE[]), 6) AS {f}" for f in VISUAL_FIELDS)
    + " FROM vis",
)
def corpus(spark, sf):
    index = visual_index(spark, sf)
    kinds = F.array(*[F.struct(F.lit(f).alias("kind"), F.col(f).alias("vector")) for f in VISUAL_FIELDS])
    long = index.select("doc_id", "label", F.explode(kinds).alias("k")).select("doc_id", "label", "k.*").where("vector IS NOT NULL")
    wide = encode_corpus(long, ["doc_id", "label"])
    total = [F.round(F.aggregate(F.col(f).cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6).alias(f) for f in VISUAL_FIELDS]
    return wide.select("doc_id", "label", *total)


def word_lengths():
    """A tiny user encoder: counts of characters and words; it refuses texts holding a digit."""

    def encode(texts):
        if any(any("0" <= c <= "9" for c in t) for t in texts):
            raise ValueError("digits are not encoded")
        return [[float(len(t)), float(t.count(" "))] for t in texts]

    return encode


@register(
    "encode_with_errors",
    """SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[0-9]') THEN length(text)::DOUBLE END AS length,
  CASE WHEN NOT regexp_matches(text, '[0-9]') THEN (length(text) - length(replace(text, ' ', '')))::DOUBLE END AS blanks,
  CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits are not encoded' END AS error FROM documents""",
)
def encoded_by_user(spark, sf):
    made = encode_column(documents(spark, sf), "text", "v", word_lengths)
    return made.select(
        "doc_id", F.col("v")[0].cast("double").alias("length"), F.col("v")[1].cast("double").alias("blanks"), F.col("v_error").alias("error")
    )


def pictures(spark, sf):
    """Gray 8 by 8 image structs of the pixel grids; label 3 stands for undecodable files."""
    data = F.unhex(F.array_join(F.transform("pixels", lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    bad = F.col("label") == 3
    image = F.struct(
        F.lit("").alias("origin"), F.when(bad, -1).otherwise(8).alias("height"), F.when(bad, -1).otherwise(8).alias("width"),
        F.when(bad, -1).otherwise(1).alias("nChannels"), F.when(bad, -1).otherwise(0).alias("mode"),
        F.when(bad, F.unhex(F.lit(""))).otherwise(data).alias("data"),
    )
    return spread_out(grids(spark, sf).join(labels, "vec_id").select("vec_id", image.alias("image")))


SQL_SIZE = 16


def sql_resized_grids(value: str, rows: str) -> str:
    """Pixel ``value`` of ``rows`` resized to 16 by 16: columns, then rows."""
    return f"""{SQL_GRIDS},
u AS (SELECT vec_id, list_transform(p, lambda x: (CASE WHEN bright < 128 THEN 255 - x ELSE x END)::FLOAT) AS p FROM e),
m AS (SELECT vec_id, p, list_min(p) AS lo, list_max(p) AS hi FROM u),
px AS (
  SELECT vec_id, (k - 1) // 8 AS y, (k - 1) % 8 AS x, {value} AS v
  FROM {rows}, unnest(range(1, 65)) AS r(k)),
taps AS (
  SELECT o, i, i - (o + 0.5::DOUBLE) * 8 / {SQL_SIZE} + 0.5::DOUBLE AS d FROM unnest(range({SQL_SIZE})) AS a(o), unnest(range(8)) AS b(i)
  WHERE i >= greatest(0, trunc((o + 0.5::DOUBLE) * 8 / {SQL_SIZE} - 2.5)) AND i < least(8, trunc((o + 0.5::DOUBLE) * 8 / {SQL_SIZE} + 3.5))),
raw AS (
  SELECT o, i, CASE WHEN d = 0 THEN 1 WHEN abs(d) < 3 THEN sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) ELSE 0 END AS w FROM taps),
wt AS (SELECT o, i, trunc(w / s * 4194304 + CASE WHEN w < 0 THEN -0.5 ELSE 0.5 END)::BIGINT AS w
       FROM raw JOIN (SELECT o, sum(w) AS s FROM raw GROUP BY o) USING (o)),
hz AS (SELECT vec_id, y, o AS x, greatest(0, least(255, (sum(v * w)::BIGINT + 2097152) >> 22)) AS v FROM px JOIN wt ON i = x GROUP BY vec_id, y, o),
vt AS (SELECT vec_id, o AS y, x, greatest(0, least(255, (sum(v * w)::BIGINT + 2097152) >> 22)) AS v FROM hz JOIN wt ON i = y GROUP BY vec_id, o, x),
lb AS (SELECT vec_id, label = 3 AS bad FROM embeddings)"""


# As in ``stretch_pixels``, and as they are.
SQL_RESIZED = sql_resized_grids("CASE WHEN hi > lo THEN trunc((p[k] - lo) / (hi - lo) * 255::FLOAT)::BIGINT ELSE 255 END", "m")
SQL_RESIZED_PLAIN = sql_resized_grids("p[k]::BIGINT", "e")


@register(
    "embed_image",
    f"""WITH {SQL_RESIZED}, pool AS (SELECT vec_id, avg(v) AS a FROM vt GROUP BY vec_id, y // 2, x // 2),
n AS (SELECT vec_id, sum(a) / sqrt(sum(a * a)) AS total FROM pool GROUP BY vec_id)
SELECT vec_id, CASE WHEN NOT bad THEN 64 END AS dims, CASE WHEN NOT bad THEN round(total, 4) END AS total,
       CASE WHEN bad THEN 'Invalid image file' END AS error FROM lb JOIN n USING (vec_id)""",
)
def embedded_images(spark, sf):
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    made = embed_image(pictures(spark, sf), "image", "v", dims=64, size=SQL_SIZE)
    return made.select("vec_id", F.size("v").alias("dims"), F.round(total, 4).alias("total"), F.col("v_error").alias("error"))


def sql_normalized(resized: str) -> str:
    return f"""WITH {resized}, h AS (SELECT vec_id, string_agg(printf('%02X', v) || printf('%02X', v) || printf('%02X', v), '' ORDER BY y, x) AS data,
  count(DISTINCT v) AS colours FROM vt GROUP BY vec_id)
SELECT vec_id, CASE WHEN bad THEN -1 ELSE 16 END AS width, CASE WHEN bad THEN -1 ELSE 16 END AS height, CASE WHEN bad THEN 0 ELSE 768 END AS size_bytes,
  CASE WHEN bad THEN 0 ELSE colours END AS colours, NOT bad AND colours = 1 AS single_colour, CASE WHEN bad THEN '' ELSE data END AS data
FROM lb JOIN h USING (vec_id)"""


def made_images(spark, sf, search):
    made = image_stats(normalize_images(pictures(spark, sf), "image", "made", SQL_SIZE, search), "made")
    return made.select("vec_id", "width", "height", "size_bytes", "colours", "single_colour", F.hex("made.data").alias("data"))


@register("normalize_images", sql_normalized(SQL_RESIZED))
def normalized_images(spark, sf):
    return made_images(spark, sf, search=True)


@register("normalize_images_plain", sql_normalized(SQL_RESIZED_PLAIN))
def resized_images(spark, sf):
    """Neither inverted nor stretched."""
    return made_images(spark, sf, search=False)


def read_plain_gray(data: bytes) -> np.ndarray:
    """Pixels of a portable graymap in plain text: a picture format that needs no image library."""
    kind, width, height, _, *pixels = data.split()
    if kind != b"P2":
        raise ValueError("not a plain graymap")
    return np.array(pixels, np.uint8).reshape(int(height), int(width))


@register(
    "image_files",
    f"""WITH {SQL_GRIDS}, h AS (SELECT vec_id, vec_id % 7 = 0 AS bad, array_to_string(list_transform(p, lambda x: printf('%02X', x)), '') AS data FROM g)
SELECT vec_id, CASE WHEN bad THEN -1 ELSE 8 END AS width, CASE WHEN bad THEN -1 ELSE 8 END AS height, CASE WHEN bad THEN '' ELSE data END AS data,
  CASE WHEN bad THEN 'Invalid image file' END AS error FROM h""",
)
def intake(spark, sf):
    """A picture file for every embedding, written and read back; every seventh is broken."""
    kind = F.when(F.col("vec_id") % 7 == 0, "P9").otherwise("P2")
    files = grids(spark, sf).select("vec_id", F.concat(kind, F.lit("\n8 8\n255\n"), F.array_join("pixels", " ")).alias("value"))
    folder = work_folder(spark)
    names = write_files(files, "vec_id", folder)
    read = named_files(read_images(spark, folder, read_plain_gray, "*.txt"), names)
    return read.select("vec_id", "image.width", "image.height", F.hex("image.data").alias("data"), F.col("image_error").alias("error"))


SQL_RUN = f"""{SQL_SVGS}, run AS (
  SELECT c_name AS icon_name, 'p' || p_partkey AS filename, 'Failed to render icon image - renderer service is required, '
    || CASE WHEN kind IN (3, 4, 5) THEN 'Failed to generate icon SVG embedding, ' ELSE '' END
    || 'Failed to render token image, Failed to render token SVG' AS errors
  FROM s JOIN (SELECT c_nationkey, c_custkey, c_name FROM customer) ON c_custkey = p_partkey)"""


@register(
    "index_release",
    f"WITH {SQL_RUN} SELECT icon_name, filename, FALSE AS success, TRUE AS indexed, 'string' AS token_type, errors FROM run",
)
def release_run(spark, sf):
    """Parts are the SVG files, customers the names of those files; nothing is rendered."""
    stem = F.concat(F.lit("p"), "p_partkey")
    files = svgs(spark, sf).select(stem.alias("filename"), F.concat(stem, F.lit(".svg")).alias("path"), F.col("svg").alias("svg_content"))
    names = table(spark, sf, "customer").select(
        F.col("c_name").alias("icon_name"), F.concat(F.lit("p"), "c_custkey").alias("filename"), F.col("c_custkey").alias("ord")
    )
    empty = spark.createDataFrame([], DOC_SCHEMA)
    run = index_release(files, names, empty, "v1.0.0", write_to=work_folder(spark))
    return run.results.withColumn("errors", F.array_join("errors", ", "))
