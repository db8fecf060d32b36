"""Files against the name map, releases, requests and documents kept up to date.

Documents play the files (their source is the file stem), customers the name map (their nation
gives the file, so every file has many aliases).
"""

from pyspark.sql import functions as F

from glyphlake.functions.text import filename_stem
from glyphlake.operators.catalog import (
    incomplete_icons, latest_release, limit_after_match, match_files, missing_files, reverse_map, to_process,
    unmatched_files,
)
from glyphlake.operators.runs import (
    batch_errors, batch_status, failed_icons, list_indexed, process_icons, run_summary,
)
from glyphlake.operators.upsert import (
    append_positions, latest_fields, split_descriptions, upsert, upsert_descriptions, with_descriptions,
)
from glyphlake.sources.corpus import outside_skipped_dirs, parse_name_map
from glyphlake.sources.index_store import exists, get
from glyphlake.sources.requests import read_items, validate_requests
from glyphlake.workloads.base import table
from glyphlake.workloads.dense import SQL_VISUAL, visual_index
from glyphlake.workloads.registry import register


def files(spark, sf):
    path = F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "doc_id", F.lit("/"), "source", F.lit(".svg"))
    return table(spark, sf, "documents").select("doc_id", path.alias("path")).withColumn("filename", filename_stem("path"))


def name_map(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("icon_name"),
        F.concat(F.lit("src"), F.col("c_nationkey") * 2).alias("filename"),
        F.col("c_custkey").alias("ord"),
    )


SQL_FILES = """f AS (SELECT doc_id, '/corpus/' || lang || '/' || doc_id || '/' || source || '.svg' AS path, source AS filename FROM documents),
nm AS (SELECT c_name AS icon_name, 'src' || (c_nationkey * 2) AS filename, c_custkey AS ord FROM customer),
rm AS (SELECT filename, arg_max(icon_name, ord) AS icon_name FROM nm GROUP BY filename)"""


@register("reverse_map", f"WITH {SQL_FILES} SELECT * FROM rm")
def reversed_names(spark, sf):
    return reverse_map(name_map(spark, sf))


@register("match_files", f"WITH {SQL_FILES} SELECT filename, doc_id, path, icon_name FROM f JOIN rm USING (filename)")
def matched(spark, sf):
    return match_files(files(spark, sf), reverse_map(name_map(spark, sf)))


@register("unmatched_files", f"WITH {SQL_FILES} SELECT * FROM f WHERE filename NOT IN (SELECT filename FROM rm)")
def unmatched(spark, sf):
    return unmatched_files(files(spark, sf), reverse_map(name_map(spark, sf)))


@register("missing_files", f"WITH {SQL_FILES} SELECT * FROM nm WHERE filename NOT IN (SELECT filename FROM f)")
def missing(spark, sf):
    return missing_files(name_map(spark, sf), files(spark, sf))


@register(
    "limit_after_match",
    f"WITH {SQL_FILES} SELECT filename, doc_id, path, icon_name FROM f JOIN rm USING (filename) ORDER BY path LIMIT 25",
)
def first_matched(spark, sf):
    return limit_after_match(matched(spark, sf), 25)


@register(
    "filename_stem",
    """SELECT page_id, CASE WHEN regexp_extract(url, '[^/]*$') SIMILAR TO '\\.*[^.].*\\.[^.]*'
  THEN regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') ELSE regexp_extract(url, '[^/]*$') END AS stem FROM pages""",
)
def stems(spark, sf):
    return table(spark, sf, "pages").select("page_id", filename_stem("url").alias("stem"))


@register(
    "skipped_dirs",
    """SELECT doc_id, NOT regexp_matches('/corpus/' || CASE WHEN source = 'src1' THEN 'node_modules' WHEN source = 'src2' THEN 'rebuild' ELSE lang END || '/a.svg',
  '/(\\.git|node_modules|dist|build|__pycache__|\\.next)/') AS kept FROM documents""",
)
def kept_paths(spark, sf):
    folder = F.when(F.col("source") == "src1", "node_modules").when(F.col("source") == "src2", "rebuild").otherwise(F.col("lang"))
    path = F.concat(F.lit("/corpus/"), folder, F.lit("/a.svg"))
    return table(spark, sf, "documents").select("doc_id", outside_skipped_dirs(path).alias("kept"))


def release_index(spark, sf):
    """Indexed icons: one document per embedding, even labels with icon fields only."""
    icon = F.concat(F.lit("i"), "doc_id")
    return visual_index(spark, sf).withColumn("icon_name", icon).withColumn(
        "release_tag", F.concat(F.lit("v"), F.floor(F.col("label") / 5), F.lit(".0.0"))
    ).withColumn("doc_id", F.concat("icon_name", F.lit("_"), "release_tag"))


def wanted_icons(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("i"), "doc_id").alias("icon_name"), "source", F.concat("source", F.lit("/"), "doc_id").alias("path")
    )


SQL_RELEASE = f"""{SQL_VISUAL},
ri AS (SELECT 'i' || doc_id || '_v' || (label // 5) || '.0.0' AS doc_id, 'v' || (label // 5) || '.0.0' AS release_tag,
              icon_image_embedding, icon_svg_embedding, token_image_embedding, token_svg_embedding FROM vis),
w AS (SELECT 'i' || doc_id AS icon_name, source, source || '/' || doc_id AS path FROM documents),
open AS (SELECT icon_name, icon_name || '_v1.0.0' AS doc_id FROM w WHERE icon_name || '_v1.0.0' NOT IN (
  SELECT doc_id FROM ri WHERE release_tag = 'v1.0.0' AND icon_image_embedding IS NOT NULL AND icon_svg_embedding IS NOT NULL
     AND token_image_embedding IS NOT NULL AND token_svg_embedding IS NOT NULL))"""


@register("incomplete_icons", f"WITH {SQL_RELEASE} SELECT icon_name, doc_id FROM open")
def incomplete(spark, sf):
    return incomplete_icons(wanted_icons(spark, sf), release_index(spark, sf), "v1.0.0")


@register(
    "check_complete",
    f"""WITH {SQL_RELEASE} SELECT source, count(*) AS icons, count(o.icon_name) AS open_icons, count(o.icon_name) = 0 AS complete
FROM w LEFT JOIN open o USING (icon_name) GROUP BY source""",
)
def complete_by_source(spark, sf):
    asked = wanted_icons(spark, sf)
    todo = incomplete_icons(asked, release_index(spark, sf), "v1.0.0").select("icon_name", F.lit(1).alias("todo"))
    return asked.join(todo, "icon_name", "left").groupBy("source").agg(
        F.count("*").alias("icons"), F.count("todo").alias("open_icons"), (F.count("todo") == 0).alias("complete")
    )


@register("incremental_by_version", f"WITH {SQL_RELEASE} SELECT w.* FROM w JOIN open USING (icon_name)")
def still_to_do(spark, sf):
    return to_process(wanted_icons(spark, sf), release_index(spark, sf), "v1.0.0", bookmark="v1.0.0")


def tags(spark, sf):
    part = F.col("o_orderkey") % 7
    tag = F.concat(F.lit("v"), F.col("o_orderkey") % 120, F.lit("."), F.when(part < 3, 0).otherwise(part), F.lit("."), F.when(part < 5, 0).otherwise(1))
    return table(spark, sf, "orders").select("o_orderstatus", F.when(part == 6, F.lit("v9x.0.0")).otherwise(tag).alias("tag"))


@register(
    "latest_release",
    """WITH t AS (SELECT CASE WHEN o_orderkey % 7 = 6 THEN 'v9x.0.0' ELSE 'v' || (o_orderkey % 120) || '.' ||
    CASE WHEN o_orderkey % 7 < 3 THEN 0 ELSE o_orderkey % 7 END || '.' || CASE WHEN o_orderkey % 7 < 5 THEN 0 ELSE 1 END END AS tag FROM orders)
SELECT tag AS latest_release FROM (SELECT DISTINCT tag, coalesce(try_cast(regexp_extract(tag, '^v(\\d+)\\.(\\d+)\\.(\\d+)', 1) AS BIGINT), 0) AS major
  FROM t WHERE tag LIKE 'v%.0.0') ORDER BY major DESC LIMIT 1""",
)
def latest(spark, sf):
    return latest_release(tags(spark, sf))


@register(
    "parse_name_map",
    """SELECT p_partkey, 'first' || p_size AS icon_name, p_brand || '_last' AS filename, 0 AS ord FROM part
UNION ALL SELECT p_partkey, 'commented', p_type, 1 FROM part""",
)
def parsed_maps(spark, sf):
    source = F.concat(
        F.lit("// names\nexport const typeToPathMap  = {\n  first"), "p_size", F.lit(": '"), "p_brand", F.lit("',\n  // commented: \""),
        "p_type", F.lit("\",\n  'quoted-key': 'never',\n  first"), "p_size", F.lit(": '"), "p_brand",
        F.lit("_last',\n};\nexport const other = { x: 'y' };"),
    )
    return parse_name_map(table(spark, sf, "part").select("p_partkey", source.alias("text")), "text", ["p_partkey"])


@register(
    "point_get",
    "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def fetched(spark, sf):
    return get(table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels"))


@register(
    "point_exists",
    "SELECT d.doc_id, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def known(spark, sf):
    return exists(table(spark, sf, "labels"), table(spark, sf, "documents"))


@register(
    "read_items",
    """SELECT c_custkey, 0 AS pos, c_name AS icon_name, c_mktsegment AS description, NULL::VARCHAR AS error FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT c_custkey, 1, c_name, NULL, NULL FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT c_custkey, NULL, NULL, NULL, 'Missing or empty ''items'' array' FROM customer WHERE c_acctbal < 0""",
)
def items(spark, sf):
    one = F.struct(F.col("c_name").alias("iconName"), F.col("c_mktsegment").alias("description"))
    two = F.struct(F.col("c_name").alias("iconName"), F.lit(None).cast("string").alias("description"))
    body = F.when(F.col("c_acctbal") >= 0, F.to_json(F.struct(F.array(one, two).alias("items")))).otherwise('{"items": []}')
    return read_items(table(spark, sf, "customer").select("c_custkey", body.alias("body")), "body", ["c_custkey"])


@register(
    "validate_requests",
    """SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'unknown type'
  WHEN turn = 0 AND role = 'assistant' THEN 'missing query'
  WHEN turn % 4 = 3 THEN 'unknown icon_type'
  WHEN role = 'assistant' AND turn % 4 = 1 THEN 'SVG content cannot be empty' END AS reason FROM conversations""",
)
def judged_requests(spark, sf):
    turn, role = F.col("turn"), F.col("role")
    asked = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(role == "user", "text").when(role == "assistant", "svg").otherwise("sound").alias("type"),
        F.when((turn == 0) & (role == "assistant"), F.lit(None)).when((role == "assistant") & (turn % 4 == 1), F.lit("  ")).otherwise(F.col("text")).alias("query"),
        F.when(turn % 4 == 3, "logo").alias("icon_type"),
    )
    return validate_requests(asked).select("conv_id", "turn", "reason")


@register("list_indexed", "SELECT source, count(*) AS docs FROM documents GROUP BY source ORDER BY docs DESC, source")
def listed(spark, sf):
    return list_indexed(table(spark, sf, "documents"), "source")


@register(
    "upsert",
    """SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, l.quality, coalesce(d.n_chars, l.toxic) AS toxic, d.lang, d.source
FROM labels l FULL JOIN (SELECT doc_id, lang, source, CASE WHEN lang = 'en' THEN n_chars END AS n_chars FROM documents) d ON l.doc_id = d.doc_id""",
)
def merged(spark, sf):
    old = table(spark, sf, "labels").withColumn("toxic", F.col("toxic").cast("bigint"))
    new = table(spark, sf, "documents").select("doc_id", "lang", "source", F.when(F.col("lang") == "en", F.col("n_chars")).alias("toxic"))
    return upsert(old, new)


@register(
    "upsert_latest",
    """WITH u AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_custkey)
SELECT coalesce(c_custkey, o_custkey) AS doc_id, coalesce(status, c_mktsegment) AS status, c_name AS name, urgent
FROM customer FULL JOIN u ON o_custkey = c_custkey""",
)
def merged_in_order(spark, sf):
    old = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("name")
    )
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))
    new = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), urgent.alias("urgent"), "o_orderdate", "o_orderkey"
    )
    return upsert(old, new, order_by=["o_orderdate", "o_orderkey"])


def described(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", F.array("source").alias("descriptions"))


def said(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("description"), F.col("role").alias("lang")
    )


SQL_LISTS = """n AS (SELECT conv_id, list(text ORDER BY turn, text) AS texts, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id)"""


def appended(spark, sf):
    return upsert_descriptions(*split_descriptions(described(spark, sf)), said(spark, sf), "turn")


@register(
    "upsert_descriptions",
    f"""WITH {SQL_LISTS}, m AS (SELECT coalesce(doc_id, conv_id) AS doc_id, coalesce(role, lang) AS lang,
  list_concat(CASE WHEN doc_id IS NULL THEN [] ELSE [source] END, coalesce(texts, [])) AS descriptions
  FROM documents FULL JOIN n ON conv_id = doc_id)
SELECT doc_id, lang, len(descriptions) AS n, md5(array_to_string(descriptions[:3], '|')) AS digest FROM m""",
)
def appended_documents(spark, sf):
    """Every document once, with the number of its texts and the first three."""
    found = with_descriptions(*appended(spark, sf))
    return found.select("doc_id", "lang", F.col("n_descriptions").alias("n"), F.md5(F.array_join("descriptions", "|")).alias("digest"))


@register(
    "description_texts",
    """SELECT doc_id, 0::BIGINT AS pos, source AS description FROM documents
UNION ALL SELECT conv_id, coalesce(d.n, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1, text
FROM conversations c LEFT JOIN (SELECT doc_id, 1 AS n FROM documents) d ON d.doc_id = c.conv_id""",
)
def appended_texts(spark, sf):
    return appended(spark, sf)[1].select("doc_id", "pos", "description")


@register(
    "append_positions",
    """SELECT conv_id AS doc_id, turn, coalesce(d.n, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
FROM conversations c LEFT JOIN (SELECT doc_id, 1 AS n FROM documents) d ON d.doc_id = c.conv_id""",
)
def description_rows(spark, sf):
    counts = described(spark, sf).select("doc_id", F.size("descriptions").cast("bigint").alias("n"))
    # Arrival order over the whole batch; texts of one conversation follow its turns.
    return append_positions(counts, said(spark, sf), ["turn", "doc_id"]).select("doc_id", "turn", "pos")


@register(
    "latest_fields",
    "SELECT conv_id AS doc_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id",
)
def last_turns(spark, sf):
    return latest_fields(table(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id"), "turn")


def rendered_icons(spark, sf):
    """Icons with payloads and vectors of which some are absent, one column each from the tables."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    vector = F.array(F.col("n_chars").cast("float"))
    return docs.select(
        F.concat(F.lit("i"), "doc_id").alias("icon_name"),
        F.col("source").alias("filename"),
        F.when(F.col("quality").isNotNull(), F.encode("text", "UTF-8")).alias("icon_image"),
        F.when(F.col("quality") == 1, vector).alias("icon_image_embedding"),
        F.when(F.col("lang") != "de", vector).alias("icon_svg_embedding"),
        F.when(F.col("lang") != "fr", F.encode("text", "UTF-8")).alias("token_image"),
        F.when(F.col("n_chars") > 500, vector).alias("token_image_embedding"),
        F.when(F.col("n_chars") > 300, F.col("text")).alias("token_svg_content"),
        F.when(F.col("n_chars") > 400, vector).otherwise(F.array().cast("array<float>")).alias("token_svg_embedding"),
        (F.col("n_chars") % 10 != 0).alias("written"),
    )


SQL_RESULTS = """e AS (
  SELECT 'i' || d.doc_id AS icon_name, source AS filename, list_filter([
    CASE WHEN quality IS NULL OR text = '' THEN 'Failed to render icon image - renderer service is required'
         WHEN quality <> 1 THEN 'Failed to generate icon image embedding' END,
    CASE WHEN lang = 'de' THEN 'Failed to generate icon SVG embedding' END,
    CASE WHEN lang = 'fr' OR text = '' THEN 'Failed to render token image'
         WHEN n_chars <= 500 THEN 'Failed to generate token image embedding' END,
    CASE WHEN n_chars <= 300 THEN 'Failed to render token SVG' WHEN n_chars <= 400 THEN 'Failed to generate token SVG embedding' END,
    CASE WHEN n_chars % 10 = 0 THEN 'Failed to index embeddings' END], lambda x: x IS NOT NULL) AS errors,
    n_chars % 10 <> 0 AS indexed
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


@register(
    "process_icons",
    f"WITH {SQL_RESULTS} SELECT icon_name, filename, len(errors) = 0 AS success, indexed, 'string' AS token_type, array_to_string(errors, ', ') AS errors FROM e",
)
def outcomes(spark, sf):
    found = process_icons(rendered_icons(spark, sf), index_ok="written")
    return found.withColumn("errors", F.array_join("errors", ", "))


@register(
    "run_summary",
    f"""WITH {SQL_RESULTS} SELECT count(*) AS total, count(*) FILTER (len(errors) = 0) AS successful, count(*) FILTER (indexed) AS indexed,
  count(*) FILTER (len(errors) > 0) AS failed, count(*) FILTER (len(errors) > 0) = 0 AS ok FROM e""",
)
def summary(spark, sf):
    return run_summary(process_icons(rendered_icons(spark, sf), index_ok="written"))


@register("failed_icons", f"WITH {SQL_RESULTS} SELECT icon_name, array_to_string(errors, ', ') AS errors FROM e WHERE len(errors) > 0")
def failures(spark, sf):
    return failed_icons(process_icons(rendered_icons(spark, sf), index_ok="written"))


def indexed_items(spark, sf):
    """Batches of items by source; a toxic label is the item's error."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select("source", F.col("doc_id").alias("icon_name"), F.when(F.col("toxic") == 1, F.concat(F.lit("toxic "), "lang")).alias("error"))


@register(
    "batch_status",
    """SELECT source, count(*) AS total, count(*) FILTER (coalesce(toxic, 0) <> 1) AS success, count(*) FILTER (toxic = 1) AS failed
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def status(spark, sf):
    return batch_status(indexed_items(spark, sf), ["source"])


@register(
    "batch_errors",
    "SELECT source, doc_id AS icon_name, 'toxic ' || lang AS error FROM documents JOIN labels USING (doc_id) WHERE toxic = 1",
)
def errors(spark, sf):
    return batch_errors(indexed_items(spark, sf), ["source"])
