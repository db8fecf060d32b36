"""SVG, string and pixel rules over whole tables.

SVG documents are put together from part rows, pixel grids from embeddings, both by the same
expression in Spark and in the checking SQL.
"""

from pyspark.sql import functions as F

from glyphlake.functions import images as I
from glyphlake.functions import svg as S
from glyphlake.functions import text as X
from glyphlake.operators.encoders import embed_svg
from glyphlake.plans.search import resolve_fields_agent
from glyphlake.workloads.base import table
from glyphlake.workloads.registry import register

# Kinds of SVG by p_partkey % 6: viewBox, sizes in px, stroke-width before a size, no size at
# all, a broken viewBox, nothing.
KINDS = 6


def svgs(spark, sf):
    kind, size = F.col("p_partkey") % KINDS, F.col("p_size").cast("string")
    shapes = F.concat(
        F.lit('<path d="M1 2L'), size, F.lit('"/><path fill-rule="evenodd" d="Z"/>\n<path fill="red" stroke="blue" d="M0"/><path><CIRCLE cx="'),
        size, F.lit('" fill=\'green\'/><rect width="2"/><path\nd="x"/>'),
    )
    head = (
        F.when(kind == 0, F.concat(F.lit('<svg class="a" viewBox="0 0 '), size, F.lit(" "), size, F.lit('.5">')))
        .when(kind == 1, F.concat(F.lit('<svg width="'), size, F.lit('px" height="'), size, F.lit('.50em">')))
        .when(kind == 2, F.concat(F.lit('<svg stroke-width="'), size, F.lit('" width="99" height="none">')))
        .when(kind == 3, F.lit("<svg>"))
        .when(kind == 4, F.concat(F.lit('<svg viewBox="0 0 '), size, F.lit(' auto">')))
    )
    inner = F.when(kind == 3, F.lit("<g>plain</g>")).otherwise(shapes)
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.concat(head, inner, F.lit("</svg>")), F.lit("")).alias("svg"))


SQL_SVGS = """base AS (SELECT p_partkey, p_partkey % 6 AS kind, p_size::VARCHAR AS size FROM part),
s AS (SELECT p_partkey, kind, size, CASE WHEN kind = 5 THEN '' ELSE
  CASE kind WHEN 0 THEN '<svg class="a" viewBox="0 0 ' || size || ' ' || size || '.5">'
            WHEN 1 THEN '<svg width="' || size || 'px" height="' || size || '.50em">'
            WHEN 2 THEN '<svg stroke-width="' || size || '" width="99" height="none">'
            WHEN 3 THEN '<svg>' ELSE '<svg viewBox="0 0 ' || size || ' auto">' END
  || CASE WHEN kind = 3 THEN '<g>plain</g>' ELSE
     '<path d="M1 2L' || size || '"/><path fill-rule="evenodd" d="Z"/>' || chr(10) || '<path fill="red" stroke="blue" d="M0"/><path><CIRCLE cx="'
     || size || '" fill=''green''/><rect width="2"/><path' || chr(10) || 'd="x"/>' END || '</svg>' END AS svg FROM base)"""

SQL_ATTRIBUTES = """a AS (SELECT *, nullif(regexp_extract(svg, 'viewBox=["'']([^"'']+)["'']', 1), '') AS vb,
  nullif(regexp_extract(svg, 'width=["'']([^"'']+)["'']', 1), '') AS w, nullif(regexp_extract(svg, 'height=["'']([^"'']+)["'']', 1), '') AS h FROM s)"""


def sql_resized(view_box):
    return f"""regexp_replace(svg, '<svg[^>]*>', '<svg viewBox="' || {view_box} || '" width="224" height="224" xmlns="http://www.w3.org/2000/svg">')"""


SQL_KEEP_BOX = """coalesce(vb, '0 0 ' || coalesce(nullif(regexp_replace(w, '[^\\d.]', '', 'g'), '')::DOUBLE, 24) || ' ' ||
  coalesce(nullif(regexp_replace(h, '[^\\d.]', '', 'g'), '')::DOUBLE, 24) || CASE WHEN w IS NULL OR h IS NULL THEN NULL ELSE '' END, '0 0 24 24')"""
SQL_MONO_BOX = """coalesce(vb, '0 0 ' || regexp_replace(coalesce(try_cast(regexp_extract(w, '^\\d+\\.?\\d*') AS DOUBLE), 24)::VARCHAR, '\\.0$', '') || ' ' ||
  regexp_replace(coalesce(try_cast(regexp_extract(h, '^\\d+\\.?\\d*') AS DOUBLE), 24)::VARCHAR, '\\.0$', '') || CASE WHEN w IS NULL OR h IS NULL THEN NULL ELSE '' END, '0 0 24 24')"""


@register("normalize_svg", f"WITH {SQL_SVGS}, {SQL_ATTRIBUTES} SELECT p_partkey, CASE WHEN svg <> '' THEN {sql_resized(SQL_KEEP_BOX)} END AS svg FROM a")
def normalized(spark, sf):
    return svgs(spark, sf).withColumn("svg", S.normalize_svg("svg"))


@register(
    "normalize_svg_mono",
    f"""WITH {SQL_SVGS}, {SQL_ATTRIBUTES} SELECT p_partkey, CASE WHEN svg <> '' THEN
  regexp_replace(regexp_replace({sql_resized(SQL_MONO_BOX)}, 'fill=["''][^"'']*["'']', '', 'g'), 'stroke=["''][^"'']*["'']', '', 'g') END AS svg FROM a""",
)
def normalized_mono(spark, sf):
    return svgs(spark, sf).withColumn("svg", S.normalize_svg_mono("svg"))


SQL_BACKGROUND = """CASE WHEN kind = 4 THEN NULL WHEN kind <> 0 THEN svg ELSE
  regexp_replace(svg, '(<svg[^>]*>)', '\\1<rect x="0.0" y="0.0" width="' || size || '.0" height="' || size || '.5" fill="white"/>') END"""


@register("add_background", f"WITH {SQL_SVGS} SELECT p_partkey, {SQL_BACKGROUND} AS svg, kind = 4 AS error FROM s")
def backgrounds(spark, sf):
    return svgs(spark, sf).select("p_partkey", S.add_background("svg").alias("svg"), S.background_error("svg").alias("error"))


SQL_FILLED = """replace(replace(replace(svg, '<path d=', '<path fill="black" d='), '<path fill-rule=', '<path fill="black" fill-rule='), '<path>', '<path fill="black">')"""


@register("fill_paths", f"WITH {SQL_SVGS} SELECT p_partkey, {SQL_FILLED} AS svg FROM s")
def filled(spark, sf):
    return svgs(spark, sf).withColumn("svg", S.fill_paths("svg"))


@register(
    "extract_svg",
    f"""WITH {SQL_SVGS} SELECT p_partkey, CASE WHEN svg = '' THEN '<b></b>' || '<i>' ELSE svg END AS svg,
  CASE WHEN svg = '' THEN '<b></b>' || '<i>' ELSE svg || '<i>' || svg END AS greedy FROM s""",
)
def extracted(spark, sf):
    page = F.concat(F.lit("<b>"), "svg", F.when(F.col("svg") == "", "</b><i>").otherwise(F.concat(F.lit("<i>"), "svg", F.lit("</i>"))))
    return svgs(spark, sf).select("p_partkey", S.extract_svg(page).alias("svg"), S.extract_svg(page, greedy=True).alias("greedy"))


@register("extract_svg_from_pages", "SELECT page_id, md5(html) AS digest FROM pages")
def pages_without_svg(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(S.extract_svg("html")).alias("digest"))


@register(
    "extract_layers",
    f"""WITH {SQL_SVGS}, l AS (SELECT p_partkey, list_concat(list_concat(regexp_extract_all(svg, '(?i)<path[^>]*>'),
  regexp_extract_all(svg, '(?i)<circle[^>]*>')), regexp_extract_all(svg, '(?i)<rect[^>]*>')) AS layers FROM s)
SELECT p_partkey, len(layers)::INTEGER AS n, array_to_string(layers, '|') AS layers FROM l""",
)
def layered(spark, sf):
    return svgs(spark, sf).withColumn("layers", S.extract_layers("svg")).select(
        "p_partkey", F.size("layers").alias("n"), F.array_join("layers", "|").alias("layers")
    )


SQL_WORDS = """w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(array_to_string(list_concat(list_concat(
    regexp_extract_all(f, '(?i)<path[^>]*>'), regexp_extract_all(f, '(?i)<circle[^>]*>')), regexp_extract_all(f, '(?i)<rect[^>]*>')), ' ')),
    '[\\p{L}\\p{N}]+')) AS token FROM filled),
x AS (SELECT p_partkey, ('0x' || substr(md5(token), 1, 8))::BIGINT % 512 AS dim,
         sum(1 - 2 * (('0x' || substr(md5(token), 9, 1))::BIGINT % 2))::DOUBLE AS x FROM w GROUP BY ALL),
n AS (SELECT p_partkey, sqrt(sum(x * x)) AS n FROM x GROUP BY ALL),
m AS (SELECT p_partkey, sum((x / n)::FLOAT::DOUBLE * (dim + 1)) AS moment FROM x JOIN n USING (p_partkey) GROUP BY ALL)"""


@register(
    "embed_svg",
    f"""WITH {SQL_SVGS}, filled AS (SELECT p_partkey, {SQL_FILLED.replace('(svg,', '(' + SQL_BACKGROUND + ',')} AS f FROM s WHERE kind NOT IN (3, 4, 5)), {SQL_WORDS}
SELECT s.p_partkey, CASE kind WHEN 5 THEN 'SVG content cannot be empty' WHEN 4 THEN 'Error processing SVG: viewBox holds no number'
   WHEN 3 THEN 'Embedding generation produced empty result' END AS error, round(moment, 4) AS moment FROM s LEFT JOIN m USING (p_partkey)""",
)
def embedded_svg(spark, sf):
    moment = F.aggregate(
        F.transform(F.col("v").cast("array<double>"), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x
    )
    return embed_svg(svgs(spark, sf), "svg", "v").select("p_partkey", F.col("v_error").alias("error"), F.round(moment, 4).alias("moment"))


# ---- strings ---------------------------------------------------------------------------------


@register(
    "doc_ids",
    "SELECT o_orderkey, c_name || '_v' || (o_orderkey % 9) || '.0.0' AS doc_id FROM orders JOIN customer ON c_custkey = o_custkey",
)
def made_ids(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    tag = F.concat(F.lit("v"), F.col("o_orderkey") % 9, F.lit(".0.0"))
    return table(spark, sf, "orders").join(names, "o_custkey").select("o_orderkey", X.doc_id("c_name", tag).alias("doc_id"))


@register(
    "image_payloads",
    """WITH p AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'data:image/png;base64,' || base64(encode(text))
  WHEN lang = 'de' THEN base64(encode(text)) ELSE text END AS payload FROM documents)
SELECT doc_id, md5(CASE WHEN payload LIKE 'data:image%' THEN substr(payload, instr(payload, ',') + 1) ELSE payload END) AS stripped,
  length(payload) > 100 AND regexp_matches(payload, '^[\\p{L}\\p{N}+/=]{100}') AS base64,
  CASE WHEN payload LIKE 'data:image%' THEN 'data_uri' WHEN length(payload) > 100 AND regexp_matches(payload, '^[\\p{L}\\p{N}+/=]{100}') THEN 'base64' ELSE 'path' END AS kind
FROM p""",
)
def payload_kinds(spark, sf):
    encoded = F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit(""))
    payload = F.when(F.col("lang") == "en", F.concat(F.lit("data:image/png;base64,"), encoded)).when(F.col("lang") == "de", encoded).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", payload.alias("p")).select(
        "doc_id", F.md5(X.strip_data_uri("p")).alias("stripped"), X.looks_base64("p").alias("base64"), X.image_payload_kind("p").alias("kind")
    )


@register(
    "resolve_fields_agent",
    """SELECT doc_id, CASE WHEN source = 'src1' THEN 'own' WHEN lang = 'en' THEN 'token_svg_embedding' ELSE 'icon_svg_embedding' END AS svg_fields,
  CASE WHEN source = 'src1' THEN 'own' WHEN lang = 'en' THEN 'token_image_embedding' ELSE 'icon_image_embedding' END AS image_fields FROM documents""",
)
def agent_fields(spark, sf):
    asked = F.when(F.col("source") == "src1", F.array(F.lit("own"))).when(F.col("source") == "src2", F.array().cast("array<string>"))
    kind = F.when(F.col("lang") == "en", "token").when(F.col("lang") == "de", "icon")
    return table(spark, sf, "documents").select("doc_id", asked.alias("fields"), kind.alias("icon_type")).select(
        "doc_id",
        F.array_join(resolve_fields_agent("svg"), ",").alias("svg_fields"),
        F.array_join(resolve_fields_agent("image"), ",").alias("image_fields"),
    )


@register(
    "format_hit",
    """SELECT doc_id, doc_id || '. ' || source || ' (score: ' || printf('%.4f', n_chars / 8.0) || ')'
  || CASE WHEN lang <> 'en' THEN chr(10) || '   Type: ' || lang ELSE '' END
  || CASE WHEN source <> 'src1' THEN chr(10) || '   Release: ' || source ELSE '' END
  || CASE WHEN length(text) = 0 THEN '' ELSE chr(10) || '   Descriptions: ' || array_to_string(string_split(text, '.')[1:3], ', ')
     || CASE WHEN len(string_split(text, '.')) > 3 THEN ' (+' || (len(string_split(text, '.')) - 3) || ' more)' ELSE '' END END AS block
FROM documents""",
)
def hit_blocks(spark, sf):
    texts = F.when(F.length("text") > 0, F.split("text", r"\.", -1))
    docs = table(spark, sf, "documents").withColumn("texts", texts)
    kind = F.when(F.col("lang") != "en", F.col("lang"))
    release = F.when(F.col("source") != "src1", F.col("source")).otherwise("")
    return docs.select("doc_id", X.format_hit("doc_id", "source", F.col("n_chars") / 8.0, kind, release, "texts").alias("block"))


SQL_TRACE = """t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '01' ELSE '00' END || '-' || md5(event_id::VARCHAR) || '-' ||
  substr(md5(user_id::VARCHAR), 1, CASE WHEN event_type = 'view' THEN 15 ELSE 16 END) || CASE WHEN event_type = 'click' THEN '' ELSE '-01' END AS header FROM events)"""


@register(
    "parse_traceparent",
    f"""WITH {SQL_TRACE}, p AS (SELECT event_id, string_split(header, '-') AS p FROM t),
ok AS (SELECT event_id, p, len(p) = 4 AND p[1] = '00' AND length(p[2]) = 32 AND length(p[3]) = 16 AS good FROM p)
SELECT event_id, CASE WHEN good THEN p[2] END AS trace_id, CASE WHEN good THEN p[3] END AS parent_id, CASE WHEN good THEN p[4] END AS flags FROM ok""",
)
def traces(spark, sf):
    kind = F.col("event_type")
    parent = F.substring(F.md5(F.col("user_id").cast("string")), F.lit(1), F.when(kind == "view", 15).otherwise(16))
    header = F.concat(
        F.when(kind == "error", "01").otherwise("00"), F.lit("-"), F.md5(F.col("event_id").cast("string")), F.lit("-"),
        parent, F.when(kind == "click", "").otherwise("-01"),
    )
    parsed = table(spark, sf, "events").select("event_id", X.parse_traceparent(header).alias("t"))
    return parsed.select("event_id", "t.trace_id", "t.parent_id", "t.flags")


@register(
    "client_key",
    """SELECT event_id, CASE WHEN c_custkey IS NOT NULL THEN 'api_key:k' || user_id
  WHEN event_type = 'click' THEN '10.0.0.' || user_id WHEN event_type = 'view' THEN '10.1.0.' || user_id
  WHEN event_type = 'error' THEN '10.2.0.' || user_id ELSE 'unknown' END AS key
FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ON c_custkey = user_id""",
)
def keys(spark, sf):
    valid = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("k"), "c_custkey").alias("api_key"), F.lit(1).alias("ok"))
    kind, user = F.col("event_type"), F.col("user_id")
    asked = table(spark, sf, "events").withColumn("api_key", F.concat(F.lit("k"), "user_id"))
    forwarded = F.when(kind == "click", F.concat(F.lit(" 10.0.0."), user, F.lit(" , 10.9.9.9")))
    real = F.when(kind == "view", F.concat(F.lit("10.1.0."), user))
    socket = F.when(kind == "error", F.concat(F.lit("10.2.0."), user))
    known = F.when(F.col("ok").isNotNull(), F.col("api_key"))
    return asked.join(valid, "api_key", "left").select("event_id", X.client_key(known, forwarded, real, socket).alias("key"))


@register(
    "display_columns",
    """SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'token' ELSE 'icon' END AS icon_type, printf('%.3f', label / 8.0) AS score FROM embeddings""",
)
def display(spark, sf):
    kind = F.when(F.col("label") % 3 == 0, "token").when(F.col("label") % 3 == 1, "")
    return table(spark, sf, "embeddings").select(
        "vec_id", X.display_type(kind).alias("icon_type"), X.display_score(F.col("label") / 8.0).alias("score")
    )


@register(
    "parse_attributes",
    "SELECT c_custkey, c_mktsegment AS segment, 'b=' || c_nationkey AS a, 3 AS n FROM customer",
)
def attributes(spark, sf):
    text = F.concat(F.lit("segment = first, segment="), "c_mktsegment", F.lit(" ,bad, a=b="), "c_nationkey", F.lit(",=x"))
    parsed = table(spark, sf, "customer").select("c_custkey", X.parse_attributes(text).alias("m"))
    return parsed.select("c_custkey", F.col("m")["segment"].alias("segment"), F.col("m")["a"].alias("a"), F.size("m").alias("n"))


# ---- pixels ----------------------------------------------------------------------------------


def grids(spark, sf):
    """8 by 8 grids of 0..255 from each embedding, darker for odd labels."""
    shift = F.when(F.col("label") % 2 == 0, 60).otherwise(-60)
    values = F.transform(
        "embedding",
        lambda x: F.greatest(F.least(F.floor(x.cast("double") * 400).cast("int") + 128 + shift, F.lit(255)), F.lit(0)),
    )
    flat = F.when(F.col("label") == 9, F.transform("embedding", lambda x: F.lit(77))).otherwise(values)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("pixels", i * 8 + 1, F.lit(8)))
    return table(spark, sf, "embeddings").select("vec_id", flat.alias("pixels")).select("vec_id", "pixels", rows.alias("grid"))


SQL_GRIDS = """g AS (SELECT vec_id, CASE WHEN label = 9 THEN list_transform(embedding, lambda x: 77) ELSE list_transform(embedding,
    lambda x: greatest(least(floor(x::DOUBLE * 400)::INTEGER + 128 + CASE WHEN label % 2 = 0 THEN 60 ELSE -60 END, 255), 0)) END AS p FROM embeddings),
e AS (SELECT vec_id, p, (list_sum(list_concat(list_concat(list_concat(p[1:5], p[4:8]), list_concat(p[57:61], p[60:64])),
   [p[1], p[9], p[17], p[25], p[33], p[25], p[33], p[41], p[49], p[57], p[8], p[16], p[24], p[32], p[40], p[32], p[40], p[48], p[56], p[64]])) / 40.0)::DOUBLE AS bright FROM g)"""


@register("is_dark_background", f"WITH {SQL_GRIDS} SELECT vec_id, round(bright, 6) AS brightness, bright < 128 AS dark FROM e")
def dark(spark, sf):
    return grids(spark, sf).select("vec_id", F.round(I.edge_brightness("grid"), 6).alias("brightness"), I.is_dark_background("grid").alias("dark"))


@register(
    "stretch_pixels",
    f"""WITH {SQL_GRIDS}, u AS (SELECT vec_id, list_transform(p, lambda x: (CASE WHEN bright < 128 THEN 255 - x ELSE x END)::FLOAT) AS p FROM e),
m AS (SELECT vec_id, p, list_min(p) AS lo, list_max(p) AS hi FROM u)
SELECT vec_id, array_to_string(list_transform(p, lambda x: CASE WHEN hi > lo THEN trunc((x - lo) / (hi - lo) * 255::FLOAT)::INTEGER ELSE 255 END), ',') AS pixels FROM m""",
)
def stretched(spark, sf):
    return grids(spark, sf).select("vec_id", F.array_join(F.flatten(I.stretch_pixels("grid")), ",").alias("pixels"))


@register(
    "image_stats",
    f"WITH {SQL_GRIDS} SELECT vec_id, 8 AS width, 8 AS height, len(list_distinct(p))::INTEGER AS colours, len(list_distinct(p)) = 1 AS single_colour FROM g",
)
def grid_statistics(spark, sf):
    return grids(spark, sf).select("vec_id", *I.grid_stats("grid"))


@register(
    "luminance",
    f"WITH {SQL_GRIDS} SELECT vec_id, round(list_sum(list_transform(range(1, 63), lambda i: p[i] * 0.299::DOUBLE + p[i + 1] * 0.587::DOUBLE + p[i + 2] * 0.114::DOUBLE)), 5) AS total FROM g",
)
def lumas(spark, sf):
    lumas = F.transform(
        F.sequence(F.lit(1), F.lit(62)),
        lambda i: I.luminance(F.element_at("pixels", i), F.element_at("pixels", i + 1), F.element_at("pixels", i + 2)),
    )
    return grids(spark, sf).select("vec_id", F.round(F.aggregate(lumas, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))
