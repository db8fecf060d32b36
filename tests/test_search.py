import base64

import numpy as np
import pytest
from conftest import png_bytes, read_png
from pyspark.sql import functions as F

from glyphlake.operators.encoders import embed_image, embed_sparse, embed_svg, embed_text
from glyphlake.functions.images import decode_base64_images
from glyphlake.functions.vectors import rounded
from glyphlake.operators.ranking import rank_page
from glyphlake.plans.indexing import index_release
from glyphlake.plans.search import (
    choose_branch, encode_queries, resolve_fields, resolve_fields_agent, search, search_report,
)
from glyphlake.schema import DOC_SCHEMA, REQUEST_SCHEMA, VISUAL_FIELDS

SQUARE = np.full((32, 32), 255, np.uint8)
SQUARE[8:24, 8:24] = 0
BAR = np.full((32, 32), 255, np.uint8)
BAR[:, 4:8] = 0
SVG_A = '<svg viewBox="0 0 24 24"><path d="M12 2L2 7v10"/></svg>'
SVG_B = '<svg viewBox="0 0 24 24"><circle cx="9"/></svg>'


def text_of(pixels):
    return base64.b64encode(png_bytes(pixels)).decode()


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("user_v1", "user", "v1.0.0", "icon", ["person", "user profile"], SVG_A, SVG_B, text_of(SQUARE), None),
        ("arrow_v1", "arrow", "v1.0.0", "token", ["arrow left"], SVG_B, None, text_of(BAR), text_of(SQUARE)),
        ("plain", None, None, None, ["user"], None, SVG_A, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id string, icon_name string, release_tag string, icon_type string, descriptions array<string>, s string, ts string, p string, tp string")
    df = df.withColumn("text", F.array_join("descriptions", " "))
    df = embed_sparse(embed_text(df, "text"), "text")
    df = embed_svg(embed_svg(df, "s", "icon_svg_embedding"), "ts", "token_svg_embedding")
    for source, out in (("p", "icon_image_embedding"), ("tp", "token_image_embedding")):
        df = embed_image(decode_base64_images(df, source, read_png, f"{source}_i"), f"{source}_i", out)
    names = [c for c in DOC_SCHEMA.fieldNames() if c in df.columns]
    return df.select(*names).cache()


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), REQUEST_SCHEMA)


def test_every_kind_of_request(spark, index):
    queries = ask(
        spark,
        ("text", "text", "user profile", None, None),
        ("typed", "text", "user", "icon", None),
        ("image", "image", "data:image/png;base64," + text_of(255 - SQUARE), "icon", None),
        ("svg", "svg", SVG_A, None, ["icon_svg_embedding"]),
        ("blank", "svg", "  ", None, None),
        ("broken", "image", "@@", None, None),
        ("odd", "sound", "x", None, None),
    )
    encoded = encode_queries(queries, decoder=read_png)
    errors = {r.query_id: r.error for r in encoded.collect()}
    assert errors["text"] is errors["image"] is errors["svg"] is None
    assert errors["blank"] and errors["broken"] and errors["odd"]
    found = {}
    for r in search(index, encoded).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {"text", "typed", "image", "svg"}
    assert found["text"][0].doc_id == "user_v1" and found["text"][0].total == 3
    assert [r.doc_id for r in found["typed"]] == ["user_v1"] and found["typed"][0].total == 1
    assert found["image"][0].doc_id == "user_v1" and found["image"][0].score > 0.99
    assert found["svg"][0].doc_id == "user_v1" and found["svg"][0].score == pytest.approx(1.0)
    names = {r.doc_id: r.icon_name for r in found["text"]}
    assert names == {"user_v1": "user", "arrow_v1": "arrow", "plain": "plain"}
    report = {r.query_id: r.report for r in search_report(search(index, encoded), queries, 1).collect()}
    lines = report["typed"].split("\n")
    assert lines[0] == "Found 1 total matches, showing top 1:" and lines[2].startswith("1. user (score: ")
    assert lines[3:] == ["   Type: icon", "   Release: v1.0.0", "   Descriptions: person, user profile", ""]
    assert report["odd"] == "No results found (total: 0)"


def test_text_without_sparse_tokens_is_dense_only(spark, index):
    encoded = encode_queries(ask(spark, ("q", "text", "user", None, ["icon_svg_embedding"])))
    none = spark.createDataFrame([], "query_id string, token string, weight double")
    found = search(index, encoded, none).orderBy("rank").collect()
    assert [r.doc_id for r in found][0] == "plain" and all(r.score <= 1.0 for r in found) and found[0].total == 3


@pytest.mark.parametrize(
    "fields, icon_type, expected",
    [
        (None, None, VISUAL_FIELDS),
        ([], "icon", VISUAL_FIELDS[:2]),
        (None, "token", VISUAL_FIELDS[2:]),
        (["token_svg_embedding", "x", "icon_svg_embedding", "token_svg_embedding"], "icon", ["token_svg_embedding", "icon_svg_embedding", "token_svg_embedding"]),
        (["x"], "icon", VISUAL_FIELDS),
    ],
)
def test_fields(spark, fields, icon_type, expected):
    df = ask(spark, ("q", "svg", "x", icon_type, fields))
    assert df.select(resolve_fields()).first()[0] == expected
    agent = fields if fields else [f"{icon_type or 'icon'}_svg_embedding"]
    assert df.select(resolve_fields_agent("svg")).first()[0] == agent


def test_branch(spark):
    df = spark.createDataFrame([("text", 2), ("text", 0), ("text", None), ("image", 0), ("svg", 3)], "type string, sparse_size int")
    assert [r[0] for r in df.select(choose_branch()).collect()] == ["hybrid", "dense", "dense", "visual", "visual"]


def test_indexing_run(spark, tmp_path):
    files = spark.createDataFrame([("/a/user.svg", "user", SVG_A), ("/a/cut.svg", "cut", " "), ("/a/odd.svg", "odd", SVG_B)], "path string, filename string, svg_content string")
    names = spark.createDataFrame([("user", "user", 0), ("cut", "cut", 1), ("gone", "gone", 2)], "icon_name string, filename string, ord int")
    pixels = bytearray(SQUARE.tobytes())
    picture = ("", 32, 32, 1, 0, pixels)
    from glyphlake.functions.images import IMAGE_STRUCT

    rendered = spark.createDataFrame([("user", picture, picture, f"<span>{SVG_B}</span>")], f"icon_name string, icon_image {IMAGE_STRUCT}, token_image {IMAGE_STRUCT}, token_svg_content string")
    empty = spark.createDataFrame([], DOC_SCHEMA)
    dry = index_release(files, names, empty, "v1.0.0", rendered)
    assert {r.icon_name: r.indexed for r in dry.results.collect()} == {"user": True, "cut": False}
    run = index_release(files, names, empty, "v1.0.0", rendered, write_to=str(tmp_path))
    results = {r.icon_name: r for r in run.results.collect()}
    assert results["user"].success and results["user"].errors == []
    assert not results["cut"].success and len(results["cut"].errors) == 4
    assert tuple(run.summary.first()) == (2, 1, 2, 1, False)
    assert [r.path for r in run.unmatched.collect()] == ["/a/odd.svg"] and [r.icon_name for r in run.missing.collect()] == ["gone"]
    docs = {r.doc_id: r for r in run.index.collect()}
    assert set(docs) == {"user_v1.0.0", "cut_v1.0.0"} and docs["user_v1.0.0"].token_type == "string"
    assert all(len(docs["user_v1.0.0"][f]) == 512 for f in VISUAL_FIELDS)
    # What is complete is left alone on the next run of the same release.
    index = run.index.cache()
    again = index_release(files, names, index, "v1.0.0", rendered, bookmark="v1.0.0")
    assert not again.up_to_date and {r.icon_name for r in again.results.collect()} == {"cut"}
    first = files.where("filename = 'user'")
    assert index_release(first, names, index, "v1.0.0", rendered, bookmark="v1.0.0").up_to_date
    # A limit counts the files that need work, not those that are complete.
    both = files.where("filename <> 'odd'").withColumn("path", F.when(F.col("filename") == "user", "/a/a.svg").otherwise("/a/b.svg"))
    limited = index_release(both, names, index, "v1.0.0", rendered, bookmark="v1.0.0", limit=1)
    assert not limited.up_to_date and [r.icon_name for r in limited.results.collect()] == ["cut"]


def test_scores_next_to_a_tie_are_rounded_as_sql_does(spark):
    """(1 + cos) / 2 of these cosines is written as ...4999999: half up in DOUBLE arithmetic gives the next digit."""
    cosines = [0.353891713, 0.612421569, 0.468807541]
    rows = [(1, i, (1 + c) / 2) for i, c in enumerate(cosines)]
    page = rank_page(spark.createDataFrame(rows, "query_id long, doc_id long, score double"))
    assert {r.doc_id: r.score for r in page.collect()} == {0: 0.676945857, 1: 0.806210785, 2: 0.734403771}
    odd = spark.createDataFrame([(0, -0.5), (1, 0.25), (2, float("nan")), (3, float("inf")), (4, 1e300), (5, None)], "i int, x double")
    found = {r.i: r.y for r in odd.select("i", rounded("x", 1).alias("y"), "x").collect()}
    assert found[0] == -0.5 and found[1] == 0.3 and found[2] != found[2] and found[3] == float("inf") and found[4] == 1e300 and found[5] is None
