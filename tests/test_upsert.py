import pytest
from pyspark.sql import functions as F

from glyphlake.operators import runs
from glyphlake.operators.upsert import (
    append_positions, latest_fields, split_descriptions, upsert, upsert_descriptions, with_descriptions,
)


def test_partial_merge(spark):
    index = spark.createDataFrame([("a", "x", [1.0], 1), ("b", "y", None, 2)], "doc_id string, name string, v array<float>, n int")
    updates = spark.createDataFrame([("a", None, [], "new"), ("b", "z", [2.0], None), ("c", "w", None, "new")], "doc_id string, name string, v array<float>, extra string")
    found = {r.doc_id: (r.name, r.v, r.n, r.extra) for r in upsert(index, updates).collect()}
    assert found == {"a": ("x", [1.0], 1, "new"), "b": ("z", [2.0], 2, None), "c": ("w", None, None, "new")}


def test_last_given_value_wins_per_field(spark):
    rows = [("a", 1, "first", [1.0]), ("a", 2, "second", []), ("a", 3, None, None)]
    updates = spark.createDataFrame(rows, "doc_id string, seq int, name string, v array<float>")
    assert [tuple(r) for r in latest_fields(updates, "seq").collect()] == [("a", "second", [1.0])]
    index = spark.createDataFrame([("a", "old")], "doc_id string, name string")
    assert [tuple(r) for r in upsert(index, updates, order_by="seq").collect()] == [("a", "second", [1.0])]


def test_descriptions_grow_in_order(spark):
    index = spark.createDataFrame([("a", ["one"], "keep"), ("b", None, "b")], "doc_id string, descriptions array<string>, tag string")
    rows = [("a", 2, "three", [3.0]), ("a", 1, "two", [2.0]), ("a", 3, "one", None), ("c", 1, "new", [9.0]), ("b", 1, None, None)]
    updates = spark.createDataFrame(rows, "doc_id string, seq int, description string, v array<float>")
    documents, texts = upsert_descriptions(*split_descriptions(index), updates, "seq")
    lists = lambda df: {d: [t for _, t in sorted(x)] for d, x in grouped(df).items()}
    assert lists(texts) == {"a": ["one", "two", "three", "one"], "b": [None], "c": ["new"]}
    assert {r.doc_id: (r.tag, r.v) for r in documents.collect()} == {"a": ("keep", [3.0]), "b": ("b", None), "c": (None, [9.0])}
    more = spark.createDataFrame([("a", n, f"t{n}", [5.0]) for n in range(8)], updates.schema)
    documents, texts = upsert_descriptions(documents, texts, more, "seq")
    assert lists(texts)["a"] == ["one", "two", "three", "one", *(f"t{n}" for n in range(8))]
    assert documents.count() == 3
    shown = {r.doc_id: (r.n_descriptions, r.descriptions) for r in with_descriptions(documents, texts).collect()}
    assert shown == {"a": (12, ["one", "two", "three"]), "b": (1, [None]), "c": (1, ["new"])}


def grouped(texts):
    found = {}
    for r in texts.collect():
        found.setdefault(r.doc_id, []).append((r.pos, r.description))
    return found


@pytest.mark.parametrize("pieces", [1, 7])
def test_positions_of_a_hot_document(spark, pieces):
    updates = spark.range(400).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 5)).alias("doc_id"), "id")
    counts = spark.createDataFrame([("hot", 10), ("d1", 3)], "doc_id string, n bigint")
    found = append_positions(counts, updates.repartition(5), "id", pieces=pieces).collect()
    assert len(found) == 400
    start = {"hot": 10, "d1": 3}
    lists = {}
    for r in sorted(found, key=lambda r: r.id):
        lists.setdefault(r.doc_id, []).append(r.pos)
    assert lists == {d: list(range(start.get(d, 0), start.get(d, 0) + len(p))) for d, p in lists.items()}


ICON = "icon_name string, filename string, icon_image binary, token_image binary, token_svg_content string, icon_image_embedding array<float>, token_image_embedding array<float>, icon_svg_embedding array<float>, token_svg_embedding array<float>, ok boolean"


def test_outcomes_of_icons(spark):
    b, v = bytearray(b"x"), [1.0]
    rows = [
        ("all", "f", b, b, "s", v, v, v, v, True),
        ("none", "f", None, None, None, None, None, None, None, False),
        ("unencoded", "f", b, b, "s", [], None, v, [], True),
    ]
    icons = spark.createDataFrame(rows, ICON)
    found = {r.icon_name: r for r in runs.process_icons(icons, index_ok="ok").collect()}
    assert found["all"].success and found["all"].errors == [] and found["all"].token_type == "string"
    assert found["none"].errors == [
        runs.RENDER_ICON_IMAGE, runs.EMBED_ICON_SVG, runs.RENDER_TOKEN_IMAGE, runs.RENDER_TOKEN_SVG, runs.INDEX_FAILED
    ]
    assert found["unencoded"].errors == [runs.EMBED_ICON_IMAGE, runs.EMBED_TOKEN_IMAGE, runs.EMBED_TOKEN_SVG]
    assert found["unencoded"].indexed and not found["none"].indexed
    dry = {r.icon_name: r for r in runs.process_icons(icons, skip_tokens=True).collect()}
    assert dry["none"].errors == [runs.RENDER_ICON_IMAGE, runs.EMBED_ICON_SVG] and not dry["none"].indexed
    assert dry["unencoded"].indexed and dry["unencoded"].token_type is None
    results = runs.process_icons(icons, index_ok="ok")
    assert tuple(runs.run_summary(results).first()) == (3, 1, 2, 2, False)
    assert {r.icon_name for r in runs.failed_icons(results).collect()} == {"none", "unencoded"}


def test_batches_and_lists(spark):
    items = spark.createDataFrame([("a", None), ("b", "bad"), ("c", None)], "icon_name string, error string")
    assert tuple(runs.batch_status(items).first()) == (3, 2, 1)
    assert [tuple(r) for r in runs.batch_errors(items).collect()] == [("b", "bad")]
    index = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "doc_id string")
    assert [tuple(r) for r in runs.list_indexed(index).collect()] == [("y", 2), ("x", 1)]
    assert [tuple(r) for r in runs.list_indexed(index, cap=1).collect()] == [("y", 2)]
