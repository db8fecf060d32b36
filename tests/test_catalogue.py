import os

import numpy as np
import pytest
from conftest import png_bytes
from pyspark.sql import functions as F

from glyphlake.operators.catalog import (
    check_complete, latest_release, limit_after_match, match_files, missing_files, reverse_map, to_process,
    unmatched_files,
)
from glyphlake.operators.joins import fits, lookup_join
from glyphlake.operators.quality import check_dims, coverage, validate_schema
from glyphlake.operators.runs import span_metrics
from glyphlake.schema import DOC_SCHEMA, EXPECTED_DIMS
from glyphlake.sources import corpus, index_store
from glyphlake.sources.requests import read_icon_names, read_request_file, validate_requests

MAP = """// names
import x from 'y';
export const typeToPathMap = {
  user: 'user',
  folderClosed: "folder_closed",
  // kept: 'commented',
  'quoted': 'never',
  alias: 'user',
  user: 'user_last',
};
export const other = { a: 'b' };
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")
    files = {
        "a/user.svg": "<svg>ü</svg>", "a/folder_closed.svg": "<svg/>", "a/other.svg": "<svg/>", "a/UPPER.SVG": "<svg/>",
        "node_modules/user.svg": "<svg/>", "a/dist/user.svg": "<svg/>", "rebuild/user.two.svg": "<svg/>", "a/readme.txt": "x",
    }
    for name, text in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return base


def test_scan_skips_directories_and_reads_utf8(spark, root):
    found = {os.path.basename(r.path): r for r in corpus.scan_svg_corpus(spark, str(root)).collect()}
    assert set(found) == {"user.svg", "folder_closed.svg", "other.svg", "user.two.svg"}
    assert {r.filename for r in found.values()} == {"user", "folder_closed", "other", "user.two"}
    texts = {r.filename: r.svg_content for r in corpus.read_svg_text(corpus.scan_svg_corpus(spark, str(root))).collect()}
    assert texts["user"] == "<svg>ü</svg>"


def test_name_map(spark, root):
    path = root / "map.txt"
    path.write_text(MAP)
    found = {r.icon_name: r.filename for r in corpus.load_name_map(spark, str(path)).collect()}
    assert found == {"user": "user_last", "folderClosed": "folder_closed", "kept": "commented", "alias": "user"}
    path = root / "none.txt"
    path.write_text("const nothing = 1;")
    assert corpus.load_name_map(spark, str(path)).collect() == []


def test_reconcile(spark):
    names = spark.createDataFrame([("first", "user", 0), ("last", "user", 1), ("gone", "absent", 2), ("gone2", "absent", 3)], "icon_name string, filename string, ord int")
    files = spark.createDataFrame([("/b/user.svg", "user"), ("/a/user.svg", "user"), ("/a/odd.svg", "odd")], "path string, filename string")
    reversed_map = reverse_map(names)
    matched = match_files(files, reversed_map)
    assert {(r.path, r.icon_name) for r in matched.collect()} == {("/a/user.svg", "last"), ("/b/user.svg", "last")}
    assert [r.path for r in unmatched_files(files, reversed_map).collect()] == ["/a/odd.svg"]
    assert {r.icon_name for r in missing_files(names, files).collect()} == {"gone", "gone2"}
    assert [r.path for r in limit_after_match(matched, 1).collect()] == ["/a/user.svg"]
    assert limit_after_match(matched, None).count() == limit_after_match(matched, 0).count() == 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    key = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 120)
    left = spark.range(300).select(key.alias("k"), "id")
    right = spark.range(0, 100, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = lookup_join(left, right, "k", how, spread="id")
    for hot_rows in (1, 50, 1000):
        large = lookup_join(left, right, "k", how, spread="id", max_rows=3, salts=4, hot_rows=hot_rows)
        assert large.columns == small.columns
        assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
    assert fits(right, 50) and not fits(right, 49) and not fits(right, 50, 500)
    wide = right.select("k", F.array_repeat(F.lit(1.0), 1000).alias("v"), F.create_map("k", "v").alias("m"))
    assert fits(wide, 50, 450_000 * 2) and not fits(wide, 50, 400_000)
    with pytest.raises(ValueError):
        lookup_join(left, right, "k", "full_outer")


def tagged(spark, rows):
    return spark.createDataFrame(rows, "tag string")


def test_latest_release(spark):
    tags = [("v9.0.0",), ("v109.0.0",), ("v110.1.0",), ("v20.0.0 ",), ("vx.0.0",), ("w200.0.0",)]
    assert latest_release(tagged(spark, tags)).first()[0] == "v109.0.0"
    assert latest_release(tagged(spark, [("vx.0.0",)])).first()[0] == "vx.0.0"
    assert latest_release(tagged(spark, [("v1.2.3",)])).first()[0] is None


def document(doc_id, tag, **vectors):
    row = {name: None for name in DOC_SCHEMA.fieldNames()}
    row.update(doc_id=doc_id, release_tag=tag, **vectors)
    return tuple(row[name] for name in DOC_SCHEMA.fieldNames())


def test_completeness_and_incremental_choice(spark):
    icon = {"icon_image_embedding": [1.0], "icon_svg_embedding": [1.0]}
    token = {"token_image_embedding": [1.0], "token_svg_embedding": [1.0]}
    index = spark.createDataFrame(
        [document("a_v1", "v1", **icon, **token), document("b_v1", "v1", **icon), document("c_v1", "v0", **icon, **token)], DOC_SCHEMA
    )
    matched = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "icon_name string")
    only = lambda *names: matched.where(F.col("icon_name").isin(*names))
    assert check_complete(only("a"), index, "v1")
    assert not check_complete(only("a", "b"), index, "v1")
    assert check_complete(only("a", "b"), index, "v1", skip_tokens=True)
    assert not check_complete(only("c"), index, "v1") and not check_complete(only("d"), index, "v1")
    assert check_complete(only("none"), index, "v1")
    names = lambda df: {r.icon_name for r in df.collect()}
    assert names(to_process(matched, index, "v1", bookmark="v1")) == {"b", "c", "d"}
    assert names(to_process(matched, index, "v1", bookmark=None)) == {"a", "b", "c", "d"}
    assert names(to_process(matched, index, "v1", bookmark="v1", force=True)) == {"a", "b", "c", "d"}
    report = {r.release_tag: r for r in coverage(index, ["icon_image_embedding", "token_svg_embedding"]).collect()}
    assert (report["v1"].docs, report["v1"].with_icon_image_embedding, report["v1"].with_token_svg_embedding) == (2, 2, 1)
    assert check_dims(index, EXPECTED_DIMS).count() == 10


def test_schema_report(spark):
    df = spark.createDataFrame([document("a", "v1", icon_image_embedding=[0.0] * 512)], DOC_SCHEMA)
    expected = {f.name: f.dataType for f in DOC_SCHEMA.fields}
    good = validate_schema(df, expected, EXPECTED_DIMS)
    assert {r.status for r in good.collect()} == {"PASS"}
    worse = df.drop("text_embedding", "text_embedding_sparse").withColumn("icon_name", F.lit(1))
    report = {(r.field, r.check): r.status for r in validate_schema(worse, expected, {"icon_image_embedding": 384}, searchable=set()).collect()}
    assert report["text_embedding", "exists"] == "FAIL" and report["icon_name", "type"] == "FAIL"
    assert report["icon_image_embedding", "dimensions"] == "FAIL" and report["icon_image_embedding", "searchable"] == "WARN"
    assert report["text_embedding_sparse", "sparse"] == "WARN"


def test_index_files(spark, tmp_path):
    path = str(tmp_path / "index")
    first = spark.createDataFrame([document("a", "v1")], DOC_SCHEMA)
    second = spark.createDataFrame([document("b", "v2")], DOC_SCHEMA)
    assert index_store.write_index(first, path)
    assert not index_store.write_index(second, path)
    assert [r.doc_id for r in spark.read.parquet(path).collect()] == ["a"]
    assert index_store.write_index(second, path, recreate=True)
    assert [r.doc_id for r in spark.read.parquet(path).collect()] == ["b"]
    stored = spark.read.parquet(index_store.write_version(first.unionByName(second), path, 3))
    plan = stored.where("release_tag = 'v1'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(release_tag" in plan
    ids = spark.createDataFrame([("a",), ("z",)], "doc_id string")
    assert [r.doc_id for r in index_store.get(stored, ids).collect()] == ["a"]
    assert {(r.doc_id, r.found) for r in index_store.exists(stored, ids).collect()} == {("a", True), ("z", False)}
    rows, total = index_store.dump(stored, 1)
    assert rows.count() == 1 and total == 2


def test_bookmark(spark, tmp_path):
    path = str(tmp_path / "bookmark")
    assert index_store.read_bookmark(spark, path, "s") is None
    assert not index_store.write_bookmark(spark, path, "s", "v1", successes=0)
    assert not index_store.write_bookmark(spark, path, "s", "v1", indexing=False)
    assert index_store.read_bookmark(spark, path, "s") is None
    assert index_store.write_bookmark(spark, path, "s", "v1") and index_store.write_bookmark(spark, path, "t", " ")
    assert index_store.write_bookmark(spark, path, "s", "v2")
    assert index_store.read_bookmark(spark, path, "s") == "v2"
    assert index_store.read_bookmark(spark, path, "t") is None


def test_saved_images(spark, tmp_path):
    good = bytearray(png_bytes(np.full((4, 4), 7, np.uint8)))
    rows = [("v1", "user", "icon", good), ("v1", "user", "token", bytearray(b"junk")), ("v2", "cut", "icon", None)]
    path = str(tmp_path / "images")
    report = index_store.save_images(spark.createDataFrame(rows, "release_tag string, icon_name string, kind string, content binary"), path)
    assert {(r.file, r.saved) for r in report.collect()} == {("v1/user_icon.png", True), ("v1/user_token.png", False), ("v2/cut_icon.png", False)}
    assert [bytes(r.content) for r in spark.read.parquet(path).collect()] == [bytes(good)]


def test_requests(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"items": [{"iconName": "a", "description": "x"}, {"iconName": "b"}]}')
    found = read_request_file(spark, str(tmp_path / "good.json"))
    assert [(r.icon_name, r.description) for r in found.orderBy("pos").collect()] == [("a", "x"), ("b", None)]
    for n, bad in enumerate(('{"items": []}', "{}", "not json")):
        (tmp_path / f"bad{n}.json").write_text(bad)
        with pytest.raises(ValueError, match="Missing or empty 'items' array"):
            read_request_file(spark, str(tmp_path / f"bad{n}.json"))
    names = spark.createDataFrame([('{"iconNames": ["a", "b"]}',), ('{"iconNames": []}',)], "body string")
    assert {(r.icon_name, r.error) for r in read_icon_names(names, "body").collect()} == {
        ("a", None), ("b", None), (None, "Missing or empty 'iconNames' array")
    }
    asked = spark.createDataFrame(
        [("1", "text", "x", None), ("2", "sound", "x", None), ("3", "svg", " ", "icon"), ("4", "image", None, None), ("5", "text", "x", "logo"), ("6", None, "x", None)],
        "query_id string, type string, query string, icon_type string",
    )
    assert {r.query_id: r.valid for r in validate_requests(asked).collect()} == {"1": True, "2": False, "3": False, "4": False, "5": False, "6": False}


@pytest.mark.parametrize("buffered", [100_000, 7, 0])
def test_percentiles_by_rank_equal_buffered_ones(spark, buffered):
    rng = np.random.default_rng(9)
    rows = [(int(t), route, None if x < 0.02 else round(float(x * 50)) / 7, bool(x > 0.9)) for t, route, x in zip(
        rng.integers(0, 180, 3000), rng.choice(["a", "b", None], 3000, p=[0.7, 0.2, 0.1]).tolist(), rng.random(3000))]
    rows.append((500, "lone", 3.5, False))
    rows.append((500, "none", None, True))
    spans = spark.createDataFrame(rows, "t int, route string, duration_ms double, failed boolean").repartition(5)
    spans = spans.withColumn("ts", F.timestamp_seconds("t"))
    found = {(r.window_start.minute, r.route): r for r in span_metrics(spans, buffered=buffered).collect()}
    groups = {}
    for t, route, ms, failed in rows:
        groups.setdefault((t // 60, route), []).append((ms, failed))
    assert set(found) == set(groups)
    for key, seen in groups.items():
        values = [ms for ms, _ in seen if ms is not None]
        assert found[key].requests == len(seen) and found[key].error_rate == pytest.approx(np.mean([f for _, f in seen]))
        want = np.percentile(values, [50, 95, 99]).tolist() if values else [None] * 3
        assert [found[key].p50, found[key].p95, found[key].p99] == (pytest.approx(want, abs=1e-9) if values else want)


def test_percentiles_of_a_busy_route(spark):
    spans = spark.range(1_000_000).select(
        F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit("hot").alias("route"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 8).alias("duration_ms"),
        F.lit(False).alias("failed"),
    )
    values = np.array([r[0] for r in spans.select("duration_ms").collect()])
    found = span_metrics(spans).first()
    assert [found.p50, found.p95, found.p99] == pytest.approx(np.percentile(values, [50, 95, 99]).tolist(), rel=1e-12)
