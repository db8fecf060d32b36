import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.functions import svg as S
from glyphlake.functions import text as X

TAG = '<svg viewBox="{}" width="224" height="224" xmlns="http://www.w3.org/2000/svg">'


def apply(spark, expression, values, column="v"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {column} string")
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "svg, box",
    [
        ('<svg viewBox="0 0 16 16"><path d="M1"/></svg>', "0 0 16 16"),
        ('<svg width="48" height="48"><path d="M1"/></svg>', "0 0 48.0 48.0"),
        ("<svg width='10.5px' height='auto'><path d=\"M1\"/></svg>", "0 0 10.5 24.0"),
        ('<svg stroke-width="2" height="7"><path d="M1"/></svg>', "0 0 2.0 7.0"),
        ('<svg\nclass="x"><path d="M1"/></svg>', "0 0 24 24"),
        ('<svg width="10000000" height="1"><path d="M1"/></svg>', "0 0 10000000.0 1.0"),
    ],
)
def test_normalize_keeps_content(spark, svg, box):
    assert apply(spark, S.normalize_svg("v"), [svg]) == [TAG.format(box) + '<path d="M1"/></svg>']


def test_normalize_edge_cases(spark):
    assert apply(spark, S.normalize_svg("v"), ["", None, "<g/>"]) == [None, None, "<g/>"]
    both = "<svg><svg></svg></svg>"
    odd = ['<svg width="1.5.2" height="4">x</svg>', '<svg width="3" height="...">x</svg>']
    assert apply(spark, S.normalize_svg("v"), odd) == [None, None]
    assert apply(spark, S.svg_size_error("v"), odd) == [f"could not convert string to float: '{n}'" for n in ("1.5.2", "...")]
    fine = ['<svg width="1.5.2" height="4" viewBox="0 0 1 1">x</svg>', '<svg width="1.5.2">x</svg>', '<svg width="px" height="2">x</svg>', None, ""]
    assert apply(spark, S.svg_size_error("v"), fine) == [None] * 5
    assert all(apply(spark, S.normalize_svg("v"), fine[:3]))
    assert apply(spark, S.normalize_svg("v", 512), [both])[0].count('width="512"') == 1
    assert apply(spark, S.normalize_svg("v"), ['<svg viewBox="$1 \\">x'])[0].startswith('<svg viewBox="$1 \\" ')


def test_normalize_mono(spark):
    cases = [
        ('<svg width="48" height="48px"><path fill="red" stroke=\'blue\' d="M1"/></svg>', TAG.format("0 0 48 48") + '<path   d="M1"/></svg>'),
        ('<svg width="none" height="0"><g/></svg>', TAG.format("0 0 24 24") + "<g/></svg>"),
        ("", None),
    ]
    assert apply(spark, S.normalize_svg_mono("v"), [c for c, _ in cases]) == [w for _, w in cases]


def test_background_and_fill(spark):
    svg = '<svg viewBox="0 0 24 24.5"><path d="a"/><path fill-rule="x"/><path fill="red"/><path><path\nd="b c"/><path/></svg>'
    rect = '<rect x="0.0" y="0.0" width="24.0" height="24.5" fill="white"/>'
    assert apply(spark, S.add_background("v"), [svg]) == [svg.replace('24.5">', '24.5">' + rect, 1)]
    comma, bad = '<svg viewBox="0,0,24,24">', '<svg viewBox="0 0 x 24">'
    assert apply(spark, S.add_background("v"), [comma, bad, "<svg>"]) == [comma, None, "<svg>"]
    assert apply(spark, S.background_error("v"), [comma, bad, "<svg>"]) == [False, True, False]
    filled = '<svg viewBox="0 0 24 24.5"><path fill="black" d="a"/><path fill="black" fill-rule="x"/><path fill="red"/><path fill="black"><path\nd="b c"/><path/></svg>'
    assert apply(spark, S.fill_paths("v"), [svg]) == [filled]


def test_extract(spark):
    page = "<b><svg a><path/>\n</svg><i><svg></svg></i></b>"
    assert apply(spark, S.extract_svg("v"), [page, "<b/>"]) == ["<svg a><path/>\n</svg>", "<b/>"]
    assert apply(spark, S.extract_svg("v", greedy=True), [page]) == ["<svg a><path/>\n</svg><i><svg></svg>"]
    layers = apply(spark, S.extract_layers("v"), ['<rect/><PATH d="1"/><circle/><path/>', "<g/>"])
    assert layers == [['<PATH d="1"/>', "<path/>", "<circle/>", "<rect/>"], []]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<>/ pathsvgrect=\"'fil-du01.\n", max_size=60), min_size=20, max_size=40))
def test_random_markup_agrees_with_python_patterns(spark, texts):
    values = [f"<svg {t}<path {t}>" for t in texts] + texts
    expected = [[m for tag in ("path", "circle", "rect") for m in re.findall(f"<{tag}[^>]*>", v, re.I)] for v in values]
    assert apply(spark, S.extract_layers("v"), values) == expected
    first = [re.search("<svg[^>]*>.*?</svg>", v, re.S) for v in values]
    assert apply(spark, S.extract_svg("v"), values) == [m.group(0) if m else v for m, v in zip(first, values)]


def test_paths_and_ids(spark):
    paths = ["/a/b/user.svg", "user.two.svg", "/a.b/user", ".hidden", "/x/.hidden.svg", "/x/..a", "/x/"]
    assert apply(spark, X.filename_stem("v"), paths) == ["user", "user.two", "user", ".hidden", ".hidden", "..a", ""]
    assert apply(spark, X.doc_id("v", F.lit("v1.0.0")), ["user"]) == ["user_v1.0.0"]


def test_payloads(spark):
    long = "A" * 101
    values = ["data:image/png;base64,QUJD", "data:image/png", long, "A" * 100, "é" * 101, "/tmp/a.png", "A" * 99 + "-" + "A" * 9]
    assert apply(spark, X.image_payload_kind("v"), values) == ["data_uri", "data_uri", "base64", "path", "base64", "path", "path"]
    assert apply(spark, X.strip_data_uri("v"), values[:3]) == ["QUJD", "data:image/png", long]


def test_headers(spark):
    good = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    parsed = apply(spark, X.parse_traceparent("v"), [good, good[:-3], "01" + good[2:], "00-a-b-01", None, good + "-x"])
    assert parsed[0].asDict() == {"version": "00", "trace_id": "a" * 32, "parent_id": "b" * 16, "flags": "01"}
    assert parsed[1:] == [None] * 5
    rows = [("k", "1.1.1.1", "2", "3"), (None, " 1.1.1.1 , 9", "2", "3"), (None, None, "2", "3"), (None, "", None, "3"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    assert [r[0] for r in df.select(X.client_key("a", "b", "c", "d")).collect()] == ["api_key:k", "1.1.1.1", "2", "3", "unknown"]


def test_attributes_and_display(spark):
    parsed = apply(spark, X.parse_attributes("v"), ["a=1, b = x=y ,bad,a=2", "", "novalue="])
    assert parsed == [{"b": "x=y", "a": "2"}, {}, {"novalue": ""}]
    assert apply(spark, X.display_type("v"), ["token", "", None]) == ["token", "icon", "icon"]
    assert apply(spark, X.display_score(F.lit(0.12345)), ["x"]) == ["0.123"]


def test_hit_text(spark):
    rows = [(1, "user", 0.95, "icon", "v1", ["a", "b", "c", "d", "e"]), (2, "cut", 0.5, None, None, None), (3, "x", 0.1, "", "", [])]
    rows += [(4, "even", 0.03125, None, None, None), (5, "up", 0.09375, None, None, None), (6, "large", 1234.5, None, None, None)]
    df = spark.createDataFrame(rows, "r int, n string, s double, t string, g string, d array<string>")
    found = [r[0] for r in df.select(X.format_hit("r", "n", "s", "t", "g", "d")).collect()]
    assert found == [
        "1. user (score: 0.9500)\n   Type: icon\n   Release: v1\n   Descriptions: a, b, c (+2 more)",
        "2. cut (score: 0.5000)",
        "3. x (score: 0.1000)",
        "4. even (score: 0.0312)",
        "5. up (score: 0.0938)",
        "6. large (score: 1234.5000)",
    ]
    assert apply(spark, X.report_title(F.lit(0), F.lit(0)), ["x"]) == ["No results found (total: 0)"]
