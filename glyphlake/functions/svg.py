"""SVG markup rules as column expressions.

Patterns follow Java's regular expressions. ``F.regexp_replace`` replaces every match, so a
first-only replacement anchors on everything before the match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, default sizes and tag texts of the document model.
VIEW_BOX = r"""viewBox=["']([^"']+)["']"""
WIDTH = r"""width=["']([^"']+)["']"""
HEIGHT = r"""height=["']([^"']+)["']"""
FILL = r"""fill=["'][^"']*["']"""
STROKE = r"""stroke=["'][^"']*["']"""
SVG_ELEMENT = r"(?s)<svg[^>]*>.*?</svg>"
SVG_ELEMENT_GREEDY = r"(?s)<svg[^>]*>.*</svg>"
FIRST_SVG_TAG = r"(?s)\A(.*?)(<svg[^>]*>)"
LAYER_TAGS = ["path", "circle", "rect"]
DEFAULT_VIEW_BOX = "0 0 24 24"
DEFAULT_SIDE = 24.0
TARGET_SIZE = 224
NAMESPACE = "http://www.w3.org/2000/svg"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _attribute(svg: Column, pattern: str) -> Column:
    """Value of the first match, null when there is none (an attribute value is never empty)."""
    return F.nullif(F.regexp_extract(svg, pattern, 1), F.lit(""))


def plain_float(x: Column) -> Column:
    """A double with at least one decimal and no exponent for ordinary sizes: 48.0, 0.5, 10000000.0."""
    digits = F.regexp_replace(F.format_string("%.15f", x), r"(\.\d+?)0+$", "$1")
    shortest = x.cast("string")
    return F.when(shortest.contains("E"), digits).otherwise(shortest)


def _short_number(x: Column) -> Column:
    """A double without a trailing ``.0``: 48, 0.5."""
    return F.regexp_replace(plain_float(x), r"\.0$", "")


def _quoted(text: Column) -> Column:
    """Keep backslashes and dollars of inserted text literal in a replacement."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _resize(svg: Column, view_box: Column, size: int) -> Column:
    tag = F.concat(
        F.lit('<svg viewBox="'), view_box, F.lit(f'" width="{size}" height="{size}" xmlns="{NAMESPACE}">')
    )
    return F.regexp_replace(svg, F.lit(FIRST_SVG_TAG), F.concat(F.lit("$1"), _quoted(tag)))


def _view_box(svg: Column, side, number) -> Column:
    width, height = _attribute(svg, WIDTH), _attribute(svg, HEIGHT)
    from_size = F.concat(F.lit("0 0 "), number(side(width)), F.lit(" "), number(side(height)))
    return F.coalesce(_attribute(svg, VIEW_BOX), from_size, F.lit(DEFAULT_VIEW_BOX))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\d.]", "")


def normalize_svg(svg: Column | str, size: int = TARGET_SIZE) -> Column:
    """Standard size and viewBox, colours kept; null for an empty document and one of which ``svg_size_error`` tells."""
    text = _col(svg)

    def side(value: Column) -> Column:
        return F.when(_digits(value) == "", F.lit(DEFAULT_SIDE)).otherwise(_digits(value).try_cast("double"))

    made = _resize(text, _view_box(text, side, plain_float), size)
    return F.when((text != "") & svg_size_error(text).isNull(), made)


def svg_size_error(svg: Column | str) -> Column:
    """Error where the box has to be taken from a width and height of which one is no number, like ``1.5.2``; else null."""
    text = _col(svg)
    width, height = _attribute(text, WIDTH), _attribute(text, HEIGHT)
    needed = _attribute(text, VIEW_BOX).isNull() & width.isNotNull() & height.isNotNull()

    def odd(value: Column) -> Column:
        return (_digits(value) != "") & _digits(value).try_cast("double").isNull()

    told = F.concat(F.lit("could not convert string to float: '"), F.when(odd(width), _digits(width)).otherwise(_digits(height)), F.lit("'"))
    return F.when(needed & (odd(width) | odd(height)), told)


def normalize_svg_mono(svg: Column | str, size: int = TARGET_SIZE) -> Column:
    """As ``normalize_svg`` with leading numbers of the sizes, then fill and stroke removed."""
    text = _col(svg)

    def side(value: Column) -> Column:
        leading = F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
        number = F.nullif(leading, F.lit("")).try_cast("double")
        return F.when(value.isNotNull(), F.coalesce(F.nullif(number, F.lit(0.0)), F.lit(DEFAULT_SIDE)))

    sized = _resize(text, _view_box(text, side, _short_number), size)
    return F.when(text != "", F.regexp_replace(F.regexp_replace(sized, FILL, ""), STROKE, ""))


def background_numbers(svg: Column | str) -> Column:
    """The four viewBox numbers, null without exactly four; one that is no number is null inside."""
    parts = F.filter(F.split(_attribute(_col(svg), VIEW_BOX), r"\s+"), lambda p: p != "")
    return F.when(F.size(parts) == 4, F.transform(parts, lambda p: p.try_cast("double")))


def background_error(svg: Column | str) -> Column:
    """True when a four part viewBox holds something that is not a number."""
    return F.coalesce(F.exists(background_numbers(svg), lambda n: n.isNull()), F.lit(False))


def add_background(svg: Column | str) -> Column:
    """A white rectangle after the first svg tag, sized by the viewBox; null on a bad number."""
    text = _col(svg)
    numbers = background_numbers(text)
    at = [plain_float(F.get(numbers, F.lit(i))) for i in range(4)]
    rect = F.concat(
        F.lit('<rect x="'), at[0], F.lit('" y="'), at[1], F.lit('" width="'), at[2],
        F.lit('" height="'), at[3], F.lit('" fill="white"/>'),
    )
    drawn = F.regexp_replace(text, F.lit(FIRST_SVG_TAG), F.concat(F.lit("$1$2"), rect))
    return F.when(numbers.isNull(), text).otherwise(drawn)


def fill_paths(svg: Column | str) -> Column:
    """``fill="black"`` for every path tag with no ``fill=`` in it."""
    with_attributes = F.regexp_replace(_col(svg), r"<path (?![^>]*fill=)([^>]*>)", '<path fill="black" $1')
    return F.replace(with_attributes, F.lit("<path>"), F.lit('<path fill="black">'))


def prepare_for_raster(svg: Column | str) -> Column:
    return fill_paths(add_background(svg))


def extract_svg(html: Column | str, greedy: bool = False) -> Column:
    """The first svg element of a page, or the page itself when it has none."""
    found = F.regexp_extract(_col(html), SVG_ELEMENT_GREEDY if greedy else SVG_ELEMENT, 0)
    return F.coalesce(F.nullif(found, F.lit("")), _col(html))


def extract_layers(svg: Column | str) -> Column:
    """All path, then circle, then rect opening tags, in any letter case."""
    found = [F.regexp_extract_all(_col(svg), F.lit(f"(?i)<{tag}[^>]*>"), F.lit(0)) for tag in LAYER_TAGS]
    return F.concat(*found)
