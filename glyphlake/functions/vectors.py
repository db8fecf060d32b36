"""Vector arithmetic as column expressions, summed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0.0 when either has no length, null when either is null."""
    return cosine_from_norms(dot(a, b), l2_norm(a), l2_norm(b))


def cosine_from_norms(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Same rule for callers that computed the norms once per side."""
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(product / (norm_a * norm_b))


def dims(v: Column | str) -> Column:
    return F.when(_col(v).isNotNull(), F.size(_col(v)))


def head(v: Column | str, n: int = 5) -> Column:
    return F.slice(_col(v), 1, n)


def _abs_diffs(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y))


def max_abs_diff(a: Column | str, b: Column | str) -> Column:
    return F.array_max(_abs_diffs(a, b))


def mean_abs_diff(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(_abs_diffs(a, b), F.lit(0.0), lambda total, x: total + x) / F.size(_col(a))


def array_equal(a: Column | str, b: Column | str) -> Column:
    return _col(a) == _col(b)


def rounded(x: Column | str, decimals: int) -> Column:
    """A number to so many decimals as numpy and SQL engines round: scaled, rounded half up and scaled back, all in DOUBLE.

    ``F.round`` rounds the shortest decimal text of a number instead: a score next to a tie, as every second ``score_of`` is, may
    then come out one unit lower. Numbers too large for decimals, infinities and NaN stay as they are.
    """
    value, scale = _col(x).cast("double"), float(10**decimals)
    whole = F.floor(F.abs(value) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return F.when(F.abs(value) < F.lit(2.0**52 / scale), F.when(value < 0, -whole).otherwise(whole)).otherwise(value)


def score_of(cos: Column | str) -> Column:
    """Relevance of a cosine hit: (1 + cos) / 2."""
    return (F.lit(1.0) + _col(cos)) / 2


def present(v: Column | str) -> Column:
    """A null or empty vector counts as absent."""
    return _col(v).isNotNull() & (F.size(_col(v)) > 0)
