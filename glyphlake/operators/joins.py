"""Joins whose small side is checked before it is broadcast, and salted where a key is hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.session import cut_lineage

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
# A key with more left rows than this is spread over several tasks.
HOT_ROWS = 1_000_000
SALTS = 32


def _width(column: Column, kind: T.DataType) -> Column:
    """Approximate bytes of one value, nested ones included."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, b: a + b, [_width(column[f.name], f.dataType) for f in kind.fields], F.lit(16).cast("bigint"))
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType)):
        size = F.size(column) * 8
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(column, F.lit(0).cast("bigint"), lambda n, x: n + 16 + _width(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = F.octet_length(column.cast("string"))
    else:
        size = F.lit(16)
    return F.coalesce(size, F.lit(0)).cast("bigint")


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` stays within both bounds; stops reading once the row bound is passed."""
    width = reduce(lambda a, b: a + b, [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(16).cast("bigint"))
    # The row bound first: only then is a whole width worth adding up.
    found = df.select(width.alias("w")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()
    return found["n"] <= max_rows and (found["w"] or 0) <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "inner",
    spread: Column | str | None = None,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a table of any size and skew with a narrower lookup table.

    A lookup table within the bounds is broadcast. Beyond them both sides are shuffled; the left
    rows of a hot key are spread over salts by ``spread`` (a column that differs between them) and
    only the lookup rows of hot keys are repeated per salt. Rows without a key match nothing and
    are spread as well. Valid for joins that keep or drop left rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join keeps left rows, so it cannot do a {how} join")
    keys = [on] if isinstance(on, str) else list(on)
    if fits(right, max_rows):
        return left.join(F.broadcast(right), keys, how)
    # Counted with partial sums; which keys are listed decides the spreading, never the result.
    hot = cut_lineage(
        left.groupBy(*keys)
        .agg(F.count("*").alias("__n"))
        .where(F.col("__n") > hot_rows)
        .orderBy(F.desc("__n"))
        .limit(BROADCAST_ROWS)
        .select(*keys, F.lit(True).alias("__hot"))
    )
    source = F.xxhash64(*([spread] if spread is not None else left.columns))
    unkeyed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salted_left = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn("__salt", F.when(F.col("__hot") | unkeyed, F.pmod(source, F.lit(salts))).otherwise(0).cast("int"))
        .drop("__hot")
    )
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return salted_left.join(salted_right, [*keys, "__salt"], how).drop("__salt")
