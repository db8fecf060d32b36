"""Turning payload columns into vectors: the pluggable surface and its deterministic defaults.

An encoder factory is called once per Python worker task and returns a function from a list of
payloads to a list of vectors. Models are brought by the user; the defaults hash tokens and pool
pixels, so results are the same on every machine.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.images import TARGET_SIZE, mean_pool, normalized_gray, pixels_of
from glyphlake.functions.svg import background_error, extract_layers, prepare_for_raster
from glyphlake.functions.text import tokens
from glyphlake.schema import TEXT_DIMS, VISUAL_DIMS, VISUAL_FIELDS

#: Rows whose tokens are laid out as numbers at once: an Arrow batch of long texts holds millions of tokens.
SLICE_ROWS = 2048

Encoder = Callable[[list], list]


@functools.lru_cache(maxsize=1 << 16)
def token_slot(token: str, dims: int) -> tuple[int, int]:
    """Dimension and sign of a token, from its md5 digest."""
    digest = hashlib.md5(token.encode("utf-8")).hexdigest()
    return int(digest[:8], 16) % dims, 1 - 2 * (int(digest[8], 16) % 2)


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and token code of every entry of an Arrow list column, and the distinct tokens."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    coded = column.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(int)
    return np.repeat(np.arange(len(column)), lengths), code, coded.dictionary.to_pylist()


def _in_slices(column: pa.Array, encode: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``encode`` over a few rows at a time, so what it lays out does not grow with the batch."""
    parts = [encode(column.slice(start, SLICE_ROWS)) for start in range(0, max(1, len(column)), SLICE_ROWS)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def _hashed(column: pa.Array, dims: int) -> pa.Array:
    row, code, words = _coded(column)
    slots = [token_slot(t, dims) for t in words]
    place = np.array([s[0] for s in slots], dtype=int)
    sign = np.array([s[1] for s in slots], dtype=float)
    flat = np.zeros(len(column) * dims)
    if len(code):
        flat = np.bincount(row * dims + place[code], weights=sign[code], minlength=len(column) * dims)
    matrix = flat.reshape(len(column), dims)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    offsets = np.arange(len(column) + 1, dtype=np.int32) * dims
    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel().astype(np.float32)))
    return pa.compute.if_else(column.is_valid(), made, pa.scalar(None, made.type))


def _weighted(column: pa.Array) -> pa.Array:
    row, code, words = _coded(column)
    key, count = np.unique(row * max(1, len(words)) + code, return_counts=True)
    row, code = np.divmod(key, max(1, len(words)))
    sizes = np.bincount(row, minlength=len(column))
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    names = pa.array(words, pa.string()).take(pa.array(code))
    made = pa.MapArray.from_arrays(offsets, names, pa.array(np.log1p(count.astype(float))))
    return pa.compute.if_else(pa.array(sizes > 0), made, pa.scalar(None, made.type))


def hashed_vectors(dims: int) -> Callable[[Column | str], Column]:
    """Column function from ARRAY<STRING> tokens to unit ARRAY<FLOAT> vectors, null stays null.

    Works on whole Arrow batches: every distinct token of a batch is hashed once. A row whose
    tokens cancel out, or with none, gives the zero vector.
    """

    @F.arrow_udf("array<float>")
    def encode(column: pa.Array) -> pa.Array:
        return _in_slices(column, lambda part: _hashed(part, dims))

    # Kept from being evaluated a second time for a filter on its result.
    return encode.asNondeterministic()


def token_weights() -> Callable[[Column | str], Column]:
    """Column function from ARRAY<STRING> tokens to a MAP of ln(1 + occurrences), null if empty."""

    @F.arrow_udf("map<string, double>")
    def encode(column: pa.Array) -> pa.Array:
        return _in_slices(column, _weighted)

    return encode.asNondeterministic()


def embed_text(df: DataFrame, col: str, out: str = "text_embedding", dims: int = TEXT_DIMS) -> DataFrame:
    """Dense text vectors by signed feature hashing of the whole text."""
    return df.withColumn(out, hashed_vectors(dims)(tokens(col)))


def embed_sparse(df: DataFrame, col: str, out: str = "text_embedding_sparse") -> DataFrame:
    """Sparse text vectors as a MAP column; a document without tokens gets null."""
    return df.withColumn(out, token_weights()(tokens(col)))


def text_postings(df: DataFrame, col: str, id_col: str = "doc_id") -> DataFrame:
    """Sparse text vectors as rows ``id, token, weight``, made in place without a shuffle."""
    made = embed_sparse(df.select(id_col, col), col, "__sparse")
    return made.select(id_col, F.explode("__sparse").alias("token", "weight"))


def encode_column(df: DataFrame, col: str, out: str, make_encoder: Callable[[], Encoder]) -> DataFrame:
    """Adds ``out`` and ``out_error`` from a user's encoder.

    A batch is encoded at once; if that fails its rows are tried one by one, so a bad payload
    spoils only its own row. Null payloads stay null without an error, an empty result is one.
    """

    @F.pandas_udf("struct<vector: array<float>, error: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for payloads in batches:
            vectors, errors = [None] * len(payloads), [None] * len(payloads)
            filled = [i for i, p in enumerate(payloads) if p is not None]
            try:
                made = list(encode([payloads.iloc[i] for i in filled])) if filled else []
            except Exception:
                made = []
                for i in filled:
                    try:
                        made.append(encode([payloads.iloc[i]])[0])
                    except Exception as problem:
                        made.append(None)
                        errors[i] = str(problem) or type(problem).__name__
            for i, vector in zip(filled, made, strict=True):
                if vector is not None and len(vector):
                    vectors[i] = np.asarray(vector, dtype=np.float32)
                elif errors[i] is None:
                    errors[i] = "Embedding generation produced empty result"
            yield pd.DataFrame({"vector": vectors, "error": errors})

    return (
        df.withColumn("__made", run(F.col(col)))
        .withColumn(out, F.col("__made.vector"))
        .withColumn(f"{out}_error", F.col("__made.error"))
        .drop("__made")
    )


def model_udf(make_predict_fn: Callable, batch_size: int = 64):
    """A model behind Spark's batch inference API: loaded once per worker, fed numpy batches."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    return predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)


def embed_image(
    df: DataFrame, col: str, out: str, dims: int = VISUAL_DIMS, size: int = TARGET_SIZE
) -> DataFrame:
    """Visual vectors of an image-source struct column: normalised, pooled to ``dims``, unit length.

    An image that could not be decoded (no pixels) gives null and an error.
    """

    @F.pandas_udf("struct<vector: array<float>, error: string>")
    def run(images: pd.DataFrame) -> pd.DataFrame:
        vectors, errors = [], []
        for height, width, channels, data in zip(
            images["height"], images["width"], images["nChannels"], images["data"], strict=True
        ):
            if pd.isna(height):
                vectors.append(None)
                errors.append(None)
            elif height <= 0 or width <= 0:
                vectors.append(None)
                errors.append("Invalid image file")
            else:
                pooled = mean_pool(normalized_gray(pixels_of(height, width, channels, data), size), dims)
                length = np.sqrt((pooled * pooled).sum())
                vectors.append((pooled / length if length > 0 else pooled).astype(np.float32))
                errors.append(None)
        return pd.DataFrame({"vector": vectors, "error": errors})

    return (
        df.withColumn("__made", run(F.col(col)))
        .withColumn(out, F.col("__made.vector"))
        .withColumn(f"{out}_error", F.col("__made.error"))
        .drop("__made")
    )


def embed_svg(df: DataFrame, col: str, out: str, dims: int = VISUAL_DIMS) -> DataFrame:
    """Visual vectors of SVG text: prepared for drawing, then the words of its layers hashed.

    Adds ``out`` and ``out_error``; a blank document, a broken viewBox or one without any layer
    gives null and an error.
    """
    text = F.col(col)
    layers = extract_layers(prepare_for_raster(text))
    words = F.flatten(F.transform(layers, lambda layer: tokens(layer)))
    error = (
        F.when(text.isNull() | (F.trim(text) == ""), F.lit("SVG content cannot be empty"))
        .when(background_error(text), F.lit("Error processing SVG: viewBox holds no number"))
        .when(F.size(layers) == 0, F.lit("Embedding generation produced empty result"))
    )
    return (
        df.withColumn(f"{out}_error", error)
        .withColumn("__words", F.when(F.col(f"{out}_error").isNull(), words))
        .withColumn(out, hashed_vectors(dims)("__words"))
        .drop("__words")
    )


def encode_corpus(vectors: DataFrame, id_cols: list[str], fields: list[str] = VISUAL_FIELDS) -> DataFrame:
    """Long rows ``ids, kind, vector`` to one wide row per icon with a column per kind, null if absent."""
    return vectors.groupBy(*id_cols).pivot("kind", fields).agg(F.first("vector", ignorenulls=True))
