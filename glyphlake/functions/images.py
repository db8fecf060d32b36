"""Pixel rules: column expressions over small pixel grids and numpy helpers for decoded images."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Luminance weights, the edge sample and its threshold, the standard size.
RED, GREEN, BLUE = 0.299, 0.587, 0.114
EDGE_SAMPLE = 5
DARK_BELOW = 128
TARGET_SIZE = 224
WHITE = 255


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often lambdas inside look at it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- expressions over ARRAY<ARRAY<number>> grids -------------------------------------------


def luminance(r: Column | str, g: Column | str, b: Column | str) -> Column:
    return _col(r) * RED + _col(g) * GREEN + _col(b) * BLUE


def edge_pixels(grid: Column | str, sample: int = EDGE_SAMPLE) -> Column:
    """First and last ``sample`` pixels of the four edges; corners count twice."""
    rows = _col(grid)

    def ends(line: Column) -> Column:
        start = F.greatest(F.size(line) - F.lit(sample - 1), F.lit(1))
        return F.concat(F.slice(line, 1, sample), F.slice(line, start, F.lit(sample)))

    first_column = F.transform(rows, lambda row: F.element_at(row, 1))
    last_column = F.transform(rows, lambda row: F.element_at(row, -1))
    return F.concat(
        ends(F.element_at(rows, 1)), ends(F.element_at(rows, -1)), ends(first_column), ends(last_column)
    )


def edge_brightness(grid: Column | str, sample: int = EDGE_SAMPLE) -> Column:
    pixels = edge_pixels(grid, sample)
    return F.aggregate(pixels, F.lit(0.0), lambda total, p: total + p.cast("double")) / F.size(pixels)


def is_dark_background(grid: Column | str, sample: int = EDGE_SAMPLE) -> Column:
    return edge_brightness(grid, sample) < DARK_BELOW


def stretch_pixels(grid: Column | str) -> Column:
    """Light background, full contrast: inverted if dark, stretched to 0..255, all white if flat.

    Computed in single precision and cut to whole numbers.
    """
    def stretch(upright: Column, span: Column) -> Column:
        low, width = span["low"], (span["high"] - span["low"]).cast("float")
        return F.transform(
            upright,
            lambda row: F.transform(
                row,
                lambda p: F.when(
                    width > 0, (((p - low) / width).cast("float") * F.lit(255.0).cast("float")).cast("int")
                ).otherwise(F.lit(WHITE)),
            ),
        )

    def spanned(upright: Column) -> Column:
        flat = F.flatten(upright)
        return bind(
            F.struct(F.array_min(flat).alias("low"), F.array_max(flat).alias("high")), lambda span: stretch(upright, span)
        )

    def turned(dark: Column) -> Column:
        return F.transform(
            _col(grid),
            lambda row: F.transform(row, lambda p: F.when(dark, F.lit(WHITE) - p).otherwise(p).cast("float")),
        )

    return bind(is_dark_background(grid), lambda dark: bind(turned(dark), spanned))


def grid_stats(grid: Column | str) -> list[Column]:
    """Width, height, number of distinct values and whether there is only one."""
    rows = _col(grid)
    colours = F.size(F.array_distinct(F.flatten(rows)))
    return [
        F.size(F.element_at(rows, 1)).alias("width"),
        F.size(rows).alias("height"),
        colours.alias("colours"),
        (colours == 1).alias("single_colour"),
    ]


# ---- numpy helpers for decoded images -------------------------------------------------------


def pixels_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB (or gray) array of an image-source struct, whose bytes are ordered blue, green, red."""
    image = np.frombuffer(data, dtype=np.uint8).reshape(int(height), int(width), int(channels))
    return image[..., 0] if channels == 1 else image[..., 2::-1]


def gray_of(image: np.ndarray) -> np.ndarray:
    """8-bit luma in 16-bit fixed point; gray input stays as it is."""
    if image.ndim == 2:
        return image
    rgb = image.astype(np.int64)
    return ((rgb[..., 0] * 19595 + rgb[..., 1] * 38470 + rgb[..., 2] * 7471 + 0x8000) >> 16).astype(np.uint8)


def dark_background(gray: np.ndarray, sample: int = EDGE_SAMPLE) -> bool:
    edges = [gray[0], gray[-1], gray[:, 0], gray[:, -1]]
    return bool(np.concatenate([part for e in edges for part in (e[:sample], e[-sample:])]).mean() < DARK_BELOW)


def stretched(gray: np.ndarray) -> np.ndarray:
    values = gray.astype(np.float32)
    if dark_background(gray):
        values = WHITE - values
    low, high = values.min(), values.max()
    if high == low:
        return np.full(gray.shape, WHITE, dtype=np.uint8)
    return np.clip((values - low) / (high - low) * 255, 0, 255).astype(np.uint8)


@lru_cache(maxsize=64)
def _lanczos_weights(size_in: int, size_out: int) -> np.ndarray:
    """Rows of 22-bit fixed-point Lanczos-3 weights, widened when shrinking."""
    scale = size_in / size_out
    widen = max(scale, 1.0)
    support = 3.0 * widen
    weights = np.zeros((size_out, size_in), dtype=np.int64)
    for out in range(size_out):
        centre = (out + 0.5) * scale
        low, high = max(0, int(centre - support + 0.5)), min(size_in, int(centre + support + 0.5))
        x = (np.arange(low, high) - centre + 0.5) / widen
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        w = w / w.sum()
        weights[out, low:high] = np.trunc(w * (1 << 22) + np.where(w < 0, -0.5, 0.5))
    return weights


def _resample(plane: np.ndarray, size: int) -> np.ndarray:
    """One axis: weighted sums along the last axis, rounded and clipped to bytes."""
    sums = plane.astype(np.int64) @ _lanczos_weights(plane.shape[-1], size).T + (1 << 21)
    return np.clip(sums >> 22, 0, 255).astype(np.uint8)


def resize(image: np.ndarray, size: int = TARGET_SIZE) -> np.ndarray:
    """Lanczos resize to a square, columns first, then rows; channels independently."""
    if image.ndim == 3:
        return np.stack([resize(image[..., c], size) for c in range(image.shape[-1])], axis=-1)
    wide = image if image.shape[1] == size else _resample(image, size)
    return wide if image.shape[0] == size else np.ascontiguousarray(_resample(wide.T, size).T)


def normalized_gray(image: np.ndarray, size: int = TARGET_SIZE) -> np.ndarray:
    """Search normal form of an image; its three colour channels are equal, so one is kept."""
    return resize(stretched(gray_of(image)), size)


def mean_pool(gray: np.ndarray, dims: int) -> np.ndarray:
    """Mean of each block of a grid of ``dims`` blocks over the image."""
    down = 2 ** (int(np.log2(dims)) // 2)
    across = dims // down
    sums = np.add.reduceat(gray.astype(np.float64), np.arange(down) * gray.shape[0] // down, axis=0)
    sums = np.add.reduceat(sums, np.arange(across) * gray.shape[1] // across, axis=1)
    rows = np.diff(np.r_[np.arange(down) * gray.shape[0] // down, gray.shape[0]])
    columns = np.diff(np.r_[np.arange(across) * gray.shape[1] // across, gray.shape[1]])
    return (sums / np.outer(rows, columns)).ravel()


IMAGE_STRUCT = "struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


Decoder = Callable[[bytes], np.ndarray]


def _decoded(contents: Iterable[bytes | None], decoder: Decoder) -> pd.DataFrame:
    """Image-source structs; null for null, height -1 and no data for what the decoder refuses."""
    rows = []
    for content in contents:
        if content is None:
            rows.append((None, None, None, None, None, None))
            continue
        try:
            pixels = decoder(content)
            planes = pixels[..., None] if pixels.ndim == 2 else pixels[..., ::-1]
            h, w, n = planes.shape
            rows.append(("", h, w, n, 0 if n == 1 else 16, np.ascontiguousarray(planes).tobytes()))
        except Exception:
            rows.append(("", -1, -1, -1, -1, b""))
    names = ["origin", "height", "width", "nChannels", "mode", "data"]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({n: "Int32" for n in names[1:5]})


def decode_images(df: DataFrame, col: str, decoder: Decoder, out: str = "image") -> DataFrame:
    """Adds the image-source struct of a column of file contents; undecodable ones get height -1, no data, and an error.

    ``decoder`` turns the bytes of an image file into gray (rows, columns) or RGB (rows, columns, 3) pixels.
    """

    @F.pandas_udf(IMAGE_STRUCT)
    def decode(contents: pd.Series) -> pd.DataFrame:
        return _decoded(contents, decoder)

    made = df.withColumn(out, decode(F.col(col)))
    return made.withColumn(f"{out}_error", F.when(F.col(out)["height"] < 0, F.lit("Invalid image file")))


def decode_base64_images(df: DataFrame, col: str, decoder: Decoder, out: str = "image") -> DataFrame:
    """Adds the image-source struct of base64 payloads; undecodable ones get height -1, no data.

    ``decoder`` turns the bytes of an image file into gray (rows, columns) or RGB (rows, columns, 3) pixels.
    """

    @F.pandas_udf(IMAGE_STRUCT)
    def decode(payloads: pd.Series) -> pd.DataFrame:
        return _decoded(payloads, lambda payload: decoder(base64.b64decode(payload, validate=False)))

    return df.withColumn(out, decode(F.col(col)))


def normalize_images(df: DataFrame, col: str, out: str, size: int = TARGET_SIZE, search: bool = True) -> DataFrame:
    """Adds the RGB struct of images at the standard size; with ``search`` in search normal form."""

    @F.pandas_udf(IMAGE_STRUCT)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for origin, h, w, n, data in zip(*[images[c] for c in ("origin", "height", "width", "nChannels", "data")], strict=True):
            if pd.isna(h) or h <= 0:
                rows.append((origin, -1, -1, -1, -1, b""))
                continue
            pixels = pixels_of(h, w, n, data)
            plane = normalized_gray(pixels, size) if search else resize(pixels, size)
            planes = np.repeat(plane[..., None], 3, axis=-1) if plane.ndim == 2 else plane[..., ::-1]
            rows.append((origin, size, size, 3, 16, np.ascontiguousarray(planes).tobytes()))
        return pd.DataFrame(rows, columns=["origin", "height", "width", "nChannels", "mode", "data"])

    return df.withColumn(out, run(F.col(col)))


def image_stats(df: DataFrame, col: str) -> DataFrame:
    """Adds width, height, mode, byte size, distinct colours and the single-colour warning."""

    @F.pandas_udf("bigint")
    def colours(images: pd.DataFrame) -> pd.Series:
        counts = []
        for n, data in zip(images["nChannels"], images["data"], strict=True):
            flat = np.frombuffer(data or b"", np.uint8)
            if len(flat):
                # One whole number per pixel sorts far faster than rows of channels.
                flat = flat.reshape(-1, int(n)).astype(np.uint32) @ (256 ** np.arange(int(n), dtype=np.uint32))
            counts.append(len(np.unique(flat)))
        return pd.Series(counts)

    image = F.col(col)
    return df.select(
        "*",
        image["width"].alias("width"),
        image["height"].alias("height"),
        image["mode"].alias("mode"),
        F.length(image["data"]).alias("size_bytes"),
        colours(image).alias("colours"),
    ).withColumn("single_colour", F.col("colours") == 1)
