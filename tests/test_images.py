import base64

import numpy as np
import pytest
from conftest import png_bytes, read_png
from pyspark.sql import functions as F

from glyphlake.functions import images as I
from glyphlake.operators.encoders import embed_image, embed_svg, encode_column, encode_corpus, model_udf
from glyphlake.sources.corpus import decode_base64, read_images, scan_image_bytes, scan_images

BLACK_ON_WHITE = np.full((40, 40), 255, np.uint8)
BLACK_ON_WHITE[10:30, 10:30] = 0


def struct_of(spark, arrays):
    rows = []
    for i, a in enumerate(arrays):
        planes = a[..., None] if a.ndim == 2 else a[..., ::-1]
        h, w, n = planes.shape
        rows.append((i, ("", h, w, n, 16, bytearray(np.ascontiguousarray(planes).tobytes()))))
    return spark.createDataFrame(rows, f"i int, image {I.IMAGE_STRUCT}")


@pytest.mark.parametrize("shade, dark", [(255, False), (0, True), (127, True), (128, False), (200, False)])
def test_background(spark, shade, dark):
    grid = np.full((10, 10), shade, np.uint8)
    assert I.dark_background(grid) is dark
    df = spark.createDataFrame([(grid.tolist(),)], "g array<array<int>>")
    assert df.select(I.is_dark_background("g")).first()[0] is dark


def test_stretch_expression_equals_numpy(spark):
    rng = np.random.default_rng(3)
    grids = [rng.integers(0, 256, (int(h), int(w))).astype(np.uint8) for h, w in rng.integers(1, 12, (12, 2))]
    grids += [np.full((6, 6), 9, np.uint8), BLACK_ON_WHITE, 255 - BLACK_ON_WHITE, (BLACK_ON_WHITE // 3 + 40).astype(np.uint8)]
    df = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(grids)], "i int, g array<array<int>>")
    made = df.select(I.stretch_pixels("g").alias("s"), I.edge_brightness("g").alias("b"), *I.grid_stats("g")).orderBy("i").collect()
    for grid, row in zip(grids, made):
        assert np.array_equal(np.array(row.s), I.stretched(grid))
        assert (row.width, row.height, row.colours) == (grid.shape[1], grid.shape[0], len(np.unique(grid)))
    assert np.array_equal(I.stretched(255 - BLACK_ON_WHITE), BLACK_ON_WHITE)


def test_gray_of_colours():
    colours = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]], np.uint8)
    assert I.gray_of(colours).tolist() == [[76, 150, 29, 255]]


def test_resize():
    flat = np.full((10, 17), 93, np.uint8)
    assert np.array_equal(I.resize(flat, 224), np.full((224, 224), 93))
    assert np.array_equal(I.resize(BLACK_ON_WHITE, 40), BLACK_ON_WHITE)
    big = I.resize(BLACK_ON_WHITE, 224)
    assert big.shape == (224, 224) and big[112, 112] == 0 and big[2, 2] == 255
    assert np.abs(big.astype(int) - big[::-1]).max() <= 1 and np.abs(big.astype(int) - big[:, ::-1]).max() <= 1
    small = I.resize(np.kron(BLACK_ON_WHITE, np.ones((8, 8), np.uint8)), 40)
    assert np.abs(small.astype(int) - BLACK_ON_WHITE).max() <= 40 and small[20, 20] == 0


def test_normalized_images(spark):
    red = np.zeros((12, 12, 3), np.uint8)
    red[..., 0] = 255
    df = struct_of(spark, [BLACK_ON_WHITE, red, 255 - BLACK_ON_WHITE])
    search = I.image_stats(I.normalize_images(df, "image", "n"), "n").orderBy("i").collect()
    assert [(r.width, r.height, r.size_bytes) for r in search] == [(224, 224, 224 * 224 * 3)] * 3
    assert [r.single_colour for r in search] == [False, True, False]
    assert bytes(search[0]["n"]["data"]) == bytes(search[2]["n"]["data"])
    plain = I.normalize_images(df, "image", "n", search=False).where("i = 1").first()["n"]
    assert bytes(plain["data"][:3]) == bytes([0, 0, 255])  # blue, green, red


def test_png_files_and_payloads(spark, tmp_path):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    assert np.array_equal(read_png(png_bytes(rgb)), rgb)
    assert np.array_equal(read_png(png_bytes(BLACK_ON_WHITE)), BLACK_ON_WHITE)
    (tmp_path / "good.png").write_bytes(png_bytes(rgb))
    (tmp_path / "bad.png").write_bytes(b"junk")
    found = {r.image["origin"].rsplit("/")[-1]: r.image for r in scan_images(spark, str(tmp_path)).collect()}
    assert found["bad.png"]["height"] == -1
    assert np.array_equal(I.pixels_of(9, 7, 3, bytes(found["good.png"]["data"])), rgb)
    assert scan_images(spark, str(tmp_path), drop_invalid=True).count() == 1
    assert scan_image_bytes(spark, str(tmp_path)).count() == 2
    read = {r.path.rsplit("/")[-1]: r for r in read_images(spark, str(tmp_path), read_png).collect()}
    assert read["bad.png"].image["height"] == -1 and read["bad.png"].image_error == "Invalid image file"
    assert read["good.png"].image_error is None and read["good.png"].image["data"] == found["good.png"]["data"]
    text = base64.b64encode(png_bytes(rgb)).decode()
    df = spark.createDataFrame([(0, text), (1, "data:image/png;base64," + text), (2, "@@@"), (3, None)], "i int, p string")
    raw = {r.i: (r.b is not None, r.b_error) for r in decode_base64(df, "p", "b").collect()}
    assert raw == {0: (True, None), 1: (True, None), 2: (False, "Invalid base64 image data"), 3: (False, None)}
    images = {r.i: r.image for r in I.decode_base64_images(df, "p", read_png).collect()}
    assert bytes(images[0]["data"]) == bytes(found["good.png"]["data"])
    assert images[2]["height"] == -1 and images[3]["height"] is None


def test_image_vectors(spark):
    df = struct_of(spark, [BLACK_ON_WHITE, 255 - BLACK_ON_WHITE, np.full((5, 5), 200, np.uint8)])
    bad = spark.createDataFrame([(3, ("", -1, -1, -1, -1, bytearray())), (4, None)], f"i int, image {I.IMAGE_STRUCT}")
    made = {r.i: r for r in embed_image(df.unionByName(bad), "image", "v").collect()}
    assert made[0].v == made[1].v and len(made[0].v) == 512 and made[0].v_error is None
    assert np.linalg.norm(made[0].v) == pytest.approx(1, abs=1e-5)
    assert made[3].v is None and made[3].v_error == "Invalid image file"
    assert made[4].v is None and made[4].v_error is None
    assert I.mean_pool(np.arange(16).reshape(4, 4), 4).tolist() == [2.5, 4.5, 10.5, 12.5]


def test_svg_vectors(spark):
    rows = [(0, '<svg viewBox="0 0 24 24"><path d="M1"/></svg>'), (1, "  "), (2, '<svg viewBox="0 0 a 24"><path/></svg>'), (3, "<svg><g/></svg>"), (4, None)]
    made = {r.i: r for r in embed_svg(spark.createDataFrame(rows, "i int, s string"), "s", "v").collect()}
    assert len(made[0].v) == 512 and made[0].v_error is None
    assert all(made[i].v is None and made[i].v_error for i in (1, 2, 3, 4))


def test_user_encoder_and_model(spark):
    df = spark.createDataFrame([(0, "ab"), (1, "bad"), (2, None), (3, "")], "i int, t string").coalesce(1)

    def make():
        def encode(texts):
            if "bad" in texts:
                raise ValueError("cannot encode bad")
            return [[float(len(t))] if t else [] for t in texts]

        return encode

    made = {r.i: (r.v, r.v_error) for r in encode_column(df, "t", "v", make).collect()}
    assert made == {0: ([2.0], None), 1: (None, "cannot encode bad"), 2: (None, None), 3: (None, "Embedding generation produced empty result")}

    def make_predict():
        return lambda x: np.stack([x, x * 2], axis=1).astype(np.float32)

    numbers = spark.range(5).select(F.col("id").cast("float").alias("x"))
    assert [r.v for r in numbers.select(model_udf(make_predict, 2)("x").alias("v")).orderBy("v").collect()] == [[float(i), 2.0 * i] for i in range(5)]


def test_wide_corpus(spark):
    long = spark.createDataFrame([("a", "icon_svg_embedding", [1.0]), ("b", "token_image_embedding", [2.0])], "icon_name string, kind string, vector array<float>")
    found = {r.icon_name: r for r in encode_corpus(long, ["icon_name"]).collect()}
    assert found["a"].icon_svg_embedding == [1.0] and found["a"].token_image_embedding is None
    assert found["b"].token_image_embedding == [2.0]
