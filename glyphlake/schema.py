"""The one document table and the constants every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names, vector sizes and search constants of the document model.
TEXT_FIELD = "text_embedding"
SPARSE_FIELD = "text_embedding_sparse"
VISUAL_FIELDS = [
    "icon_image_embedding",
    "icon_svg_embedding",
    "token_image_embedding",
    "token_svg_embedding",
]
LEGACY_FIELDS = ["image_embedding", "svg_embedding"]
TEXT_DIMS = 384
VISUAL_DIMS = 512
REQUEST_TYPES = ["text", "image", "svg"]
ICON_TYPES = ["icon", "token"]
KNN_K = 10
NUM_CANDIDATES = 100
PAGE_SIZE = 50
SIMILAR_THRESHOLD = 0.99
SIMILAR_SHOWN = 20
SAMPLED_PAIRS = 100

VECTOR = T.ArrayType(T.FloatType())

DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("icon_name", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("release_tag", T.StringType()),
        T.StructField("icon_type", T.StringType()),
        T.StructField("token_type", T.StringType()),
        T.StructField("descriptions", T.ArrayType(T.StringType())),
        T.StructField(TEXT_FIELD, VECTOR),
        T.StructField(SPARSE_FIELD, T.MapType(T.StringType(), T.DoubleType())),
        *[T.StructField(name, VECTOR) for name in VISUAL_FIELDS + LEGACY_FIELDS],
        T.StructField("svg_content", T.StringType()),
        T.StructField("token_svg_content", T.StringType()),
    ]
)

# field -> expected vector length, used by the dimension and schema checks
EXPECTED_DIMS = {TEXT_FIELD: TEXT_DIMS, **{name: VISUAL_DIMS for name in VISUAL_FIELDS}}

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("query_id", T.StringType(), False),
        T.StructField("type", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("icon_type", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StringType())),
    ]
)
