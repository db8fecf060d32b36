"""Reading file corpora: SVG text, images and the name map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions.images import Decoder, decode_images
from glyphlake.functions.text import filename_stem

# Directories that are never part of a corpus, and the name map's source patterns.
SKIPPED_DIRS = [".git", "node_modules", "dist", "build", "__pycache__", ".next"]
MAP_PATTERN = r"""export\s+const\s+typeToPathMap\s*=\s*\{([^}]+)\}"""
PAIR_PATTERN = r"""(\w+):\s*["']([^"']+)["']"""


def outside_skipped_dirs(path: Column | str) -> Column:
    """False for paths below a skipped directory; the file's own name is not looked at."""
    column = F.col(path) if isinstance(path, str) else path
    names = "|".join(name.replace(".", r"\.") for name in SKIPPED_DIRS)
    return ~column.rlike(f"/({names})/")


def scan_svg_corpus(spark: SparkSession, root: str, glob: str = "*.svg") -> DataFrame:
    """``path, modificationTime, length, content, filename`` of every file of that name below ``root``.

    Spark itself also leaves out directories starting with ``.`` or ``_``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    base = root.rstrip("/")
    inner = F.substring_index(F.col("path"), base, -1)
    return files.where(outside_skipped_dirs(inner)).withColumn("filename", filename_stem("path"))


def read_svg_text(files: DataFrame) -> DataFrame:
    """The corpus with its content as UTF-8 text instead of bytes."""
    return files.select("path", "filename", F.decode("content", "UTF-8").alias("svg_content"))


def scan_images(spark: SparkSession, root: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded image structs; an undecodable file has height -1 unless dropped."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).load(root)


def scan_image_bytes(spark: SparkSession, root: str, glob: str = "*.png") -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    )


def read_images(spark: SparkSession, root: str, decoder: Decoder, glob: str = "*.png") -> DataFrame:
    """``path, length, image, image_error`` of picture files of any format that ``decoder`` reads.

    Spark packs small files into tasks by their bytes; a broken file is a row with height -1 and an error.
    """
    files = scan_image_bytes(spark, root, glob).select("path", "length", "content")
    return decode_images(files, "content", decoder).drop("content")


def decode_base64(df: DataFrame, col: str, out: str) -> DataFrame:
    """Adds the bytes of a base64 column (data URI heads removed) and an error for bad input."""
    from glyphlake.functions.text import strip_data_uri

    bytes_ = F.try_to_binary(strip_data_uri(col), F.lit("base64"))
    return df.withColumn(out, bytes_).withColumn(
        f"{out}_error", F.when(F.col(col).isNotNull() & F.col(out).isNull(), F.lit("Invalid base64 image data"))
    )


def parse_name_map(sources: DataFrame, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """``icon_name, filename, ord`` of the map literal in a column of source text.

    Only the first literal of a text counts, quoted keys do not match, and of a repeated key the
    last file wins while keeping the key's first place in the order. ``keep`` columns (the key of
    a source) are carried along; without them all texts count as one source.
    """
    kept = keep or []
    body = F.regexp_extract(text_col, MAP_PATTERN, 1)
    names = F.regexp_extract_all(body, F.lit(PAIR_PATTERN), F.lit(1))
    files = F.regexp_extract_all(body, F.lit(PAIR_PATTERN), F.lit(2))
    pairs = sources.select(*kept, F.posexplode(F.arrays_zip(names.alias("n"), files.alias("f"))).alias("pos", "pair"))
    return pairs.groupBy(*kept, F.col("pair.n").alias("icon_name")).agg(
        F.max_by("pair.f", "pos").alias("filename"), F.min("pos").alias("ord")
    )


def load_name_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_name_map(spark.read.text(path, wholetext=True), "value")
