"""The document index as parquet: versions, point reads, the bookmark and saved images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from glyphlake.operators.joins import lookup_join


def write_index(df: DataFrame, path: str, recreate: bool = False, partition_by: str | None = "release_tag") -> bool:
    """Write the index; an existing one is kept unless ``recreate``. True if it was written."""
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    if not recreate and _exists(df.sparkSession, path):
        return False
    writer.mode("overwrite" if recreate else "errorifexists").parquet(path)
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def write_version(df: DataFrame, root: str, version: int, partition_by: str | None = "release_tag") -> str:
    """A new index state next to the old ones; the state being read is never overwritten."""
    path = f"{root.rstrip('/')}/version={version}"
    write_index(df, path, recreate=True, partition_by=partition_by)
    return path


def write_bookmarks(releases: DataFrame, path: str) -> None:
    """Remember the processed release of every source in one write: ``source, release_tag, successes, indexing``, one row a source.

    Only rows with a success and with indexing on count; the bookmarks of other sources stay.
    """
    done = releases.where((F.col("successes") >= 1) & F.col("indexing")).select("source", "release_tag")
    rows = done.withColumn("processed_at", F.current_timestamp()).repartition("source")
    rows.write.mode("overwrite").partitionBy("source").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """``source, release_tag``: the last processed release of every source that has one."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "source string, release_tag string")
    tag = F.trim("release_tag")
    return spark.read.parquet(path).select(F.col("source").cast("string").alias("source"), tag.alias("release_tag")).where(tag != "")


def write_bookmark(
    spark: SparkSession, path: str, source: str, release_tag: str, successes: int = 1, indexing: bool = True
) -> bool:
    """Remember the processed release of one source if anything succeeded and indexing was on."""
    if successes < 1 or not indexing:
        return False
    row = [(source, release_tag, successes, indexing)]
    write_bookmarks(spark.createDataFrame(row, "source string, release_tag string, successes int, indexing boolean"), path)
    return True


def read_bookmark(spark: SparkSession, path: str, source: str) -> str | None:
    """The last processed release of a source; none or a blank one gives None."""
    row = read_bookmarks(spark, path).where(F.col("source") == source).first()
    return row["release_tag"] if row else None


def image_table(rendered: DataFrame) -> DataFrame:
    """``release_tag, icon_name, kind, file, saved, content`` from rendered ``icon_name,
    release_tag, kind, content`` rows; bytes that are no PNG or JPEG are not saved."""
    head = F.hex(F.substring("content", 1, 3))
    good = F.coalesce(head.isin("89504E", "FFD8FF"), F.lit(False))
    return rendered.select(
        "release_tag",
        "icon_name",
        "kind",
        F.concat_ws("/", "release_tag", F.concat("icon_name", F.lit("_"), "kind", F.lit(".png"))).alias("file"),
        good.alias("saved"),
        F.when(good, F.col("content")).alias("content"),
    )


def save_images(rendered: DataFrame, path: str) -> DataFrame:
    """Write decodable images to a table partitioned by release; returns what was saved or not."""
    images = image_table(rendered)
    images.where("saved").drop("saved").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "release_tag"
    ).parquet(path)
    return images.drop("content")


def get(index: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of the asked ids; unknown ids give no row."""
    return lookup_join(index, ids.select(id_col).distinct(), id_col, "left_semi")


def exists(index: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The asked ids with a flag telling whether the index holds them."""
    asked = ids.select(id_col).distinct()
    found = get(index.select(id_col), asked, id_col).withColumn("found", F.lit(True))
    return asked.join(found, id_col, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def dump(index: DataFrame, n: int | None = None, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """The documents in the order of their ids, with ``n`` the first so many, and how many there are in all."""
    ordered = index.orderBy(id_col)
    return (ordered if n is None else ordered.limit(n)), index.count()
