"""What the operators share: word rules, tables kept in the shared folder, Arrow batch bounds."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these six characters.
GAP_CHARS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"

ARROW_ROWS = 2048
ARROW_BYTES = 32 * 1024 * 1024

#: With it Spark deletes the shuffle files of a query when it has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application: below ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder and a cluster is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all nodes share")
        folder = _local_folders.setdefault(context.applicationId, tempfile.mkdtemp(prefix="glyphlake-work-"))
    return f"{folder.rstrip('/')}/glyphlake-work/{context.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as parquet to the shared folder and read back: lineage is cut, columns stay prunable.

    Survives lost executors, and is computed once however often it is read.
    """
    return _written(df, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}")


def _written(df: DataFrame, place: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_SHUFFLES, "false")
    # Nothing reads the shuffles of a table that is written; else they would stay until the driver collects garbage.
    conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(place)
    finally:
        conf.set(CLEAN_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Stored tables that go together, once all that was made of them is stored itself."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def stored(self, df: DataFrame) -> DataFrame:
        return _written(df, f"{self.folder}/{uuid.uuid4().hex}")

    def clear(self) -> None:
        _delete(self.spark, self.folder)


def clear_stored(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once their results have been written."""
    _delete(spark, shared_folder(spark))


def bound_arrow(spark: SparkSession) -> None:
    """Bound the batches that Python tasks get, so that a batch of very long texts fits in memory."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def united_bits(words: DataFrame, bits: int) -> np.ndarray:
    """The union of rows ``(word, held)`` as a set of ``2 ** bits`` bits in 64-bit words: at most as many rows reach the driver."""
    united = words.groupBy("word").agg(F.bit_or("held").alias("held"))
    found = np.zeros(1 << max(bits - 6, 0), np.int64)
    for batch in united.toArrow().to_batches():
        found[batch.column("word").to_numpy()] = batch.column("held").to_numpy()
    return found.view(np.uint64)
