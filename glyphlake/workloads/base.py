"""Tables the registered queries read, all derived from whole input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_out(df: DataFrame) -> DataFrame:
    """Rows over all cores when the table is read in fewer tasks than there are cores.

    For work that is heavy per row, such as encoding; a table of many tasks stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_files(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """The ``value`` of every row as a text file of its own in ``folder``: ``place, task, file, key`` tells which file has which key.

    Tasks number their files. A directory for each key instead would be made, renamed by the driver and listed one by one.
    """
    placed = cut_lineage(rows.select(key, "value").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism))
    placed = placed.withColumn("__at", F.monotonically_increasing_id())
    # Tasks put their files in place themselves; in a folder of this run alone a repeated task overwrites its own.
    files = placed.select("value").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    files.text(folder)
    task, file = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(F.lit(folder.rsplit("/", 1)[-1]).alias("place"), task.alias("task"), file.alias("file"), key)


def named_files(files: DataFrame, names: DataFrame) -> DataFrame:
    """Files read back, each with the key that ``write_files`` told for it."""
    pattern = r"([^/]+)/part-(\d+)-[^/]*-c(\d+)\.txt$"
    place, task, file = (F.regexp_extract("path", pattern, i) for i in (1, 2, 3))
    found = files.withColumns({"place": place, "task": task.cast("bigint"), "file": file.cast("bigint")})
    return found.join(names, ["place", "task", "file"]).drop("place", "task", "file")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as an index: doc_id, vector, icon_type."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.col("embedding").alias("vector"),
        "label",
        F.when(F.col("label") % 2 == 0, F.lit("icon")).otherwise(F.lit("token")).alias("icon_type"),
    )


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of all its vectors. Labels are few, dimensions fixed."""
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = long.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector")
    )


def text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with dense text vectors."""
    from glyphlake.operators.encoders import embed_text

    return embed_text(documents(spark, sf_dir), "text", "text_embedding").drop("text")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.operators.encoders import embed_text

    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return embed_text(asked, "text", "vector")


def requests_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as requests: key, at (microseconds), event_id, event_type."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type"
    )


# ---- the same tables for the checking SQL ---------------------------------------------------

SQL_VECTORS = """idx AS (
  SELECT vec_id AS doc_id, embedding::DOUBLE[] AS vector, label,
         CASE WHEN label % 2 = 0 THEN 'icon' ELSE 'token' END AS icon_type
  FROM embeddings)"""

SQL_CENTROIDS = """q AS (
  SELECT label::BIGINT AS query_id, list(x ORDER BY pos) AS qv
  FROM (SELECT label, pos, avg(x::DOUBLE) AS x
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
        GROUP BY label, pos)
  GROUP BY label)"""


def sql_tokens(table_name: str, id_col: str, name: str) -> str:
    return f"""{name} AS (
  SELECT {id_col} AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM {table_name})"""


def sql_text_vectors(table_name: str, id_col: str, name: str, dims: int = 384) -> str:
    """CTEs ``<name>_tok`` and ``<name>(id, v)``: hashed text vectors in single precision."""
    return f"""{sql_tokens(table_name, id_col, name + '_tok')},
{name}_dim AS (
  SELECT id, ('0x' || substr(md5(token), 1, 8))::BIGINT % {dims} AS dim,
         sum(1 - 2 * (('0x' || substr(md5(token), 9, 1))::BIGINT % 2))::DOUBLE AS x
  FROM {name}_tok GROUP BY ALL),
{name}_raw AS (
  SELECT t.{id_col} AS id, list(coalesce(d.x, 0) ORDER BY g.dim) AS r, sqrt(sum(coalesce(d.x * d.x, 0))) AS n
  FROM {table_name} t CROSS JOIN (SELECT unnest(range({dims})) AS dim) g
  LEFT JOIN {name}_dim d ON d.id = t.{id_col} AND d.dim = g.dim
  GROUP BY t.{id_col}),
{name} AS (
  SELECT id, list_transform(r, lambda x: CASE WHEN n > 0 THEN (x / n)::FLOAT ELSE 0::FLOAT END) AS v FROM {name}_raw)"""


SQL_DOC_VECTORS = sql_text_vectors("documents", "doc_id", "dv")
SQL_QUERY_VECTORS = sql_text_vectors("benchmark", "item_id", "qv")


def sql_cos(a: str, b: str) -> str:
    return f"round(coalesce(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 0), 9)"


SQL_REQUESTS = """ev AS (
  SELECT user_id AS key, epoch_us(ts) AS "at", event_id, event_type FROM events)"""
