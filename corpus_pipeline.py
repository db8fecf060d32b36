"""From raw documents to token ids: quality rules, near copies, secrets, the mix of sources, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.bpe import Bpe
from glyphlake.llm.common import bound_arrow, stored, table
from glyphlake.llm.mixing import Mix
from glyphlake.llm.quality_rules import kept_rows
from glyphlake.llm.secrets import redact
from glyphlake.llm.simhash import one_of_each_group
from glyphlake.session import ship_package

# Several stages have no counterpart in SQL; the tests compare them with plain versions.
ORACLE_SQL = None


def _prepared(spark: SparkSession) -> None:
    ship_package(spark)
    bound_arrow(spark)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; all columns as they were."""
    return kept_rows(docs, lang="lang")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    _prepared(spark)
    return one_of_each_group(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with a mark in place of every secret; n_chars counts the new text."""
    _prepared(spark)
    clean = docs.withColumn("text", redact("text"))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every draw of a document, with the words taken; n_chars counts the new text."""
    mixed = Mix(docs).texts()
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    _prepared(spark)
    bpe = Bpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = docs.select("doc_id", "lang", "source", bpe.encode("text").alias("ids"))
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", reject_poor),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", remove_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each but the last returns is written and read again."""
    _prepared(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs)
    return docs
