"""Corpora of one file a row: where the files lie and whose they are."""

import os

from pyspark.sql import functions as F

from glyphlake.sources.corpus import read_svg_text, scan_svg_corpus
from glyphlake.workloads.base import named_files, write_files


def test_every_row_has_a_file_of_its_own_in_one_folder(spark, tmp_path):
    rows = spark.range(-20, 1500).select(F.col("id").alias("key"), F.concat(F.lit("<svg>"), "id").alias("value"))
    names = write_files(rows.repartition(1), "key", f"{tmp_path}/icons").unionByName(write_files(rows.where("key < 5"), "key", f"{tmp_path}/more"))
    assert not [d for _, folders, _ in os.walk(tmp_path) for d in folders if d not in ("icons", "more")]
    read = named_files(read_svg_text(scan_svg_corpus(spark, str(tmp_path), "*.txt")), names)
    found = sorted((r.key, r.svg_content) for r in read.collect())
    assert found == sorted((k, f"<svg>{k}\n") for k in [*range(-20, 1500), *range(-20, 5)])


def test_no_rows_have_no_files(spark, tmp_path):
    none = spark.range(0).select(F.col("id").alias("key"), F.lit("x").alias("value"))
    names = write_files(none, "key", f"{tmp_path}/icons")
    assert named_files(scan_svg_corpus(spark, str(tmp_path), "*.txt"), names).count() == 0
