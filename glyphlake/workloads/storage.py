"""Corpora and index stores: written to the session's shared folder and read back."""

from pyspark.sql import functions as F

from glyphlake.session import work_folder
from glyphlake.sources import index_store
from glyphlake.sources.bucketed import BucketedIndex
from glyphlake.sources.corpus import read_svg_text, scan_svg_corpus
from glyphlake.workloads.base import named_files, table, vector_index, write_files
from glyphlake.workloads.registry import register


def svg_files(spark, sf):
    """A corpus with a file for every supplier, those of every fifth below a skipped directory, and whose each file is."""
    root = work_folder(spark)
    rows = table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("<svg id=\""), "s_name", F.lit("\"/>")).alias("value"), (F.col("s_suppkey") % 5 == 0).alias("skip")
    )
    named = [write_files(rows.where(F.col("skip") == skip), "s_suppkey", f"{root}/{place}") for skip, place in ((False, "icons"), (True, "node_modules"))]
    return scan_svg_corpus(spark, root, "*.txt"), named[0].unionByName(named[1])


@register("scan_svg_corpus", "SELECT s_suppkey, (length(s_name) + 13)::BIGINT AS length FROM supplier WHERE s_suppkey % 5 <> 0")
def scanned(spark, sf):
    files, names = svg_files(spark, sf)
    return named_files(files.select("path", "length"), names).select("s_suppkey", "length")


@register("read_svg_text", "SELECT s_suppkey, '<svg id=\"' || s_name || '\"/>' || chr(10) AS svg_content FROM supplier WHERE s_suppkey % 5 <> 0")
def svg_texts(spark, sf):
    files, names = svg_files(spark, sf)
    return named_files(read_svg_text(files), names).select("s_suppkey", "svg_content")


SQL_KIND = "CASE WHEN label % 2 = 0 THEN 'icon' ELSE 'token' END AS icon_type"


@register("write_index", f"SELECT vec_id AS doc_id, {SQL_KIND}, len(embedding) AS dims, FALSE AS again FROM embeddings")
def written(spark, sf):
    """The index written once; a second write without recreating it leaves it alone."""
    place, index = work_folder(spark), vector_index(spark, sf)
    index_store.write_index(index, place, partition_by="icon_type")
    again = index_store.write_index(index.limit(0), place, partition_by="icon_type")
    return spark.read.parquet(place).select("doc_id", "icon_type", F.size("vector").alias("dims"), F.lit(again).alias("again"))


@register(
    "bookmark",
    """SELECT source, 'v' || max(doc_id) || '.0.0' AS release_tag FROM documents WHERE source IS NOT NULL GROUP BY source""",
)
def bookmarks(spark, sf):
    """The last release of every source: an older one remembered, then the last, then one that failed."""
    place = work_folder(spark)
    tags = table(spark, sf, "documents").where("source IS NOT NULL").groupBy("source").agg(F.max("doc_id").alias("n"))
    last = F.concat(F.lit("v"), "n", F.lit(".0.0"))
    for tag, successes in ((F.lit("v0.0.1"), 1), (last, 1), (F.lit("v9.9.9"), 0)):
        run = tags.select("source", tag.alias("release_tag"), F.lit(successes).alias("successes"), F.lit(True).alias("indexing"))
        index_store.write_bookmarks(run, place)
    return index_store.read_bookmarks(spark, place)


@register(
    "save_images",
    """SELECT 'v' || doc_id % 3 AS release_tag, 'd' || doc_id AS icon_name, lang AS kind, 'v' || doc_id % 3 || '/d' || doc_id || '_' || lang || '.png' AS file,
  doc_id % 2 = 0 AS saved, CASE WHEN doc_id % 2 = 0 THEN 8 + strlen(text) END AS bytes FROM documents""",
)
def saved_images(spark, sf):
    """Documents as image bytes; the odd ones lack an image's first bytes."""
    head = F.unhex(F.when(F.col("doc_id") % 2 == 0, "89504E470D0A1A0A").otherwise("0000000000000000"))
    made = table(spark, sf, "documents").select(
        F.concat(F.lit("v"), F.col("doc_id") % 3).alias("release_tag"),
        F.concat(F.lit("d"), "doc_id").alias("icon_name"),
        F.col("lang").alias("kind"),
        F.concat(head, F.col("text").cast("binary")).alias("content"),
    )
    place = work_folder(spark)
    told = index_store.save_images(made, place)
    stored = spark.read.parquet(place).select("file", F.octet_length("content").cast("bigint").alias("bytes"))
    return told.join(stored, "file", "left").select("release_tag", "icon_name", "kind", "file", "saved", "bytes")


@register("dump", f"SELECT vec_id AS doc_id, {SQL_KIND}, count(*) OVER () AS documents FROM embeddings")
def dumped(spark, sf):
    rows, total = index_store.dump(vector_index(spark, sf))
    return rows.select("doc_id", "icon_type", F.lit(total).cast("bigint").alias("documents"))


@register("project", f"SELECT vec_id AS doc_id, {SQL_KIND}, round(embedding[1]::DOUBLE, 6) AS head FROM embeddings")
def projected(spark, sf):
    """The name and one vector's head, as read from a stored index."""
    place = work_folder(spark)
    index_store.write_index(vector_index(spark, sf), place, partition_by=None)
    return spark.read.parquet(place).select("doc_id", "icon_type", F.round(F.col("vector")[0].cast("double"), 6).alias("head"))


SQL_LABELLED = "SELECT d.doc_id, coalesce(l.quality, d.n_chars) AS n_chars, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)"


def bucketed(spark, sf):
    """The documents in 16 buckets, with the labelled ones' quality merged in as a second version."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    store = BucketedIndex.create(docs, work_folder(spark), 16)
    store.upsert(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("n_chars")))
    return store


@register(
    "bucketed_upsert",
    f"""SELECT doc_id, n_chars, lang, 2 AS version FROM ({SQL_LABELLED})
UNION ALL SELECT doc_id, quality, NULL, 2 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def merged_buckets(spark, sf):
    store = bucketed(spark, sf)
    return store.read().withColumn("version", F.lit(store.version()))


@register("bucketed_get", f"SELECT * FROM ({SQL_LABELLED}) WHERE doc_id IN (SELECT vec_id * 3 FROM embeddings)")
def read_from_buckets(spark, sf):
    return bucketed(spark, sf).get(table(spark, sf, "embeddings").select((F.col("vec_id") * 3).alias("doc_id")))
