"""The streaming jobs over the events and documents, drained into a table and read back."""

from pyspark.sql import functions as F

from glyphlake.operators.upsert import latest_fields
from glyphlake.session import ROCKSDB, work_folder
from glyphlake.streaming.indexing import compact, micro_batch_index, read_compacted, read_status, read_updates
from glyphlake.streaming.limits import rate_limit_stream
from glyphlake.streaming.windows import debounce_stream, span_metrics_stream
from glyphlake.workloads.base import SQL_REQUESTS, table
from glyphlake.workloads.registry import register
from glyphlake.workloads.requests import DAY, HOUR, sql_judged, sql_limited

# Later than all events: an event of this time, alone in the last trigger, moves the watermark past the others.
END = "2100-01-01 00:00:00"


def event_stream(spark, sf):
    """The events as a stream of files, closed by a far event."""
    place = work_folder(spark)
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    far = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit(END).cast("timestamp").alias("ts"), F.lit(-1).cast("bigint").alias("user_id"),
        F.lit("end").alias("event_type"), F.lit(0.0).alias("value"),
    )
    events.write.parquet(f"{place}/a")
    first = spark.readStream.schema(events.schema).parquet(f"{place}/a")
    return place, first, far.select(*[F.col(f.name).cast(f.dataType) for f in events.schema.fields]), events.schema


def drained(spark, sf, job):
    """Rows that a job over the events has written once everything is read and the watermark has passed all."""
    place, _, far, schema = event_stream(spark, sf)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream = spark.readStream.schema(schema).parquet(f"{place}/[ab]")
    for closing in (False, True):
        # The far event comes in a run of its own, so that no event is late.
        if closing:
            far.write.parquet(f"{place}/b")
        query = (
            job(stream).writeStream.format("parquet").option("checkpointLocation", f"{place}/state").option("path", f"{place}/out")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(f"{place}/out")


@register("rate_limit_stream", f"WITH RECURSIVE {SQL_REQUESTS}, {sql_judged(2, DAY)} {sql_limited(2, DAY)}")
def limited_stream(spark, sf):
    def job(events):
        named = events.select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"), "event_id")
        return rate_limit_stream(named, 2, DAY)

    return drained(spark, sf, job).where("key >= 0")


@register(
    "debounce_stream",
    f"""WITH {SQL_REQUESTS} SELECT key, event_id FROM (
  SELECT *, lead("at") OVER (PARTITION BY key ORDER BY "at", event_id) - "at" AS gap FROM ev) WHERE gap IS NULL OR gap >= {HOUR}""",
)
def settled_stream(spark, sf):
    def job(events):
        return debounce_stream(events.select(F.col("user_id").alias("key"), "ts", "event_id"), "key", gap="1 hour")

    return drained(spark, sf, job).where("key >= 0").select("key", "event_id")


@register(
    "span_metrics_stream",
    """SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type AS route, count(*) AS requests,
  round(avg(CASE WHEN value >= 20 THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events GROUP BY 1, 2""",
)
def latency_stream(spark, sf):
    def job(events):
        failed = (F.col("value") >= 20).alias("failed")
        spans = events.select("ts", F.col("event_type").alias("route"), F.col("value").alias("duration_ms"), failed)
        return span_metrics_stream(spans, "1 hour")

    rows = drained(spark, sf, job).where("route <> 'end'")
    return rows.select(F.unix_micros("window_start").alias("window_start"), "route", "requests", F.round("error_rate", 6).alias("error_rate"))


@register(
    "micro_batch_index",
    """WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN length(text) END AS n FROM documents)
SELECT doc_id, n, (SELECT count(*) FROM d) AS total, (SELECT count(n) FROM d) AS success FROM d WHERE n IS NOT NULL""",
)
def indexed_stream(spark, sf):
    """Documents indexed in micro-batches; those not in English fail."""
    place = work_folder(spark)
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    docs.write.parquet(f"{place}/in")

    def encode(batch):
        good = F.col("lang") == "en"
        return batch.select("doc_id", F.length("text").cast("bigint").alias("n"), F.when(good, F.lit(None)).otherwise("no text").alias("error"))

    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 4).parquet(f"{place}/in")
    micro_batch_index(stream, encode, f"{place}/log", f"{place}/state", pause=None).awaitTermination()
    status = read_status(spark, f"{place}/log").first()
    rows = latest_fields(read_updates(spark, f"{place}/log"), "batch_id")
    return rows.select("doc_id", "n", F.lit(status["total"]).alias("total"), F.lit(status["success"]).alias("success"))


@register(
    "compact",
    """WITH t AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS pos, text, role, turn FROM conversations)
SELECT doc_id, pos, md5(text) AS digest, arg_max(role, turn) OVER (PARTITION BY doc_id) AS last_role, 2 AS version FROM t""",
)
def compacted_log(spark, sf):
    """The turns as a log of two batches, merged after each batch and, without effect, once more."""
    root, log = work_folder(spark), work_folder(spark)
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("description"), F.col("role"), "turn")
    none = turns.limit(0)
    versions = []
    for batch, part in enumerate((turns.where("turn < 2"), turns.where("turn >= 2"))):
        part.write.parquet(f"{log}/updates/batch_id={batch}")
        for _ in range(2):
            versions.append(compact(spark, root, log, "turn", none.select("doc_id", "role"), none.select("doc_id", F.lit(0).cast("bigint").alias("pos"), "description")))
    documents, texts = read_compacted(spark, root)
    rows = texts.join(documents, "doc_id").select("doc_id", "pos", F.md5("description").alias("digest"), F.col("role").alias("last_role"))
    return rows.withColumn("version", F.lit(versions[-1]))
