"""Rate limits, bursts and latency over the events."""

from pyspark.sql import functions as F

from glyphlake.operators.ratelimit import expire_state, multi_limit, rate_limit, state_at_end
from glyphlake.operators.runs import span_metrics
from glyphlake.operators.timeline import debounce
from glyphlake.workloads.base import SQL_REQUESTS, requests_by_user, table
from glyphlake.workloads.registry import register

HOUR, DAY = 3_600_000_000, 86_400_000_000


def sql_judged(limit: int, window: int, source: str = "ev", name: str = "judged") -> str:
    """CTEs ending in ``<name>(key, at, event_id, opened, rank)``."""
    return f"""{name}_open(key, opened) AS (
  SELECT key, min("at") FROM {source} GROUP BY key
  UNION ALL
  SELECT o.key, min(e."at") FROM {name}_open o JOIN {source} e ON e.key = o.key AND e."at" > o.opened + {window} GROUP BY o.key),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY key, opened ORDER BY "at", event_id) AS rank FROM (
    SELECT e.key, e."at", e.event_id, max(o.opened) AS opened
    FROM {source} e JOIN {name}_open o ON o.key = e.key AND o.opened <= e."at" GROUP BY ALL))"""


def sql_limited(limit: int, window: int, name: str = "judged") -> str:
    return f"""SELECT key, "at", event_id, rank <= {limit} AS allowed, (greatest({limit} - rank, 0))::BIGINT AS remaining,
  opened + {window} AS reset FROM {name}"""


@register("rate_limit", f"WITH RECURSIVE {SQL_REQUESTS}, {sql_judged(2, DAY)} {sql_limited(2, DAY)}")
def limited(spark, sf):
    events = requests_by_user(spark, sf).drop("event_type")
    return rate_limit(events, 2, DAY).withColumn("remaining", F.col("remaining").cast("bigint"))


SQL_TYPES = 'ty AS (SELECT event_type AS key, epoch_us(ts) AS "at", event_id FROM events)'


@register(
    "rate_limit_busy_keys",
    f"WITH RECURSIVE {SQL_TYPES}, {sql_judged(10, DAY, 'ty')} {sql_limited(10, DAY)}",
)
def limited_by_type(spark, sf):
    """Five keys hold all events, so every key takes the path for busy keys."""
    events = requests_by_user(spark, sf).select(F.col("event_type").alias("key"), "at", "event_id")
    return rate_limit(events, 10, DAY, fold_rows=1000).withColumn("remaining", F.col("remaining").cast("bigint"))


LIMITS = [("default", 2, DAY), ("default", 1, HOUR), ("search", 1, DAY)]


@register(
    "multi_limit",
    f"""WITH RECURSIVE {SQL_REQUESTS}, de AS (SELECT * FROM ev WHERE event_type <> 'view'), se AS (SELECT * FROM ev WHERE event_type = 'view'),
{sql_judged(2, DAY, 'de', 'a')}, {sql_judged(1, HOUR, 'de', 'b')}, {sql_judged(1, DAY, 'se', 'c')},
j AS (SELECT event_id, rank <= 2 AS ok FROM a UNION ALL SELECT event_id, rank <= 1 FROM b UNION ALL SELECT event_id, rank <= 1 FROM c)
SELECT event_id, bool_and(ok) AS allowed, count(*) FILTER (NOT ok) AS limits_hit FROM j GROUP BY event_id""",
)
def limited_by_group(spark, sf):
    group = F.when(F.col("event_type") == "view", "search").otherwise("default")
    return multi_limit(requests_by_user(spark, sf).withColumn("limit_group", group), LIMITS)


SQL_STATE = """st AS (SELECT key, opened, least(count(*), 2) AS count FROM judged GROUP BY key, opened),
fin AS (SELECT key, arg_max(count, opened)::BIGINT AS count, max(opened) + 86400000000 AS reset FROM st GROUP BY key)"""


@register(
    "expire_state",
    f"""WITH RECURSIVE {SQL_REQUESTS}, {sql_judged(2, DAY)}, {SQL_STATE}
SELECT * FROM fin WHERE reset >= 1706659200000000""",
)
def unexpired(spark, sf):
    state = state_at_end(requests_by_user(spark, sf), 2, DAY)
    return expire_state(state, 1_706_659_200_000_000)


@register(
    "debounce",
    f"""WITH {SQL_REQUESTS} SELECT key, "at", event_id, event_type FROM (
  SELECT *, lead("at") OVER (PARTITION BY key ORDER BY "at", event_id) - "at" AS gap FROM ev) WHERE gap IS NULL OR gap >= {HOUR}""",
)
def settled(spark, sf):
    return debounce(requests_by_user(spark, sf), "key", "at", HOUR, tie="event_id")


@register(
    "span_metrics",
    """SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type AS route, count(*) AS requests,
  round(avg(CASE WHEN value >= 20 THEN 1.0 ELSE 0.0 END), 6) AS error_rate, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1, 2""",
)
def latencies(spark, sf):
    spans = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("route"), F.col("value").alias("duration_ms"),
        (F.col("value") >= 20).alias("failed"),
    )
    found = span_metrics(spans, "1 hour").withColumn("window_start", F.unix_micros("window_start"))
    return found.select("window_start", "route", "requests", *[F.round(c, 6).alias(c) for c in ("error_rate", "p50", "p95", "p99")])
