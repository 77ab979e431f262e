"""Streaming queries, run over all input present and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.rollup import job_rollup
from lectern.plans import sql
from lectern.plans.history import REPLAYED
from lectern.plans.registry import query
from lectern.session import new_folder
from lectern.sources import views
from lectern.streaming import feeds

#: How long streams wait for events; later ones are rows of their own, merged by the batch step.
DELAY = "30 minutes"
#: How long a fragment without events is remembered.
TTL = "7 days"
LEASE = "6 hours"
PAGE = 1_000


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    code = F.coalesce(*[
        F.when(F.col("event_type") == kind, value) for kind, value in views.CODES.items()])
    return feeds.stream_table(spark, folder, "events").select(
        F.col("user_id").alias("fragment_id"), "event_id", "event_type",
        F.col("ts").cast("timestamp").alias("completed_at"), code.alias("code"))


@query("stream_progress", """
WITH l AS (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS t FROM events GROUP BY 1),
s AS (SELECT user_id % 20 AS job_id, CASE t WHEN 'purchase' THEN 'ready' WHEN 'error'
  THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'warning' END AS status FROM l),
c AS (SELECT job_id, count(CASE WHEN status = 'pending' THEN 1 END) AS pending,
  count(CASE WHEN status = 'ready' THEN 1 END) AS ready,
  count(CASE WHEN status = 'warning' THEN 1 END) AS warnings,
  count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM s GROUP BY job_id)
SELECT *, CASE WHEN pending > 0 THEN 'running' WHEN failed > 0 THEN 'failed'
  WHEN warnings > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM c""")
def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    status = (
        F.when(F.col("code") == "ready", "ready").when(F.col("code") == "failed", "failed")
        .when(F.col("code") == "text_edited", "pending").otherwise("warning"))
    events = _stream(spark, folder).withColumns({
        "job_id": F.col("fragment_id") % 20, "status": status})
    present = feeds.run_progress(events, "progress")
    return job_rollup(present.select("job_id").distinct(), present)


@query("event_feed", f"""
WITH {sql.ATTEMPTS}
SELECT event_id, fragment_id, code, epoch_us(completed_at) AS completed FROM attempts""")
def event_feed(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.run_to_folder(_stream(spark, folder), "feed").select(
        "event_id", "fragment_id", "code", F.unix_micros("completed_at").alias("completed"))


@query("event_feed_pages", f"""
WITH p AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // {PAGE} AS page FROM events),
g AS (SELECT page, max(event_id) AS last_event, count(*) AS events FROM p GROUP BY page)
SELECT page, coalesce(lag(last_event) OVER (ORDER BY page), -1) AS cursor, last_event, events FROM g""")
def event_feed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The feed as a reader with a cursor sees it; the stream is stopped and started again."""
    root = new_folder(spark, "pages")
    events = _stream(spark, folder).select("event_id", "fragment_id", "code", "completed_at")
    feeds.run(events, root)
    return feeds.feed_pages(feeds.run(events, root).rows(), PAGE)


@query("stream_dedup", f"""
WITH {sql.ATTEMPTS}
SELECT event_id, fragment_id, code FROM attempts""")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every third event is delivered twice; each must come out once."""
    times = F.when(F.col("event_id") % 3 == 0, 2).otherwise(1)
    repeated = _stream(spark, folder).withColumn(
        "_copy", F.explode(F.array_repeat(F.lit(0), times))).drop("_copy")
    key = ["fragment_id", "event_id"]
    done = feeds.run(feeds.without_repeats(repeated, key, DELAY), new_folder(spark, "dedup"))
    return feeds.all_deliveries(done, key).select("event_id", "fragment_id", "code")


def _rates_sql(span: str, slide_hours: int, copies: int) -> str:
    return f"""
WITH w AS (SELECT time_bucket(INTERVAL {slide_hours} HOUR, ts) - i * INTERVAL {slide_hours} HOUR AS s,
  event_type FROM events, range({copies}) AS r(i))
SELECT epoch_us(s) AS window_start, epoch_us(s + INTERVAL {span}) AS window_end,
  count(*) AS attempts, count(CASE WHEN event_type = 'error' THEN 1 END) AS failures,
  count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS retries
FROM w GROUP BY s"""


def _rates(spark: SparkSession, folder: str, span: str, slide: str | None) -> DataFrame:
    rates = feeds.outcome_rates(_stream(spark, folder), DELAY, span, slide)
    return feeds.all_rates(feeds.run(rates, new_folder(spark, "rates")))


@query("stream_rates", _rates_sql("1 DAY", 24, 1))
def stream_rates(spark: SparkSession, folder: str) -> DataFrame:
    return _rates(spark, folder, "1 day", None)


@query("stream_rates_sliding", _rates_sql("12 HOUR", 3, 4))
def stream_rates_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return _rates(spark, folder, "12 hours", "3 hours")


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
  + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events),
n AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts
  ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT user_id AS fragment_id, epoch_us(min(ts)) AS session_start,
  epoch_us(max(ts) + INTERVAL 6 HOUR) AS silent_from, count(*) AS beats
FROM n GROUP BY user_id, nth""")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    sessions = feeds.worker_sessions(_stream(spark, folder), DELAY, LEASE)
    return feeds.all_sessions(feeds.run(sessions, new_folder(spark, "sessions")), LEASE)


@query("stream_replay", f"""
WITH {REPLAYED} SELECT fragment_id, event_id, action, from_status, legal FROM judged""")
def stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    events = feeds.stream_table(spark, folder, "events").select(
        F.col("user_id").alias("fragment_id"), "event_id",
        F.col("ts").cast("timestamp").alias("happened_at"), views.action_column().alias("action"))
    done = feeds.run(feeds.judged_events(events, DELAY, TTL), new_folder(spark, "replay"))
    return feeds.all_judged(done).select(
        "fragment_id", "event_id", "action", "from_status", "legal")
