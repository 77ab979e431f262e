"""Contract audits in one pass a table, metric sketches, and the keys of all stages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import keys
from lectern.functions.audio import MAX_REFERENCE_BYTES
from lectern.operators import chapters as ch
from lectern.operators import contracts as co
from lectern.operators import rollup as ro
from lectern.plans import sql
from lectern.plans.registry import query
from lectern.sources import views


@query("contract_fragments", f"""
WITH {sql.FRAGMENTS}, {sql.JOBS},
f AS (SELECT CASE WHEN job_id % 19 = 0 THEN job_id + 1000000000 ELSE job_id END AS job_id,
    CASE WHEN job_id % 11 = 0 AND ordinal = 2 THEN 1 ELSE ordinal END AS ordinal,
    CASE WHEN job_id % 23 = 0 THEN 'lost' ELSE status END AS status,
    CASE WHEN job_id % 7 = 0 AND ordinal = 1 THEN -duration_ms ELSE duration_ms END AS duration_ms,
    samples FROM fragments),
c AS (SELECT job_id, count(*) AS n, count(CASE WHEN status IN ('pending', 'generating') THEN 1 END)
    AS pending, count(CASE WHEN status = 'ready' THEN 1 END) AS ready,
  count(CASE WHEN status = 'warning' THEN 1 END) AS warnings,
  count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM f GROUP BY job_id),
j AS (SELECT job_id, CASE WHEN job_id % 29 = 0 THEN -1 ELSE book_id END AS book_id,
    coalesce(n, 0) AS fragments_count, coalesce(pending, 0) + (job_id % 13 = 0)::INT AS pending,
    coalesce(ready, 0) - (job_id % 17 = 0)::INT AS ready, coalesce(warnings, 0) AS warnings,
    coalesce(failed, 0) + (job_id % 17 = 0)::INT AS failed,
    coalesce(pending, 0) AS p, coalesce(ready, 0) AS r, coalesce(warnings, 0) AS w,
    coalesce(failed, 0) AS x FROM jobs LEFT JOIN c USING (job_id))
SELECT 'fragment_status' AS rule, count(*) AS rows_checked, count(CASE WHEN status NOT IN
  ('pending', 'generating', 'ready', 'warning', 'failed') THEN 1 END) AS violations FROM f
UNION ALL SELECT 'fragment_duration', count(*), count(CASE WHEN duration_ms < 0 THEN 1 END) FROM f
UNION ALL SELECT 'fragment_samples', count(*), count(CASE WHEN samples <> duration_ms * 24
  THEN 1 END) FROM f
UNION ALL SELECT 'fragment_ordinal_unique', sum(n), count(CASE WHEN n > 1 THEN 1 END) FROM
  (SELECT count(*) AS n FROM f GROUP BY job_id, ordinal)
UNION ALL SELECT 'fragment_job', count(*), count(CASE WHEN job_id NOT IN
  (SELECT job_id FROM jobs) THEN 1 END) FROM f
UNION ALL SELECT 'job_counters_total', count(*), count(CASE WHEN pending + ready + warnings + failed
  <> fragments_count THEN 1 END) FROM j
UNION ALL SELECT 'job_counters_stored', count(*), count(CASE WHEN pending <> p OR ready <> r
  OR warnings <> w OR failed <> x THEN 1 END) FROM j
UNION ALL SELECT 'job_book', count(*), count(CASE WHEN book_id NOT IN
  (SELECT c_custkey FROM customer) THEN 1 END) FROM j""")
def contract_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs and fragments with planted faults against every rule."""
    job, ordinal = F.col("job_id"), F.col("ordinal")
    fragments = views.fragments(spark, folder).select(
        F.when(job % 19 == 0, job + 1_000_000_000).otherwise(job).alias("job_id"),
        F.when((job % 11 == 0) & (ordinal == 2), 1).otherwise(ordinal).alias("ordinal"),
        F.when(job % 23 == 0, "lost").otherwise(F.col("status")).alias("status"),
        F.when((job % 7 == 0) & (ordinal == 1), -F.col("duration_ms"))
        .otherwise(F.col("duration_ms")).alias("duration_ms"), "samples")
    jobs = views.jobs(spark, folder)
    counts = fragments.groupBy("job_id").agg(F.count("*").alias("fragments_count"))
    derived = ro.job_rollup(jobs.select("job_id"), fragments).drop("status").join(
        counts, "job_id", "left").fillna(0, ["fragments_count"])
    stored = jobs.select("job_id", F.when(job % 29 == 0, -1).otherwise(F.col("book_id"))
                         .alias("book_id")).join(derived, "job_id").withColumns({
                             "pending": F.col("pending") + (job % 13 == 0).cast("int"),
                             "ready": F.col("ready") - (job % 17 == 0).cast("int"),
                             "failed": F.col("failed") + (job % 17 == 0).cast("int")})
    books = views.table(spark, folder, "customer").select(F.col("c_custkey").alias("book_id"))
    return co.audit_fragments(fragments, stored, books)


@query("contract_attempts", f"""
WITH {sql.ATTEMPTS},
a AS (SELECT fragment_id, CASE WHEN event_id % 101 = 0 THEN attempt - 1 ELSE attempt END AS attempt
  FROM attempts),
g AS (SELECT attempt, count(*) AS n FROM a GROUP BY fragment_id, attempt)
SELECT 'attempt_unique' AS rule, sum(n) AS rows_checked, sum(n - 1) AS violations FROM g
UNION ALL SELECT 'attempt_number', sum(n), sum(CASE WHEN attempt < 1 THEN n ELSE 0 END) FROM g""")
def contract_attempts(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("attempt")
    return co.audit_attempts(views.attempts(spark, folder).select("fragment_id", F.when(
        F.col("event_id") % 101 == 0, number - 1).otherwise(number).alias("attempt")))


@query("contract_voices", f"""
WITH v AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN '' WHEN s_suppkey % 25 = 1
    THEN repeat('x', {MAX_REFERENCE_BYTES} + 1) ELSE s_name END AS data,
  length(s_name) + (s_suppkey % 9 = 0)::INT AS size_bytes FROM supplier)
SELECT 'voice_size' AS rule, count(*) AS rows_checked, count(CASE WHEN length(data) NOT BETWEEN 1
  AND {MAX_REFERENCE_BYTES} THEN 1 END) AS violations FROM v
UNION ALL SELECT 'voice_size_stored', count(*), count(CASE WHEN length(data) <> size_bytes
  THEN 1 END) FROM v""")
def contract_voices(spark: SparkSession, folder: str) -> DataFrame:
    key, name = F.col("s_suppkey"), F.col("s_name")
    voices = views.table(spark, folder, "supplier").select(
        F.when(key % 10 == 0, "").when(key % 25 == 1, F.repeat(
            F.lit("x"), F.lit(MAX_REFERENCE_BYTES + 1))).otherwise(name).alias("data"),
        (F.octet_length(name) + (key % 9 == 0).cast("int")).alias("size_bytes"))
    return co.audit_voices(voices, MAX_REFERENCE_BYTES)


@query("contract_rewrites", f"""
WITH {sql.REWRITES},
i AS (SELECT item_id // 10 AS task_id, CASE WHEN item_id % 19 = 0 THEN 'pending'
    WHEN item_id % 6 = 5 THEN 'failed' ELSE 'completed' END AS status,
  original <> rewritten AS changed,
  CASE WHEN (original <> rewritten) <> (item_id % 23 = 0) THEN 'r' || item_id END AS revision_id
  FROM rewrites),
t AS (SELECT task_id, count(*) AS n, count(CASE WHEN status = 'pending' THEN 1 END) AS p,
  count(CASE WHEN status = 'completed' THEN 1 END) AS c,
  count(CASE WHEN status = 'failed' THEN 1 END) AS f FROM i GROUP BY task_id),
s AS (SELECT *, p + (task_id % 5 = 0)::INT AS sp, c - (task_id % 7 = 0)::INT AS sc,
  f + (task_id % 7 = 0)::INT AS sf FROM t)
SELECT 'rewrite_revision' AS rule, count(*) AS rows_checked, count(CASE WHEN changed <>
  (revision_id IS NOT NULL) THEN 1 END) AS violations FROM i
UNION ALL SELECT 'rewrite_unchanged', count(*), count(CASE WHEN changed AND status <> 'completed'
  THEN 1 END) FROM i
UNION ALL SELECT 'rewrite_counters_total', count(*), count(CASE WHEN sp + sc + sf <> n THEN 1 END)
  FROM s
UNION ALL SELECT 'rewrite_counters_stored', count(*), count(CASE WHEN sp <> p OR sc <> c
  OR sf <> f THEN 1 END) FROM s""")
def contract_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    number, task = F.col("item_id"), F.floor(F.col("item_id") / 10)
    changed = F.col("original") != F.col("rewritten")
    items = views.rewrites(spark, folder).select(
        task.alias("task_id"), F.when(number % 19 == 0, "pending").when(number % 6 == 5, "failed")
        .otherwise("completed").alias("status"), changed.alias("changed"),
        F.when(changed != (number % 23 == 0), F.concat(F.lit("r"), number.cast("string")))
        .alias("revision_id"))
    tasks = items.groupBy("task_id").agg(
        F.count("*").alias("fragments_count"), *[
            (F.count_if(F.col("status") == kind) + shift).alias(f"stored_{kind}")
            for kind, shift in (
                ("pending", (F.col("task_id") % 5 == 0).cast("int")),
                ("completed", -(F.col("task_id") % 7 == 0).cast("int")),
                ("failed", (F.col("task_id") % 7 == 0).cast("int")))])
    return co.audit_rewrites(items.join(tasks, "task_id"))


METRICS = f"""{sql.ATTEMPTS},
m AS (SELECT CAST(completed_at AS DATE) AS day, CASE code WHEN 'ready' THEN 'ready'
    WHEN 'failed' THEN 'failed' WHEN 'text_edited' THEN 'edited' ELSE 'warning' END AS status,
  CASE WHEN code = 'ready' THEN '' ELSE code END AS reason, processing_ms,
  1000 + event_id % 5000 AS audio_ms FROM attempts)"""


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    code = F.col("code")
    return views.attempt_log(spark, folder).select(
        F.to_date("completed_at").alias("day"),
        F.when(code.isin("ready", "failed"), code).when(code == "text_edited", "edited")
        .otherwise("warning").alias("status"),
        F.when(code == "ready", "").otherwise(code).alias("reason"), "processing_ms",
        (F.col("event_id") % 5_000 + 1_000).alias("audio_ms"))


GRAINS = {"reason": ["day", "status", "reason"], "status": ["day", "status"], "day": ["day"],
          "all_days": ["status", "reason"]}


@query("metric_rollup", f"WITH {METRICS}\n" + "\nUNION ALL ".join(
    f"""SELECT '{grain}' AS grain, {', '.join(
        name if name in names else f"NULL AS {name}" for name in ("day", "status", "reason"))},
  count(*) AS attempts, sum(processing_ms) AS processing_ms, sum(audio_ms) AS audio_ms,
  round(sum(processing_ms) / sum(audio_ms), 6) AS real_time_factor, true AS p50_holds,
  true AS p95_holds FROM m GROUP BY {', '.join(names)}""" for grain, names in GRAINS.items()))
def metric_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches per day, status and reason, merged upwards; each quantile's rank is checked."""
    log = _metrics(spark, folder)
    finest = ro.metric_sketches(log, GRAINS["reason"])
    parts = []
    for grain, names in GRAINS.items():
        sketches = finest if grain == "reason" else ro.merged_sketches(finest, names)
        rows = ro.with_quantiles(sketches, {"p50": 0.5, "p95": 0.95})
        for name, share in (("p50", 0.5), ("p95", 0.95)):
            error = ro.rank_error(log, rows, names, name, share)
            rows = rows.join(error.withColumnRenamed("rank_error", f"{name}_error"), names)
        empty = [F.lit(None).cast("date" if name == "day" else "string").alias(name)
                 for name in ("day", "status", "reason") if name not in names]
        parts.append(rows.select(
            F.lit(grain).alias("grain"), *names, *empty, "attempts", "processing_ms", "audio_ms",
            F.round(F.col("processing_ms") / F.col("audio_ms"), 6).alias("real_time_factor"),
            *[(F.col(f"{name}_error") <= ro.RANK_ERROR).alias(f"{name}_holds")
              for name in ("p50", "p95")]))
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


MOST_FAILURES, MOST_RETRIES = 0.1, 0.6


@query("metric_alerts", f"""
WITH {METRICS},
r AS (SELECT day, count(*) AS attempts, count(CASE WHEN status = 'failed' THEN 1 END) / count(*)
    AS failure_ratio, count(CASE WHEN status = 'warning' THEN 1 END) / count(*) AS retry_ratio
  FROM m GROUP BY day)
SELECT *, failure_ratio > {MOST_FAILURES} AS failures_alert, retry_ratio > {MOST_RETRIES}
  AS retries_alert FROM r""")
def metric_alerts(spark: SparkSession, folder: str) -> DataFrame:
    sketches = ro.metric_sketches(_metrics(spark, folder), GRAINS["reason"])
    return ro.daily_alerts(sketches, MOST_FAILURES, MOST_RETRIES)


def _attempt_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One to three attempts of every fragment of the books, the last one chosen."""
    fragments = ch.fragment_rows(ch.with_chapters(views.books_with_blocks(spark, folder)))
    voice = keys.voice_key(F.lit("clone"), F.lit("reference"), F.lit("text"), F.lit(""), {"pace": 1})
    times = (F.col("ordinal") % 3 + 1).cast("int")
    rows = fragments.select(
        "book_id", "chapter_number", "ordinal", F.sha2(F.encode("text", "UTF-8"), 256)
        .alias("text_hash"), (F.col("words") * 9_600).alias("samples"), times.alias("times"))
    return rows.withColumn("attempt", F.explode(F.sequence(F.lit(1), "times"))).select(
        "*", (F.col("attempt") == F.col("times")).alias("chosen"), voice.alias("voice_hash"),
        (F.col("book_id") * 1_000 + F.col("ordinal") * 10 + F.col("attempt")).alias("seed"))


#: The version that changes, and the value it takes.
CHANGES = {"contract": "2", "stt_version": "2", "validation": "2", "encoder": "2"}


def _keys_sql(name: str, versions: keys.Versions) -> str:
    def text(*parts: str) -> str:
        return f"sha256(concat_ws(chr(0), {', '.join(parts)}))"

    v = versions
    voice = text("'voice-profile-v1'", "'clone'", "'reference'", "'text'", "''",
                 "'" + keys.canonical_json({"pace": 1}) + "'")
    generate = text("'generate-v1'", "sha256(text)", voice, "attempt::VARCHAR",
                    "(book_id * 1000 + ordinal * 10 + attempt)::VARCHAR",
                    f"'{v.speech_model}'", f"'{v.speech_version}'", f"'{v.contract}'")
    stt = text("'stt-v1'", "g", f"'{v.stt_model}'", f"'{v.stt_version}'", f"'{v.language}'",
               f"'{str(v.words).lower()}'")
    validation = text("'validation-v1'", "g", "sha256(text)", "s", f"'{v.validation}'",
                      f"'{keys.canonical_json(v.profile)}'")
    export = text("'export-v1'", "string_agg(g, ',' ORDER BY ordinal)",
                  "string_agg((words * 9600)::VARCHAR, ',' ORDER BY ordinal)",
                  f"'{keys.canonical_json(v.export)}'", f"'{v.metadata}'", f"'{v.encoder}'")
    return f"""
{name}_g AS (SELECT *, {generate} AS g FROM tries),
{name}_s AS (SELECT *, {stt} AS s FROM {name}_g),
{name} AS (
  SELECT 'generate' AS kind, concat_ws(':', book_id, ordinal, attempt) AS item, g AS key FROM {name}_s
  UNION ALL SELECT 'stt', concat_ws(':', book_id, ordinal, attempt), s FROM {name}_s
  UNION ALL SELECT 'validation', concat_ws(':', book_id, ordinal, attempt), {validation} FROM {name}_s
  UNION ALL SELECT 'export', concat_ws(':', book_id, chapter_number), {export} FROM {name}_g
    WHERE attempt = ordinal % 3 + 1 GROUP BY book_id, chapter_number)"""


TRIES = f"""{sql.BOOK_FRAGMENTS},
tries AS (SELECT *, unnest(range(1, (ordinal % 3 + 2)::BIGINT)) AS attempt FROM book_fragments)"""


@query("stage_keys", f"""
WITH {TRIES}, {_keys_sql("k", keys.Versions())} SELECT kind, item, key FROM k""")
def stage_keys(spark: SparkSession, folder: str) -> DataFrame:
    return keys.key_graph(_attempt_rows(spark, folder), keys.Versions()).select(
        "kind", "item", "key")


@query("stale_keys", f"WITH {TRIES}, {_keys_sql('k', keys.Versions())}, " + ", ".join(
    _keys_sql(name, replace(keys.Versions(), **{name: value})) for name, value in CHANGES.items())
    + " UNION ALL ".join(f"""
SELECT '{name}' AS changed, kind, count(*) AS stale FROM {name} WHERE NOT EXISTS
  (SELECT 1 FROM k WHERE k.kind = {name}.kind AND k.key = {name}.key) GROUP BY kind"""
                         for name in CHANGES))
def stale_keys(spark: SparkSession, folder: str) -> DataFrame:
    """What must be made anew if one version changes: its own stage and those after it."""
    return keys.stale_counts(_attempt_rows(spark, folder), keys.Versions(), {
        name: replace(keys.Versions(), **{name: value}) for name, value in CHANGES.items()})
