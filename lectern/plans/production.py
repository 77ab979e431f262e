"""Queries over jobs and their fragments: lists, joins, roll-ups, exports, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import with_file_name
from lectern.operators import contracts as co
from lectern.operators import export as ex
from lectern.operators import rollup as ro
from lectern.operators import selection as se
from lectern.plans import sql
from lectern.plans.registry import query
from lectern.sources import views


def micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


@query("job_rollup", f"""
WITH {sql.FRAGMENTS}, {sql.JOBS},
c AS (SELECT j.job_id, count(CASE WHEN f.status IN ('pending', 'generating') THEN 1 END)
    AS pending, count(CASE WHEN f.status = 'ready' THEN 1 END) AS ready,
  count(CASE WHEN f.status = 'warning' THEN 1 END) AS warnings,
  count(CASE WHEN f.status = 'failed' THEN 1 END) AS failed
  FROM jobs j LEFT JOIN fragments f USING (job_id) GROUP BY j.job_id)
SELECT *, CASE WHEN pending > 0 THEN 'running' WHEN failed > 0 THEN 'failed'
  WHEN warnings > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM c""")
def job_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return ro.job_rollup(views.jobs(spark, folder), views.fragment_states(spark, folder))


def _page(status: str, limit: int, offset: int):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        page = ro.job_page(views.jobs(spark, folder), status, limit, offset)
        return page.select("job_id", "book_id", "status", micros("created_at").alias("created"),
                           "total")

    return run


def _page_sql(condition: str, limit: int, offset: int) -> str:
    return f"""
WITH {sql.JOBS}, c AS (SELECT * FROM jobs WHERE {condition})
SELECT job_id, book_id, status, epoch_us(created_at) AS created,
  (SELECT count(*) FROM c) AS total
FROM c ORDER BY created_at DESC, job_id DESC LIMIT {limit} OFFSET {offset}"""


query("jobs_page", _page_sql("status IN ('queued', 'running')", 50, 20))(_page("active", 50, 20))
query("jobs_page_all", _page_sql("true", 100, 0))(_page("all", 100, 0))
query("jobs_page_completed", _page_sql("status = 'completed'", 10, 40))(
    _page("completed", 10, 40))


@query("job_issues", f"""
WITH {sql.FRAGMENTS}
SELECT job_id, ordinal, id, status FROM fragments WHERE status IN ('warning', 'failed')""")
def job_issues(spark: SparkSession, folder: str) -> DataFrame:
    return ro.issues(views.fragments(spark, folder)).select("job_id", "ordinal", "id", "status")


@query("voices_list", """
SELECT s_suppkey AS voice_id, s_name AS voice_name,
  DATE '2024-01-01' + CAST(s_nationkey AS INT) AS created_at FROM supplier""")
def voices_list(spark: SparkSession, folder: str) -> DataFrame:
    created = F.date_add(F.lit("2024-01-01").cast("date"), F.col("s_nationkey"))
    rows = views.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("voice_id"), F.col("s_name").alias("voice_name"),
        created.alias("created_at"))
    return ro.voice_list(rows)


@query("work_items", f"""
WITH {sql.FRAGMENTS}, {sql.JOBS}
SELECT f.id, f.job_id, f.chapter_number, f.ordinal, j.book_id, j.voice_id, s_name AS voice_name
FROM fragments f JOIN jobs j USING (job_id) JOIN supplier ON s_suppkey = voice_id""")
def work_items(spark: SparkSession, folder: str) -> DataFrame:
    items = se.work_items(views.fragments(spark, folder), views.jobs_with_voice(spark, folder),
                          views.voices(spark, folder))
    return items.select("id", "job_id", "chapter_number", "ordinal", "book_id", "voice_id",
                        "voice_name")


@query("orphans", f"""
WITH {sql.JOBS}
SELECT 'fragment_without_job' AS problem, l_orderkey AS key, count(*) AS found FROM lineitem
  WHERE l_orderkey NOT IN (SELECT job_id FROM jobs) GROUP BY 2
UNION ALL SELECT 'job_without_book', book_id, count(*) FROM jobs
  WHERE book_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 2
UNION ALL SELECT 'job_without_fragments', job_id, count(*) FROM jobs
  WHERE job_id NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 2""")
def orphans(spark: SparkSession, folder: str) -> DataFrame:
    jobs, states = views.jobs(spark, folder), views.fragment_states(spark, folder)
    customers = views.table(spark, folder, "customer")
    by_job = se.orphan_counts(states, jobs, "job_id", "job_id")
    by_book = se.orphan_counts(jobs, customers, "book_id", "c_custkey")
    lonely = F.col("parents") == 0
    rows = by_job.where(lonely | (F.col("children") == 0)).select(
        F.when(lonely, "fragment_without_job").otherwise("job_without_fragments")
        .alias("problem"), "key", F.greatest("children", "parents").alias("found"))
    return rows.unionAll(by_book.where(lonely).select(
        F.lit("job_without_book").alias("problem"), "key", F.col("children").alias("found")))


@query("chapter_catalog", f"""
WITH {sql.FRAGMENTS}, {sql.JOBS},
c AS (SELECT job_id, chapter_number, min(chapter_title) AS title, count(*) AS fragments_count,
  coalesce(sum(duration_ms), 0) AS duration_ms, count(DISTINCT chapter_title) AS titles,
  bool_and(status = 'ready') AS all_ready FROM fragments GROUP BY ALL)
SELECT job_id, chapter_number, title, fragments_count, duration_ms, all_ready,
  CASE WHEN chapter_number <= 0 OR duration_ms < 0 OR titles <> 1 THEN 'invalid_metadata'
    WHEN j.status <> 'completed' THEN 'job_not_completed'
    WHEN NOT all_ready THEN 'not_ready' ELSE 'ok' END AS verdict
FROM c JOIN jobs j USING (job_id)""".replace("GROUP BY ALL", "GROUP BY job_id, chapter_number"))
def chapter_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return ro.chapter_catalog(views.fragment_states(spark, folder), views.jobs(spark, folder))


@query("catalog_counts", f"""
WITH {sql.FRAGMENTS}, {sql.JOBS},
n AS (SELECT job_id, count(*) AS n FROM fragments GROUP BY job_id),
w AS (SELECT job_id FROM jobs LEFT JOIN n USING (job_id) WHERE job_id % 31 = 0),
c AS (SELECT job_id, chapter_number, min(chapter_title) AS title, count(*) AS fragments_count,
  coalesce(sum(duration_ms), 0) AS duration_ms, count(DISTINCT chapter_title) AS titles,
  bool_and(status = 'ready') AS all_ready FROM fragments GROUP BY job_id, chapter_number)
SELECT job_id, chapter_number, title, fragments_count, duration_ms, all_ready,
  CASE WHEN chapter_number <= 0 OR duration_ms < 0 OR titles <> 1 THEN 'invalid_metadata'
    WHEN j.status <> 'completed' THEN 'job_not_completed'
    WHEN NOT all_ready THEN 'not_ready'
    WHEN job_id IN (SELECT job_id FROM w) THEN 'count_mismatch' ELSE 'ok' END AS verdict
FROM c JOIN jobs j USING (job_id)""")
def catalog_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog where every 31st job declares one fragment too many."""
    states = views.fragment_states(spark, folder)
    counts = states.groupBy("job_id").agg(F.count("*").alias("fragments_count"))
    jobs = views.jobs(spark, folder).join(counts, "job_id", "left").withColumn(
        "fragments_count", F.coalesce("fragments_count", F.lit(0))
        + (F.col("job_id") % 31 == 0).cast("int"))
    return ro.checked_catalog(states, jobs)


# Requests for retries: some repeated, some for other jobs or unknown fragments.
REQUESTS = """requests AS (
  SELECT event_id // 3 AS job_id, (event_id // 3 + CASE WHEN event_type = 'error' THEN 1
    ELSE 0 END) || '-' || (1 + user_id % 5) AS fragment_id FROM events)"""


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    job = F.floor(F.col("event_id") / 3)
    other = F.when(F.col("event_type") == "error", job + 1).otherwise(job)
    return views.table(spark, folder, "events").select(
        job.alias("job_id"),
        F.concat_ws("-", other.cast("string"), (F.col("user_id") % 5 + 1).cast("string"))
        .alias("fragment_id"))


def _active_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return views.table(spark, folder, "orders").where(urgent).select(
        F.col("o_orderkey").alias("job_id"))


def _most(spark: SparkSession, folder: str) -> int:
    """A bound of the rows of requests and fragments together, and of jobs."""
    return max(views.row_count(spark, folder, "orders"), views.row_count(
        spark, folder, "events") + views.row_count(spark, folder, "lineitem"))


@query("retry_select", f"""
WITH {sql.FRAGMENTS}, {sql.JOBS}, {REQUESTS},
v AS (SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'job_active'
  WHEN job_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
  THEN 'rewrite_active' ELSE 'ok' END AS job_verdict FROM jobs),
a AS (SELECT job_id, fragment_id, count(*) AS times FROM requests GROUP BY 1, 2),
s AS (SELECT a.job_id, fragment_id, 'explicit' AS mode, CASE WHEN times > 1 THEN 'duplicate'
    WHEN f.id IS NULL THEN 'not_found' WHEN f.job_id <> a.job_id THEN 'wrong_job'
    WHEN f.status NOT IN ('warning', 'failed') THEN 'not_retryable' ELSE 'ok' END AS verdict
  FROM a LEFT JOIN fragments f ON f.id = a.fragment_id
  UNION ALL SELECT job_id, id, 'implicit', 'ok' FROM fragments
  WHERE status IN ('warning', 'failed') AND job_id NOT IN (SELECT job_id FROM requests))
SELECT job_id, fragment_id, mode, verdict, coalesce(job_verdict, 'job_not_found') AS job_verdict
FROM s LEFT JOIN v USING (job_id)""")
def retry_select(spark: SparkSession, folder: str) -> DataFrame:
    return se.retry_selection(
        _requests(spark, folder), views.fragments(spark, folder),
        views.jobs(spark, folder), _active_rewrites(spark, folder), _most(spark, folder))


@query("retry_jobs", f"""
WITH {sql.FRAGMENTS}, {sql.JOBS}, {REQUESTS},
a AS (SELECT job_id, fragment_id, count(*) AS times FROM requests GROUP BY 1, 2),
s AS (SELECT a.job_id FROM a JOIN fragments f ON f.id = a.fragment_id AND f.job_id = a.job_id
    AND f.status IN ('warning', 'failed') AND times = 1
  UNION ALL SELECT job_id FROM fragments
  WHERE status IN ('warning', 'failed') AND job_id NOT IN (SELECT job_id FROM requests)),
n AS (SELECT job_id, count(*) AS n FROM s GROUP BY job_id)
SELECT job_id, coalesce(n, 0) AS fragments, CASE WHEN status IN ('queued', 'running')
    THEN 'job_active' WHEN job_id IN (SELECT o_orderkey FROM orders
      WHERE o_orderpriority = '1-URGENT') THEN 'rewrite_active'
    WHEN n IS NULL THEN 'nothing_left' ELSE 'ok' END AS verdict
FROM jobs LEFT JOIN n USING (job_id)""")
def retry_jobs(spark: SparkSession, folder: str) -> DataFrame:
    jobs, active = views.jobs(spark, folder), _active_rewrites(spark, folder)
    most = _most(spark, folder)
    choice = se.retry_choice(_requests(spark, folder), views.fragments(spark, folder), most)
    return se.retry_refusals(choice, jobs, active, most)


@query("rewrite_select", f"""
WITH {sql.FRAGMENTS}, {REQUESTS},
a AS (SELECT job_id, fragment_id, count(*) AS times FROM requests GROUP BY 1, 2),
s AS (SELECT a.job_id, fragment_id, ordinal, CASE WHEN times > 1 THEN 'duplicate'
    WHEN f.id IS NULL THEN 'not_found' WHEN f.job_id <> a.job_id THEN 'wrong_job'
    WHEN f.status <> 'warning' THEN 'not_warning' ELSE 'ok' END AS verdict
  FROM a LEFT JOIN fragments f ON f.id = a.fragment_id
  UNION ALL SELECT job_id, id, ordinal, 'ok' FROM fragments WHERE status = 'warning'
    AND job_id NOT IN (SELECT job_id FROM requests))
SELECT job_id, fragment_id, ordinal, verdict, CASE WHEN verdict = 'ok' THEN row_number() OVER (
  PARTITION BY job_id, verdict ORDER BY ordinal, fragment_id) END AS place FROM s""")
def rewrite_select(spark: SparkSession, folder: str) -> DataFrame:
    return se.rewrite_selection(
        _requests(spark, folder), views.fragments(spark, folder), _most(spark, folder))


@query("first_duplicate", """
WITH i AS (SELECT user_id AS list_id, event_id AS position,
  CAST(json_extract(props, '$.k') AS BIGINT) AS id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY list_id, id ORDER BY position) AS nth FROM i)
SELECT list_id, arg_min(id, position) AS duplicate, min(position) AS position
FROM n WHERE nth > 1 GROUP BY list_id""")
def first_duplicate(spark: SparkSession, folder: str) -> DataFrame:
    return ro.first_duplicate(views.table(spark, folder, "events").select(
        F.col("user_id").alias("list_id"), F.col("event_id").alias("position"),
        F.get_json_object("props", "$.k").cast("long").alias("id")))


@query("export_order", f"""
WITH {sql.FRAGMENTS}
SELECT job_id, chapter_number, ordinal, id, CASE WHEN ordinal <= 0 THEN 'invalid_ordinal'
  WHEN count(*) OVER (PARTITION BY job_id, ordinal) > 1 THEN 'duplicate_ordinal'
  ELSE 'ok' END AS verdict FROM (SELECT * REPLACE (CASE WHEN job_id % 50 = 0 THEN
  ordinal // 2 ELSE ordinal END AS ordinal) FROM fragments)""")
def export_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every 50th job has damaged ordinals."""
    damaged = F.when(F.col("job_id") % 50 == 0, F.floor(F.col("ordinal") / 2)).otherwise(
        F.col("ordinal"))
    return ro.export_order(views.fragments(spark, folder).withColumn("ordinal", damaged))


READY = f"""{sql.FRAGMENTS}, {sql.JOBS},
declared AS (SELECT j.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = j.job_id)
  + CASE WHEN job_id % 97 = 0 THEN 1 ELSE 0 END AS fragments_count FROM jobs j),
counted AS (SELECT job_id, count(*) AS n, count(CASE WHEN status <> 'ready' THEN 1 END) AS bad,
  count(CASE WHEN status = 'ready' AND samples <= 0 THEN 1 END) AS silent
  FROM fragments GROUP BY job_id),
ready AS (SELECT d.*, CASE WHEN d.status <> 'completed' THEN 'job_not_completed'
    WHEN n IS NULL THEN 'no_fragments' WHEN bad > 0 THEN 'not_ready'
    WHEN silent > 0 THEN 'no_audio' WHEN n <> fragments_count THEN 'count_mismatch'
    ELSE 'ok' END AS verdict FROM declared d LEFT JOIN counted USING (job_id))"""


def _ready(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs with declared counts (every 97th is wrong) and their export verdict."""
    counted = ex.fragment_counts(views.fragment_states(spark, folder))
    wrong = F.when(F.col("job_id") % 97 == 0, 1).otherwise(0)
    declared = views.jobs_with_voice(spark, folder).join(counted, "job_id", "left").withColumn(
        "fragments_count", F.coalesce("fragments", F.lit(0)) + wrong)
    return ex.export_verdicts(declared).drop("fragments", "unready", "silent")


@query("export_ready", f"""
WITH {READY} SELECT job_id, book_id, voice_id, fragments_count, verdict FROM ready""")
def export_ready(spark: SparkSession, folder: str) -> DataFrame:
    return _ready(spark, folder).select(
        "job_id", "book_id", "voice_id", "fragments_count", "verdict")


@query("timeline", f"""
WITH {sql.FRAGMENTS}
SELECT id, job_id, chapter_number, ordinal, samples, CAST(coalesce(sum(samples) OVER (
  PARTITION BY job_id, chapter_number ORDER BY ordinal, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_sample
FROM fragments""")
def timeline(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.row_count(spark, folder, "lineitem")
    return ex.timeline(views.fragments(spark, folder), rows).select(
        "id", "job_id", "chapter_number", "ordinal", "samples", "start_sample")


PLACED = f"""{READY},
f AS (SELECT f.*, printf('character_%04d_', chapter_number) || chapter_title || '.flac' AS path,
  CAST(coalesce(sum(samples) OVER (PARTITION BY f.job_id, chapter_number ORDER BY ordinal, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_sample,
  {{'ordinal': ordinal, 'id': id, 'chapter_number': chapter_number, 'path': path,
    'start_sample': start_sample, 'samples': samples, 'status': f.status,
    'duration_ms': duration_ms}} AS entry
  FROM fragments f JOIN ready r USING (job_id) WHERE verdict = 'ok'),
c AS (SELECT job_id, chapter_number, {{'chapter_number': chapter_number,
    'title': min(chapter_title), 'fragments_count': count(*),
    'duration_ms': CAST(sum(duration_ms) AS BIGINT), 'path': min(path),
    'total_samples': CAST(sum(samples) AS BIGINT)}} AS chapter FROM f GROUP BY 1, 2),
heads AS (SELECT job_id, to_json({{'job_id': job_id, 'book': c_name, 'voice': s_name,
    'fragments_count': fragments_count}}) AS job FROM ready
  JOIN customer ON c_custkey = book_id JOIN supplier ON s_suppkey = voice_id)"""


def _placed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Heads and fragments of the jobs that may be exported."""
    ready = _ready(spark, folder).where(F.col("verdict") == "ok")
    titles = views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("book_id"), F.col("c_name").alias("book"))
    heads = (
        ready.join(titles, "book_id").join(views.voices(spark, folder), "voice_id")
        .select("job_id", "book", F.col("voice_name").alias("voice"), "fragments_count"))
    fragments = views.fragments(spark, folder).join(
        ready.select("job_id"), "job_id", "left_semi")
    placed = with_file_name(
        ex.timeline(fragments, views.row_count(spark, folder, "lineitem")),
        "chapter_number", "chapter_title", "path")
    return heads, placed


@query("manifest", f"""
WITH {PLACED},
e AS (SELECT job_id, to_json(list(entry ORDER BY ordinal)) AS fragments FROM f GROUP BY job_id),
l AS (SELECT job_id, to_json(list(chapter ORDER BY chapter_number)) AS chapters
  FROM c GROUP BY job_id)
SELECT job_id, 0 AS part, '{{"version":"{ex.FULL_MANIFEST_VERSION}","part":0,"job":' || job
  || ',"chapters":' || chapters || ',"fragments":' || fragments || '}}' AS document
FROM e JOIN l USING (job_id) JOIN heads USING (job_id)""")
def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return ex.manifest(*_placed(spark, folder))


FULL = f"""{PLACED},
e AS (SELECT f.*, {{'id': id, 'chapter_number': chapter_number, 'ordinal': ordinal, 'path': path,
    'start_sample': start_sample, 'samples': samples, 'text': 'Fragment ' || id,
    'stt_text': 'fragment ' || id, 'status': f.status, 'attempt': 1 + ordinal % 3,
    'duration_ms': duration_ms}} AS full_entry FROM f),
g AS (SELECT job_id, chapter_number, to_json(list(full_entry ORDER BY ordinal)) AS fragments,
  {{'chapter_number': chapter_number, 'title': min(chapter_title), 'fragments_count': count(*),
    'duration_ms': CAST(sum(duration_ms) AS BIGINT), 'path': min(path), 'audio_format': 'flac',
    'sample_rate': 24000, 'channels': 1, 'bits_per_sample': 16,
    'total_samples': CAST(sum(samples) AS BIGINT),
    'pcm_bytes': CAST(sum(samples) * 2 AS BIGINT)}} AS full_chapter
  FROM e GROUP BY job_id, chapter_number),
h AS (SELECT job_id, '"book":' || to_json({{'id': book_id, 'title': c_name}}) || ',"voice":'
    || to_json({{'id': voice_id, 'name': s_name}}) || ',"job":' || to_json({{'id': job_id,
    'status': status, 'fragments_count': fragments_count}}) AS head
  FROM ready JOIN customer ON c_custkey = book_id JOIN supplier ON s_suppkey = voice_id)"""


@query("manifest_documents", f"""
WITH {FULL}
SELECT job_id, 0 AS chapter_number, '{{"version":"{ex.FULL_MANIFEST_VERSION}",' || any_value(head)
  || ',"chapters":' || to_json(list(full_chapter ORDER BY chapter_number)) || '}}' AS document
FROM g JOIN h USING (job_id) GROUP BY job_id
UNION ALL SELECT job_id, chapter_number, '{{"version":"{ex.CHAPTER_MANIFEST_VERSION}",'
  || '"scope":"chapter","chapter":' || to_json(full_chapter) || ',' || head || ',"fragments":'
  || fragments || '}}' FROM g JOIN h USING (job_id)""")
def manifest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All fields, whatever the size: a document per job and one per chapter."""
    _, placed = _placed(spark, folder)
    ready = _ready(spark, folder).where(F.col("verdict") == "ok")
    titles = views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("book_id"), F.col("c_name").alias("title"))
    heads = ready.join(titles, "book_id").join(views.voices(spark, folder), "voice_id").select(
        "job_id", F.struct(F.col("book_id").alias("id"), "title").alias("book"),
        F.struct(F.col("voice_id").alias("id"), F.col("voice_name").alias("name")).alias("voice"),
        F.struct(F.col("job_id").alias("id"), "status", "fragments_count").alias("job"))
    return ex.manifest_documents(heads, placed.withColumns({
        "text": F.concat(F.lit("Fragment "), "id"), "stt_text": F.concat(F.lit("fragment "), "id"),
        "attempt": F.col("ordinal") % 3 + 1, "audio_format": F.lit("flac"),
        "sample_rate": F.lit(views.SAMPLE_RATE), "channels": F.lit(1),
        "bits_per_sample": F.lit(16), "pcm_bytes": F.col("samples") * 2}))


@query("chapter_manifest", f"""
WITH {PLACED},
e AS (SELECT job_id, chapter_number, to_json(list(entry ORDER BY ordinal)) AS fragments
  FROM f GROUP BY job_id, chapter_number)
SELECT job_id, chapter_number, 0 AS part, '{{"version":"{ex.CHAPTER_MANIFEST_VERSION}",'
  || '"scope":"chapter","part":0,"chapter":' || to_json(chapter) || ',"job":' || job
  || ',"fragments":' || fragments || '}}' AS document
FROM e JOIN c USING (job_id, chapter_number) JOIN heads USING (job_id)""")
def chapter_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return ex.chapter_manifest(*_placed(spark, folder))


SETTINGS_SQL = """
WITH c AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 3 AS num_steps,
  p_retailprice / 150 AS guidance_scale,
  CASE WHEN p_partkey % 13 = 0 THEN 'NaN'::DOUBLE WHEN p_partkey % 3 = 0 THEN NULL
    ELSE p_size / 20.0 END AS speed,
  CASE WHEN p_partkey % 29 = 0 THEN 'Infinity'::DOUBLE END AS t_shift,
  CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 12 END AS automatic_warning_retries FROM part),
r AS (SELECT p_partkey, coalesce(num_steps, 32) AS num_steps,
  coalesce(guidance_scale, 2) AS guidance_scale, coalesce(speed, 1) AS speed,
  coalesce(t_shift, 0.1) AS t_shift,
  coalesce(automatic_warning_retries, 5) AS automatic_warning_retries FROM c)
SELECT p_partkey AS config_id, automatic_warning_retries AS retries,
  CASE WHEN isnan(num_steps) OR NOT num_steps BETWEEN 1 AND 100 THEN 'num_steps'
    WHEN isnan(guidance_scale) OR NOT guidance_scale BETWEEN 0 AND 10 THEN 'guidance_scale'
    WHEN isnan(speed) OR NOT speed BETWEEN 0.5 AND 2 THEN 'speed'
    WHEN isnan(t_shift) OR NOT t_shift BETWEEN 0.001 AND 10 THEN 't_shift'
    WHEN NOT automatic_warning_retries BETWEEN 0 AND 10 THEN 'automatic_warning_retries'
    ELSE '' END AS violation FROM r"""


@query("settings_audit", SETTINGS_SQL)
def settings_audit(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    configs = views.table(spark, folder, "part").select(
        key.alias("config_id"), (size * 3).alias("num_steps"),
        (F.col("p_retailprice") / 150).alias("guidance_scale"),
        F.when(key % 13 == 0, float("nan")).when(key % 3 != 0, size / 20).alias("speed"),
        F.when(key % 29 == 0, float("inf")).alias("t_shift"),
        F.when(key % 2 == 0, (key % 12).cast("double")).alias("automatic_warning_retries"))
    return co.settings_audit(configs).select(
        "config_id", F.col("automatic_warning_retries").cast("long").alias("retries"),
        "violation")


@query("rewrite_settings_audit", """
SELECT p_partkey AS config_id, CASE WHEN NOT p_size / 40.0 BETWEEN 0 AND 1
    THEN 'rewrite_temperature' WHEN NOT p_partkey % 250 BETWEEN 0 AND 200 THEN 'top_k'
  WHEN NOT p_size / 45.0 BETWEEN 0 AND 1 THEN 'top_p'
  WHEN NOT p_size * 50 BETWEEN 16 AND 2048 THEN 'max_tokens' ELSE '' END AS violation
FROM part""")
def rewrite_settings_audit(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    configs = views.table(spark, folder, "part").select(
        F.col("p_partkey").alias("config_id"), (size / 40).alias("rewrite_temperature"),
        (F.col("p_partkey") % 250).alias("top_k"), (size / 45).alias("top_p"),
        F.lit(0.05).alias("min_p"), F.lit(1.1).alias("repeat_penalty"),
        (size * 50).alias("max_tokens"))
    return co.rewrite_settings_audit(configs).select("config_id", "violation")


@query("contract_audit", f"""
WITH {sql.FRAGMENTS}, {sql.JOBS}, {sql.REVISIONS}
SELECT 'fragment_status' AS rule, count(*) AS rows_checked, count(CASE WHEN status NOT IN
  ('pending', 'generating', 'ready', 'warning', 'failed') THEN 1 END) AS violations FROM fragments
UNION ALL SELECT 'fragment_duration', count(*), count(CASE WHEN duration_ms < 0 THEN 1 END)
  FROM fragments
UNION ALL SELECT 'fragment_samples', count(*), count(CASE WHEN samples <> duration_ms * 24
  THEN 1 END) FROM fragments
UNION ALL SELECT 'job_counters', count(*), 0 FROM jobs
UNION ALL SELECT 'fragment_ordinal_unique', sum(n), count(CASE WHEN n > 1 THEN 1 END) FROM
  (SELECT count(*) AS n FROM fragments GROUP BY job_id, ordinal)
UNION ALL SELECT 'fragment_chapter_unique', sum(n), count(CASE WHEN n > 1 THEN 1 END) FROM
  (SELECT count(*) AS n FROM fragments GROUP BY job_id, chapter_number)
UNION ALL SELECT 'fragment_job', count(*), count(CASE WHEN job_id NOT IN
  (SELECT job_id FROM jobs) THEN 1 END) FROM fragments
UNION ALL SELECT 'job_book', count(*), count(CASE WHEN book_id NOT IN
  (SELECT c_custkey FROM customer) THEN 1 END) FROM jobs
UNION ALL SELECT 'revision_origin', count(*), count(CASE WHEN (revision_number = 1) <>
  (source = 'original') THEN 1 END) FROM revisions
UNION ALL SELECT 'revision_root', count(*), count(CASE WHEN (revision_number = 1) <>
  (parent_id IS NULL) THEN 1 END) FROM revisions
UNION ALL SELECT 'revision_text', count(*), count(CASE WHEN trim(text) = '' THEN 1 END)
  FROM revisions
UNION ALL SELECT 'revision_parent', count(*) FILTER (parent_id IS NOT NULL), count(CASE WHEN
  parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM revisions) THEN 1 END)
  FROM revisions""")
def contract_audit(spark: SparkSession, folder: str) -> DataFrame:
    fragments, jobs = views.fragments(spark, folder), views.jobs(spark, folder)
    states, revisions = views.fragment_states(spark, folder), views.revisions(spark, folder)
    first = F.col("revision_number") == 1
    parented = revisions.where(F.col("parent_id").isNotNull())
    totals = states.groupBy("job_id").agg(F.count("*").alias("fragments_count"))
    counted = ro.job_rollup(jobs, states).join(totals, "job_id", "left").fillna(
        0, ["fragments_count"])
    return co.audit(
        co.check_rows(states, {
            "fragment_status": F.col("status").isin(
                "pending", "generating", "ready", "warning", "failed"),
            "fragment_duration": F.col("duration_ms") >= 0,
            "fragment_samples": F.col("samples") == F.col("duration_ms") * 24,
        }),
        co.check_rows(counted, {
            "job_counters": F.col("pending") + F.col("ready") + F.col("warnings")
            + F.col("failed") == F.col("fragments_count"),
        }),
        co.check_unique(fragments, "fragment_ordinal_unique", ["job_id", "ordinal"]),
        co.check_unique(states, "fragment_chapter_unique", ["job_id", "chapter_number"]),
        co.check_reference(states, "fragment_job", "job_id", jobs, "job_id"),
        co.check_reference(jobs, "job_book", "book_id",
                           views.table(spark, folder, "customer"), "c_custkey"),
        co.check_rows(revisions, {
            "revision_origin": first == (F.col("source") == "original"),
            "revision_root": first == F.col("parent_id").isNull(),
            "revision_text": F.trim("text") != "",
        }),
        co.check_reference(parented, "revision_parent", "parent_id", revisions, "id"),
    )


@query("ops_metrics", f"""
WITH {sql.ATTEMPTS}
SELECT code, count(*) AS attempts, sum(processing_ms) AS processing_ms,
  sum(1000 + event_id % 5000) AS audio_ms,
  quantile_disc(processing_ms, 0.5) AS p50_ms, quantile_disc(processing_ms, 0.95) AS p95_ms,
  max(processing_ms) AS max_ms,
  round(count(*) / (SELECT count(*) FROM attempts), 6) AS share,
  round(sum(processing_ms) / sum(1000 + event_id % 5000), 6) AS real_time_factor
FROM attempts GROUP BY code""")
def ops_metrics(spark: SparkSession, folder: str) -> DataFrame:
    log = views.attempt_log(spark, folder).withColumn(
        "audio_ms", F.col("event_id") % 5_000 + 1_000)
    return ro.ops_metrics(log)
