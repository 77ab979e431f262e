"""Queries over attempts, revisions, reviews and state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import rewrite_verdict
from lectern.operators import history as hi
from lectern.operators import replay as re
from lectern.operators import rollup as ro
from lectern.plans import sql
from lectern.plans.production import micros
from lectern.plans.registry import query
from lectern.sources import views


@query("latest_job", f"""
WITH {sql.JOBS},
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY created_at DESC, job_id DESC)
  AS place FROM jobs)
SELECT book_id, job_id, status, epoch_us(created_at) AS created FROM r WHERE place = 1""")
def latest_job(spark: SparkSession, folder: str) -> DataFrame:
    return hi.latest_job(views.jobs(spark, folder)).select(
        "book_id", "job_id", "status", micros("created_at").alias("created"))


@query("current_revision", f"""
WITH {sql.REVISIONS},
r AS (SELECT *, row_number() OVER (PARTITION BY fragment_id ORDER BY revision_number DESC,
  id DESC) AS place FROM revisions)
SELECT fragment_id, id, revision_number, source, md5(text) AS text_md5 FROM r WHERE place = 1""")
def current_revision(spark: SparkSession, folder: str) -> DataFrame:
    return hi.current_revision(views.revisions(spark, folder)).select(
        "fragment_id", "id", "revision_number", "source",
        F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("attempt_history", f"""
WITH {sql.ATTEMPTS}
SELECT fragment_id, attempt, code, processing_ms, epoch_us(completed_at) AS completed
FROM attempts""")
def attempt_history(spark: SparkSession, folder: str) -> DataFrame:
    return views.attempts(spark, folder).select(
        "fragment_id", "attempt", "code", "processing_ms",
        micros("completed_at").alias("completed"))


@query("attempt_summary", f"""
WITH {sql.ATTEMPTS}
SELECT fragment_id, count(*) AS attempts, arg_max(code, attempt) AS last_code,
  max(attempt) AS last_attempt, min(CASE WHEN code = 'ready' THEN attempt END) AS first_ready
FROM attempts GROUP BY fragment_id""")
def attempt_summary(spark: SparkSession, folder: str) -> DataFrame:
    return hi.attempt_summary(views.attempts(spark, folder))


@query("revision_backfill", """
WITH r AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0)
SELECT doc_id || ':original' AS id, doc_id AS fragment_id, 1 AS revision_number,
  'original' AS source, text, CAST(NULL AS VARCHAR) AS parent_id
FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM r)""")
def revision_backfill(spark: SparkSession, folder: str) -> DataFrame:
    fragments = views.table(spark, folder, "documents").select(
        F.col("doc_id").alias("fragment_id"), "text")
    return hi.backfill_revisions(fragments, views.revisions(spark, folder))


# Edit requests made from the events: which fragment, what kind, which old revision.
EDITS = """edits AS (
  SELECT user_id AS fragment_id, ts AS requested_at, event_id AS request_id,
    CASE event_type WHEN 'click' THEN 'manual' WHEN 'view' THEN 'ai' ELSE 'restore' END AS kind,
    'edit ' || event_id AS text,
    user_id || ':' || (1 + event_id % 3) AS selected_id
  FROM events)"""


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return views.table(spark, folder, "events").select(
        F.col("user_id").alias("fragment_id"),
        F.col("ts").cast("timestamp").alias("requested_at"),
        F.col("event_id").alias("request_id"),
        F.when(kind == "click", "manual").when(kind == "view", "ai").otherwise("restore")
        .alias("kind"),
        F.concat(F.lit("edit "), F.col("event_id").cast("string")).alias("text"),
        F.concat_ws(":", F.col("user_id").cast("string"),
                    (F.col("event_id") % 3 + 1).cast("string")).alias("selected_id"))


@query("revision_append", f"""
WITH {sql.REVISIONS}, {EDITS},
c AS (SELECT fragment_id, max(revision_number) AS last_no, arg_max(id, revision_number)
  AS last_id FROM revisions GROUP BY fragment_id),
k AS (SELECT e.*, last_no, last_id, r.text AS old_text, CASE
    WHEN last_no IS NULL THEN 'unknown_fragment'
    WHEN kind = 'restore' AND r.id IS NULL THEN 'unknown_revision' ELSE 'appended' END AS verdict
  FROM edits e LEFT JOIN c USING (fragment_id)
  LEFT JOIN revisions r ON r.fragment_id = e.fragment_id AND r.id = e.selected_id),
n AS (SELECT * REPLACE (CASE WHEN verdict = 'appended' THEN last_no + row_number() OVER (
  PARTITION BY fragment_id, verdict ORDER BY requested_at, request_id) END AS last_no),
  row_number() OVER (PARTITION BY fragment_id, verdict ORDER BY requested_at, request_id) AS nth
  FROM k)
SELECT request_id, verdict, fragment_id || ':' || last_no AS id, fragment_id,
  last_no AS revision_number, kind AS source,
  CASE WHEN verdict <> 'appended' THEN NULL WHEN kind = 'restore' THEN old_text ELSE text END
    AS text,
  CASE WHEN verdict <> 'appended' THEN NULL WHEN kind = 'restore' THEN selected_id
    WHEN nth = 1 THEN last_id ELSE fragment_id || ':' || (last_no - 1) END AS parent_id
FROM n""")
def revision_append(spark: SparkSession, folder: str) -> DataFrame:
    return hi.append_revisions(
        views.revisions(spark, folder), _edits(spark, folder),
        views.row_count(spark, folder, "events"))


@query("revision_audit", f"""
WITH {sql.REVISIONS},
d AS (SELECT * REPLACE (CASE WHEN fragment_id % 7 = 0 AND revision_number = 3 THEN 5
  ELSE revision_number END AS revision_number, CASE WHEN fragment_id % 11 = 0 THEN id
  ELSE parent_id END AS parent_id) FROM revisions)
SELECT fragment_id, count(*) AS revisions, min(revision_number) <> 1
    OR max(revision_number) <> count(DISTINCT revision_number) AS has_gap,
  count(*) > count(DISTINCT revision_number) AS has_repeat,
  count(CASE WHEN NOT ((revision_number = 1) = (source = 'original')
    AND (revision_number = 1) = (parent_id IS NULL)) THEN 1 END) AS bad_origin,
  count(CASE WHEN parent_id IS NOT NULL AND (parent_id = id OR NOT EXISTS (SELECT 1 FROM d p
    WHERE p.fragment_id = d.fragment_id AND p.id = d.parent_id)) THEN 1 END) AS bad_parent
FROM d GROUP BY fragment_id""")
def revision_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Chains with planted damage: moved numbers and rows that are their own parent."""
    number, fragment = F.col("revision_number"), F.col("fragment_id")
    damaged = views.revisions(spark, folder).withColumns({
        "revision_number": F.when((fragment % 7 == 0) & (number == 3), 5).otherwise(number),
        "parent_id": F.when(fragment % 11 == 0, F.col("id")).otherwise(F.col("parent_id")),
    })
    return hi.audit_revisions(damaged)


APPROVALS = f"""{sql.FRAGMENTS},
asked AS (SELECT doc_id || '-1' AS id, doc_id AS review_id FROM labels),
sized AS (SELECT *, CASE WHEN duration_ms % 5000 = 0 THEN 0 ELSE samples * 2 END AS pcm_bytes
  FROM fragments)"""


@query("approvals", f"""
WITH {APPROVALS}
SELECT a.id, a.review_id, CASE WHEN s.status IS NULL THEN 'not_found'
  WHEN s.status <> 'warning' THEN 'not_warning'
  WHEN pcm_bytes <= 0 OR pcm_bytes > 16777216 THEN 'no_playable_audio'
  ELSE 'approved' END AS verdict FROM asked a LEFT JOIN sized s USING (id)""")
def approvals(spark: SparkSession, folder: str) -> DataFrame:
    asked = views.table(spark, folder, "labels").select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-1")).alias("id"),
        F.col("doc_id").alias("review_id"))
    sized = views.fragments(spark, folder).select(
        "id", "status", "duration_ms", F.lit(views.SAMPLE_RATE).alias("sample_rate"),
        F.lit(1).alias("channels"), F.lit(2).alias("sample_width"),
        F.when(F.col("duration_ms") % 5_000 == 0, 0).otherwise(F.col("samples") * 2)
        .alias("pcm_bytes"))
    return hi.approval_verdicts(asked, sized).select("id", "review_id", "verdict")


@query("review_trail", f"""
WITH {sql.ATTEMPTS},
v AS (SELECT event_id AS review_id, fragment_id, greatest(attempt - event_id % 3, 0) AS attempt,
  completed_at AS created_at FROM attempts WHERE code IN ('transcript_mismatch', 'audio_warning'))
SELECT v.fragment_id, review_id, row_number() OVER (PARTITION BY v.fragment_id
    ORDER BY created_at, review_id) AS review_number, v.attempt, l.code AS warning_code,
  'approved' AS decision
FROM v LEFT JOIN attempts l ON l.fragment_id = v.fragment_id AND l.attempt = v.attempt""")
def review_trail(spark: SparkSession, folder: str) -> DataFrame:
    """A review after every warning, of that attempt or one of the two before it."""
    attempts = views.attempts(spark, folder)
    reviews = attempts.where(F.col("code").isin("transcript_mismatch", "audio_warning")).select(
        F.col("event_id").alias("review_id"), "fragment_id",
        F.greatest(F.col("attempt") - F.col("event_id") % 3, F.lit(0)).alias("attempt"),
        F.col("completed_at").alias("created_at"))
    return hi.review_trail(reviews, attempts).select(
        "fragment_id", "review_id", "review_number", "attempt", "warning_code", "decision")


MOVES = " ".join(
    f"WHEN x = '{action}' AND split_part(acc, ',', -1) = '{old}' THEN '{new}'"
    for action, moves in re.TRANSITIONS.items() for old, new in moves.items())

REPLAYED = f"""{sql.ACTIONS},
lists AS (SELECT fragment_id, list(action ORDER BY happened_at, event_id) AS acts,
  list(event_id ORDER BY happened_at, event_id) AS ids FROM actions GROUP BY fragment_id),
paths AS (SELECT *, string_split(list_reduce(list_prepend('{re.INITIAL}', acts), lambda acc, x:
  acc || ',' || CASE {MOVES} ELSE split_part(acc, ',', -1) END), ',') AS path FROM lists),
steps AS (SELECT fragment_id, unnest(ids) AS event_id, unnest(acts) AS action,
  unnest(path[1:len(acts)]) AS from_state, unnest(path[2:]) AS to_state,
  generate_subscripts(acts, 1) AS nth FROM paths),
legal_pairs AS (SELECT * FROM (VALUES {", ".join(
    f"('{action}', '{old}')" for action, moves in re.TRANSITIONS.items() for old in moves
)}) AS t(action, from_state)),
judged AS (SELECT s.*, regexp_extract(s.from_state, '^[a-z]+') AS from_status,
    p.action IS NOT NULL AS legal FROM steps s LEFT JOIN legal_pairs p
  ON p.action = s.action AND p.from_state = s.from_state)"""


def _replayed(spark: SparkSession, folder: str) -> DataFrame:
    return re.replay(
        views.action_log(spark, folder), "fragment_id", ["happened_at", "event_id"],
        views.row_count(spark, folder, "events"))


@query("state_replay", f"""
WITH {REPLAYED}
SELECT fragment_id, regexp_extract(arg_max(to_state, nth), '^[a-z]+') AS status,
  count(CASE WHEN legal AND action = 'start' THEN 1 END) AS attempt,
  regexp_extract(arg_max(to_state, nth), '^warning:(.*)$', 1) AS warning_code,
  count(CASE WHEN legal THEN 1 END) AS applied,
  count(CASE WHEN NOT legal THEN 1 END) AS rejected FROM judged GROUP BY fragment_id""")
def state_replay(spark: SparkSession, folder: str) -> DataFrame:
    return re.current_states(
        _replayed(spark, folder), "fragment_id", ["happened_at", "event_id"])


@query("bad_transitions", f"""
WITH {REPLAYED} SELECT fragment_id, event_id, action, from_status FROM judged WHERE NOT legal""")
def bad_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return re.illegal_events(_replayed(spark, folder), re.transition_table(spark)).select(
        "fragment_id", "event_id", "action", "from_status")


APPLY = f"""{sql.REWRITES},
results AS (SELECT item_id // 10 AS task_id, item_id AS fragment_id, item_id + n * 1000000
    AS place, original AS expected_text, CASE n WHEN 0 THEN rewritten ELSE original || '?' END
    AS rewritten, CASE WHEN item_id % 11 = 0 THEN 'other' ELSE 'model'
    END AS model_id, CASE WHEN item_id % 13 = 0 THEN 'r2' ELSE 'r1' END AS model_revision,
    CASE WHEN item_id % 5 = 0 THEN 'ready' ELSE 'warning' END AS status,
    CASE WHEN item_id % 7 = 0 THEN original || '!' ELSE original END AS text
  FROM rewrites, range(2) AS r(n) WHERE n = 0 OR item_id % 3 = 0),
ok AS (SELECT *, model_id = 'model' AS m, status = 'warning' AND text = expected_text AS u
  FROM results),
pins AS (SELECT task_id, min(place) AS pinned_at, arg_min(model_revision, place) AS pinned
  FROM ok WHERE m AND u GROUP BY task_id),
alone AS (SELECT ok.*, CASE WHEN NOT m THEN 'invalid'
  WHEN coalesce(place > pinned_at AND model_revision <> pinned, false) OR NOT u THEN 'conflict'
  WHEN rewritten = expected_text THEN 'unchanged' ELSE 'applied' END AS own
  FROM ok LEFT JOIN pins USING (task_id)),
verdicts AS (SELECT *, CASE WHEN own IN ('applied', 'unchanged') AND place > min(CASE WHEN
  own = 'applied' THEN place END) OVER (PARTITION BY fragment_id) THEN 'conflict' ELSE own END
  AS verdict FROM alone)"""


def _verdicts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    number = F.col("item_id")
    rows = views.rewrites(spark, folder)
    again = rows.select("*", F.explode(
        F.when(number % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .alias("n"))  # every third fragment gets two results
    results = again.select(
        F.floor(number / 10).alias("task_id"), F.lit("model").alias("task_model_id"),
        number.alias("fragment_id"), (number + F.col("n") * 1_000_000).alias("place"),
        F.col("original").alias("expected_text"),
        F.when(F.col("n") == 0, F.col("rewritten"))
        .otherwise(F.concat("original", F.lit("?"))).alias("rewritten"),
        F.when(number % 11 == 0, "other").otherwise("model").alias("model_id"),
        F.when(number % 13 == 0, "r2").otherwise("r1").alias("model_revision"))
    current = rows.select(
        number.alias("fragment_id"),
        F.when(number % 5 == 0, "ready").otherwise("warning").alias("status"),
        F.when(number % 7 == 0, F.concat("original", F.lit("!"))).otherwise(F.col("original"))
        .alias("text"),
        F.when(number % 5 == 0, "").otherwise("transcript_mismatch").alias("warning_code"))
    return hi.apply_rewrites(results, current), current


@query("rewrite_apply", f"""
WITH {APPLY} SELECT task_id, fragment_id, place, verdict FROM verdicts""")
def rewrite_apply(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder)[0].select("task_id", "fragment_id", "place", "verdict")


@query("rewrite_state", f"""
WITH {APPLY} SELECT fragment_id, coalesce(max(CASE WHEN verdict = 'applied' THEN rewritten END),
    any_value(text)) AS text, any_value(status) AS status,
  CASE WHEN bool_or(verdict = 'applied') THEN 'text_rewritten'
    WHEN any_value(status) = 'ready' THEN '' ELSE 'transcript_mismatch' END AS warning_code
FROM verdicts GROUP BY fragment_id""")
def rewrite_state(spark: SparkSession, folder: str) -> DataFrame:
    verdicts, current = _verdicts(spark, folder)
    return hi.rewritten_state(current, verdicts)


@query("rewrite_rollup", rf"""
WITH {sql.REWRITES},
i AS (SELECT item_id // 10 AS task_id, CASE WHEN item_id % 19 = 0 THEN 'queued'
    WHEN item_id // 10 % 5 = 1 THEN 'failed' WHEN replace(lower(regexp_replace(original,
    '[^\p{{L}}\p{{N}}\p{{S}}]', '', 'g')), 'ё', 'е') = replace(lower(regexp_replace(rewritten,
    '[^\p{{L}}\p{{N}}\p{{S}}]', '', 'g')), 'ё', 'е') THEN 'completed' ELSE 'failed' END AS status
  FROM rewrites),
c AS (SELECT task_id, count(*) AS fragments_count,
  count(CASE WHEN status = 'queued' THEN 1 END) AS pending,
  count(CASE WHEN status = 'completed' THEN 1 END) AS completed,
  count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM i GROUP BY task_id)
SELECT *, CASE WHEN pending > 0 THEN 'running' WHEN failed = fragments_count THEN 'failed'
  WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM c""")
def rewrite_rollup(spark: SparkSession, folder: str) -> DataFrame:
    number, task = F.col("item_id"), F.floor(F.col("item_id") / 10)
    verdict = rewrite_verdict(F.col("original"), F.col("rewritten"), F.col("reason"))
    return ro.rewrite_rollup(views.rewrites(spark, folder).select(
        task.alias("task_id"),
        F.when(number % 19 == 0, "queued").when(task % 5 == 1, "failed")
        .when(verdict == "accepted", "completed").otherwise("failed").alias("status")))
