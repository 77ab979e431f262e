"""Queries that compare texts, score attempts and decide on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import align as al
from lectern.operators import chapters as ch
from lectern.operators import decisions as de
from lectern.plans import sql
from lectern.plans.registry import query
from lectern.sources import views


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.transcripts(spark, folder)
    return rows.select(
        "doc_id", "lang", tx.comparison_form(F.col("expected")).alias("expected"),
        tx.comparison_form(F.col("transcript")).alias("transcript"))


COMPARED = f"""{sql.TRANSCRIPTS},
compared AS (
  SELECT doc_id, lang, dropped, replaced, {sql.comparison_form('expected')} AS expected,
    {sql.comparison_form('transcript')} AS transcript FROM transcripts)"""

COUNTED = f"""{COMPARED},
counted AS (
  SELECT doc_id, lang, CASE WHEN expected = '' THEN 0
      ELSE len(string_split(expected, ' ')) END - dropped - replaced AS matches,
    replaced AS substitutions, dropped AS deletions, 0 AS insertions FROM compared)"""


@query("norm_text", f"""
WITH {COMPARED}
SELECT doc_id, md5(expected) AS expected_md5, md5(transcript) AS transcript_md5,
  length(expected) AS chars FROM compared""")
def norm_text(spark: SparkSession, folder: str) -> DataFrame:
    return _compared(spark, folder).select(
        "doc_id", F.md5(F.encode("expected", "UTF-8")).alias("expected_md5"),
        F.md5(F.encode("transcript", "UTF-8")).alias("transcript_md5"),
        F.char_length("expected").alias("chars"))


@query("norm_diag", f"""
WITH d AS (SELECT doc_id, {sql.collapsed(sql.folded('text'))} AS t FROM documents)
SELECT doc_id, md5(t) AS text_md5, length(t) AS chars FROM d""")
def norm_diag(spark: SparkSession, folder: str) -> DataFrame:
    clean = views.documents(spark, folder, "text").select(
        "doc_id", tx.diagnostic_form(F.col("text")).alias("t"))
    return clean.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("text_md5"),
                        F.char_length("t").alias("chars"))


@query("decide_v1", f"""
WITH {COMPARED}
SELECT doc_id, CASE WHEN expected <> transcript THEN 'transcript_mismatch'
  WHEN doc_id % 5 = 0 THEN 'audio_warning' ELSE '' END AS warning_code,
  CASE WHEN expected <> transcript OR doc_id % 5 = 0 THEN 'warning' ELSE 'ready' END AS status
FROM compared""")
def decide_v1(spark: SparkSession, folder: str) -> DataFrame:
    notes = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("clipping"))).otherwise(
        F.array().cast("array<string>"))
    code = de.warning_code(F.col("expected"), F.col("transcript"), notes)
    return _compared(spark, folder).select("doc_id", code.alias("warning_code")).withColumn(
        "status", F.when(F.col("warning_code") == "", "ready").otherwise("warning"))


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    return al.edit_counts(_compared(spark, folder), "expected", "transcript")


@query("align", f"""
WITH {COUNTED}
SELECT doc_id, lang, matches, substitutions, deletions, insertions FROM counted""")
def align(spark: SparkSession, folder: str) -> DataFrame:
    return _counted(spark, folder)


@query("align_operations", f"""
WITH {COUNTED}
SELECT 'match' AS op, sum(matches) AS operations FROM counted HAVING sum(matches) > 0
UNION ALL SELECT 'substitution', sum(substitutions) FROM counted HAVING sum(substitutions) > 0
UNION ALL SELECT 'deletion', sum(deletions) FROM counted HAVING sum(deletions) > 0""")
def align_operations(spark: SparkSession, folder: str) -> DataFrame:
    aligned = al.align(_compared(spark, folder), "expected", "transcript", fields=("op",))
    return aligned.select(F.explode("alignment.op").alias("op")).groupBy("op").agg(
        F.count("*").alias("operations"))


@query("align_insertions", f"""
WITH {COUNTED}
SELECT doc_id, matches, substitutions, 0 AS deletions, deletions AS insertions FROM counted""")
def align_insertions(spark: SparkSession, folder: str) -> DataFrame:
    """The other way round: what the transcript lacks is added to it."""
    return al.edit_counts(_compared(spark, folder), "transcript", "expected").drop("lang")


@query("align_substitutions", f"""
WITH {COMPARED},
split AS (SELECT doc_id, string_split(expected, ' ') AS e, string_split(transcript, ' ') AS t
  FROM compared WHERE dropped = 0)
SELECT doc_id, i - 1 AS expected_index, i - 1 AS actual_index, e[i] AS expected, t[i] AS actual
FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM split) WHERE e[i] <> t[i]""")
def align_substitutions(spark: SparkSession, folder: str) -> DataFrame:
    """Every replaced word with its place on both sides."""
    aligned = al.align(_compared(spark, folder), "expected", "transcript", ("substitution",))
    return aligned.select("doc_id", F.explode("alignment").alias("x")).select(
            "doc_id", "x.expected_index", "x.actual_index", "x.expected", "x.actual")


@query("wer", f"""
WITH {COUNTED},
e AS (SELECT *, substitutions + deletions + insertions AS errors,
  matches + substitutions + deletions AS words FROM counted)
SELECT doc_id, words, errors, round(errors / greatest(words, 1), 6) AS wer,
  CAST(ceil(words / 10) AS BIGINT) AS threshold, errors > ceil(words / 10) AS failed FROM e""")
def wer(spark: SparkSession, folder: str) -> DataFrame:
    words = F.col("matches") + F.col("substitutions") + F.col("deletions")
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    rows = _counted(spark, folder).select("doc_id", words.alias("words"), errors.alias("errors"))
    return rows.withColumns({
        "wer": F.round(al.error_rate(F.col("errors"), F.col("words")), 6),
        "threshold": al.error_threshold(F.col("words"), "MODERATE"),
    }).withColumn("failed", F.col("errors") > F.col("threshold"))


@query("corpus_wer", f"""
WITH {COUNTED}
SELECT lang, count(*) AS texts, sum(substitutions + deletions + insertions) AS errors,
  sum(matches + substitutions + deletions) AS words,
  round(sum(substitutions + deletions + insertions)
    / greatest(sum(matches + substitutions + deletions), 1), 6) AS wer
FROM counted GROUP BY lang""")
def corpus_wer(spark: SparkSession, folder: str) -> DataFrame:
    words = F.col("matches") + F.col("substitutions") + F.col("deletions")
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return _counted(spark, folder).groupBy("lang").agg(
        F.count("*").alias("texts"), F.sum(errors).alias("errors"), F.sum(words).alias("words"),
    ).withColumn("wer", F.round(al.error_rate(F.col("errors"), F.col("words")), 6))


@query("phrase_guard", rf"""
WITH {sql.REWRITES},
p AS (SELECT *, replace(lower(regexp_replace(original, '[^\p{{L}}\p{{N}}\p{{S}}]', '', 'g')),
    'ё', 'е') AS a,
  replace(lower(regexp_replace(rewritten, '[^\p{{L}}\p{{N}}\p{{S}}]', '', 'g')), 'ё', 'е') AS b,
  regexp_extract_all(original, '(\[[^\]]*\]|\{{[^}}]*\}}|<[^>]*>)', 1) AS c,
  regexp_extract_all(rewritten, '(\[[^\]]*\]|\{{[^}}]*\}}|<[^>]*>)', 1) AS d
  FROM rewrites)
SELECT item_id, md5(a) AS content_md5, len(c) AS controls,
  CASE WHEN trim(rewritten) = '' THEN 'empty_text' WHEN a <> b THEN 'phrase_changed'
    WHEN c <> d THEN 'controls_changed' ELSE 'accepted' END AS verdict FROM p""")
def phrase_guard(spark: SparkSession, folder: str) -> DataFrame:
    original, rewritten = F.col("original"), F.col("rewritten")
    return views.rewrites(spark, folder).select(
        "item_id",
        F.md5(F.encode(tx.protected_content(original), "UTF-8")).alias("content_md5"),
        F.size(tx.inline_controls(original)).alias("controls"),
        tx.rewrite_verdict(original, rewritten, F.col("reason")).alias("verdict"))


@query("edit_clean", f"""
WITH c AS (SELECT conv_id, turn, {sql.collapsed('text')} AS t FROM conversations)
SELECT conv_id, turn, md5(t) AS text_md5, length(t) AS chars,
  CASE WHEN t = '' THEN 'empty' WHEN length(t) > 20000 THEN 'too_long' ELSE 'ok' END AS verdict
FROM c""")
def edit_clean(spark: SparkSession, folder: str) -> DataFrame:
    clean = views.table(spark, folder, "conversations").select(
        "conv_id", "turn", tx.collapse_space(F.col("text")).alias("t"))
    return clean.select("conv_id", "turn", F.md5(F.encode("t", "UTF-8")).alias("text_md5"),
                        F.char_length("t").alias("chars"),
                        tx.edit_verdict(F.col("t")).alias("verdict"))


@query("id_audit", r"""
SELECT page_id AS row_id, 'url' AS kind,
  regexp_matches(url, '^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$') AS valid FROM pages
UNION ALL SELECT page_id, 'host', regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1),
  '^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$') FROM pages
UNION ALL SELECT doc_id, 'lang', regexp_matches(lang, '^[A-Za-z][A-Za-z0-9-]*$')
  AND length(lang) BETWEEN 2 AND 16 FROM documents
UNION ALL SELECT doc_id, 'source', regexp_matches(source,
  '^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$') FROM documents""")
def id_audit(spark: SparkSession, folder: str) -> DataFrame:
    pages = views.table(spark, folder, "pages").select("page_id", "url")
    docs = views.table(spark, folder, "documents").select("doc_id", "lang", "source")

    def valid(pattern, value):
        return F.coalesce(value.rlike(pattern), F.lit(False)).alias("valid")

    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    page_rows = pages.select("page_id", F.explode(F.array(
        F.struct(F.lit("url").alias("kind"), valid(tx.ID_PATTERN, F.col("url"))),
        F.struct(F.lit("host").alias("kind"), valid(tx.ID_PATTERN, host)))).alias("r"))
    lang_ok = (F.col("lang").rlike(tx.LANGUAGE_PATTERN)
               & F.char_length("lang").between(2, 16)).alias("valid")
    doc_rows = docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit("lang").alias("kind"), lang_ok),
        F.struct(F.lit("source").alias("kind"), valid(tx.ID_PATTERN, F.col("source"))),
    )).alias("r"))
    return page_rows.select(F.col("page_id").alias("row_id"), "r.*").unionAll(
        doc_rows.select(F.col("doc_id").alias("row_id"), "r.*"))


@query("json_contract", r"""
SELECT event_id, CASE WHEN event_type IN ('error', 'view', 'signup') THEN 'OUTPUT_INVALID'
  WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN 'OUTPUT_INVALID'
  ELSE 'ok' END AS verdict FROM events""")
def json_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Model outputs built from the event payloads: good ones and broken kinds."""
    props, kind, turn = F.col("props"), F.col("event_type"), F.col("event_id") % 4
    good = F.to_json(F.struct(props.alias("rewritten_text"), kind.alias("reason")))
    payload = (
        F.when(kind == "error", props)
        .when(kind == "view", F.concat(F.lit("[ "), good))
        .when(kind == "signup", F.to_json(F.struct(
            props.alias("rewritten_text"), F.lit(" \t").alias("reason"))))
        .when((kind == "purchase") & (turn == 1), F.concat(good, F.lit(" trailing")))
        .when((kind == "purchase") & (turn == 2), F.concat(good, F.lit(', {"x": 1}')))
        .when((kind == "purchase") & (turn == 3), F.concat(good, F.lit("]")))
        .otherwise(good))
    return views.table(spark, folder, "events").select(
        "event_id",
        tx.output_contract(payload, {"rewritten_text": 12_000, "reason": 1_000})
        .alias("verdict"))


@query("stable_keys", f"""
WITH {sql.BOOK_FRAGMENTS},
s AS (SELECT book_id, chapter_number, sha256(concat_ws(chr(0), 'section-v1', CAST(book_id AS
  VARCHAR), title, CAST(chapter_number AS VARCHAR))) AS section_key FROM chapters)
SELECT f.book_id, f.ordinal, s.section_key, sha256(f.text) AS content_hash,
  sha256(concat_ws(chr(0), 'segment-v1', s.section_key, CAST(f.ordinal_in_chapter AS VARCHAR),
    f.text, '60')) AS segment_key
FROM book_fragments f JOIN s USING (book_id, chapter_number)""")
def stable_keys(spark: SparkSession, folder: str) -> DataFrame:
    books = ch.with_chapters(views.books_with_blocks(spark, folder))
    keyed = books.withColumn("chapters", F.transform("chapters", lambda chapter: chapter.withField(
        "section_key", tx.content_key(
            "section-v1", F.col("book_id"), chapter["title"], chapter["chapter_number"]))))
    return ch.fragment_rows(keyed, "section_key").select(
        "book_id", "ordinal", "section_key",
        F.sha2(F.col("text"), 256).alias("content_hash"),
        tx.content_key("segment-v1", F.col("section_key"), F.col("ordinal_in_chapter"),
                       F.col("text"), F.lit("60")).alias("segment_key"))


@query("chapter_files", f"""
WITH {sql.CHAPTERS},
t AS (SELECT book_id, chapter_number, regexp_replace(nfc_normalize(title || ': ' || segs[1]),
  '[\\p{{Cc}}\\p{{Cf}}/\\\\<>:"|?*]', ' ', 'g') AS t FROM chapters),
c AS (SELECT book_id, chapter_number, trim({sql.collapsed('t')}, '. ') AS t FROM t),
n AS (SELECT book_id, chapter_number,
  CASE WHEN length(t) > 120 THEN rtrim(left(t, 120), '. ') ELSE t END AS t FROM c)
SELECT book_id, chapter_number, printf('character_%04d_', chapter_number) || CASE WHEN t = ''
  THEN 'Глава ' || chapter_number ELSE t END || '.flac' AS file_name FROM n""")
def chapter_files(spark: SparkSession, folder: str) -> DataFrame:
    chapters = ch.chapter_rows(ch.with_chapters(views.books_with_blocks(spark, folder)))
    named = chapters.select("book_id", "chapter_number", F.concat(
        "title", F.lit(": "), F.element_at("segments", 1)).alias("title"))
    return tx.with_file_name(named, "chapter_number", "title", "file_name").select(
        "book_id", "chapter_number", "file_name")


def _pad(byte: int) -> str:
    return bytes(x ^ byte for x in b"job-1".ljust(64, b"\0")).hex()


@query("seeds", f"""
WITH {sql.ATTEMPTS},
d AS (SELECT fragment_id, attempt, sha256(from_hex('{_pad(0x5C)}') || from_hex(sha256(
  from_hex('{_pad(0x36)}') || encode(fragment_id || chr(0) || attempt)))) AS digest FROM attempts)
SELECT fragment_id, attempt, ('0x' || substr(digest, 1, 16))::UBIGINT::DECIMAL(20, 0) AS seed
FROM d""")
def seeds(spark: SparkSession, folder: str) -> DataFrame:
    """The retry seed of every attempt."""
    seed = tx.retry_seed(F.lit("job-1"), F.col("fragment_id"), F.col("attempt"))
    return views.attempts(spark, folder).select("fragment_id", "attempt", seed.alias("seed"))


@query("duration_flags", f"""
WITH {sql.FRAGMENTS}
SELECT id, duration_ms, (chapter_number * 10) AS words,
  duration_ms > 1500 + chapter_number * 10 * 750
    AND NOT regexp_matches(chapter_title || ' ' || job_id, '[0-9]{{3,}}') AS excessive
FROM fragments""")
def duration_flags(spark: SparkSession, folder: str) -> DataFrame:
    words = F.col("chapter_number") * 10
    text = F.concat_ws(" ", "chapter_title", F.col("job_id").cast("string"))
    return views.fragments(spark, folder).select(
        "id", "duration_ms", words.alias("words"),
        de.excessive_duration(F.col("duration_ms"), words, text).alias("excessive"))


# Scored attempts: whole numbers derived from the events, so that both sides agree.
SCORED = f"""{sql.ATTEMPTS},
scored AS (
  SELECT fragment_id, attempt, event_id, code, event_id % 7 AS errors,
    10 + event_id % 50 AS words, code = 'failed' AS technical, event_id % 2 = 0 AS retryable,
    CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS hard_invalid_count,
    ((event_id % 7) * 1000000) // (10 + event_id % 50) AS wer_ppm,
    event_id % 11 = 0 AS truncated, (event_id * 7919) % 1000000 AS confidence_ppm,
    500000 + (event_id * 104729) % 1000000 AS duration_ppm, event_id % 3 AS warning_count,
    3 - ((attempt - 1) % 4) AS attempts_left
  FROM attempts),
decided AS (
  SELECT *, CASE WHEN technical AND NOT retryable THEN 'FAIL'
    WHEN (technical OR hard_invalid_count > 0) AND attempts_left > 0 THEN 'RETRY'
    WHEN NOT technical AND hard_invalid_count = 0 AND errors <= ceil(words / 10) THEN 'ACCEPT'
    WHEN NOT technical AND hard_invalid_count = 0 AND attempts_left > 0 THEN 'RETRY'
    WHEN NOT technical AND hard_invalid_count = 0 AND errors <= 5 THEN 'ACCEPT_WITH_WARNING'
    ELSE 'FAIL' END AS decision FROM scored)"""


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("event_id")
    scored = views.attempts(spark, folder).select(
        "fragment_id", "attempt", "event_id", "code",
        (number % 7).alias("errors"), (number % 50 + 10).alias("words"),
        (F.col("code") == "failed").alias("technical"), (number % 2 == 0).alias("retryable"),
        F.when(number % 9 == 0, 1).otherwise(0).alias("hard_invalid_count"),
        F.floor((number % 7) * 1_000_000 / (number % 50 + 10)).alias("wer_ppm"),
        (number % 11 == 0).alias("truncated"),
        (number * 7_919 % 1_000_000).alias("confidence_ppm"),
        (number * 104_729 % 1_000_000 + 500_000).alias("duration_ppm"),
        (number % 3).alias("warning_count"),
        (3 - (F.col("attempt") - 1) % 4).alias("attempts_left"))
    return scored.withColumn("decision", de.decision(
        F.col("technical"), F.col("retryable"), F.col("hard_invalid_count") > 0,
        F.col("errors"), al.error_threshold(F.col("words"), "MODERATE"),
        F.col("attempts_left"), F.lit(True), F.lit(5)))


@query("decide_v2", f"""
WITH {SCORED}
SELECT fragment_id, attempt, errors, attempts_left, decision FROM decided""")
def decide_v2(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder).select(
        "fragment_id", "attempt", "errors", "attempts_left", "decision")


@query("best_attempt", f"""
WITH {SCORED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY fragment_id ORDER BY
  CASE decision WHEN 'ACCEPT' THEN 0 WHEN 'ACCEPT_WITH_WARNING' THEN 1 ELSE 2 END,
  hard_invalid_count, errors, wer_ppm, truncated, confidence_ppm DESC,
  abs(duration_ppm - 1000000), warning_count, attempt) AS place FROM decided)
SELECT fragment_id, attempt, decision, errors, wer_ppm, confidence_ppm FROM ranked
WHERE place = 1""")
def best_attempt(spark: SparkSession, folder: str) -> DataFrame:
    return de.best_attempt(_decided(spark, folder)).select(
        "fragment_id", "attempt", "decision", "errors", "wer_ppm", "confidence_ppm")


@query("findings", """
SELECT event_id, array_to_string(list_filter([
  CASE WHEN value < 2 THEN 'AUDIO_EMPTY' END, CASE WHEN value < 5 THEN 'AUDIO_SILENCE' END,
  CASE WHEN event_type = 'error' THEN 'AUDIO_CORRUPT' END,
  CASE WHEN value > 60 THEN 'EXCESSIVE_DURATION' END,
  CASE WHEN event_id % 11 = 0 THEN 'POSSIBLE_TRUNCATION' END,
  CASE WHEN user_id % 10 = 0 THEN 'WRONG_LANGUAGE' END], lambda x: x IS NOT NULL), ',') AS hard,
  array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'CLIPPING' END,
  CASE WHEN value < 8 THEN 'LOW_RMS' END], lambda x: x IS NOT NULL), ',') AS soft
FROM events""")
def findings(spark: SparkSession, folder: str) -> DataFrame:
    value, number = F.col("value"), F.col("event_id")
    holds = [value < 2, value < 5, F.col("event_type") == "error", value > 60,
             number % 11 == 0, F.col("user_id") % 10 == 0]
    return views.table(spark, folder, "events").select(
        "event_id",
        F.array_join(de.findings(list(zip(de.HARD_INVALID, holds))), ",").alias("hard"),
        F.array_join(de.findings([("CLIPPING", number % 3 == 0), ("LOW_RMS", value < 8)]), ",")
        .alias("soft"))


POLICY = ", ".join(
    f"('{code}', '{same}', '{new}', {str(end).lower()})" for code, same, new, end
    in de.ERROR_POLICY)
POLICY_CODES = ", ".join(f"'{row[0]}'" for row in de.ERROR_POLICY)


@query("error_policy", f"""
WITH policy AS (SELECT * FROM (VALUES {POLICY}) AS t(code, retry_same, new_attempt, terminal)),
coded AS (SELECT event_id, [{POLICY_CODES}][1 + CAST(json_extract(props, '$.k') AS INT) % 14]
  AS code FROM events)
SELECT event_id, code, retry_same, new_attempt, terminal FROM coded JOIN policy USING (code)""")
def error_policy(spark: SparkSession, folder: str) -> DataFrame:
    codes = F.array(*[F.lit(row[0]) for row in de.ERROR_POLICY])
    place = F.get_json_object("props", "$.k").cast("int") % len(de.ERROR_POLICY)
    events = views.table(spark, folder, "events").select(
        "event_id", F.get(codes, place).alias("code"))
    # A fixed table of 14 rows.
    return events.join(F.broadcast(de.error_policy(spark)), "code").select(
        "event_id", "code", "retry_same", "new_attempt", "terminal")


@query("retry_budget", f"""
WITH {sql.ATTEMPTS},
r AS (SELECT *, count(CASE WHEN code NOT IN ('transcript_mismatch', 'audio_warning') THEN 1 END)
  OVER (PARTITION BY fragment_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING) AS run FROM attempts),
u AS (SELECT *, row_number() OVER (PARTITION BY fragment_id, run ORDER BY attempt) - 1
  AS used FROM r)
SELECT fragment_id, attempt, code, used AS retries_used, greatest(5 - used, 0) AS retries_left,
  code IN ('transcript_mismatch', 'audio_warning') AND used < 5 AS should_retry,
  code IN ('transcript_mismatch', 'audio_warning') AND used = 5 AS exhausted,
  used > 5 AS over_budget FROM u""")
def retry_budget(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.row_count(spark, folder, "events")
    return de.retry_budget(views.attempts(spark, folder), at_most=rows)


@query("repeat_failures", f"""
WITH {sql.ATTEMPTS},
i AS (SELECT *, attempt - row_number() OVER (PARTITION BY fragment_id, code ORDER BY attempt)
  AS island FROM attempts)
SELECT fragment_id, code, min(attempt) AS first_attempt, max(attempt) AS last_attempt,
  count(*) AS length FROM i WHERE code IN ('failed', 'transcript_mismatch', 'audio_warning')
GROUP BY fragment_id, code, island HAVING count(*) >= 2""")
def repeat_failures(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.row_count(spark, folder, "events")
    return de.repeated_failures(views.attempts(spark, folder), at_most=rows)


@query("confidence", """
WITH p AS (SELECT vec_id, list_transform(embedding, lambda v:
  least(1.0, greatest(0.0, CAST(v AS DOUBLE) + 0.5))) AS probs, embedding[1] AS first
  FROM embeddings)
SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN exp(-abs(CAST(first AS DOUBLE)))
  ELSE list_sum(probs) / len(probs) END, 6) AS confidence,
  CAST(greatest(0, round_even(CAST(first AS DOUBLE) * 1000, 0)) AS INT) AS start_ms FROM p""")
def confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Nested transcripts: 64 words in four segments, or segments with a log score only."""
    samples = F.col("samples")
    scored = F.transform(samples, lambda v: F.struct(
        (v.cast("double") + 0.5).alias("probability")))
    first = F.element_at(samples, 1).cast("double")
    no_words = F.array().cast("array<struct<probability:double>>")
    nested = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(
        (-F.abs(first)).alias("avg_logprob"),
        F.when(F.col("vec_id") % 3 == 0, no_words)
        .otherwise(F.slice(scored, i * 16 + 1, 16)).alias("words")))
    rows = views.waves(spark, folder).select(
        "vec_id", nested.alias("segments"), first.alias("first"))
    return de.confidence_rollup(rows).select(
        "vec_id", F.round("confidence", 6).alias("confidence"),
        de.milliseconds(F.col("first")).alias("start_ms"))
