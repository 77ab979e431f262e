"""Attempt, revision and review history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.hot_groups import numbered

# Fixed values of the data contract.
MAX_AUDIO_BYTES = 16 * 1024 * 1024


def latest(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """Row with the greatest ``order`` per key: combined before the shuffle, no sort."""
    rest = [name for name in frame.columns if name != key]
    return frame.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def latest_job(jobs: DataFrame) -> DataFrame:
    return latest(jobs, "book_id", "created_at", "job_id")


def current_revision(revisions: DataFrame) -> DataFrame:
    return latest(revisions, "fragment_id", "revision_number", "id")


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """Number of attempts, the latest outcome and the first success of a fragment."""
    return attempts.groupBy("fragment_id").agg(
        F.count("*").alias("attempts"),
        F.max_by("code", "attempt").alias("last_code"),
        F.max("attempt").alias("last_attempt"),
        F.min(F.when(F.col("code") == "ready", F.col("attempt"))).alias("first_ready"))


def backfill_revisions(fragments: DataFrame, revisions: DataFrame) -> DataFrame:
    """``original`` revisions for the fragments that have none."""
    missing = fragments.join(
        revisions.where(F.col("revision_number") == 1).select("fragment_id"),
        "fragment_id", "left_anti")
    return missing.select(
        F.concat(F.col("fragment_id").cast("string"), F.lit(":original")).alias("id"),
        "fragment_id", F.lit(1).cast("long").alias("revision_number"),
        F.lit("original").alias("source"), "text",
        F.lit(None).cast("string").alias("parent_id"))


def append_revisions(
    revisions: DataFrame, requests: DataFrame, at_most: int | None = None
) -> DataFrame:
    """New revisions for requests, numbered on from the current one of the fragment.

    ``requests``: fragment_id, requested_at, request_id, kind (manual, ai, restore),
    text, selected_id. Manual and AI revisions follow the revision before them;
    a restore follows the selected revision and copies its text. Every request gets a
    ``verdict``: ``appended``, ``unknown_fragment`` or ``unknown_revision``; refused ones
    have no revision and are not numbered.
    """
    current = revisions.groupBy("fragment_id").agg(
        F.max("revision_number").alias("_last"),
        F.max_by("id", F.struct("revision_number", "id")).alias("_last_id"))
    selected = revisions.select(
        "fragment_id", F.col("id").alias("selected_id"), F.col("text").alias("_old_text"))
    judged = (
        requests.join(current, "fragment_id", "left")
        .join(selected.withColumn("_found", F.lit(True)), ["fragment_id", "selected_id"], "left")
        .withColumn("verdict", (
            F.when(F.col("_last").isNull(), "unknown_fragment")
            .when((F.col("kind") == "restore") & F.col("_found").isNull(), "unknown_revision")
            .otherwise("appended"))))
    placed = numbered(
        judged, ["fragment_id", "verdict"], ["requested_at", "request_id"], "_nth", at_most)
    number = F.when(F.col("verdict") == "appended", F.col("_last") + F.col("_nth"))

    def ident(value):
        return F.concat(F.col("fragment_id").cast("string"), F.lit(":"), value.cast("string"))

    made = F.col("verdict") == "appended"
    return placed.select(
        "request_id", "verdict",
        ident(number).alias("id"), "fragment_id", number.alias("revision_number"),
        F.col("kind").alias("source"),
        F.when(made & (F.col("kind") == "restore"), F.col("_old_text"))
        .when(made, F.col("text")).alias("text"),
        F.when(made & (F.col("kind") == "restore"), F.col("selected_id"))
        .when(made & (F.col("_nth") == 1), F.col("_last_id"))
        .when(made, ident(number - 1)).alias("parent_id"))


def audit_revisions(revisions: DataFrame) -> DataFrame:
    """Per fragment: gaps, repeats, and broken origin or parent rules.

    The parent is looked up by its own fragment and id, so no fragment is gathered.
    """
    parents = revisions.select(
        "fragment_id", F.col("id").alias("parent_id"), F.lit(True).alias("_found"))
    checked = revisions.join(parents, ["fragment_id", "parent_id"], "left")
    first = F.col("revision_number") == 1
    origin = (first == (F.col("source") == "original")) & (first == F.col("parent_id").isNull())
    numbers = checked.groupBy("fragment_id", "revision_number").agg(
        F.count("*").alias("_rows"),
        F.count_if(~origin).alias("_origin"),
        F.count_if(F.col("parent_id").isNotNull()
                   & (F.col("_found").isNull() | (F.col("parent_id") == F.col("id"))))
        .alias("_parent"))
    return numbers.groupBy("fragment_id").agg(
        F.sum("_rows").alias("revisions"),
        ((F.min("revision_number") != 1) | (F.max("revision_number") != F.count("*")))
        .alias("has_gap"),
        F.coalesce(F.bool_or(F.col("_rows") > 1), F.lit(False)).alias("has_repeat"),
        F.sum("_origin").alias("bad_origin"),
        F.sum("_parent").alias("bad_parent"))


def approval_verdicts(requests: DataFrame, fragments: DataFrame) -> DataFrame:
    """Which approval requests may go through, and why the others may not.

    ``fragments``: id, status, pcm_bytes, sample_rate, channels, sample_width,
    duration_ms.
    """
    joined = requests.join(fragments, "id", "left")
    frame_bytes = F.col("channels") * F.col("sample_width")
    playable = (
        (F.col("pcm_bytes") > 0) & (F.col("pcm_bytes") <= MAX_AUDIO_BYTES)
        & (F.col("sample_rate") > 0) & (F.col("sample_rate") <= 4_294_967_295)
        & (F.col("channels") > 0) & (F.col("channels") <= 65_535)
        & (F.col("sample_width") == 2) & (frame_bytes <= 65_535)
        & (F.col("duration_ms") >= 0) & (F.col("pcm_bytes") % frame_bytes == 0))
    return joined.withColumn("verdict", (
        F.when(F.col("status").isNull(), "not_found")
        .when(F.col("status") != "warning", "not_warning")
        .when(~playable, "no_playable_audio").otherwise("approved")))


def review_trail(reviews: DataFrame, attempts: DataFrame) -> DataFrame:
    """Reviews in order per fragment, with the outcome of the attempt that was reviewed.

    ``reviews``: review_id, fragment_id, attempt, created_at; one output row per review.
    """
    codes = attempts.select("fragment_id", "attempt", F.col("code").alias("warning_code"))
    placed = numbered(reviews, ["fragment_id"], ["created_at", "review_id"], "review_number")
    return placed.join(codes, ["fragment_id", "attempt"], "left").withColumn(
        "decision", F.lit("approved"))


def apply_rewrites(results: DataFrame, current: DataFrame) -> DataFrame:
    """Verdict for every rewrite result against the present fragments.

    ``results``: task_id, task_model_id, fragment_id, place, expected_text,
    rewritten, model_id, model_revision. ``current``: fragment_id, status, text.
    The first result that completes pins the model revision of its task, and the first
    one applied to a fragment makes later ones for it conflicts.
    """
    joined = results.join(current, "fragment_id", "left")
    same_model = (F.col("model_id") == F.col("task_model_id")) & (F.col("model_revision") != "")
    untouched = F.coalesce(
        (F.col("status") == "warning") & (F.col("text") == F.col("expected_text")), F.lit(False))
    judged = joined.withColumns({"_model": same_model, "_untouched": untouched})
    pins = judged.where("_model AND _untouched").groupBy("task_id").agg(
        F.min("place").alias("_pinned_at"),
        F.min_by("model_revision", "place").alias("_pinned"))
    other = (F.col("place") > F.col("_pinned_at")) & (F.col("model_revision") != F.col("_pinned"))
    alone = judged.join(pins, "task_id", "left").withColumn("verdict", (
        F.when(~F.col("_model"), "invalid")
        .when(F.coalesce(other, F.lit(False)) | ~F.col("_untouched"), "conflict")
        .when(F.col("rewritten") == F.col("expected_text"), "unchanged")
        .otherwise("applied")))
    first = alone.where("verdict = 'applied'").groupBy("fragment_id").agg(
        F.min(F.struct("place", "task_id")).alias("_first"))
    late = F.struct("place", "task_id") > F.col("_first")
    return alone.join(first, "fragment_id", "left").withColumn("verdict", F.when(
        F.col("verdict").isin("applied", "unchanged") & F.coalesce(late, F.lit(False)),
        "conflict").otherwise(F.col("verdict")))


def rewritten_state(current: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Fragment table after the applied results; everything else stays as it is.

    ``current`` also has warning_code. A fragment has one applied result at most.
    """
    applied = verdicts.where(F.col("verdict") == "applied").select(
        "fragment_id", F.col("rewritten").alias("_new"))
    return current.join(applied, "fragment_id", "left").select(
        "fragment_id",
        F.coalesce("_new", "text").alias("text"), "status",
        F.when(F.col("_new").isNotNull(), "text_rewritten").otherwise(F.col("warning_code"))
        .alias("warning_code"))
