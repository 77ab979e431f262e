"""Budgets, stretches, reviews, rewrites and joined audio on small planted cases."""

from pyspark.sql import functions as F

from lectern.operators import decisions as de
from lectern.operators import export as ex
from lectern.operators import history as hi
from lectern.operators import replay as re


def test_a_budget_is_not_renewed(spark):
    attempts = spark.range(1, 10).select(
        F.lit(1).alias("fragment_id"), F.col("id").alias("attempt"),
        F.lit("audio_warning").alias("code"))
    rows = {r["attempt"]: r for r in de.retry_budget(attempts).collect()}
    assert [rows[k]["retries_left"] for k in (1, 2, 6, 7, 9)] == [5, 4, 0, 0, 0]
    assert [k for k in rows if rows[k]["should_retry"]] == [1, 2, 3, 4, 5]
    assert [k for k in sorted(rows) if rows[k]["over_budget"]] == [7, 8, 9]


def test_good_outcomes_are_no_failures(spark):
    codes = ["ready", "ready", "failed", "failed", "text_edited", "text_edited", "failed"]
    attempts = spark.createDataFrame(
        [(1, k, c) for k, c in enumerate(codes)], "fragment_id int, attempt int, code string")
    found = de.repeated_failures(attempts).collect()
    assert [(r["code"], r["first_attempt"], r["length"]) for r in found] == [("failed", 2, 2)]


def test_a_review_shows_the_attempt_it_judged(spark):
    attempts = spark.createDataFrame([(5, k, f"c{k}") for k in range(1, 10)],
                                     "fragment_id int, attempt int, code string")
    reviews = spark.createDataFrame([(1, 5, 1, 10), (2, 5, 99, 20)],
                                    "review_id int, fragment_id int, attempt int, created_at int")
    found = sorted(hi.review_trail(reviews, attempts).collect(), key=lambda r: r["review_id"])
    assert [(r["attempt"], r["warning_code"], r["review_number"]) for r in found] == [
        (1, "c1", 1), (99, None, 2)]


def test_one_rewrite_is_applied_to_a_fragment(spark):
    current = spark.createDataFrame(
        [(1, "warning", "old", "audio_warning"), (2, "warning", "two", "transcript_mismatch")],
        "fragment_id int, status string, text string, warning_code string")
    results = spark.createDataFrame(
        [(9, "m", 1, 1, "old", "new", "m", "r"), (9, "m", 1, 2, "old", "newer", "m", "r"),
         (9, "m", 1, 3, "old", "old", "m", "r")],
        "task_id int, task_model_id string, fragment_id int, place int, expected_text string, "
        "rewritten string, model_id string, model_revision string")
    verdicts = hi.apply_rewrites(results, current.drop("warning_code"))
    assert [r["verdict"] for r in sorted(verdicts.collect(), key=lambda r: r["place"])] == [
        "applied", "conflict", "conflict"]
    state = sorted(map(tuple, hi.rewritten_state(current, verdicts).collect()))
    assert state == [(1, "new", "warning", "text_rewritten"),
                     (2, "two", "warning", "transcript_mismatch")]


def test_refused_requests_have_a_verdict(spark):
    revisions = spark.createDataFrame(
        [("1:1", 1, 1, "original", "t", None)], "id string, fragment_id int, revision_number int, "
        "source string, text string, parent_id string")
    requests = spark.createDataFrame(
        [(1, 10, 1, "manual", "a", None), (1, 20, 2, "restore", None, "1:7"),
         (2, 30, 3, "ai", "b", None)], "fragment_id int, requested_at int, request_id int, "
        "kind string, text string, selected_id string")
    found = {r["request_id"]: r for r in hi.append_revisions(revisions, requests).collect()}
    assert [found[k]["verdict"] for k in (1, 2, 3)] == [
        "appended", "unknown_revision", "unknown_fragment"]
    assert [found[k]["revision_number"] for k in (1, 2, 3)] == [2, None, None]


def test_audio_bounds(spark):
    base = dict(status="warning", pcm_bytes=131_072, sample_rate=24_000, channels=1,
                sample_width=2, duration_ms=1)
    cases = [{}, {"channels": 32_768}, {"channels": 32_767, "pcm_bytes": 65_534},
             {"sample_rate": 4_294_967_296}]
    fragments = spark.createDataFrame([(i, *{**base, **c}.values()) for i, c in enumerate(cases)],
                                      "id int, status string, pcm_bytes long, sample_rate long, "
                                      "channels long, sample_width long, duration_ms long")
    found = hi.approval_verdicts(fragments.select("id"), fragments).orderBy("id").collect()
    assert [r["verdict"] for r in found] == [
        "approved", "no_playable_audio", "approved", "no_playable_audio"]


def test_a_chapter_of_two_rates_is_not_uniform(spark):
    rows = [(1, 1, n, str(n), 100, bytes([n]), 24_000 if n < 5 else 48_000, 1, 2)
            for n in range(1, 9)]
    fragments = spark.createDataFrame(
        rows, "job_id int, chapter_number int, ordinal int, id string, samples long, pcm binary, "
        "sample_rate int, channels int, sample_width int")
    found = ex.joined_pcm(fragments, part_samples=100).collect()
    assert len(found) == 8 and not any(r["uniform_format"] for r in found)


def test_retries_can_be_cancelled_and_are_guarded(spark):
    steps = [("start", True), ("complete_with_audio_warning", True), ("auto_retry", True),
             ("cancel_retry", True), ("ai_rewrite_same", True), ("approve", True),
             ("restore", True), ("auto_retry", False), ("approve", False), ("manual_retry", True),
             ("restore", True), ("cancel_retry", True), ("ai_rewrite", True), ("manual_retry", True),
             ("start", True), ("cancel_retry", False), ("fail", True), ("manual_retry", True),
             ("cancel_retry", True), ("manual_edit", True), ("ai_rewrite_same", True)]
    events = spark.createDataFrame([(1, k, action) for k, (action, _) in enumerate(steps)],
                                   "f int, k int, action string")
    rows = re.replay(events, "f", ["k"]).orderBy("k").collect()
    assert [r["legal"] for r in rows] == [legal for _, legal in steps]
    assert [r["to_status"] for r in rows[2:7]] == [
        "pending", "warning", "warning", "ready", "warning"]
    state = re.current_states(re.replay(events, "f", ["k"]), "f", ["k"]).first()
    assert (state["status"], state["warning_code"], state["attempt"], state["rejected"]) == (
        "warning", "text_edited", 2, 3)
