"""Alignment, decisions, retries, confidence, audio, settings, selection, inference."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import audio as au
from lectern.operators import align as al
from lectern.operators import contracts as co
from lectern.operators import decisions as de
from lectern.operators import export as ex
from lectern.operators import history as hi
from lectern.operators import infer as inf
from lectern.operators import rollup as ro
from lectern.operators import selection as se
from lectern.streaming import feeds


def distance(left, right):
    row = list(range(len(right) + 1))
    for i, a in enumerate(left, 1):
        new = [i]
        for j, b in enumerate(right, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def most_matches(left, right):
    """Least errors and, with these, the most matches."""
    row = [(j, 0) for j in range(len(right) + 1)]
    for i, a in enumerate(left, 1):
        new = [(i, 0)]
        for j, b in enumerate(right, 1):
            paired = row[j - 1]
            new.append(min((row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1]),
                           (paired[0], paired[1] - 1) if a == b else (paired[0] + 1, paired[1])))
        row = new
    return row[-1][0], -row[-1][1]


@pytest.mark.parametrize("seed, longest", [(1, 14), (2, 40), (3, 120)])
def test_alignment_is_cheapest_and_whole(seed, longest):
    draw = random.Random(seed)
    for _ in range(15_000 // longest):
        letters = "abcdefgh"[:draw.choice([1, 2, 3, 8])]
        left = draw.choices(letters, k=draw.randint(0, longest))
        right = draw.choices(letters, k=draw.randint(0, longest))
        if draw.random() < 0.5:
            right = [w for w in left if draw.random() < 0.8]
            right.insert(draw.randint(0, len(right)), "h")
        steps = al.align_words(left, right)
        counts = al.count_edits(left, right)
        names = [s["op"] for s in steps]
        assert counts == tuple(names.count(op) for op in (
            "match", "substitution", "deletion", "insertion"))
        assert (sum(counts[1:]), counts[0]) == most_matches(left, right)
        assert [s["expected"] for s in steps if s["op"] != "insertion"] == left
        assert [s["actual"] for s in steps if s["op"] != "deletion"] == right
        assert all((s["expected"] == s["actual"]) == (s["op"] == "match") for s in steps)


def test_long_alignments_are_as_short_ones():
    """Many errors, and a length that differs by thousands of words, change no rule."""
    draw = random.Random(4)
    words = [str(draw.randrange(400)) for _ in range(6_000)]
    kept = [w for k, w in enumerate(words) if k % 5]
    assert al.count_edits(words, kept) == (4_800, 0, 1_200, 0)
    assert al.count_edits(kept, words) == (4_800, 0, 0, 1_200)
    assert al.count_edits(words, words[:1_000]) == (1_000, 0, 5_000, 0)
    swapped = ["other" if k % 7 == 3 else w for k, w in enumerate(words)]
    assert al.count_edits(words, swapped) == (6_000 - 857, 857, 0, 0)


def test_alignment_rows(spark):
    frame = spark.createDataFrame([(1, "one two three", "one blue three four"), (2, "", "")],
                                  "i int, e string, a string")
    found = {r["i"]: [(o["op"], o["expected_index"], o["actual_index"]) for o in r["alignment"]]
             for r in al.align(frame, "e", "a").collect()}
    assert found == {1: [("match", 0, 0), ("substitution", 1, 1), ("match", 2, 2),
                         ("insertion", None, 3)], 2: []}


@pytest.mark.parametrize("words, wanted", [
    (0, (1, 0, 0, 0)), (10, (2, 1, 0, 0)), (11, (3, 2, 1, 0)), (100, (11, 10, 9, 0))])
def test_thresholds(spark, words, wanted):
    row = spark.range(1).select(*[
        al.error_threshold(F.lit(words), name) for name in
        ("LOW", "MODERATE", "HIGH", "INTOLERANT")]).first()
    assert tuple(row) == wanted


def outcomes(spark, codes):
    rows = [(1, i, code) for i, code in enumerate(codes, 1)]
    return spark.createDataFrame(rows, "fragment_id long, attempt long, code string")


def test_retry_budget(spark):
    def flags(codes, retries):
        rows = de.retry_budget(outcomes(spark, codes), retries).orderBy("attempt").collect()
        return [(r["retries_left"], r["should_retry"], r["exhausted"]) for r in rows]

    bad = "transcript_mismatch"
    assert flags([bad] * 6, 5) == [(5 - i, i < 5, i == 5) for i in range(6)]
    assert flags([bad, "ready"], 5) == [(5, True, False), (4, False, False)]
    assert flags(["failed"], 5) == [(5, False, False)]
    assert flags([bad], 0) == [(0, False, True)]


def test_repeated_failures(spark):
    x, y = "audio_warning", "failed"
    rows = de.repeated_failures(outcomes(spark, [x, x, y, x, y, y, y])).collect()
    assert sorted((r["code"], r["first_attempt"], r["last_attempt"]) for r in rows) == [
        (x, 1, 2), (y, 5, 7)]


@pytest.mark.parametrize("technical, retryable, hard, errors, left, effort, wanted", [
    (True, False, False, 0, 3, True, "FAIL"),
    (True, True, False, 0, 3, True, "RETRY"),
    (True, True, False, 0, 0, True, "FAIL"),
    (False, False, True, 0, 1, True, "RETRY"),
    (False, False, True, 0, 0, True, "FAIL"),
    (False, False, False, 2, 0, True, "ACCEPT"),
    (False, False, False, 3, 1, True, "RETRY"),
    (False, False, False, 3, 0, True, "ACCEPT_WITH_WARNING"),
    (False, False, False, 3, 0, False, "FAIL"),
    (False, False, False, 6, 0, True, "FAIL"),
])
def test_decision(spark, technical, retryable, hard, errors, left, effort, wanted):
    found = spark.range(1).select(de.decision(
        F.lit(technical), F.lit(retryable), F.lit(hard), F.lit(errors), F.lit(2),
        F.lit(left), F.lit(effort), F.lit(5)).alias("d")).first()["d"]
    assert found == wanted


def test_confidence(spark):
    rows = [(1, [(-0.5, [(0.5,), (1.5,)]), (None, [])]), (2, [(-1.0, []), (None, [])]), (3, []),
            (4, [(2.0, [])])]
    frame = spark.createDataFrame(
        rows, "i int, segments array<struct<avg_logprob:double,words:array<struct<probability:double>>>>")
    found = {r["i"]: r["confidence"] for r in de.confidence_rollup(frame).collect()}
    assert found == {1: 0.75, 2: pytest.approx(math.exp(-1) / 2), 3: 0.0, 4: 1.0}


def test_half_even_milliseconds(spark):
    row = spark.range(1).select(*[de.milliseconds(F.lit(v)) for v in (0.0005, 0.0015, -3.0)]).first()
    assert tuple(row) == (0, 2, 0)


def wave(spark, *waves):
    return spark.createDataFrame([(i, list(w)) for i, w in enumerate(waves)],
                                 "i int, x array<float>").orderBy("i")


def test_audio(spark):
    x = F.col("x")
    frame = wave(spark, [0.0] * 4, [0.2, 1.1, -1.2], [float("nan"), float("inf"), 0.5])
    rows = frame.select(
        (au.rms(x) < au.SILENCE_RMS).alias("silent"), au.clipping_ratio(x).alias("clip"),
        au.quantize_verdict(x, 24_000).alias("v"), au.peak_normalized(x).alias("n")).collect()
    assert rows[0]["silent"] and rows[0]["v"] == "silent" and rows[0]["n"] == [0.0] * 4
    assert rows[1]["clip"] == pytest.approx(2 / 3) and rows[1]["v"] == "ok"
    assert rows[2]["v"] == "not_finite" and rows[2]["n"] == [0.0, 0.0, 1.0]


def test_packing_equals_numpy(spark):
    values = np.sin(np.arange(2400) * 440 * 2 * np.pi / 24_000).astype(np.float32) * 1.3
    row = wave(spark, [float(v) for v in values]).select(
        au.quantized(F.col("x")).alias("q"), au.pack_pcm(F.col("x")).alias("p")).first()
    wanted = np.rint(np.clip(values, -1, 1) * np.float32(32767)).astype("<i2")
    assert row["q"] == wanted.tolist() and bytes(row["p"]) == wanted.tobytes()
    length = spark.range(1).select(au.duration_ms(F.lit(2400), F.lit(24_000)).alias("d"))
    assert length.first()["d"] == 100


def test_pcm_parts_are_bounded_and_whole(spark):
    rows = [(1, 1, i, str(i), 10, bytearray([i % 256] * 20), 24_000, 1, 2) for i in range(1, 101)]
    frame = spark.createDataFrame(
        rows, "job_id long, chapter_number int, ordinal long, id string, samples long, "
        "pcm binary, sample_rate int, channels int, sample_width int")
    parts = ex.joined_pcm(frame, part_samples=95).orderBy("part").collect()
    assert len(parts) == 11 and max(p["samples"] for p in parts) <= 95 + 10
    assert b"".join(bytes(p["pcm"]) for p in parts) == b"".join(bytes(r[5]) for r in rows)


def test_manifest_parts(spark):
    rows = [(1, 1 + i // 60, "T", i + 1, f"1-{i + 1}", "ready", 5, 120, 0, "p") for i in range(100)]
    placed = spark.createDataFrame(
        rows, "job_id long, chapter_number int, chapter_title string, ordinal long, id string, "
        "status string, duration_ms long, samples long, start_sample long, path string")
    heads = spark.createDataFrame([(1, "b")], "job_id long, book string")
    parts = ex.manifest(heads, placed, part_fragments=30).select("part", F.from_json(
        "document", "part int, chapters array<struct<chapter_number:int>>, "
        "fragments array<struct<ordinal:long>>").alias("d")).orderBy("part").collect()
    assert [len(p["d"]["fragments"]) for p in parts] == [30, 30, 30, 10]
    assert [[c["chapter_number"] for c in p["d"]["chapters"]] for p in parts] == [[1], [], [2], []]
    assert [f["ordinal"] for p in parts for f in p["d"]["fragments"]] == list(range(1, 101))


def test_settings_defaults_are_valid(spark):
    row = co.settings_audit(spark.range(1)).first()
    assert row["violation"] == "" and row["num_steps"] == 32.0 and row["vad_filter"] is False


@pytest.mark.parametrize("name, value", [
    ("num_steps", 0.0), ("speed", math.nan), ("t_shift", math.inf), ("patience", 2.01),
    ("stt_temperature", -0.1), ("automatic_warning_retries", 11.0)])
def test_settings_ranges(spark, name, value):
    frame = spark.range(1).withColumn(name, F.lit(value))
    assert co.settings_audit(frame).first()["violation"] == name


def test_job_pages(spark):
    jobs = spark.createDataFrame(
        [(i, s, i % 2) for i, s in enumerate(["queued", "running", "failed", "queued"])],
        "job_id long, status string, created_at long")
    page = ro.job_page(jobs, "active", 2, 1).collect()
    assert [(r["job_id"], r["total"]) for r in page] == [(3, 3), (0, 3)] or [
        (r["job_id"], r["total"]) for r in page] == [(1, 3), (0, 3)]
    for bad in ({"status": "odd"}, {"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            ro.job_page(jobs, **bad)


def test_job_rollup_order(spark):
    states = {1: ["ready"], 2: ["ready", "warning"], 3: ["failed", "warning"],
              4: ["pending", "failed"], 5: ["generating"], 6: []}
    jobs = spark.createDataFrame([(k,) for k in states], "job_id long")
    rows = [(k, s) for k, values in states.items() for s in values]
    found = ro.job_rollup(jobs, spark.createDataFrame(rows, "job_id long, status string"))
    assert {r["job_id"]: r["status"] for r in found.collect()} == {
        1: "completed", 2: "completed_with_warnings", 3: "failed", 4: "running",
        5: "running", 6: "completed"}


def test_retry_selection(spark):
    fragments = spark.createDataFrame(
        [("a", 1, "warning", 1), ("b", 1, "ready", 2), ("c", 2, "failed", 1), ("d", 3, "failed", 1)],
        "id string, job_id long, status string, ordinal long")
    jobs = spark.createDataFrame([(1, "failed"), (2, "running"), (3, "failed")],
                                 "job_id long, status string")
    requests = spark.createDataFrame(
        [(1, x) for x in ("a", "b", "c", "e", "e")], "job_id long, fragment_id string")
    rows = se.retry_selection(requests, fragments, jobs, spark.createDataFrame([(3,)], "job_id long"))
    assert sorted((r["job_id"], r["fragment_id"], r["verdict"], r["job_verdict"])
                  for r in rows.collect()) == [
        (1, "a", "ok", "ok"), (1, "b", "not_retryable", "ok"), (1, "c", "wrong_job", "ok"),
        (1, "e", "duplicate", "ok"), (2, "c", "ok", "job_active"),
        (3, "d", "ok", "rewrite_active")]


def test_rewrite_apply_pins_the_first_completed_model(spark):
    results = spark.createDataFrame(
        [(1, "m", i, i, "t", new, model, rev) for i, (new, model, rev) in enumerate([
            ("t!", "x", "r9"), ("t!", "m", ""), ("t!", "m", "r1"), ("t", "m", "r1"),
            ("t!", "m", "r2")])],
        "task_id int, task_model_id string, fragment_id int, place int, expected_text string, "
        "rewritten string, model_id string, model_revision string")
    current = spark.createDataFrame([(i, "warning", "t") for i in range(5)],
                                    "fragment_id int, status string, text string")
    found = hi.apply_rewrites(results, current)
    assert [r["verdict"] for r in found.orderBy("place").collect()] == [
        "invalid", "invalid", "applied", "unchanged", "conflict"]
    state = hi.rewritten_state(current.withColumn("warning_code", F.lit("w")), found)
    assert [(r["text"], r["warning_code"]) for r in state.orderBy("fragment_id").collect()] == [
        ("t", "w"), ("t", "w"), ("t!", "text_rewritten"), ("t", "w"), ("t", "w")]


def test_inference_keeps_bad_rows(spark):
    def load():
        def model(rows):
            if (rows["id"] == 0).any():
                raise ZeroDivisionError("division by zero")
            return (10 / rows[["id"]]).rename(columns={"id": "half"})

        return model

    found = inf.infer(spark.range(3), load, "half double", group="id")
    assert [(r["id"], r["half"], bool(r["error"])) for r in found.orderBy("id").collect()] == [
        (0, None, True), (1, 10.0, False), (2, 5.0, False)]


def test_feed_pages(spark):
    events = spark.range(10).withColumnRenamed("id", "event_id")
    assert [r[0] for r in feeds.feed_page(events, 4, 3).collect()] == [5, 6, 7]


def test_count_mismatches(spark):
    fragments = spark.createDataFrame([(1,), (1,), (2,)], "job_id long")
    declared = spark.createDataFrame([(1, 2), (2, 2), (3, 0), (4, 1)],
                                     "job_id long, fragments_count long")
    found = ro.count_mismatches(fragments, declared).collect()
    assert sorted((r["job_id"], r["actual"]) for r in found) == [(2, 1), (4, 0)]
