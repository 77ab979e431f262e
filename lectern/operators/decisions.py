"""Quality decisions over attempts, as ordered column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.hot_groups import numbered, running

# Fixed values of the data contract.
RETRYABLE_CODES = ("transcript_mismatch", "audio_warning")
FAILURE_CODES = ("failed", *RETRYABLE_CODES)
DEFAULT_RETRIES = 5
HARD_INVALID = ("AUDIO_EMPTY", "AUDIO_SILENCE", "AUDIO_CORRUPT", "EXCESSIVE_DURATION",
                "POSSIBLE_TRUNCATION", "WRONG_LANGUAGE")
ERROR_POLICY = [
    # code, retry the same task, make a new attempt, terminal
    ("UNAVAILABLE", "yes", "no", False),
    ("CONNECTION_LOST", "yes", "no", False),
    ("INVALID_REQUEST", "no", "no", True),
    ("VOICE_REFERENCE_ERROR", "no", "no", True),
    ("MODEL_NOT_READY", "yes", "no", False),
    ("OUT_OF_MEMORY", "limited", "maybe", False),
    ("TIMEOUT", "limited", "yes", False),
    ("INFERENCE_ERROR", "limited", "yes", False),
    ("OUTPUT_INVALID_AUDIO", "no", "yes", False),
    ("TRANSCRIPTION_TRANSIENT", "yes", "no", False),
    ("TRANSCRIPT_POOR", "no", "yes", False),
    ("DURATION_OR_TRUNCATION", "no", "yes", False),
    ("REPEATED_FINGERPRINT", "no", "no", True),
    ("CANCELLED", "no", "no", True),
]


def warning_code(expected: Column, transcript: Column, notes: Column) -> Column:
    """First rule that holds over compared texts, or the empty string."""
    return (
        F.when(expected != transcript, "transcript_mismatch")
        .when(F.size(notes) > 0, "audio_warning").otherwise("")
    )


def error_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ERROR_POLICY, "code string, retry_same string, new_attempt string, terminal boolean")


def excessive_duration(duration_ms: Column, words: Column, text: Column) -> Column:
    """Longer than 1.5 s + 0.75 s per word, unless a word has three digits or more."""
    limit = F.lit(1500) + words * 750
    return (duration_ms > limit) & ~text.rlike(r"\d{3,}")


def findings(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))


def decision(
    technical: Column, retryable: Column, hard_invalid: Column, errors: Column,
    threshold: Column, attempts_left: Column, best_effort: Column, best_effort_limit: Column,
) -> Column:
    """FAIL, RETRY, ACCEPT or ACCEPT_WITH_WARNING by the first step that applies.

    ``technical`` is true for attempts that gave no candidate; those and hard
    invalid ones can never be accepted.
    """
    usable = ~technical & ~hard_invalid
    more = attempts_left > 0
    return (
        F.when(technical & ~retryable, "FAIL")
        .when((technical | hard_invalid) & more, "RETRY")
        .when(usable & (errors <= threshold), "ACCEPT")
        .when(usable & more, "RETRY")
        .when(usable & best_effort & (errors <= best_effort_limit), "ACCEPT_WITH_WARNING")
        .otherwise("FAIL")
    )


def score_order() -> list[Column]:
    """The nine parts of the attempt score, best first."""
    rank = (F.when(F.col("decision") == "ACCEPT", 0)
            .when(F.col("decision") == "ACCEPT_WITH_WARNING", 1).otherwise(2))
    return [
        rank, F.col("hard_invalid_count"), F.col("errors"), F.col("wer_ppm"),
        F.col("truncated").cast("int"), -F.col("confidence_ppm"),
        F.abs(F.col("duration_ppm") - 1_000_000), F.col("warning_count"), F.col("attempt"),
    ]


def best_attempt(scored: DataFrame) -> DataFrame:
    """Best attempt per fragment, as a minimum combined before the shuffle, safe for hot keys."""
    parts = F.struct(*[part.alias(f"p{i}") for i, part in enumerate(score_order())])
    row = F.struct(*[F.col(c) for c in scored.columns if c != "fragment_id"])
    return (
        scored.groupBy("fragment_id").agg(F.min_by(row, parts).alias("best"))
        .select("fragment_id", "best.*")
    )


def retry_budget(
    attempts: DataFrame, retries: int = DEFAULT_RETRIES, at_most: int | None = None
) -> DataFrame:
    """Automatic retries used and left at every attempt of a run of attempts.

    Only the two quality codes are retried; a run ends at its first other outcome.
    Attempts beyond the first and its ``retries`` are flagged ``over_budget``.
    """
    quality = F.col("code").isin(*RETRYABLE_CODES)
    runs = running(
        attempts, ["fragment_id"], ["attempt"],
        {"run": F.when(~quality, 1).otherwise(0)}, at_most=at_most)
    in_run = numbered(runs, ["fragment_id", "run"], ["attempt"], "_place", at_most)
    used = F.col("_place") - 1
    return in_run.select(
        "fragment_id", "attempt", "code",
        used.alias("retries_used"),
        F.greatest(F.lit(retries) - used, F.lit(0)).alias("retries_left"),
        (quality & (used < retries)).alias("should_retry"),
        (quality & (used == retries)).alias("exhausted"),
        (used > retries).alias("over_budget"))


def repeated_failures(
    attempts: DataFrame, least: int = 2, at_most: int | None = None
) -> DataFrame:
    """Stretches of at least ``least`` attempts in a row that failed with the same code."""
    same = numbered(attempts, ["fragment_id", "code"], ["attempt"], "_nth", at_most)
    return (
        same.where(F.col("code").isin(*FAILURE_CODES))
        .groupBy("fragment_id", "code", (F.col("attempt") - F.col("_nth")).alias("_island"))
        .agg(F.min("attempt").alias("first_attempt"), F.max("attempt").alias("last_attempt"),
             F.count("*").alias("length"))
        .where(F.col("length") >= least).drop("_island")
    )


def confidence_rollup(segments: DataFrame) -> DataFrame:
    """Confidence per transcript from nested segments.

    ``segments`` ARRAY<STRUCT<avg_logprob, words ARRAY<STRUCT<probability, ..>>>>:
    mean over all words, else over the segments, else 0.
    """
    words = F.flatten(F.transform("segments", lambda s: F.transform(
        s["words"], lambda w: F.least(F.lit(1.0), F.greatest(F.lit(0.0), w["probability"])))))
    from_log = F.transform("segments", lambda s: F.coalesce(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(s["avg_logprob"]))), F.lit(0.0)))

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
        return total / F.size(values)

    return segments.withColumn("confidence", (
        F.when(F.size(words) > 0, mean(words))
        .when(F.size("segments") > 0, mean(from_log)).otherwise(F.lit(0.0))))


def milliseconds(seconds: Column) -> Column:
    """Half-even rounding, never below zero."""
    return F.greatest(F.lit(0), F.rint(seconds * 1000).cast("int"))
