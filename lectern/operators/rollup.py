"""Roll-ups of fragment states, chapter catalogs, pages and operational metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the data contract.
JOB_STATUSES = ("queued", "running", "completed", "completed_with_warnings", "failed")
STATUS_ALIASES = {"active": ["queued", "running"]}
PAGE_DEFAULT, PAGE_MAX = 50, 100


def _counts(pending: Column, **kinds: str) -> list[Column]:
    return [F.count_if(pending).alias("pending")] + [
        F.count_if(F.col("status") == status).alias(name) for name, status in kinds.items()]


def job_rollup(jobs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Counters and derived status of every job; jobs without fragments are completed."""
    counters = fragments.groupBy("job_id").agg(
        *_counts(F.col("status").isin("pending", "generating"),
                 ready="ready", warnings="warning", failed="failed"))
    names = ["pending", "ready", "warnings", "failed"]
    filled = jobs.select("job_id").join(counters, "job_id", "left").fillna(0, names)
    return filled.select(
        "job_id", *names,
        F.when(F.col("pending") > 0, "running").when(F.col("failed") > 0, "failed")
        .when(F.col("warnings") > 0, "completed_with_warnings")
        .otherwise("completed").alias("status"))


def rewrite_rollup(items: DataFrame) -> DataFrame:
    """Counters and status of rewrite tasks from their fragments."""
    counted = items.groupBy("task_id").agg(
        F.count("*").alias("fragments_count"),
        *_counts(F.col("status").isin("queued", "running"),
                 completed="completed", failed="failed"))
    return counted.withColumn("status", (
        F.when(F.col("pending") > 0, "running")
        .when(F.col("failed") == F.col("fragments_count"), "failed")
        .when(F.col("failed") > 0, "completed_with_errors").otherwise("completed")))


def chapter_catalog(fragments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Chapters of every job with the first reason why they cannot be listed."""
    # Numbers per title first: without texts to compare, both phases hash.
    titled = fragments.groupBy("job_id", "chapter_number", "chapter_title").agg(
        F.count("*").alias("_n"), F.sum("duration_ms").alias("_ms"),
        F.count_if(F.col("status") != "ready").alias("_unready"))
    chapters = titled.groupBy("job_id", "chapter_number").agg(
        F.min("chapter_title").alias("title"), F.sum("_n").alias("fragments_count"),
        F.coalesce(F.sum("_ms"), F.lit(0)).alias("duration_ms"),
        ((F.count("*") > 1) | F.min("chapter_title").isNull()).alias("_mixed"),
        (F.sum("_unready") == 0).alias("all_ready"))
    problem = (
        F.when((F.col("chapter_number") <= 0) | (F.col("duration_ms") < 0) | F.col("_mixed"),
               "invalid_metadata")
        .when(F.col("status") != "completed", "job_not_completed")
        .when(~F.col("all_ready"), "not_ready").otherwise("ok"))
    return chapters.join(jobs.select("job_id", "status"), "job_id").select(
        "job_id", "chapter_number", "title", "fragments_count", "duration_ms", "all_ready",
        problem.alias("verdict"))


def checked_catalog(fragments: DataFrame, jobs: DataFrame) -> DataFrame:
    """The catalog of jobs with a declared ``fragments_count``; a wrong one refuses all chapters."""
    wrong = count_mismatches(fragments, jobs).select("job_id", F.lit(True).alias("_wrong"))
    return chapter_catalog(fragments, jobs).join(wrong, "job_id", "left").withColumn(
        "verdict", F.when((F.col("verdict") == "ok") & F.col("_wrong").isNotNull(),
                          "count_mismatch").otherwise(F.col("verdict"))).drop("_wrong")


def count_mismatches(fragments: DataFrame, declared: DataFrame) -> DataFrame:
    """Jobs whose declared fragments_count differs from their fragments."""
    actual = fragments.groupBy("job_id").agg(F.count("*").alias("actual"))
    return declared.join(actual, "job_id", "left").fillna(0, ["actual"]).where(
        F.col("actual") != F.col("fragments_count"))


def filter_jobs(jobs: DataFrame, status: str = "all") -> DataFrame:
    """``all``, the alias ``active``, or one exact status; others are an error."""
    if status == "all":
        return jobs
    if status not in JOB_STATUSES and status not in STATUS_ALIASES:
        raise ValueError(f"unknown job status {status!r}")
    return jobs.where(F.col("status").isin(STATUS_ALIASES.get(status, [status])))


def job_page(
    jobs: DataFrame, status: str = "all", limit: int = PAGE_DEFAULT, offset: int = 0
) -> DataFrame:
    """One page, newest first, with the size of the whole filtered set in ``total``."""
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be between 1 and {PAGE_MAX}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    chosen = filter_jobs(jobs, status)
    total = chosen.agg(F.count("*")).scalar()
    page = chosen.orderBy(F.desc("created_at"), F.desc("job_id")).offset(offset).limit(limit)
    return page.withColumn("total", total)


def issues(fragments: DataFrame) -> DataFrame:
    return fragments.where(F.col("status").isin("warning", "failed")).orderBy(
        "job_id", "ordinal", "id")


def voice_list(voices: DataFrame) -> DataFrame:
    return voices.orderBy("created_at", "voice_id")


def export_order(fragments: DataFrame) -> DataFrame:
    """Fragments in export order with problems of their ordinals.

    Repeats are found by counting (job, ordinal), which combines before the shuffle.
    """
    repeats = (
        fragments.groupBy("job_id", "ordinal").agg(F.count("*").alias("_times"))
        .where(F.col("_times") > 1).select("job_id", "ordinal", F.lit(True).alias("_repeat")))
    checked = fragments.join(repeats, ["job_id", "ordinal"], "left")
    return checked.select(
        "job_id", "chapter_number", "ordinal", "id",
        F.when(F.col("ordinal") <= 0, "invalid_ordinal")
        .when(F.col("_repeat"), "duplicate_ordinal").otherwise("ok").alias("verdict"),
    ).orderBy("job_id", "chapter_number", "ordinal", "id")


def first_duplicate(items: DataFrame) -> DataFrame:
    """First repeated id per list: list_id, position, id -> the earliest second sight.

    Only the first position of every id and the smallest later one are combined;
    no list is ever gathered.
    """
    firsts = items.groupBy("list_id", "id").agg(
        F.min("position").alias("_first"), F.count("*").alias("_times"),
    ).where(F.col("_times") > 1).drop("_times")
    again = items.join(firsts, ["list_id", "id"]).where(F.col("position") > F.col("_first"))
    return again.groupBy("list_id").agg(
        F.min_by("id", "position").alias("duplicate"), F.min("position").alias("position"))


def chapter_totals(fragments: DataFrame) -> DataFrame:
    """Audio totals per chapter and whether all fragments share one format.

    Needs sample_rate, channels, sample_width and pcm_bytes.
    """
    frame_bytes = F.col("channels") * F.col("sample_width")
    form = F.struct("sample_rate", "channels", "sample_width")
    return fragments.groupBy("job_id", "chapter_number").agg(
        F.count("*").alias("fragments_count"),
        F.sum(F.floor(F.col("pcm_bytes") / frame_bytes)).cast("long").alias("total_samples"),
        F.sum("pcm_bytes").alias("pcm_bytes"),
        F.sum("duration_ms").alias("duration_ms"),
        (F.min(form) == F.max(form)).alias("uniform_format"),
        F.bool_and(F.col("pcm_bytes") % frame_bytes == 0).alias("whole_frames"))


def ops_metrics(attempts: DataFrame) -> DataFrame:
    """Counts, shares and exact duration percentiles per outcome of an attempt.

    ``attempts``: code, processing_ms, audio_ms. Equal durations are counted first, so
    that ranks are cumulated over distinct milliseconds only.
    """
    counted = attempts.groupBy("code", "processing_ms").agg(
        F.count("*").alias("_n"), F.sum("audio_ms").alias("_audio"))
    ranked = Window.partitionBy("code").orderBy("processing_ms")
    valued = F.when(F.col("processing_ms").isNotNull(), F.col("_n"))
    placed = counted.withColumns({
        "_upto": F.sum(valued).over(ranked), "_rows": F.sum(valued).over(
            Window.partitionBy("code"))})

    def percentile(share: float) -> Column:
        return F.min(F.when(
            (F.col("_upto") >= F.ceil(F.col("_rows") * share)) & F.col("processing_ms").isNotNull(),
            F.col("processing_ms")))

    total = attempts.agg(F.count("*")).scalar()
    return placed.groupBy("code").agg(
        F.sum("_n").alias("attempts"),
        F.sum(F.col("processing_ms") * F.col("_n")).alias("processing_ms"),
        F.sum("_audio").alias("audio_ms"),
        percentile(0.5).alias("p50_ms"), percentile(0.95).alias("p95_ms"),
        F.max("processing_ms").alias("max_ms"),
    ).withColumns({
        "share": F.round(F.col("attempts") / total, 6),
        "real_time_factor": F.round(F.col("processing_ms") / F.col("audio_ms"), 6),
    })


#: Items of a sketch; a quantile's rank is then within 2 % of the rows, and exact up to them.
SKETCH_ITEMS, RANK_ERROR = 400, 0.02


def metric_sketches(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sums and a mergeable sketch of durations per key, combined before the shuffle.

    ``attempts``: keys, processing_ms, audio_ms.
    """
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.sum("processing_ms").alias("processing_ms"),
        F.sum("audio_ms").alias("audio_ms"),
        F.kll_sketch_agg_bigint("processing_ms", F.lit(SKETCH_ITEMS)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same for fewer keys, from the sketches alone."""
    return sketches.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in ("attempts", "processing_ms", "audio_ms")],
        F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_ITEMS)).alias("sketch"))


def with_quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Quantiles in place of the sketch."""
    return sketches.withColumns({
        name: F.kll_sketch_get_quantile_bigint("sketch", F.lit(share))
        for name, share in shares.items()}).drop("sketch")


def rank_error(attempts: DataFrame, quantiles: DataFrame, keys: list[str], name: str,
               share: float) -> DataFrame:
    """How far, as a share of the rows, a quantile of each key is from its rank."""
    low, high = F.count_if(F.col("processing_ms") < F.col(name)), F.count_if(
        F.col("processing_ms") <= F.col(name))
    return attempts.join(quantiles.select(*keys, name), keys).groupBy(*keys).agg(
        F.greatest(low / F.count("*") - share, share - high / F.count("*"), F.lit(0.0))
        .alias("rank_error"))


def daily_alerts(sketches: DataFrame, most_failures: float, most_retries: float) -> DataFrame:
    """Failure and retry ratios per day, and which of them is too high.

    ``sketches``: day, status, attempts.
    """
    def share(status: str) -> Column:
        return F.sum(F.when(F.col("status") == status, F.col("attempts")).otherwise(0)) / F.sum(
            "attempts")

    ratios = sketches.groupBy("day").agg(
        F.sum("attempts").alias("attempts"), share("failed").alias("failure_ratio"),
        share("warning").alias("retry_ratio"))
    return ratios.withColumns({
        "failures_alert": F.col("failure_ratio") > most_failures,
        "retries_alert": F.col("retry_ratio") > most_retries})
