"""Settings ranges and table contracts as countable expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data contract, in the order they are checked:
# name, least, greatest, default.
NUMERIC_SETTINGS = [
    ("num_steps", 1, 100, 32),
    ("guidance_scale", 0, 10, 2.0),
    ("speed", 0.5, 2, 1.0),
    ("t_shift", 0.001, 10, 0.1),
    ("layer_penalty_factor", 0, 20, 5.0),
    ("position_temperature", 0, 20, 5.0),
    ("class_temperature", 0, 10, 0.0),
    ("audio_chunk_duration", 1, 120, 15.0),
    ("audio_chunk_threshold", 1, 600, 30.0),
    ("pad_duration", 0, 5, 0.1),
    ("fade_duration", 0, 5, 0.1),
    ("beam_size", 1, 10, 5),
    ("patience", 0.1, 2, 1.0),
    ("stt_temperature", 0, 1, 0.0),
    ("automatic_warning_retries", 0, 10, 5),
]
BOOLEAN_SETTINGS = [
    ("normalize_text", True),
    ("denoise", True),
    ("preprocess_prompt", True),
    ("postprocess_output", True),
    ("vad_filter", False),
    ("word_timestamps", True),
]
REWRITE_SETTINGS = [
    ("rewrite_temperature", 0, 1),
    ("top_k", 0, 200),
    ("top_p", 0, 1),
    ("min_p", 0, 1),
    ("repeat_penalty", 0.5, 2),
    ("max_tokens", 16, 2_048),
]


def resolve_settings(configs: DataFrame) -> DataFrame:
    """Fill unset settings with their defaults; settings may be missing as columns."""
    defaults = {name: float(default) for name, _, _, default in NUMERIC_SETTINGS}
    filled = {}
    for name, default in [*defaults.items(), *BOOLEAN_SETTINGS]:
        value = F.lit(default)
        filled[name] = F.coalesce(F.col(name), value) if name in configs.columns else value
    return configs.withColumns(filled)


def out_of_range(value: Column, least: float, greatest: float) -> Column:
    """True for NaN, infinities and values outside the closed range."""
    number = value.cast("double")
    return F.isnan(number) | ~number.between(float(least), float(greatest))


def first_violation(rules: list[tuple[str, float, float]]) -> Column:
    """Name of the first setting outside its range, in the declared order, or NULL."""
    return F.coalesce(*[
        F.when(out_of_range(F.col(name), least, greatest), name)
        for name, least, greatest in rules])


def settings_audit(configs: DataFrame) -> DataFrame:
    resolved = resolve_settings(configs)
    generation = first_violation([(n, lo, hi) for n, lo, hi, _ in NUMERIC_SETTINGS])
    return resolved.withColumn("violation", F.coalesce(generation, F.lit("")))


def rewrite_settings_audit(configs: DataFrame) -> DataFrame:
    return configs.withColumn(
        "violation", F.coalesce(first_violation(REWRITE_SETTINGS), F.lit("")))


def check_rows(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All row rules of a table in one pass: rule, rows_checked, violations."""
    counted = frame.agg(
        F.count("*").alias("rows_checked"),
        *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name)
          for name, rule in rules.items()])
    return counted.select("rows_checked", F.explode(F.create_map(*[
        part for name in rules for part in (F.lit(name), F.col(name))
    ])).alias("rule", "violations")).select("rule", "rows_checked", "violations")


def check_unique(frame: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    counts = frame.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return counts.agg(
        F.lit(name).alias("rule"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_checked"),
        F.count_if(F.col("_rows") > 1).alias("violations"))


def check_reference(
    child: DataFrame, name: str, key: str, parent: DataFrame, parent_key: str
) -> DataFrame:
    """Child rows without a parent; children are counted per key before the join."""
    counts = child.groupBy(key).agg(F.count("*").alias("_rows"))
    parents = parent.select(F.col(parent_key).alias(key), F.lit(True).alias("_found"))
    return counts.join(parents, key, "left").agg(
        F.lit(name).alias("rule"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_checked"),
        F.coalesce(F.sum(F.when(F.col("_found").isNull(), F.col("_rows"))), F.lit(0))
        .alias("violations"))


def audit(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def violations(**rules: Column) -> list[Column]:
    """Aggregates that count the rows of a pass and those that break each rule."""
    return [F.count("*").alias("_rows"), *[
        F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]]


def listed(totals: DataFrame, names: list[str]) -> DataFrame:
    """One row of totals as rows rule, rows_checked (of ``_rows``), violations."""
    filled = totals.select(F.coalesce("_rows", F.lit(0)).alias("rows_checked"), *[
        F.coalesce(name, F.lit(0)).alias(name) for name in names])
    return filled.select("rows_checked", F.explode(F.create_map(*[
        part for name in names for part in (F.lit(name), F.col(name))])).alias(
            "rule", "violations")).select("rule", "rows_checked", "violations")


def audit_fragments(fragments: DataFrame, jobs: DataFrame, books: DataFrame) -> DataFrame:
    """All rules of jobs and their fragments in one pass over either.

    The rules of single fragments are counted on the way to their jobs, where a job's
    counters, those that are stored, and the numbers of its fragments meet. Counts ride on
    the aggregation rather than on ``observe``, whose metrics count a row again when a lost
    task is repeated.
    """
    status = F.col("status")
    kinds = {"pending": status.isin("pending", "generating"), "ready": status == "ready",
             "warnings": status == "warning", "failed": status == "failed"}
    single = {
        "fragment_status": status.isin("pending", "generating", "ready", "warning", "failed"),
        "fragment_duration": F.col("duration_ms") >= 0,
        "fragment_samples": F.col("samples") == F.col("duration_ms") * 24}
    places = fragments.groupBy("job_id", "ordinal").agg(
        *violations(**single), *[F.count_if(rule).alias(f"_{kind}") for kind, rule in kinds.items()])
    sums = ["_rows", *single, *[f"_{kind}" for kind in kinds]]
    per_job = places.groupBy("job_id").agg(
        *[F.sum(name).alias(name) for name in sums],
        F.count_if(F.col("_rows") > 1).alias("fragment_ordinal_unique"))
    rows = jobs.withColumn("_job", F.lit(True)).join(per_job, "job_id", "full_outer").join(
        books.select("book_id", F.lit(True).alias("_book")).distinct(), "book_id", "left")
    have = F.col("_job").isNotNull()
    stored = [F.coalesce(F.col(kind), F.lit(0)) for kind in kinds]
    derived = [F.coalesce(F.col(f"_{kind}"), F.lit(0)) for kind in kinds]
    agrees = F.lit(True)
    for left, right in zip(stored, derived):
        agrees = agrees & (left == right)
    of_fragments = [*single, "fragment_ordinal_unique", "fragment_job"]
    of_jobs = ["job_counters_total", "job_counters_stored", "job_book"]
    totals = rows.agg(
        F.sum("_rows").alias("fragments"), F.count_if(have).alias("jobs"),
        *[F.sum(name).alias(name) for name in (*single, "fragment_ordinal_unique")],
        F.sum(F.when(~have, F.col("_rows"))).alias("fragment_job"),
        F.count_if(have & (sum(stored[1:], stored[0]) != F.col("fragments_count")))
        .alias("job_counters_total"),
        F.count_if(have & ~agrees).alias("job_counters_stored"),
        F.count_if(have & F.col("_book").isNull()).alias("job_book"))
    return listed(totals.withColumnRenamed("fragments", "_rows"), of_fragments).unionByName(
        listed(totals.withColumnRenamed("jobs", "_rows"), of_jobs))


def audit_attempts(attempts: DataFrame) -> DataFrame:
    """A fragment has one attempt of a number, and numbers are positive."""
    found = attempts.groupBy("fragment_id", "attempt").agg(F.count("*").alias("n"))
    return listed(found.agg(
        F.sum("n").alias("_rows"), F.sum(F.col("n") - 1).alias("attempt_unique"),
        F.sum(F.when(F.col("attempt") >= 1, 0).otherwise(F.col("n"))).alias("attempt_number")),
        ["attempt_unique", "attempt_number"])


def audit_voices(voices: DataFrame, most: int) -> DataFrame:
    """Reference audio is there, within its limit, and as long as its row says."""
    size = F.octet_length("data")
    rules = {"voice_size": size.between(1, most), "voice_size_stored": size == F.col("size_bytes")}
    return listed(voices.agg(*violations(**rules)), list(rules))


def audit_rewrites(items: DataFrame) -> DataFrame:
    """Rewritten fragments: counters of a task, and changed texts have a revision."""
    kinds = ("pending", "completed", "failed")
    changed = F.col("changed") == F.col("revision_id").isNotNull()
    done = F.col("status") == "completed"
    tasks = items.groupBy("task_id").agg(
        *violations(rewrite_revision=changed, rewrite_unchanged=done | ~F.col("changed")),
        F.max("fragments_count").alias("fragments_count"),
        *[F.max(f"stored_{kind}").alias(f"stored_{kind}") for kind in kinds],
        *[F.count_if(F.col("status") == kind).alias(kind) for kind in kinds])
    total = F.col("stored_pending") + F.col("stored_completed") + F.col("stored_failed")
    agrees = F.lit(True)
    for kind in kinds:
        agrees = agrees & (F.col(f"stored_{kind}") == F.col(kind))
    totals = tasks.agg(
        F.sum("_rows").alias("items"), F.count("*").alias("tasks"),
        F.sum("rewrite_revision").alias("rewrite_revision"),
        F.sum("rewrite_unchanged").alias("rewrite_unchanged"),
        F.count_if(total != F.col("fragments_count")).alias("rewrite_counters_total"),
        F.count_if(~agrees).alias("rewrite_counters_stored"))
    return listed(totals.withColumnRenamed("items", "_rows"), [
        "rewrite_revision", "rewrite_unchanged"]).unionByName(listed(
            totals.withColumnRenamed("tasks", "_rows"),
            ["rewrite_counters_total", "rewrite_counters_stored"]))
