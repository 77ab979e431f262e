"""The production entities, read from the shared tables with pruned columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import collapse_space, upper_by_letter
from lectern.operators.hot_groups import numbered
from lectern.session import use_utc

# Fixed values of the data contract.
SAMPLE_RATE = 24_000
ACTIVE_STATUSES = ("queued", "running")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table scan; stored times are UTC, so the session must read them as that."""
    use_utc(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_count(spark: SparkSession, folder: str, name: str) -> int:
    """Rows of a table, from the Parquet footers alone."""
    return table(spark, folder, name).count()


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Share heavy row work among all cores when the scan has too few partitions.

    A large corpus has more partitions than cores and is left as it is.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() * 2 <= cores:
        return frame.repartition(cores, key)
    return frame


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", *columns), "doc_id")


def books(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder, "text", "lang").withColumnRenamed("doc_id", "book_id")


def books_with_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as books of line blocks; line 0 is loose text, then four per section."""

    def block(line: Column, i: Column) -> Column:
        section = F.when(i > 0, F.floor(i / 4).cast("int"))
        path = F.array(
            F.concat(F.lit("Part "), F.floor(section / 3).cast("string")),
            F.concat(F.lit("Section "), section.cast("string")))
        return F.struct(section.alias("section_id"),
                        F.when(section.isNotNull(), path).alias("section_path"),
                        line.alias("text"))

    return documents(spark, folder, "text").select(
        F.col("doc_id").alias("book_id"),
        F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("body_title"),
        F.transform(F.split("text", "\n"), block).alias("blocks"))


def planted_edit(text: Column, number: Column) -> Column:
    """A transcript with known errors, chosen by ``number`` modulo 4.

    0 unchanged; 1 upper case with ``. ! ,`` as spaces; 2 every 17th word dropped;
    3 every 23rd word replaced by ``zz``. Only words with one run of letters or
    digits are touched, so that each edit changes exactly one compared word.
    """
    words = F.split(collapse_space(text), " ")
    plain = r"^[^\p{L}\p{N}]*[\p{L}\p{N}]+[^\p{L}\p{N}]*$"
    dropped = F.filter(words, lambda word, i: ((i + 1) % 17 != 0) | ~word.rlike(plain))
    replaced = F.transform(words, lambda word, i: F.when(
        ((i + 1) % 23 == 0) & word.rlike(plain), "zz").otherwise(word))
    return (
        F.when(number % 4 == 0, text)
        .when(number % 4 == 1, F.translate(F.upper(text), ".!,", "   "))
        .when(number % 4 == 2, F.array_join(dropped, " "))
        .otherwise(F.array_join(replaced, " "))
    )


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder, "text", "lang").select(
        "doc_id", "lang", F.col("text").alias("expected"),
        planted_edit(F.col("text"), F.col("doc_id")).alias("transcript"))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("book_id"),
        F.when(status == "O", "queued").when(status == "P", "running")
        .otherwise("completed").alias("status"),
        F.col("o_orderdate").alias("created_at"))


def voices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("voice_id"), F.col("s_name").alias("voice_name"))


def jobs_with_voice(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs with the voice they were started for (a scalar subquery, not a join)."""
    count = table(spark, folder, "supplier").agg(F.count("*")).scalar()
    return jobs(spark, folder).withColumn("voice_id", F.col("book_id") % count)


def _fragment_columns() -> dict[str, Column]:
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    duration = (F.col("l_quantity") * 1000).cast("long")
    return {
        "job_id": F.col("l_orderkey"),
        "chapter_number": F.col("l_linenumber"),
        "chapter_title": F.concat(F.lit("Chapter "), F.col("l_linenumber").cast("string")),
        "status": F.when(flag == "A", "ready")
        .when((flag == "R") & (line == "F"), "failed")
        .when(flag == "R", "warning")
        .when(line == "F", "generating").otherwise("pending"),
        "duration_ms": duration,
        "samples": duration * (SAMPLE_RATE // 1000),
    }


def fragment_states(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments without their ordinals: a pruned scan and no shuffle."""
    return table(spark, folder, "lineitem").select(
        *[value.alias(name) for name, value in _fragment_columns().items()])


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments numbered per job by all source columns, line number first."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    ranked = numbered(table(spark, folder, "lineitem"), ["l_orderkey"], order, "ordinal")
    ident = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("ordinal").cast("string"))
    return ranked.select(
        *[value.alias(name) for name, value in _fragment_columns().items()],
        "ordinal", ident.alias("id"))


CODES = {  # fixed values: event type -> outcome of an attempt
    "click": "transcript_mismatch",
    "view": "audio_warning",
    "error": "failed",
    "purchase": "ready",
    "signup": "text_edited",
}


def attempt_log(spark: SparkSession, folder: str) -> DataFrame:
    """Attempt outcomes in arrival order, without attempt numbers."""
    kind = F.col("event_type")
    code = F.coalesce(*[F.when(kind == k, v) for k, v in CODES.items()])
    return table(spark, folder, "events").select(
        F.col("user_id").alias("fragment_id"), "event_id",
        F.col("ts").cast("timestamp").alias("completed_at"),
        code.alias("code"),
        F.round(F.col("value") * 1000).cast("long").alias("processing_ms"))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return numbered(attempt_log(spark, folder), ["fragment_id"],
                    ["completed_at", "event_id"], "attempt")


ACTIONS = {  # event type -> actions taken in turn
    "view": ("start",),
    "purchase": ("complete", "approve", "auto_retry", "manual_retry"),
    "click": ("complete_with_warning", "complete_with_audio_warning"),
    "error": ("fail", "manual_edit", "cancel_retry"),
    "signup": ("manual_retry", "restore", "ai_rewrite", "ai_rewrite_same", "cancel_retry"),
}


def action_column() -> Column:
    """Events as actions on fragments, chosen by type and number."""
    kind, number = F.col("event_type"), F.col("event_id")
    chosen = F.coalesce(*[
        F.when(kind == name, F.element_at(F.array(*[F.lit(a) for a in actions]),
                                          (number % len(actions) + 1).cast("int")))
        for name, actions in ACTIONS.items()])
    return chosen


def action_log(spark: SparkSession, folder: str) -> DataFrame:
    """The life of every fragment as a log of actions."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("fragment_id"), "event_id",
        F.col("ts").cast("timestamp").alias("happened_at"), action_column().alias("action"))


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    role = F.col("role")
    ident = F.col("conv_id").cast("string")
    number = F.col("turn") + 1
    return table(spark, folder, "conversations").select(
        F.concat_ws(":", ident, number.cast("string")).alias("id"),
        F.col("conv_id").alias("fragment_id"), number.alias("revision_number"),
        F.when(F.col("turn") == 0, "original").when(role == "user", "manual")
        .when(role == "assistant", "ai").otherwise("restore").alias("source"),
        "text",
        F.when(F.col("turn") > 0, F.concat_ws(":", ident, F.col("turn").cast("string")))
        .alias("parent_id"))


def rewrites(spark: SparkSession, folder: str) -> DataFrame:
    """Rewrite results over the benchmark passages, some of them damaged."""
    text, number = F.col("text"), F.col("item_id")
    rewritten = (
        F.when(number % 4 == 0, text)
        .when(number % 4 == 1, upper_by_letter(text))
        .when(number % 4 == 2, F.regexp_replace(text, r"\.$", "!"))
        .otherwise(F.regexp_replace(text, r"^\S+ ", ""))
    )
    return table(spark, folder, "benchmark").select(
        "item_id", F.col("text").alias("original"), rewritten.alias("rewritten"),
        F.lit("punctuation").alias("reason"))


def waves(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").alias("samples"))
