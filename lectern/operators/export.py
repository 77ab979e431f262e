"""Export of finished jobs: readiness, timelines, manifests and joined PCM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.hot_groups import running

# Fixed values of the data contract.
FULL_MANIFEST_VERSION = "audiobook-chapter-flac-archive-v2"
CHAPTER_MANIFEST_VERSION = "audiobook-single-chapter-flac-archive-v3"

# A job or chapter may be of any size, so its documents and blobs come in parts.
PART_FRAGMENTS = 10_000
PART_SAMPLES = 64 * 1024 * 1024 // 2
# What can be exported.
MOST_RATE, MOST_CHANNELS, WIDTH = 655_350, 8, 2


def fragment_counts(fragments: DataFrame) -> DataFrame:
    """fragments, unready and silent per job, from job_id, status and samples."""
    return fragments.groupBy("job_id").agg(
        F.count("*").alias("fragments"),
        F.count_if(F.col("status") != "ready").alias("unready"),
        F.count_if((F.col("status") == "ready") & (F.col("samples") <= 0)).alias("silent"))


def export_verdicts(counted: DataFrame) -> DataFrame:
    """Per job, why it cannot be exported, or ``ok``.

    ``counted``: jobs with status and fragments_count, joined to ``fragment_counts``.
    """
    return counted.withColumn("verdict", (
        F.when(F.col("status") != "completed", "job_not_completed")
        .when(F.coalesce("fragments", F.lit(0)) == 0, "no_fragments")
        .when(F.col("unready") > 0, "not_ready")
        .when(F.col("silent") > 0, "no_audio")
        .when(F.col("fragments") != F.col("fragments_count"), "count_mismatch")
        .otherwise("ok")))


def timeline(fragments: DataFrame, at_most: int | None = None) -> DataFrame:
    """Add ``start_sample``: the samples before the fragment in its chapter."""
    return running(fragments, ["job_id", "chapter_number"], ["ordinal", "id"],
                   {"start_sample": F.col("samples")}, at_most=at_most)


ENTRY = ("ordinal", "id", "chapter_number", "path", "start_sample", "samples", "status",
         "duration_ms")
CHAPTER = ("chapter_number", "title", "fragments_count", "duration_ms", "path", "total_samples")


def _part(part_fragments: int) -> Column:
    return F.floor((F.col("ordinal") - 1) / part_fragments).cast("int").alias("part")


def _entries() -> Column:
    return F.array_sort(F.collect_list(F.struct(*ENTRY))).alias("fragments")


def _chapter_totals(placed: DataFrame) -> DataFrame:
    return placed.groupBy("job_id", "chapter_number").agg(
        F.min("ordinal").alias("ordinal"), F.min("path").alias("path"),
        F.min("chapter_title").alias("title"), F.count("*").alias("fragments_count"),
        F.sum("duration_ms").alias("duration_ms"), F.sum("samples").alias("total_samples"))


def _jobs(heads: DataFrame) -> DataFrame:
    return heads.select("job_id", F.struct(*heads.columns).alias("job"))


def manifest(
    heads: DataFrame, placed: DataFrame, part_fragments: int = PART_FRAGMENTS
) -> DataFrame:
    """JSON documents per job, at most ``part_fragments`` fragments each.

    ``heads``: job_id and the columns to show as ``job``. ``placed``: fragments of
    those jobs with start_sample and path. Part 0 holds the first fragments; a
    chapter is listed in the part where it begins.
    """
    fragments = placed.groupBy("job_id", _part(part_fragments)).agg(_entries())
    listed = _chapter_totals(placed).groupBy("job_id", _part(part_fragments)).agg(
        F.array_sort(F.collect_list(F.struct(*CHAPTER))).alias("chapters"))
    document = F.to_json(F.struct(
        F.lit(FULL_MANIFEST_VERSION).alias("version"), "part", "job",
        F.coalesce("chapters", F.array().cast(listed.schema["chapters"].dataType))
        .alias("chapters"), "fragments"))
    return (
        fragments.join(listed, ["job_id", "part"], "left").join(_jobs(heads), "job_id")
        .select("job_id", "part", document.alias("document")))


def chapter_manifest(
    heads: DataFrame, placed: DataFrame, part_fragments: int = PART_FRAGMENTS
) -> DataFrame:
    """JSON documents per chapter, in parts as for ``manifest``."""
    fragments = placed.groupBy("job_id", "chapter_number", _part(part_fragments)).agg(_entries())
    totals = _chapter_totals(placed).select(
        "job_id", "chapter_number", F.struct(*CHAPTER).alias("chapter"))
    document = F.to_json(F.struct(
        F.lit(CHAPTER_MANIFEST_VERSION).alias("version"), F.lit("chapter").alias("scope"),
        "part", "chapter", "job", "fragments"))
    return (
        fragments.join(totals, ["job_id", "chapter_number"]).join(_jobs(heads), "job_id")
        .select("job_id", "chapter_number", "part", document.alias("document")))


FULL_ENTRY = ("id", "chapter_number", "ordinal", "path", "start_sample", "samples", "text",
              "stt_text", "status", "attempt", "duration_ms")
FULL_CHAPTER = ("chapter_number", "title", "fragments_count", "duration_ms", "path",
                "audio_format", "sample_rate", "channels", "bits_per_sample", "total_samples",
                "pcm_bytes")


def manifest_documents(heads: DataFrame, placed: DataFrame) -> DataFrame:
    """One document per job, with its chapters, and one per chapter, with its fragments.

    The shape is the same at every size. ``heads``: job_id and the structs book, voice and
    job. ``placed``: fragments of those jobs with the fields of ``FULL_ENTRY``, their
    chapter_title, audio_format, sample_rate, channels, bits_per_sample and pcm_bytes. A job's
    own document has the chapter number 0. Fragments are grouped once, and jobs from chapters.
    """
    entry = F.struct("ordinal", F.struct(*FULL_ENTRY).alias("entry"))
    chapters = placed.groupBy("job_id", "chapter_number").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"),
        F.first("chapter_title").alias("title"), F.first("path").alias("path"),
        F.count("*").alias("fragments_count"), F.sum("duration_ms").alias("duration_ms"),
        F.sum("samples").alias("total_samples"), F.sum("pcm_bytes").alias("pcm_bytes"),
        *[F.first(name).alias(name) for name in (
            "audio_format", "sample_rate", "channels", "bits_per_sample")])
    chapters = chapters.select("job_id", F.struct(*FULL_CHAPTER).alias("chapter"), F.transform(
        "entries", lambda row: row["entry"]).alias("fragments"))
    jobs = chapters.groupBy("job_id").agg(
        F.array_sort(F.collect_list("chapter")).alias("chapters")).join(heads, "job_id")
    own = F.to_json(F.struct(F.lit(FULL_MANIFEST_VERSION).alias("version"), "book", "voice",
                             "job", "chapters"))
    of_chapter = F.to_json(F.struct(
        F.lit(CHAPTER_MANIFEST_VERSION).alias("version"), F.lit("chapter").alias("scope"),
        "chapter", "book", "voice", "job", "fragments"))
    return jobs.select("job_id", F.lit(0).alias("chapter_number"), own.alias("document")).union(
        chapters.join(heads, "job_id").select(
            "job_id", "chapter.chapter_number", of_chapter.alias("document")))


def pcm_refusals(fragments: DataFrame) -> DataFrame:
    """Per chapter why its audio cannot be joined, or ``ok``, and the bytes it would have.

    ``fragments``: job_id, chapter_number, pcm_bytes, sample_rate, channels, sample_width.
    """
    frame = F.col("channels") * F.col("sample_width")
    broken = (F.col("pcm_bytes") <= 0) | (F.col("pcm_bytes") % frame != 0)
    form = ("sample_rate", "channels", "sample_width")
    chapters = fragments.groupBy("job_id", "chapter_number").agg(
        F.sum("pcm_bytes").cast("long").alias("pcm_bytes"),
        F.count_if(F.coalesce(broken, F.lit(True))).alias("broken"),
        *[F.min(name).alias(f"least_{name}") for name in form],
        *[F.max(name).alias(f"most_{name}") for name in form])
    mixed = F.lit(False)
    for name in form:
        mixed = mixed | (F.col(f"least_{name}") != F.col(f"most_{name}"))
    return chapters.select("job_id", "chapter_number", "pcm_bytes", (
        F.when(mixed, "mixed_format")
        .when(~F.col("most_sample_rate").between(1, MOST_RATE), "unsupported_rate")
        .when(~F.col("most_channels").between(1, MOST_CHANNELS), "unsupported_channels")
        .when(F.col("most_sample_width") != WIDTH, "unsupported_width")
        .when(F.col("broken") > 0, "broken_frames").otherwise("ok")).alias("verdict"))


def write_manifests(manifests: DataFrame, path: str) -> None:
    """One text line per document, in a folder per job bucket."""
    manifests.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(256))).select(
        "bucket", "document").write.partitionBy("bucket").text(path)


def joined_pcm(
    fragments: DataFrame, part_samples: int = PART_SAMPLES, at_most: int | None = None
) -> DataFrame:
    """Chapter audio in order, as binaries of bounded size.

    ``fragments``: job_id, chapter_number, ordinal, id, samples, pcm, sample_rate,
    channels, sample_width. A part takes the fragments that start within its span of
    ``part_samples`` mono samples of 16 bits, fewer of wider frames, so that its bytes are
    bounded however long the chapter is.
    """
    placed = timeline(fragments, at_most)
    frame = F.greatest(F.col("channels") * F.col("sample_width"), F.lit(WIDTH))
    part = F.floor(F.col("start_sample") * frame / (WIDTH * part_samples)).cast("int")
    form = F.struct("sample_rate", "channels", "sample_width")
    forms = fragments.groupBy("job_id", "chapter_number", form.alias("form")).agg(
        F.lit(1).alias("one")).groupBy("job_id", "chapter_number").agg(
            (F.count("*") == 1).alias("uniform_format"))  # of the whole chapter
    parts = placed.groupBy("job_id", "chapter_number", part.alias("part")).agg(
        F.expr("listagg(pcm) WITHIN GROUP (ORDER BY struct(ordinal, id))").alias("pcm"),
        F.min("start_sample").alias("start_sample"), F.sum("samples").alias("samples"),
        F.count("*").alias("fragments"))
    return parts.join(forms, ["job_id", "chapter_number"])
