"""Queries over waveforms, PCM bytes and voice files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import audio as au
from lectern.operators import export as ex
from lectern.operators import rollup as ro
from lectern.plans.registry import query
from lectern.sources import views


@query("audio_level", """
WITH r AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda v:
  CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / len(embedding)) AS rms FROM embeddings)
SELECT vec_id, round(rms, 6) AS rms, rms < 1e-5 AS silent FROM r""")
def audio_level(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.waves(spark, folder).select("vec_id", au.rms(F.col("samples")).alias("level"))
    return rows.select("vec_id", F.round("level", 6).alias("rms"),
                       (F.col("level") < au.SILENCE_RMS).alias("silent"))


def _loud(samples: Column) -> Column:
    """The clipped variant: four times as loud."""
    return F.transform(samples, lambda v: v.cast("double") * 4)


@query("clipping", """
WITH r AS (SELECT vec_id, len(list_filter(embedding, lambda v: abs(CAST(v AS DOUBLE) * 4) >= 1))
  / len(embedding) AS ratio FROM embeddings)
SELECT vec_id, ratio AS clipping_ratio, CASE WHEN ratio > 0.01 THEN 'OUTPUT_CLIPPING_RATIO_HIGH'
  ELSE '' END AS warning FROM r""")
def clipping(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.waves(spark, folder).select(
        "vec_id", au.clipping_ratio(_loud(F.col("samples"))).alias("clipping_ratio"))
    return rows.withColumn("warning", F.when(
        F.col("clipping_ratio") > au.CLIPPING_RATIO, "OUTPUT_CLIPPING_RATIO_HIGH").otherwise(""))


@query("peak_norm", """
WITH p AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda v: abs(v))) AS peak
  FROM embeddings),
n AS (SELECT vec_id, peak, list_transform(embedding, lambda v: v / peak) AS x FROM p)
SELECT vec_id, round(CAST(peak AS DOUBLE), 6) AS peak, round(CAST(x[1] AS DOUBLE), 6) AS first,
  len(list_filter(x, lambda v: abs(v) = 1)) AS at_peak, round(sqrt(list_sum(list_transform(x,
  lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / len(x)), 6) AS rms FROM n""")
def peak_norm(spark: SparkSession, folder: str) -> DataFrame:
    samples = F.col("samples")
    rows = views.waves(spark, folder).select(
        "vec_id", au.peak(au.sanitize(samples)).alias("top"),
        au.peak_normalized(samples).alias("x"))
    return rows.select(
        "vec_id", F.round(F.col("top").cast("double"), 6).alias("peak"),
        F.round(F.element_at("x", 1).cast("double"), 6).alias("first"),
        F.size(F.filter("x", lambda v: F.abs(v) == 1)).alias("at_peak"),
        F.round(au.rms(F.col("x")), 6).alias("rms"))


QUANTIZED = """list_transform(embedding, lambda v: CAST(round_even(CAST(CAST(greatest(
    CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), v)) * CAST(32767 AS FLOAT) AS FLOAT) AS DOUBLE),
    0) AS INT))"""

PCM = f"""pcm AS (
  SELECT vec_id, label, unhex(array_to_string(list_transform({QUANTIZED}, lambda q:
    printf('%02X%02X', q & 255, (q >> 8) & 255)), '')) AS data FROM embeddings)"""


@query("quantize", f"""
WITH {PCM}
SELECT e.vec_id, list_min({QUANTIZED}) AS low, list_max({QUANTIZED}) AS high,
  CAST(list_sum({QUANTIZED}) AS BIGINT) AS total, sha256(data) AS pcm_sha, 'ok' AS verdict
FROM embeddings e JOIN pcm p USING (vec_id)""")
def quantize(spark: SparkSession, folder: str) -> DataFrame:
    samples = F.col("samples")
    rows = views.waves(spark, folder).select(
        "vec_id", au.quantized(samples).alias("q"), au.pack_pcm(samples).alias("pcm"),
        au.quantize_verdict(samples, views.SAMPLE_RATE).alias("verdict"))
    return rows.select(
        "vec_id", F.array_min("q").alias("low"), F.array_max("q").alias("high"),
        F.aggregate("q", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"),
        F.sha2("pcm", 256).alias("pcm_sha"), "verdict")


@query("pcm_geometry", f"""
WITH {PCM},
d AS (SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN 0 WHEN vec_id % 10 = 0
  THEN octet_length(data) - 1 ELSE octet_length(data) END AS bytes FROM pcm)
SELECT vec_id, bytes, bytes // 2 AS frames,
  CAST(round_even(bytes // 2 * 1000 / 24000, 0) AS BIGINT) AS duration_ms,
  CASE WHEN bytes = 0 THEN 'empty' WHEN bytes % 2 <> 0 THEN 'partial_frame'
    WHEN vec_id % 23 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS verdict FROM d""")
def pcm_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """Some payloads are emptied, cut by a byte, or declared with a foreign hash."""
    number, pcm = F.col("vec_id"), F.col("pcm")
    packed = views.waves(spark, folder).select("vec_id", au.pack_pcm(F.col("samples")).alias("pcm"))
    damaged = packed.withColumn(
        "pcm", F.when(number % 17 == 0, F.substring(pcm, 1, 0))
        .when(number % 10 == 0, F.substring(pcm, F.lit(1), F.octet_length(pcm) - 1))
        .otherwise(pcm)).withColumn(
        "declared", F.when(number % 23 == 0, F.sha2(F.lit("other"), 256))
        .otherwise(F.upper(F.sha2(pcm, 256))))
    rate, one, two = F.lit(views.SAMPLE_RATE), F.lit(1), F.lit(2)
    frames = au.pcm_frames(pcm, one, two)
    return damaged.select(
        "vec_id", F.octet_length(pcm).alias("bytes"), frames.alias("frames"),
        au.duration_ms(frames, rate).alias("duration_ms"),
        au.pcm_verdict(pcm, rate, one, two, F.col("declared")).alias("verdict"))


def _pcm_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Waves as fragments: a job per label, five chapters, numbered by vector."""
    rows = views.waves(spark, folder).select(
        F.col("label").alias("job_id"), (F.col("vec_id") % 5 + 1).alias("chapter_number"),
        (F.col("vec_id") + 1).alias("ordinal"), F.col("vec_id").cast("string").alias("id"),
        F.lit(views.SAMPLE_RATE).alias("sample_rate"), F.lit(1).alias("channels"),
        F.lit(2).alias("sample_width"), au.pack_pcm(F.col("samples")).alias("pcm"))
    return rows.withColumns({
        "pcm_bytes": F.octet_length("pcm"), "samples": F.floor(F.octet_length("pcm") / 2),
    }).withColumn("duration_ms", au.duration_ms(F.col("samples"), F.lit(views.SAMPLE_RATE)))


@query("chapter_pcm", f"""
WITH {PCM}
SELECT label AS job_id, vec_id % 5 + 1 AS chapter_number, 0 AS part, 0 AS start_sample,
  CAST(sum(octet_length(data) // 2) AS BIGINT) AS samples, count(*) AS fragments,
  sha256(unhex(string_agg(hex(data), '' ORDER BY vec_id))) AS pcm_sha, true AS uniform_format
FROM pcm GROUP BY label, vec_id % 5""")
def chapter_pcm(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.row_count(spark, folder, "embeddings")
    return ex.joined_pcm(_pcm_fragments(spark, folder), at_most=rows).select(
        "job_id", "chapter_number", "part", "start_sample", "samples", "fragments",
        F.sha2("pcm", 256).alias("pcm_sha"), "uniform_format")


@query("chapter_totals", f"""
WITH {PCM}
SELECT label AS job_id, vec_id % 5 + 1 AS chapter_number, count(*) AS fragments_count,
  CAST(sum(octet_length(data) // 2) AS BIGINT) AS total_samples,
  CAST(sum(octet_length(data)) AS BIGINT) AS pcm_bytes,
  CAST(sum(round_even(octet_length(data) // 2 * 1000 / 24000, 0)) AS BIGINT) AS duration_ms,
  true AS uniform_format, true AS whole_frames
FROM pcm GROUP BY label, vec_id % 5""")
def chapter_totals(spark: SparkSession, folder: str) -> DataFrame:
    return ro.chapter_totals(_pcm_fragments(spark, folder).drop("pcm"))


@query("pcm_durations", f"""
WITH {PCM},
d AS (SELECT vec_id, octet_length(data) // 2 AS frames, CAST(round_even(octet_length(data) // 2
  * 1000 / 24000, 0) AS BIGINT) AS ms FROM pcm),
s AS (SELECT *, CASE WHEN vec_id % 13 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN ms + 2
  WHEN vec_id % 5 = 0 THEN ms + 1 ELSE ms END AS declared_ms FROM d)
SELECT vec_id, frames, declared_ms, CASE WHEN declared_ms IS NULL OR declared_ms <= 0
    THEN 'invalid_duration' WHEN abs(ms - declared_ms) > 1 THEN 'duration_mismatch'
    ELSE 'ok' END AS verdict FROM s""")
def pcm_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Declared durations, some missing, some a millisecond or two too long."""
    rows = _pcm_fragments(spark, folder).select(
        F.col("id").cast("long").alias("vec_id"), F.col("samples").alias("frames"), "duration_ms")
    number, ms, rate = F.col("vec_id"), F.col("duration_ms"), F.lit(views.SAMPLE_RATE)
    declared = F.when(number % 13 == 0, None).when(number % 7 == 0, ms + 2).when(
        number % 5 == 0, ms + 1).otherwise(ms)
    return rows.select("vec_id", "frames", declared.alias("declared_ms")).withColumn(
        "verdict", au.declared_duration_verdict(F.col("frames"), rate, F.col("declared_ms")))


@query("pcm_refusals", f"""
WITH {PCM},
f AS (SELECT label AS job_id, vec_id % 5 + 1 AS chapter_number, octet_length(data)
    - CASE WHEN label % 7 = 1 AND vec_id % 9 = 0 THEN 1 ELSE 0 END AS bytes,
  CASE WHEN label % 7 = 2 THEN 700000 WHEN label % 7 = 3 AND vec_id % 10 < 5 THEN 22050
    ELSE 24000 END AS rate, CASE WHEN label % 7 = 4 THEN 9 ELSE 1 END AS channels,
  CASE WHEN label % 7 = 5 THEN 3 ELSE 2 END AS width FROM pcm)
SELECT job_id, chapter_number, CAST(sum(bytes) AS BIGINT) AS pcm_bytes,
  CASE WHEN count(DISTINCT (rate, channels, width)) > 1 THEN 'mixed_format'
    WHEN max(rate) NOT BETWEEN 1 AND 655350 THEN 'unsupported_rate'
    WHEN max(channels) NOT BETWEEN 1 AND 8 THEN 'unsupported_channels'
    WHEN max(width) <> 2 THEN 'unsupported_width'
    WHEN count(CASE WHEN bytes <= 0 OR bytes % (channels * width) <> 0 THEN 1 END) > 0
    THEN 'broken_frames' ELSE 'ok' END AS verdict
FROM f GROUP BY job_id, chapter_number""")
def pcm_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of some jobs with cut frames or formats that cannot be exported."""
    kind, number = F.col("job_id") % 7, F.col("id").cast("long")
    return ex.pcm_refusals(_pcm_fragments(spark, folder).withColumns({
        "pcm_bytes": F.col("pcm_bytes") - ((kind == 1) & (number % 9 == 0)).cast("int"),
        "sample_rate": F.when(kind == 2, 700_000).when(
            (kind == 3) & (number % 10 < 5), 22_050).otherwise(F.col("sample_rate")),
        "channels": F.when(kind == 4, 9).otherwise(1),
        "sample_width": F.when(kind == 5, 3).otherwise(2)}))


@query("voice_intake", """
WITH v AS (SELECT s_suppkey AS voice_id, CASE s_suppkey % 4 WHEN 0 THEN 'fLaC' || s_name
    WHEN 1 THEN 'RIFF0000WAVE' || s_name WHEN 2 THEN 'RIFF' ELSE s_name END AS data,
  CASE s_suppkey % 3 WHEN 0 THEN 'audio/flac' WHEN 1 THEN 'audio/x-wav'
    ELSE 'application/octet-stream' END AS declared, s_suppkey % 2 = 0 AS has_text FROM supplier),
f AS (SELECT *, CASE WHEN data LIKE 'fLaC%' THEN 'flac' WHEN data LIKE 'RIFF____WAVE%' THEN 'wav'
  END AS format FROM v)
SELECT voice_id, format, length(data) AS size_bytes, sha256(data) AS sha256, has_text
    AS has_reference_text, declared = 'application/octet-stream' OR coalesce(format = 'flac' AND
    declared = 'audio/flac' OR format = 'wav' AND declared = 'audio/x-wav', false) AS media_fits,
  CASE WHEN format IS NULL THEN 'unsupported_format' ELSE 'ok' END AS verdict FROM f""")
def voice_intake(spark: SparkSession, folder: str) -> DataFrame:
    key, name = F.col("s_suppkey"), F.col("s_name")
    data = (
        F.when(key % 4 == 0, F.concat(F.lit("fLaC"), name))
        .when(key % 4 == 1, F.concat(F.lit("RIFF0000WAVE"), name))
        .when(key % 4 == 2, F.lit("RIFF")).otherwise(name)).cast("binary")
    rows = views.table(spark, folder, "supplier").select(
        key.alias("voice_id"), data.alias("data"),
        F.when(key % 3 == 0, "audio/flac").when(key % 3 == 1, "audio/x-wav")
        .otherwise("application/octet-stream").alias("declared"),
        (key % 2 == 0).alias("has_reference_text"))
    form, size = au.container_format(F.col("data")), F.octet_length("data")
    return rows.select(
        "voice_id", form.alias("format"), size.alias("size_bytes"),
        F.sha2("data", 256).alias("sha256"), "has_reference_text",
        au.media_type_fits(form, F.col("declared")).alias("media_fits"),
        F.when(form.isNull(), "unsupported_format")
        .when(size > au.MAX_REFERENCE_BYTES, "too_large").otherwise("ok").alias("verdict"))


def _little(value: Column, size: int) -> Column:
    """An integer as little-endian hex digits."""
    return F.concat(*[
        F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0")
        for i in range(size)])


@query("voice_policy", """
WITH v AS (SELECT s_suppkey AS voice_id, CASE WHEN s_suppkey % 5 = 4 THEN NULL
    WHEN s_suppkey % 2 = 0 THEN 'wav' ELSE 'flac' END AS format,
  CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS channels,
  CASE WHEN s_suppkey % 7 = 0 THEN 48000 ELSE 24000 END AS sample_rate,
  s_nationkey * 20000 AS frames FROM supplier)
SELECT voice_id, format, CASE WHEN format IS NOT NULL THEN sample_rate END AS sample_rate,
  CASE WHEN format IS NOT NULL THEN channels END AS channels,
  CASE WHEN format IS NOT NULL THEN frames END AS frames,
  CASE WHEN format IS NULL THEN 'unsupported_format' WHEN frames <= 0 THEN 'empty'
    WHEN channels <> 1 THEN 'not_mono' WHEN frames > sample_rate * 15 THEN 'too_long'
    ELSE 'ok' END AS verdict FROM v""")
def voice_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Headers are built from the suppliers as bytes and read back from them."""
    key = F.col("s_suppkey")
    channels = F.when(key % 3 == 0, 2).otherwise(1)
    rate = F.when(key % 7 == 0, 48_000).otherwise(24_000)
    frames = F.col("s_nationkey") * 20_000
    wav = F.concat(
        F.lit("5249464600000000" "57415645" "666D7420"), _little(F.lit(16), 4),
        _little(F.lit(1), 2), _little(channels, 2), _little(rate, 4),
        _little(rate * channels * 2, 4), _little(channels * 2, 2), _little(F.lit(16), 2),
        F.lit("64617461"), _little(frames * channels * 2, 4))
    packed = F.shiftleft(rate.cast("long"), 12).bitwiseOR(
        F.shiftleft((channels - 1).cast("long"), 9)).bitwiseOR(F.lit(15 << 4).cast("long"))
    flac = F.concat(
        F.lit("664C6143" "00000022" + "00" * 10), F.lpad(F.hex(packed), 8, "0"),
        F.lpad(F.hex(frames.cast("long")), 8, "0"))
    data = F.unhex(F.when(key % 5 == 4, F.lit("4D503300")).when(key % 2 == 0, wav).otherwise(flac))
    rows = views.table(spark, folder, "supplier").select(
        key.alias("voice_id"), data.alias("data"))
    read = rows.select("voice_id", au.header(F.col("data")).alias("info"))
    return read.select("voice_id", "info.format", "info.sample_rate", "info.channels",
                       "info.frames", au.voice_verdict(F.col("info")).alias("verdict"))
