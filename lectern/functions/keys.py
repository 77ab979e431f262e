"""Keys of the stages of production, each built from the key or content of the one before.

A key names what a stage was made from: contents, models, settings, versions. If one of them
changes, the key changes and so do the keys of all stages that follow, and of no others.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import content_key


def canonical_json(settings: dict) -> str:
    """Sorted keys and no white space."""
    return json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@dataclass(frozen=True)
class Versions:
    """Everything besides the texts that a result depends on."""

    speech_model: str = "speech"
    speech_version: str = "1"
    contract: str = "1"
    stt_model: str = "transcript"
    stt_version: str = "1"
    language: str = ""
    words: bool = True
    validation: str = "1"
    profile: dict = field(default_factory=lambda: {"tolerance": "MODERATE"})
    export: dict = field(default_factory=lambda: {"format": "flac", "rate": 24_000})
    metadata: str = "1"
    encoder: str = "1"


def voice_key(mode: Column, audio_hash: Column, text: Column, instruction: Column,
              settings: dict) -> Column:
    return content_key("voice-profile-v1", mode, audio_hash, text, instruction,
                       F.lit(canonical_json(settings)))


def attempt_key(content_hash: Column, voice: Column, attempt: Column, seed: Column,
                versions: Versions) -> Column:
    return content_key("generate-v1", content_hash, voice, attempt, seed,
                       *map(F.lit, (versions.speech_model, versions.speech_version,
                                    versions.contract)))


def stt_key(audio_hash: Column, versions: Versions) -> Column:
    return content_key("stt-v1", audio_hash, *map(F.lit, (
        versions.stt_model, versions.stt_version, versions.language,
        str(versions.words).lower())))


def validation_key(audio_hash: Column, text_hash: Column, transcript_hash: Column,
                   versions: Versions) -> Column:
    return content_key("validation-v1", audio_hash, text_hash, transcript_hash,
                       *map(F.lit, (versions.validation, canonical_json(versions.profile))))


def export_key(audio_hashes: Column, boundaries: Column, versions: Versions) -> Column:
    """Of ordered arrays; their elements are joined by commas."""
    return content_key(
        "export-v1", F.array_join(audio_hashes, ","),
        F.array_join(boundaries.cast("array<string>"), ","),
        *map(F.lit, (canonical_json(versions.export), versions.metadata, versions.encoder)))


def key_graph(attempts: DataFrame, versions: Versions) -> DataFrame:
    """(kind, item, key) of all stages of attempts.

    ``attempts``: book_id, chapter_number, ordinal, attempt, chosen, seed, samples, text_hash,
    voice_hash. What a stage will produce is named by its key as long as it is not there.
    """
    made = attempts.withColumn("generate", attempt_key(
        F.col("text_hash"), F.col("voice_hash"), F.col("attempt"), F.col("seed"), versions))
    heard = made.withColumn("stt", stt_key(F.col("generate"), versions))
    judged = heard.withColumn("validation", validation_key(
        F.col("generate"), F.col("text_hash"), F.col("stt"), versions))
    item = F.concat_ws(":", "book_id", "ordinal", "attempt")
    stages = judged.select(item.alias("item"), F.explode(F.create_map(*[
        part for kind in ("generate", "stt", "validation")
        for part in (F.lit(kind), F.col(kind))])).alias("kind", "key"))
    chosen = made.where("chosen").groupBy("book_id", "chapter_number").agg(F.array_sort(
        F.collect_list(F.struct("ordinal", "generate", "samples"))).alias("parts"))
    exports = chosen.select(
        F.concat_ws(":", "book_id", "chapter_number").alias("item"), F.lit("export").alias("kind"),
        export_key(F.transform("parts", lambda part: part["generate"]),
                   F.transform("parts", lambda part: part["samples"]), versions).alias("key"))
    return stages.unionByName(exports)


def stale_keys(now: DataFrame, before: DataFrame) -> DataFrame:
    """The stages to be made anew: their keys are not among those made before."""
    return now.join(before.select("kind", "key"), ["kind", "key"], "left_anti")


def stale_counts(attempts: DataFrame, before: Versions, changes: dict[str, Versions]) -> DataFrame:
    """(changed, kind, stale): how many keys of a kind are new ones under changed versions.

    One pass over the attempts of ``key_graph``: the keys of all versions stand side by side, and
    one is stale if the same item had another before. Keys of other items need not be looked up:
    parts are joined by NUL, which none of them holds, so a key with another version in it is
    nobody's earlier key.
    """
    versions = list(enumerate([before, *changes.values()]))
    made = attempts.withColumns({f"generate{k}": attempt_key(
        F.col("text_hash"), F.col("voice_hash"), F.col("attempt"), F.col("seed"), v)
        for k, v in versions})
    heard = made.withColumns({f"stt{k}": stt_key(F.col(f"generate{k}"), v) for k, v in versions})
    judged = heard.withColumns({f"validation{k}": validation_key(
        F.col(f"generate{k}"), F.col("text_hash"), F.col(f"stt{k}"), v) for k, v in versions})
    numbers, kinds = range(1, len(versions)), ("generate", "stt", "validation")
    part = F.struct("ordinal", "samples", *[f"generate{k}" for k, _ in versions])
    chapters = judged.groupBy("book_id", "chapter_number").agg(
        *[F.count_if(F.col(f"{kind}{k}") != F.col(f"{kind}0")).alias(f"{kind}_{k}")
          for kind in kinds for k in numbers],
        F.array_sort(F.collect_list(F.when(F.col("chosen"), part))).alias("parts"))
    exports = chapters.withColumns({f"export{k}": export_key(
        F.col(f"parts.generate{k}"), F.col("parts.samples"), v) for k, v in versions})
    totals = exports.agg(
        *[F.sum(f"{kind}_{k}").alias(f"{kind}_{k}") for kind in kinds for k in numbers],
        *[F.count_if((F.size("parts") > 0) & (F.col(f"export{k}") != F.col("export0")))
          .alias(f"export_{k}") for k in numbers])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("changed"), F.lit(kind).alias("kind"),
                 F.col(f"{kind}_{k}").alias("stale"))
        for k, name in enumerate(changes, 1) for kind in (*kinds, "export")]))).where("stale > 0")
