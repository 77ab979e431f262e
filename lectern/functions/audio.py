"""Waveform and container columns: geometry, level, clipping, packing, voice checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data contract.
SILENCE_RMS = 1e-5
CLIPPING_RATIO = 0.01
MAX_OUTPUT_SECONDS = 120
MAX_REFERENCE_SECONDS = 15
MAX_REFERENCE_BYTES = 5 * 1024 * 1024
MEDIA_TYPES = {
    "flac": ("audio/flac", "audio/x-flac"),
    "wav": ("audio/wav", "audio/x-wav", "audio/vnd.wave"),
}


def rms(samples: Column) -> Column:
    """Root mean square in double precision."""
    squares = F.aggregate(
        samples, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return F.sqrt(squares / F.size(samples))


def clipping_ratio(samples: Column) -> Column:
    return F.size(F.filter(samples, lambda v: F.abs(v) >= 1.0)) / F.size(samples)


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def sanitize(samples: Column) -> Column:
    """Non-finite samples become 0, the rest is clipped to [-1, 1]."""
    return F.transform(samples, lambda v: F.when(
        finite(v), F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), v)),
    ).otherwise(F.lit(0.0).cast("float")))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda v: F.abs(v)))


def peak_normalized(samples: Column) -> Column:
    """Sanitized samples divided by their peak (a silent wave stays as it is)."""
    clean = sanitize(samples)
    top = peak(clean)
    return F.when(top > 0, F.transform(clean, lambda v: (v / top).cast("float"))
                  ).otherwise(clean)


def quantized(samples: Column) -> Column:
    """Samples as 16-bit integers, rounded half to even."""
    one = F.lit(1.0).cast("float")
    scale = F.lit(32767.0).cast("float")
    return F.transform(samples, lambda v: F.rint(
        F.greatest(-one, F.least(one, v)) * scale).cast("int"))


def quantize_verdict(samples: Column, rate: int) -> Column:
    """Why a wave cannot be stored, or ``ok``."""
    return (
        F.when(F.size(samples) == 0, "empty")
        .when(F.exists(samples, lambda v: ~finite(v)), "not_finite")
        .when(F.size(samples) > rate * MAX_OUTPUT_SECONDS, "too_long")
        .when(rms(samples) < SILENCE_RMS, "silent").otherwise("ok"))


@F.pandas_udf(T.BinaryType())
def pack_pcm(samples: pd.Series) -> pd.Series:
    """Float samples as little-endian signed 16-bit PCM bytes."""
    return samples.map(lambda wave: np.rint(
        np.clip(np.asarray(wave, dtype=np.float32), -1.0, 1.0) * np.float32(32767.0)
    ).astype("<i2").tobytes(), na_action="ignore")


def pcm_verdict(
    pcm: Column, rate: Column, channels: Column, width: Column, declared_sha: Column
) -> Column:
    size = F.octet_length(pcm)
    return (
        F.when(size == 0, "empty")
        .when((channels * width <= 0) | (size % (channels * width) != 0), "partial_frame")
        .when(rate <= 0, "invalid_rate")
        .when(F.lower(declared_sha) != F.sha2(pcm, 256), "hash_mismatch").otherwise("ok"))


def pcm_frames(pcm: Column, channels: Column, width: Column) -> Column:
    return F.floor(F.octet_length(pcm) / (channels * width))


def duration_ms(frames: Column, rate: Column) -> Column:
    """Half-even milliseconds."""
    return F.rint(frames * 1000 / rate).cast("long")


def declared_duration_verdict(
    frames: Column, rate: Column, declared_ms: Column, tolerance_ms: int = 1
) -> Column:
    """Whether a declared duration is that of the samples, to ``tolerance_ms``."""
    return (
        F.when(declared_ms.isNull() | (declared_ms <= 0), "invalid_duration")
        .when(F.abs(duration_ms(frames, rate) - declared_ms) > tolerance_ms, "duration_mismatch")
        .otherwise("ok"))


def container_format(data: Column) -> Column:
    """``flac`` or ``wav`` by magic bytes, else NULL."""
    head = F.substring(data, 1, 4)
    return (
        F.when(head == F.lit(b"fLaC"), "flac")
        .when((F.octet_length(data) >= 12) & (head == F.lit(b"RIFF"))
              & (F.substring(data, 9, 4) == F.lit(b"WAVE")), "wav"))


def media_type_fits(form: Column, declared: Column) -> Column:
    """The declared media type names the container, or is the generic one."""
    named = F.lit(False)
    for name, types in MEDIA_TYPES.items():
        named = named | ((form == name) & declared.isin(*types))
    return (declared == "application/octet-stream") | F.coalesce(named, F.lit(False))


def _unsigned(data: Column, offset: int, size: int, little: bool) -> Column:
    places = range(size, 0, -1) if little else range(1, size + 1)
    digits = F.concat(*[F.hex(F.substring(data, offset + place, 1)) for place in places])
    return F.conv(digits, 16, 10).cast("long")


def header(data: Column) -> Column:
    """STRUCT(format, sample_rate, channels, frames) from canonical WAV or FLAC headers."""
    form = container_format(data)
    channels_wav = _unsigned(data, 22, 2, little=True)
    rate_wav = _unsigned(data, 24, 4, little=True)
    block = _unsigned(data, 32, 2, little=True)
    frames_wav = F.floor(_unsigned(data, 40, 4, little=True) / block)
    # STREAMINFO: 20 bits rate, 3 bits channels - 1, 5 bits depth - 1, 36 bits frames.
    packed = _unsigned(data, 18, 4, little=False)
    rate_flac = F.shiftright(packed, 12)
    channels_flac = F.shiftright(packed, 9).bitwiseAND(F.lit(7)) + 1
    frames_flac = packed.bitwiseAND(F.lit(15)) * (1 << 32) + _unsigned(data, 22, 4, little=False)
    wav = form == "wav"
    return F.struct(
        form.alias("format"),
        F.when(wav, rate_wav).when(form == "flac", rate_flac).alias("sample_rate"),
        F.when(wav, channels_wav).when(form == "flac", channels_flac).alias("channels"),
        F.when(wav, frames_wav).when(form == "flac", frames_flac).alias("frames"))


def voice_verdict(info: Column) -> Column:
    """Policy for reference audio: FLAC or WAV, mono, not empty, at most 15 s."""
    return (
        F.when(info["format"].isNull(), "unsupported_format")
        .when((info["frames"] <= 0) | (info["sample_rate"] <= 0), "empty")
        .when(info["channels"] != 1, "not_mono")
        .when(info["frames"] > info["sample_rate"] * MAX_REFERENCE_SECONDS, "too_long")
        .otherwise("ok"))
