"""Column functions for text: white space, words, normalisation, guards, names, keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data contract.
MAX_EDIT_CHARS = 20_000
MAX_REWRITE_CHARS = 20_000
MAX_REASON_CHARS = 2_000
MAX_FILE_TITLE_CHARS = 120
MAX_FILE_BYTES = 240
SPEECH_MAX_CHARS = 2_000
SPEECH_MAX_WORDS = 120
TRANSCRIBE_MAX_CHARS = 4_000
REWRITE_MAX_CHARS = 8_000
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
LANGUAGE_PATTERN = r"^[A-Za-z][A-Za-z0-9-]*$"


def collapse_space(text: Column) -> Column:
    """Every run of Unicode white space becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    """Words of a text whose white space is already collapsed."""
    spaces = F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(spaces + 1)


# Letters whose capitals are several characters, their capitals of one character (else
# themselves), and private characters that stand for them meanwhile.
LONG_CAPITALS = "".join(c for c in map(chr, range(0x80, 0xFB20)) if len(c.upper()) > 1)
ONE_CAPITAL = "".join(
    "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in LONG_CAPITALS)
STAND_INS = "".join(chr(0xF700 + k) for k in range(len(LONG_CAPITALS)))


def upper_by_letter(text: Column) -> Column:
    """Upper case letter by letter, so that no text changes its length (sharp s becomes U+1E9E)."""
    kept = F.upper(F.translate(text, LONG_CAPITALS, STAND_INS))
    return F.when(text.rlike(f"[{LONG_CAPITALS}]"),
                  F.translate(kept, STAND_INS, ONE_CAPITAL)).otherwise(F.upper(text))


# Characters that NFKC keeps as they are, that do not combine, and whose full
# case fold is their lower case (sharp s apart, handled below): Latin, Cyrillic,
# common quotes and dashes. Greek is left out because of the final sigma. Texts of
# only these never leave the JVM; a test checks the class against the database.
SIMPLE_TEXT = (
    "^[\\u0000-\\u009F\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB"
    "\\u00BF-\\u012F\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E"
    "\\u0400-\\u0482\\u048A-\\u052F"
    "\\u2010\\u2012-\\u2016\\u2018-\\u2023]*$"
)


@F.pandas_udf(T.StringType())
def _nfkc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda text: unicodedata.normalize("NFKC", text).casefold(), na_action="ignore"
    )


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFKC", text), na_action="ignore")


def fold(text: Column) -> Column:
    """NFKC and full case folding.

    Only texts with characters outside the simple class are sent to Python; all
    others arrive there as NULL and cost nothing.
    """
    simple = text.rlike(SIMPLE_TEXT)
    return F.coalesce(
        _nfkc_casefold(F.when(~simple, text)),
        F.replace(F.lower(text), F.lit("ß"), F.lit("ss")),
    )


def comparison_form(text: Column, strip_marks: bool = False) -> Column:
    """Folded letters and numbers, every other run of characters one space."""
    folded = fold(text)
    if strip_marks:
        folded = F.regexp_replace(folded, r"\p{M}+", "")
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def diagnostic_form(text: Column) -> Column:
    """Folded text with collapsed white space; punctuation stays."""
    return collapse_space(fold(text))


def protected_content(text: Column) -> Column:
    """Letters, numbers and symbols in lower case; stress marks and io-dots ignored."""
    kept = F.regexp_replace(text, r"[^\p{L}\p{N}\p{S}]", "")
    # Sigma and dotted I first: the JVM lowers them by context, the rule by character.
    return F.translate(F.lower(F.translate(kept, "Σİ", "σi")), "ё", "е")


def inline_controls(text: Column) -> Column:
    """Bracketed spans in reading order: [..], {..} and <..>."""
    return F.regexp_extract_all(text, F.lit(r"(\[[^\]]*\]|\{[^}]*\}|<[^>]*>)"), F.lit(1))


def preserves_phrase(original: Column, rewritten: Column) -> Column:
    return (protected_content(original) == protected_content(rewritten)) & (
        inline_controls(original) == inline_controls(rewritten)
    )


def rewrite_verdict(original: Column, rewritten: Column, reason: Column) -> Column:
    text, why = F.trim(rewritten), F.trim(reason)
    return (
        F.when(text == "", "empty_text")
        .when(F.char_length(text) > MAX_REWRITE_CHARS, "text_too_long")
        .when(why == "", "empty_reason")
        .when(F.char_length(why) > MAX_REASON_CHARS, "reason_too_long")
        .when(protected_content(original) != protected_content(text), "phrase_changed")
        .when(inline_controls(original) != inline_controls(text), "controls_changed")
        .otherwise("accepted")
    )


def edit_verdict(cleaned: Column) -> Column:
    return (
        F.when(cleaned == "", "empty")
        .when(F.char_length(cleaned) > MAX_EDIT_CHARS, "too_long")
        .otherwise("ok")
    )


def stage_limits(text: Column, words: Column) -> Column:
    """Stages that will refuse a text of this size, in processing order."""
    length = F.char_length(text)
    return F.array_compact(F.array(
        F.when(length > SPEECH_MAX_CHARS, "speech_chars"),
        F.when(words > SPEECH_MAX_WORDS, "speech_words"),
        F.when(length > TRANSCRIBE_MAX_CHARS, "transcribe_chars"),
        F.when(length > REWRITE_MAX_CHARS, "rewrite_chars"),
        F.when(length > MAX_EDIT_CHARS, "edit_chars"),
    ))


@F.pandas_udf(T.StringType())
def _cut_utf8(texts: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([
        None if text is None else text.encode()[:max(limit, 0)].decode("utf-8", "ignore")
        for text, limit in zip(texts, limits)
    ], dtype=object)


def cut_bytes(text: Column, limit: Column) -> Column:
    """Longest prefix of at most ``limit`` UTF-8 bytes that ends between characters."""
    too_long = F.octet_length(text) > limit
    return F.coalesce(_cut_utf8(F.when(too_long, text), limit.cast("int")), text)


def with_file_name(frame: DataFrame, number: str, title: str, name: str) -> DataFrame:
    """Add the safe audio file name of a chapter, at most 240 bytes.

    Done in steps of one column each, as every step uses the one before it twice.
    """
    text = F.col("_name")
    # Plain letters, digits and spaces keep their form and need no Unicode work.
    plain = F.col(title).rlike(r"^[\x00-\x7F]*$")
    prefix = F.format_string("character_%04d_", F.col(number))
    room = F.lit(MAX_FILE_BYTES - len(".flac")) - F.octet_length(prefix)
    steps = [
        F.coalesce(_nfkc(F.when(~plain, F.col(title))), F.col(title)),
        F.regexp_replace(text, r'[\p{Cc}\p{Cf}/\\<>:"|?*]', " "),
        F.btrim(collapse_space(text), F.lit(". ")),
        F.when(F.char_length(text) > MAX_FILE_TITLE_CHARS, F.rtrim(
            F.substring(text, 1, MAX_FILE_TITLE_CHARS), F.lit(". "))).otherwise(text),
        F.when(text == "", F.format_string("Глава %d", F.col(number))).otherwise(text),
        F.rtrim(cut_bytes(text, room), F.lit(". ")),
        F.concat(prefix, F.when(text == "", "Глава").otherwise(text), F.lit(".flac")),
    ]
    for step in steps:
        frame = frame.withColumn("_name", step)
    return frame.withColumnRenamed("_name", name)


def content_key(version: str, *parts: Column) -> Column:
    """SHA-256 over a version label and parts, joined by NUL."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.sha2(F.concat_ws("\u0000", F.lit(version), *texts), 256)


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 of two texts as lower-case hex digits, from built-in functions."""
    raw = F.encode(key, "UTF-8")
    digits = F.rpad(
        F.when(F.octet_length(raw) > 64, F.sha2(raw, 256)).otherwise(F.hex(raw)), 128, "0")

    def padded(byte: int) -> Column:
        """The key's 64 bytes, each combined with ``byte``; seven of them at a time."""
        parts = []
        for start in range(0, 128, 14):
            width = min(14, 128 - start)
            mask = int(f"{byte:02x}" * (width // 2), 16)
            number = F.conv(F.substring(digits, start + 1, width), 16, 10).cast("long")
            parts.append(F.lpad(F.hex(number.bitwiseXOR(F.lit(mask).cast("long"))), width, "0"))
        return F.unhex(F.concat(*parts))

    inner = F.sha2(F.concat(padded(0x36), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(padded(0x5C), F.unhex(inner)), 256)


def retry_seed(job_seed: Column, segment: Column, attempt: Column) -> Column:
    """First 64 bits of HMAC-SHA256(job seed, segment NUL attempt), as DECIMAL(20)."""
    message = F.concat_ws("\0", segment.cast("string"), attempt.cast("string"))
    digest = hmac_sha256(job_seed.cast("string"), message)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def output_contract(payload: Column, fields: dict[str, int]) -> Column:
    """``ok`` for one JSON object of exactly these text fields within their limits.

    ``fields`` maps each field to its greatest length in characters. Nothing may follow
    the object: read as the first of two entries of a list, the second one being a
    digest that no payload can hold, it must leave exactly these two. Blank texts are
    refused, as the next step trims them.
    """
    tail = F.md5(F.encode(payload, "UTF-8"))
    entries = F.from_json(
        F.concat(F.lit("["), payload, F.lit(', "'), tail, F.lit('"]')), "array<string>")
    single = (F.size(entries) == 2) & (F.get(entries, F.lit(1)) == tail)
    names = F.json_object_keys(payload)
    expected = F.array(*[F.lit(name) for name in sorted(fields)])
    shape = F.array_sort(names) == expected
    parsed = F.from_json(payload, ", ".join(f"{name} STRING" for name in fields))
    quoted = F.lit(True)
    for name, limit in fields.items():
        value = parsed[name]
        is_text = payload.rlike(rf'"{name}"\s*:\s*"')
        filled = collapse_space(value) != ""
        quoted = quoted & is_text & filled & (F.char_length(value) <= limit)
    return F.when(F.coalesce(single & shape & quoted, F.lit(False)), "ok").otherwise("OUTPUT_INVALID")
