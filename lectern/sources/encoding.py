"""Decoding of raw text files with an audit of how it was done."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
UTF8_BOM = b"\xef\xbb\xbf"
UTF16_LE_BOM, UTF16_BE_BOM = b"\xff\xfe", b"\xfe\xff"
MAX_REPLACED = 0.01


@F.pandas_udf(T.StringType())
def _decode_as(data: pd.Series, charsets: pd.Series) -> pd.Series:
    def decode(raw, name):
        if raw is None:
            return None
        try:
            codecs.lookup(name)
        except LookupError:
            name = "utf-8"
        return bytes(raw).decode(name, "replace")

    return pd.Series([decode(raw, name) for raw, name in zip(data, charsets)], dtype=object)


def decode_audit(
    files: DataFrame, content: str = "content", declared: str = "charset",
    max_replaced: float = MAX_REPLACED,
) -> DataFrame:
    """Add ``encoding``, ``text``, ``replaced`` (share of U+FFFD) and ``verdict``.

    A byte order mark decides; else strict UTF-8; else the declared charset; else
    UTF-8 with replacement. Only bytes that are not valid UTF-8 leave the JVM.
    """
    data = F.col(content)

    def starts(mark: bytes) -> Column:
        return F.substring(data, 1, len(mark)) == F.lit(mark)

    valid = F.is_valid_utf8(data.cast("string"))
    encoding = (
        F.when(starts(UTF8_BOM), "utf-8-sig")
        .when(starts(UTF16_LE_BOM) | starts(UTF16_BE_BOM), "utf-16")
        .when(valid, "utf-8")
        .when(F.coalesce(F.col(declared), F.lit("")) != "", F.lower(F.col(declared)))
        .otherwise("utf-8-replace"))
    native = F.when(valid & starts(UTF8_BOM), F.substring(data, 4, 2**31 - 1)).when(
        valid, data).cast("string")
    charset = F.when(F.col("encoding") == "utf-8-replace", "utf-8").otherwise(F.col("encoding"))
    named = files.withColumn("encoding", encoding)
    python_only = F.when(native.isNull() | (F.col("encoding") == "utf-16"), data)
    decoded = named.withColumn("text", F.coalesce(_decode_as(python_only, charset), native))
    bad = F.char_length("text") - F.char_length(F.replace("text", F.lit("�"), F.lit("")))
    return decoded.withColumn(
        "replaced", bad / F.greatest(F.char_length("text"), F.lit(1)),
    ).withColumn("verdict", (
        F.when(F.octet_length(data) == 0, "empty")
        .when(F.col("replaced") > max_replaced, "too_many_replacements").otherwise("ok")))
