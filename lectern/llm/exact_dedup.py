"""Exact de-duplication by salted, content-checked combining.

Three stages shrink each group of equal texts. Every one of them groups by digest and by
the whole normalised text, so equal digests alone never merge two texts:

1. local: a map task reduces its own copies to one row before anything is shuffled;
2. salted: what a text's map tasks hold meets in ``SALTS`` groups, dealt by task;
3. global: the at most ``SALTS`` winners of a text meet.

The last stage also proves that a digest stands for one text (two would end the job with
an error), so documents can look up their group by digest. Only groups of two or more
are looked up, and large ones are cut into slices of doc_ids, so that a hot text is never
one task's work.

Null texts count as empty; texts without words are equal if both have white space or
neither has. A null doc_id is larger than any number. Rows that repeat doc_id and text
are reported one by one and stay together; ``keep_first`` leaves one of them, the
smallest by its other columns. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import GAP, packed, present
from lectern.llm.lookup import first_of_repeats, with_groups
from lectern.session import reliable_checkpoint

SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(present(text), GAP, " ")


def sha256(text: Column) -> Column:
    return F.coalesce(F.sha2(F.encode(text, "UTF-8"), 256), F.lit(""))


def groups(docs: DataFrame, digest=sha256) -> DataFrame:
    """digest, keep_id and group_size of every text that occurs more than once."""
    local = (
        docs.select("doc_id", normalised(F.col("text")).alias("norm"))
        .withColumns({"digest": digest(F.col("norm")),
                      "salt": F.pmod(F.spark_partition_id(), F.lit(SALTS))}))
    salted = local.groupBy("digest", "salt", "norm").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = salted.repartition("digest").groupBy("digest", "norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    proven = winners.groupBy("digest").agg(
        F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"))
    clash = F.raise_error(F.concat(F.lit("two texts have the digest "), F.col("digest")))
    return proven.where("group_size > 1").select(
        "digest", "keep_id",
        F.when(F.col("texts") == 1, F.col("group_size")).otherwise(clash.cast("long"))
        .alias("group_size"))


def dedup_report(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", digest(normalised(F.col("text"))).alias("digest"))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    found = reliable_checkpoint(groups(docs, digest))
    return with_groups(rows, found, "digest", "group_size", docs.count()).select(
        "doc_id", keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, digest=sha256) -> DataFrame:
    """The documents that stay, with their own columns."""
    rows = docs.select(packed(docs), "doc_id",
                       digest(normalised(F.col("text"))).alias("digest"))
    found = reliable_checkpoint(groups(docs, digest))  # read twice below
    joined = with_groups(rows, found, "digest", "group_size", docs.count())
    stays = F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return first_of_repeats(joined.where(stays), "digest", docs.schema).select("row.*")
